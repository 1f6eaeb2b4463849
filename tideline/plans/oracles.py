"""The DuckDB twin of each registered panel query that SQL can express."""

from __future__ import annotations

from tideline.operators.specs import SPECS
from tideline.plans.queries import CUTOFF, SINCE
from tideline.sources.proxy import EVENT_KINDS, MODELS, VINTAGES

OBS = """
cells AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS release_month, CASE WHEN day(l_shipdate) <= 10 THEN 1 WHEN day(l_shipdate) <= 20 THEN 2 ELSE 3 END AS ord, p_brand AS product_name, snapshot,
         (CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) * CASE snapshot WHEN 'corrected' THEN 102 ELSE 100 END // CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)) / 10000 AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey, (VALUES ('full'), ('early'), ('corrected')) s(snapshot)
  WHERE snapshot = 'full' OR (snapshot = 'early' AND l_linestatus = 'F') OR (snapshot = 'corrected' AND month(l_shipdate) % 4 = 1 AND day(l_shipdate) BETWEEN 11 AND 20) GROUP BY 1, 2, 3, 4),
dated AS (
  SELECT *, CAST(release_month || '-01' AS DATE) AS m0, CAST(split_part(product_name, '#', 2) AS INTEGER) AS num FROM cells),
kept AS (
  SELECT *, CAST(CASE ord WHEN 1 THEN m0 + 9 WHEN 2 THEN m0 + 19 ELSE last_day(m0) END AS DATE) AS ends, CAST(CASE ord WHEN 1 THEN m0 WHEN 2 THEN m0 + 10 ELSE m0 + 20 END AS DATE) AS starts,
         'https://stats.example.org/release/' || release_month || '/' || CAST(ord AS VARCHAR) || '/' || CASE snapshot WHEN 'corrected' THEN 'full' ELSE snapshot END AS source_url
  FROM dated WHERE NOT (num % 8 = 0 AND release_month >= '1998-07') AND NOT (num % 9 = 0 AND release_month < '1997-02') AND NOT (month(m0) = 10 AND year(m0) % 3 = 0 AND ord = 1)),
stamped AS (
  SELECT *, ends + CASE WHEN snapshot = 'corrected' AND month(m0) = 5 THEN 3 WHEN snapshot = 'corrected' THEN 44 ELSE 4 END + INTERVAL '9 hours 30 minutes' AS published_at FROM kept),
obs AS (
  SELECT release_month, ord, product_name, snapshot, price, 'C' || CAST(num % 5 AS VARCHAR) AS category, 'S' || CAST(num % 3 AS VARCHAR) AS sector, num,
         CASE ord WHEN 1 THEN '1-10' WHEN 2 THEN '11-20' ELSE '21-end' END AS "window", ends, starts, published_at,
         published_at + to_hours(CASE snapshot WHEN 'early' THEN 1 WHEN 'corrected' THEN 1200 ELSE 24 + (year(m0) * 31 + month(m0) * 7 + ord * 13) % 72 END) AS retrieved_at,
         source_url, sha256(source_url || CASE snapshot WHEN 'corrected' THEN '#corrected' ELSE '' END) AS content_sha256
  FROM stamped)"""


def avail(cutoff: str | None = CUTOFF, strict: bool = True, name: str = "avail") -> str:
    known = "TRUE" if cutoff is None else f"published_at <= TIMESTAMP '{cutoff}'" + (f" AND retrieved_at <= TIMESTAMP '{cutoff}'" if strict else "")
    return f"""
{name} AS (SELECT * FROM obs WHERE {known} QUALIFY dense_rank() OVER (PARTITION BY release_month, ord ORDER BY published_at DESC, retrieved_at DESC, content_sha256 DESC) = 1)"""


def cells(source: str = "avail", name: str = "lp") -> str:
    pick = ", ".join(f"max(CASE WHEN back = {b} AND ord = {k} THEN v END) AS {'p' if b else 'c'}{k}" for b in (0, 1) for k in (1, 2, 3))
    return f"""
{name}_sent AS (SELECT product_name, category, sector, ord, ln(price) AS v, release_month AS month, 0 AS back FROM {source} WHERE price > 0
  UNION ALL SELECT product_name, category, sector, ord, ln(price), strftime(CAST(release_month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m'), 1 FROM {source} WHERE price > 0),
{name} AS (SELECT product_name, category, sector, month, {pick} FROM {name}_sent GROUP BY ALL HAVING min(back) = 0)"""


def timing(source: str = "lp", name: str = "timing") -> str:
    final = "ln((exp(c1) + exp(c2)) / 2) - ln((exp(p1) + exp(p2)) / 2)"
    parts = {("twentieth", "price"): "c2 - p2", ("final", "price"): final, ("early", "price"): "c1 - p1", ("early_carry", "price"): "c1 - p1", ("early_carry", "carry"): "c1 - p3"}
    return f"\n{name} AS (" + " UNION ALL ".join(f"SELECT product_name, category, sector, month, '{v}' AS variant, '{p}' AS part, 100 * ({e}) AS value FROM {source}" for (v, p), e in parts.items()) + ")"


def prior(month: str, n: int = 1) -> str:
    return f"strftime(CAST({month} || '-01' AS DATE) - INTERVAL {n} MONTH, '%Y-%m')"


def vintages(ord: int, pick: str = "min", back: int = 1, name: str = "") -> str:
    """Cells of each month as its own cutoff knew them: the last published snapshot of each period."""
    months = ", ".join(["c.month", *(prior("c.month", k) for k in range(1, back + 1))])
    cell = lambda k, b: f"max(CASE WHEN o.ord = {k} AND o.release_month = {'month' if not b else prior('month', b)} THEN ln(price) END) AS {'cpq'[b]}{k}"
    picks = ", ".join(cell(k, b) for b in range(back + 1) for k in (1, 2, 3))
    return f"""
cut{name} AS (SELECT release_month AS month, {pick}(published_at) AS cutoff FROM obs WHERE ord = {ord} GROUP BY 1),
snaps{name} AS (SELECT DISTINCT release_month, ord, content_sha256, published_at, retrieved_at FROM obs),
pick{name} AS (SELECT c.month, c.cutoff, s.release_month, s.ord, s.content_sha256 FROM cut{name} c JOIN snaps{name} s ON s.release_month IN ({months}) AND s.published_at <= c.cutoff
  QUALIFY row_number() OVER (PARTITION BY c.month, s.release_month, s.ord ORDER BY s.published_at DESC, s.retrieved_at DESC, s.content_sha256 DESC) = 1),
lpv{name} AS (SELECT product_name, category, sector, month, {picks}, bool_or(o.release_month = month) AS now, bool_or(o.release_month = {prior("month")}) AS was FROM obs o JOIN pick{name} USING (release_month, ord, content_sha256) WHERE price > 0 GROUP BY ALL)"""


ACT = """
act_m AS (SELECT strftime(o_orderdate, '%Y-%m') AS target_month, avg(o_totalprice) AS level FROM orders GROUP BY 1),
act_r AS (SELECT target_month, round(100 * (level / lag(level) OVER (ORDER BY target_month) - 1), 6) AS mom FROM act_m),
act AS (SELECT target_month, version, round(mom * factor, 6) AS actual_mom_pct, CAST(CAST(target_month || '-01' AS DATE) + INTERVAL 1 MONTH AS DATE) + days + INTERVAL '9 hours 30 minutes' AS published_at,
               CAST(CAST(target_month || '-01' AS DATE) + INTERVAL 1 MONTH AS DATE) + days + INTERVAL '33 hours 30 minutes' AS retrieved_at
        FROM act_r, (VALUES (1, 8, 1.0::DOUBLE), (2, 38, 0.8::DOUBLE)) v(version, days, factor) WHERE mom IS NOT NULL)"""

FC = f"""
fc_b AS (SELECT target_month, lag(actual_mom_pct) OVER (ORDER BY target_month) AS before FROM act WHERE version = 1),
fc AS (SELECT target_month, model_key, vintage, round(before * w + b + days / 100.0::DOUBLE, 6) AS estimate_mom_pct, CAST(target_month || '-01' AS DATE) + days + INTERVAL 12 HOURS AS as_of,
              sha256(target_month || '|' || vintage) AS feature_hash, substr(sha256(target_month || '|' || vintage || '|' || model_key), 1, 24) AS forecast_id
       FROM fc_b, (VALUES {", ".join(f"('{m}', {w}::DOUBLE, {b}::DOUBLE)" for m, w, b in MODELS)}) m(model_key, w, b), (VALUES {", ".join(f"('{v}', {d})" for v, d in VINTAGES)}) v(vintage, days) WHERE before IS NOT NULL)"""

FIRST_ACT = """
first_act AS (SELECT target_month, actual_mom_pct, published_at AS actual_published_at FROM act WHERE version = 1)"""

SCORES = """
sc AS (SELECT fc.*, actual_mom_pct, actual_published_at, estimate_mom_pct - actual_mom_pct AS error, CAST(sign(estimate_mom_pct) = sign(actual_mom_pct) AS INTEGER)::DOUBLE AS right_way
       FROM fc JOIN first_act USING (target_month) WHERE as_of < actual_published_at QUALIFY row_number() OVER (PARTITION BY target_month, model_key, vintage ORDER BY as_of DESC, forecast_id DESC) = 1)"""

METRICS = "count(*) AS n, round(avg(abs(error)), 9) + 0.0 AS mae, round(sqrt(avg(error * error)), 9) + 0.0 AS rmse, round(avg(error), 9) + 0.0 AS bias, round(avg(right_way), 9) + 0.0 AS direction"

def matrix(variant: str = "twentieth") -> tuple[str, ...]:
    """vals and mx of a timing, each month at its own cutoff; used: what may be trained on; origins: with what."""
    return (OBS, ACT, FIRST_ACT, vintages(1 if variant.startswith("early") else 2), "\nlpn AS (SELECT * FROM lpv WHERE now)", timing("lpn", "timing_n"), f"""
vals AS (SELECT * FROM timing_n WHERE variant = '{variant}'),
mx AS (SELECT m.month, coalesce(v.n_values, 0) AS n_values, cutoff, actual_mom_pct, actual_published_at,
              CASE WHEN cutoff IS NULL THEN 'no_release' WHEN actual_mom_pct IS NULL THEN 'no_actual' WHEN actual_published_at <= cutoff THEN 'actual_already_public' WHEN coalesce(v.n_values, 0) = 0 THEN 'no_comparable' END AS reason
       FROM (SELECT DISTINCT release_month AS month FROM obs) m LEFT JOIN (SELECT month, count(value) AS n_values FROM vals WHERE part = 'price' GROUP BY 1) v USING (month) LEFT JOIN cut USING (month) LEFT JOIN first_act ON target_month = m.month),
used AS (SELECT * FROM mx WHERE reason IS NULL),
origins AS (SELECT o.month, o.cutoff, t.month AS train_month, t.actual_mom_pct AS y FROM used o JOIN used t ON t.month < o.month AND t.actual_published_at < o.cutoff)""")


EPOCHS = """
per AS (SELECT release_month, ord, min(starts) AS starts, min(ends) AS ends, list(DISTINCT product_name ORDER BY product_name) AS products FROM avail GROUP BY 1, 2),
runs AS (SELECT *, lag(products) OVER (ORDER BY starts) AS before FROM per),
ep AS (SELECT row_number() OVER (ORDER BY starts) AS version, starts AS effective_from, CAST(lead(starts) OVER (ORDER BY starts) - 1 AS DATE) AS effective_to, products, coalesce(before, []) AS before FROM runs WHERE before IS NULL OR before <> products)"""


def q(*parts: str) -> str:
    """A query of common table expressions and a select; a select that begins with a comma brings more of them."""
    *ctes, select = parts
    return "WITH " + ",".join(ctes) + "\n" + select


SNAPSHOT = "SELECT release_month, ord, product_name, snapshot, price FROM avail"
TWENTIETH = "SELECT product_name, category, month, 100 * (exp(c2 - p2) - 1) AS change_pct FROM lp"
NOW = avail(None)
BASE = (OBS, NOW, cells())
TIMED = (*BASE, timing())
SCORED = (ACT, FC, FIRST_ACT, SCORES)
MATRICES = matrix()
SURVEY = """
sv AS (SELECT product_name, category, month, {level} AS change_pct FROM (
  SELECT product_name, category, month, max(CASE WHEN b = 0 AND ord = 1 THEN v END) AS c1, max(CASE WHEN b = 0 AND ord = 2 THEN v END) AS c2, max(CASE WHEN b = 1 AND ord = 1 THEN v END) AS p1, max(CASE WHEN b = 1 AND ord = 2 THEN v END) AS p2,
         max(CASE WHEN b = 1 AND ord = 3 THEN v END) AS p3, max(CASE WHEN b = 2 AND ord = 3 THEN v END) AS q3, bool_or(b = 0) AS now, bool_or(b = 1) AS was
  FROM (SELECT product_name, category, ord, ln(price) AS v, b, strftime(CAST(release_month || '-01' AS DATE) + to_months(b), '%Y-%m') AS month FROM avail, (VALUES (0), (1), (2)) t(b) WHERE price > 0) GROUP BY ALL) WHERE now AND was)"""
LEVEL = "100 * (exp(((0.5 * p3 + 0.5 * c1) + c2) / 2 - ((0.5 * q3 + 0.5 * p1) + p2) / 2) - 1)"
EARLY_LEVEL = "100 * (exp(coalesce(((0.5 * p3 + 0.5 * c1) + c2) / 2, 0.5 * p3 + 0.5 * c1) - coalesce(((0.5 * q3 + 0.5 * p1) + p2) / 2, 0.5 * q3 + 0.5 * p1)) - 1)"
SURVEYED = (*BASE, SURVEY.replace("{level}", LEVEL))
REGISTRY = (ACT, FC, """
stored AS (SELECT * FROM fc WHERE target_month < '1999-01'),
incoming AS (SELECT target_month, vintage, model_key, feature_hash, CASE WHEN target_month = '1998-08' AND model_key = 'boosting' THEN round(estimate_mom_pct + 1, 6) ELSE estimate_mom_pct END AS estimate_mom_pct FROM fc WHERE target_month >= '1998-07')""")
OFFENDING = (*REGISTRY, """
batch AS (
  SELECT * REPLACE (CASE WHEN (target_month, model_key) IN (('1998-09', 'no_change'), ('1999-04', 'sector_first')) THEN NULL WHEN (target_month, model_key) = ('1998-10', 'product_ridge') THEN estimate_mom_pct + 1e-13 ELSE estimate_mom_pct END AS estimate_mom_pct) FROM incoming
  UNION ALL SELECT * FROM incoming WHERE target_month = '1999-03'
  UNION ALL SELECT * REPLACE (round(estimate_mom_pct + 8, 6) AS estimate_mom_pct) FROM incoming WHERE (target_month, model_key) = ('1999-02', 'persistence')),
ranges AS (SELECT target_month, vintage, model_key, min(estimate_mom_pct) AS lowest, max(estimate_mom_pct) AS highest, count(*) - count(estimate_mom_pct) AS nulls FROM batch GROUP BY 1, 2, 3),
faults AS (SELECT * FROM (SELECT r.*, s.estimate_mom_pct AS stored_value, CASE WHEN nulls > 0 THEN 'null' WHEN highest - lowest > 1e-12 THEN 'batch' WHEN s.target_month IS NOT NULL AND coalesce(abs(lowest - s.estimate_mom_pct) > 1e-12, TRUE) THEN 'stored' END AS fault
  FROM ranges r LEFT JOIN stored s USING (target_month, vintage, model_key)) WHERE fault IS NOT NULL)""")
KINDS = "[" + ", ".join(f"'{k}'" for k in EVENT_KINDS) + "]"
JOURNAL = f"""
ja AS (SELECT event_id AS sequence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS as_of, CAST(user_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS cycle_id FROM events),
jb AS (SELECT *, {KINDS}[CAST(k % 8 AS INTEGER) + 1] AS kind, CAST(k AS VARCHAR) AS payload FROM ja),
jc AS (SELECT *, concat_ws('|', sequence, kind, strftime(as_of, '%Y-%m-%d %H:%M:%S'), key, cycle_id, payload) AS content FROM jb),
jg AS (SELECT key, list(sequence ORDER BY sequence) AS seqs, list(content ORDER BY sequence) AS parts FROM jc GROUP BY 1),
ji AS (SELECT key, seqs, list_transform(range(1, len(parts) + 1), lambda n: list_reduce(list_prepend('', parts[1:n]), lambda a, b: sha256(a || '|' || b))) AS ids FROM jg),
je AS (SELECT key, unnest(seqs) AS sequence, unnest(ids) AS event_id, unnest(list_prepend(NULL, ids[1:len(ids) - 1])) AS previous_event, unnest(range(1, len(ids) + 1)) AS step FROM ji),
jn AS (SELECT jb.*, step, previous_event, event_id FROM jb JOIN je USING (key, sequence))"""
OWN = "sha256(coalesce(previous_event, '') || '|' || concat_ws('|', sequence, kind, strftime(as_of, '%Y-%m-%d %H:%M:%S'), key, cycle_id, payload))"
SAVED = f"""
fresh AS (SELECT * FROM sc WHERE target_month >= '{SINCE}'),
saved AS (SELECT model_key, vintage, round(avg(abs(estimate_mom_pct - actual_mom_pct)), 9) AS reference_mae FROM fc JOIN first_act USING (target_month) WHERE target_month < '{SINCE}' GROUP BY 1, 2)"""
PROMOTIONS = """
pp AS (SELECT c.vintage, c.model_key, c.target_month, c.error, b.error AS old FROM {source} c JOIN {source} b ON c.vintage = b.vintage AND c.target_month = b.target_month AND b.model_key = 'sector_first' WHERE c.model_key <> 'sector_first' QUALIFY row_number() OVER (PARTITION BY c.vintage, c.model_key ORDER BY c.target_month) <= 6),
pa AS (SELECT vintage, model_key, count(*) AS n, avg(abs(old)) AS a, avg(abs(error)) AS b, sqrt(avg(old * old)) AS c, sqrt(avg(error * error)) AS d, avg(old) AS e, avg(error) AS f, avg(CAST(abs(error) < abs(old) AS INTEGER)) AS g FROM pp GROUP BY 1, 2 HAVING count(*) >= 6),
pr AS (SELECT *, a - b >= 0.05 * a AS rule_relative_gain, a - b >= 0.02 AS rule_absolute_gain, d <= c AS rule_rmse_ratio, abs(f) - abs(e) <= 0.05 AS rule_bias, g >= 0.5 AS rule_wins FROM pa),
pd AS (SELECT *, rule_relative_gain AND rule_absolute_gain AND rule_rmse_ratio AND rule_bias AND rule_wins AS promoted FROM pr)"""
DRIFT = """
dr AS (SELECT *, row_number() OVER (PARTITION BY model_key, vintage ORDER BY target_month DESC) AS r FROM {source}),
da AS (SELECT model_key, vintage, avg(abs(error)) FILTER (r <= 4) AS recent_mae, avg(error) FILTER (r <= 4) AS recent_bias, count(*) AS outcomes FROM dr GROUP BY 1, 2),
dd AS (SELECT *, concat_ws(',', CASE WHEN outcomes >= 4 AND recent_mae > greatest(1.5 * reference_mae, reference_mae + 0.15) THEN 'error' END, CASE WHEN outcomes >= 4 AND abs(recent_bias) > 0.25 THEN 'bias' END, CASE WHEN outcomes >= 12 THEN 'refresh' END) AS reasons FROM da JOIN saved USING (model_key, vintage))"""
CYCLE = (f"""
held AS (SELECT * FROM fresh WHERE actual_published_at <= TIMESTAMP '{CUTOFF}')""", DRIFT.replace("{source}", "held"), PROMOTIONS.replace("{source}", "held"), """
due AS (SELECT vintage, reasons FROM dd WHERE model_key = 'sector_first' AND reasons <> ''),
trial AS (SELECT vintage, model_key FROM (SELECT vintage, model_key, round(avg(abs(error)), 9) AS mae FROM held WHERE model_key <> 'sector_first' GROUP BY 1, 2) JOIN due USING (vintage) QUALIFY row_number() OVER (PARTITION BY vintage ORDER BY mae, model_key) <= 2),
cycle AS (SELECT vintage, 'trigger' AS event_type, 'sector_first' AS model_key, reasons AS payload FROM due UNION ALL SELECT vintage, 'trial', model_key, '' FROM trial
  UNION ALL SELECT vintage, CASE WHEN promoted THEN 'promotion' ELSE 'rejection' END, model_key, '' FROM pd JOIN trial USING (vintage, model_key))""")


MARGINAL = """
mm AS (SELECT version, product_name, count(*) AS n, avg(value) AS centre, greatest(stddev_pop(value), 1.0) AS scale, covar_pop(value, y) AS cv, var_pop(value) AS vp FROM tr JOIN lng USING (month) WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12),
ml AS (SELECT version, avg(y) AS bias, count(*) AS n_train FROM tr JOIN (SELECT DISTINCT month, y FROM lng) USING (month) GROUP BY 1),
mp AS (SELECT *, count(*) OVER (PARTITION BY version) AS products FROM mm),
coef AS (SELECT version, model_key, product_name, centre, scale, (n * cv / scale) / (n * vp / (scale * scale) + penalty) / products AS weight, bias, n_train FROM mp JOIN ml USING (version) JOIN kinds USING (version))"""
LNG = "lng AS (SELECT month, product_name, sector, value, actual_mom_pct AS y, cutoff, actual_published_at FROM vals JOIN used USING (month))"
TRIAL = (*MATRICES, LNG, f"""
ready AS (SELECT month FROM origins WHERE month >= '{SINCE}' GROUP BY 1 HAVING count(*) >= 24),
kinds AS (SELECT min(month) AS version, 'champion' AS model_key, 100.0::DOUBLE AS penalty FROM ready UNION ALL SELECT min(month), 'challenger', 10.0::DOUBLE FROM ready WHERE month > (SELECT min(month) FROM ready) GROUP BY substr(month, 1, 4)),
tr AS (SELECT DISTINCT version, train_month AS month FROM origins JOIN kinds ON origins.month = version)""", MARGINAL, """
asked AS (SELECT r.month, model_key, max(version) AS version FROM ready r JOIN kinds ON version <= r.month GROUP BY 1, 2),
est AS (SELECT a.month, model_key, version, max(bias) + sum(coalesce((value - centre) / scale, 0) * weight) AS estimate FROM asked a JOIN coef USING (version, model_key) LEFT JOIN lng USING (month, product_name) GROUP BY 1, 2, 3),
hashes AS (SELECT month, sha256(string_agg(product_name || ':' || coalesce(CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY product_name || ':' || coalesce(CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR), '-'))) AS feature_hash FROM lng GROUP BY 1),
made AS (SELECT e.*, feature_hash FROM est e JOIN hashes USING (month) QUALIFY count(*) OVER (PARTITION BY e.month) = 2)""")
DAMAGED = """
forged AS (SELECT month, model_key, version, CASE WHEN substr(month, 6, 2) = '07' THEN estimate + 1e-6 ELSE estimate END AS saved FROM made),
again AS (SELECT a.month, a.model_key, max(bias) + sum(coalesce((value + CASE WHEN substr(month, 6, 2) = '03' AND product_name LIKE '%#11' THEN 1 ELSE 0 END - centre) / scale, 0) * weight) AS again FROM made a JOIN coef USING (version, model_key) LEFT JOIN lng USING (month, product_name)
  WHERE NOT (model_key = 'challenger' AND version LIKE '1999%') GROUP BY 1, 2),
touched AS (SELECT DISTINCT month FROM lng WHERE substr(month, 6, 2) = '03' AND product_name LIKE '%#11' AND value IS NOT NULL),
bad AS (SELECT month, model_key AS role, version, model_key, saved, again, CASE WHEN month IN (FROM touched) THEN 'features' WHEN again IS NULL THEN 'version' WHEN abs(saved - again) > 1e-10 THEN 'estimate' END AS fault FROM forged LEFT JOIN again USING (month, model_key))"""
STRESS = (*MATRICES, LNG, """
fn AS (SELECT month, row_number() OVER (ORDER BY month) AS r, count(*) OVER () AS n FROM used),
fk AS (SELECT *, least(5, greatest(2, n // 6)) AS k, n // (least(5, greatest(2, n // 6)) + 1) AS size FROM fn),
fe AS (SELECT *, unnest(range(1, CAST(k + 1 AS BIGINT))) AS fold FROM fk),
fp AS (SELECT CAST(fold AS VARCHAR) AS version, month, r <= n - (k - fold) * size - size AS train, r > n - (k - fold) * size - size AND r <= n - (k - fold) * size AS test FROM fe),
tr AS (SELECT version, month FROM fp WHERE train),
kinds AS (SELECT DISTINCT version, m.model_key, m.penalty FROM fp, (VALUES ('marginal_10', 10.0::DOUBLE), ('marginal_100', 100.0::DOUBLE), ('marginal_1600', 1600.0::DOUBLE)) m(model_key, penalty))""", MARGINAL, """
sides AS (SELECT t.version, t.month, model_key, max(bias) + sum(coalesce((value - centre) / scale, 0) * weight) AS clean,
    max(bias) + sum(CASE WHEN CAST('0x' || substr(sha256(product_name || '|' || month), 1, 6) AS BIGINT) % 10 = 0 THEN 0 ELSE coalesce((value - centre) / scale, 0) * weight END) AS stressed
  FROM (SELECT * FROM fp WHERE test) t JOIN coef USING (version) LEFT JOIN lng USING (month, product_name) GROUP BY 1, 2, 3),
se AS (SELECT model_key, clean - y AS c, stressed - y AS s, abs(stressed - clean) AS moved FROM sides JOIN (SELECT DISTINCT month, y FROM lng) USING (month))""")


def bootstrap(length: int, draws: int) -> str:
    """From pairs (a, b, target_month, d) to intervals: each draw's months are listed one by one."""
    return f"""
bh AS (SELECT a, b, CAST(round(d * 1000000) AS BIGINT) AS v, row_number() OVER (PARTITION BY a, b ORDER BY target_month) - 1 AS r, count(*) OVER (PARTITION BY a, b) AS n FROM pairs),
bn AS (SELECT a, b, max(n) AS n, sum(v) / count(*) / 1000000 AS mean_difference FROM bh GROUP BY 1, 2),
bd AS (SELECT a, b, n, draw, place, CAST('0x' || substr(md5(concat_ws('|', 7, a, b, draw, place // {length})), 1, 8) AS BIGINT) % n AS start FROM (SELECT *, unnest(range(n)) AS place FROM (SELECT *, unnest(range({draws})) AS draw FROM bn))),
bm AS (SELECT bd.a, bd.b, draw, sum(v) / max(bd.n) / 1000000 AS mean FROM bd JOIN bh ON bh.a = bd.a AND bh.b = bd.b AND bh.r = (start + place % {length}) % bd.n GROUP BY 1, 2, 3),
bounds AS (SELECT a, b, n, round(mean_difference, 9) + 0.0 AS mean_difference, round(quantile_cont(mean, 0.025), 9) + 0.0 AS low, round(quantile_cont(mean, 0.975), 9) + 0.0 AS high FROM bm JOIN bn USING (a, b) GROUP BY 1, 2, 3, mean_difference)"""


def known(policy: str) -> str:
    order = {"first": "published_at, retrieved_at", "last_published": "published_at DESC, retrieved_at DESC", "last_retrieved": "retrieved_at DESC, published_at DESC"}[policy]
    return q(ACT, f"SELECT target_month, actual_mom_pct, published_at FROM act WHERE published_at <= TIMESTAMP '{CUTOFF}' AND retrieved_at <= TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY target_month ORDER BY {order}) = 1")


def timed(variant: str) -> str:
    return q(*TIMED, f"SELECT product_name, month, part, round(value, 6) + 0.0 AS value FROM timing WHERE variant = '{variant}'")


def trained(variant: str) -> str:
    return q(*matrix(variant), "SELECT month, product_name, part, round(value, 6) + 0.0 AS value, actual_mom_pct, cutoff FROM vals JOIN used USING (month, cutoff)".replace("USING (month, cutoff)", "USING (month)"))


def benchmark(vintage: str) -> str:
    level = {"final": LEVEL, "early": EARLY_LEVEL}[vintage]
    return q(OBS, vintages(1 if vintage == "early" else 2, "max", 2), f"""
bs AS (SELECT month, CASE WHEN c AND f AND s THEN 'final' WHEN c AND f THEN 'early' ELSE 'not_ready' END AS state FROM (
  SELECT month, bool_or(ord = 3 AND release_month = {prior("month")}) AS c, bool_or(ord = 1 AND release_month = month) AS f, bool_or(ord = 2 AND release_month = month) AS s FROM pick GROUP BY 1))""", f"SELECT product_name, month, round({level}, 6) + 0.0 AS change_pct, state FROM lpv JOIN bs USING (month) WHERE now AND was")


def summary(source: str, name: str) -> str:
    return f"""
tr_{source} AS (SELECT month, change_pct AS x, row_number() OVER (PARTITION BY month ORDER BY change_pct) AS r, count(*) OVER (PARTITION BY month) AS n FROM {source} WHERE change_pct IS NOT NULL),
sum_{source} AS (SELECT month, round(avg(change_pct), 6) + 0.0 AS {name}_mean, round(median(change_pct), 6) + 0.0 AS {name}_median, round(any_value(trimmed), 6) + 0.0 AS {name}_trimmed, round(stddev_samp(change_pct), 6) + 0.0 AS {name}_sd, count(change_pct) AS {name}_n, round(avg(CAST(change_pct IS NULL AS INTEGER)), 6) + 0.0 AS {name}_missing
  FROM {source} LEFT JOIN (SELECT month, avg(CASE WHEN r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN x END) AS trimmed FROM tr_{source} GROUP BY 1) USING (month) GROUP BY 1)"""


LONG = f"""
lt AS ({TWENTIETH}),
lr AS (SELECT sv.month, sv.product_name, sv.category, sv.change_pct AS s, lt.change_pct AS t FROM sv JOIN lt USING (month, product_name)),
lf AS (SELECT month, 'product__' || product_name AS feature, s AS value FROM lr UNION ALL SELECT month, 'missing__' || product_name, CAST(s IS NULL AS INTEGER) FROM lr
  UNION ALL SELECT month, 'twentieth_product__' || product_name, t FROM lr UNION ALL SELECT month, 'twentieth_missing__' || product_name, CAST(t IS NULL AS INTEGER) FROM lr
  UNION ALL SELECT month, 'category__' || category, avg(s) FROM lr GROUP BY month, category UNION ALL SELECT month, 'twentieth_category__' || category, avg(t) FROM lr GROUP BY month, category
  UNION ALL SELECT month, 'global__' || g, CASE g WHEN 'mean' THEN m WHEN 'median' THEN d WHEN 'sd' THEN sd WHEN 'n' THEN n ELSE q END FROM (SELECT month, avg(s) AS m, median(s) AS d, stddev_samp(s) AS sd, count(s)::DOUBLE AS n, avg(CAST(s IS NULL AS INTEGER)) AS q FROM lr GROUP BY 1), (VALUES ('mean'), ('median'), ('sd'), ('n'), ('missing')) v(g))"""
CANONICAL = """
cn AS (SELECT *, 'p_' || substr(sha256('"' || product || '|' || u || '"'), 1, 16) AS product_id FROM (
  SELECT * REPLACE (product_name || '(A' || CAST(num % 4 AS VARCHAR) || ')' AS product_name), product_name || '(A' || CAST(num % 4 AS VARCHAR) || ')' AS product, 'A' || CAST(num % 4 AS VARCHAR) AS product_specification, product_name AS continuity_group,
         CASE WHEN num = 23 THEN '箱' WHEN num % 3 = 0 THEN '吨' WHEN num % 3 = 1 THEN '千克' ELSE '张' END AS u, CASE WHEN num = 23 THEN NULL WHEN num % 3 = 0 THEN 'CNY/tonne' WHEN num % 3 = 1 THEN 'CNY/kg' ELSE 'CNY/sheet' END AS unit,
         price AS absolute_price, release_month || ':' || CAST(ord AS VARCHAR) AS observation_period, CASE WHEN num = 23 THEN 'unknown_unit' ELSE 'ok' END AS status FROM avail))"""
ODD = "starts_with(content_sha256, '0')"  # what release_pages() makes a challenge page
PAGES = (OBS, """
pc AS (SELECT *, price - lag(price) OVER (PARTITION BY product_name, snapshot ORDER BY release_month, ord) AS change FROM obs),
pp0 AS (SELECT source_url || '#' || substr(content_sha256, 1, 8) AS source_url, content_sha256, ['I. ', 'II. ', 'III. ', 'IV. ', 'V. '][num % 5 + 1] || category AS category, product_name, 't' AS unit, price, CAST(printf('%.4f', change) AS DOUBLE) AS change, round(100 * change / (price - change), 1) + 0.0 AS change_pct FROM pc),
pn AS (SELECT *, starts_with(content_sha256, '0') AS odd, bool_or(change IS NOT NULL) OVER (PARTITION BY source_url) AS any_row FROM pp0),
pg AS (SELECT source_url, category, product_name, unit, price, change, change_pct FROM pn WHERE change IS NOT NULL AND NOT odd UNION ALL SELECT DISTINCT source_url, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM pn WHERE odd OR NOT any_row)""")


def grouped_metrics(keys: str, extra: str = "", source: str = "sc") -> str:
    return f"SELECT {keys}, {METRICS}{extra} FROM {source} GROUP BY {keys}"


ORACLES = {
    "asof_strict": q(OBS, avail(), SNAPSHOT),
    "asof_publication": q(OBS, avail(strict=False), SNAPSHOT),
    "latest_snapshot_per_url": q(OBS, f"""SELECT release_month, ord, source_url, content_sha256, count(*) AS n_rows FROM (
SELECT * FROM obs WHERE retrieved_at <= TIMESTAMP '{CUTOFF}' AND published_at <= TIMESTAMP '{CUTOFF}' QUALIFY dense_rank() OVER (PARTITION BY release_month, ord, source_url ORDER BY retrieved_at DESC, published_at DESC, content_sha256 DESC) = 1) GROUP BY ALL"""),
    "latest_snapshot_per_period": q(OBS, avail(), "SELECT release_month, ord, snapshot, content_sha256, count(*) AS n_rows FROM avail GROUP BY ALL"),
    "vintage_state": q(OBS, avail(), """
SELECT release_month, carry, first, second, CASE WHEN carry AND first AND second THEN 'final' WHEN carry AND first THEN 'early' ELSE 'not_ready' END AS state
FROM (SELECT release_month, bool_or(ord = 0) AS carry, bool_or(ord = 1) AS first, bool_or(ord = 2) AS second
      FROM (SELECT release_month, ord FROM avail UNION ALL SELECT strftime(CAST(release_month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m'), 0 FROM avail WHERE ord = 3) GROUP BY 1)"""),
    "actuals_first": known("first"),
    "actuals_last_published": known("last_published"),
    "actuals_last_retrieved": known("last_retrieved"),
    "forecast_prerelease_latest": q(ACT, FC, FIRST_ACT, "SELECT target_month, model_key, vintage, forecast_id, estimate_mom_pct, actual_mom_pct FROM fc JOIN first_act USING (target_month) WHERE as_of < actual_published_at QUALIFY row_number() OVER (PARTITION BY target_month, model_key ORDER BY as_of DESC, forecast_id DESC) = 1"),
    "latest_saved_forecast": q(ACT, FC, f"SELECT model_key, target_month, vintage, forecast_id, estimate_mom_pct FROM fc WHERE as_of <= TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY as_of DESC, forecast_id DESC) = 1"),
    "log_price_cells": q(*BASE, "SELECT product_name, month, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("p1", "p2", "p3", "c1", "c2", "c3")) + " FROM lp"),
    "survey_change": q(*SURVEYED, "SELECT product_name, month, round(change_pct, 6) + 0.0 AS change_pct FROM sv"),
    "survey_change_early": q(*BASE, SURVEY.replace("{level}", EARLY_LEVEL), "SELECT product_name, month, round(change_pct, 6) + 0.0 AS change_pct FROM sv"),
    "twentieth_change": q(*BASE, f"SELECT product_name, month, round(change_pct, 6) + 0.0 AS change_pct FROM ({TWENTIETH})"),
    "final_two_window_change": timed("final"),
    "early_change": timed("early"),
    "early_carry_change": timed("early_carry"),
    "midpoint_imputation": q(*BASE, "SELECT product_name, month, round(ln((exp(p3) + exp(c2)) / 2), 6) + 0.0 AS c1 FROM lp WHERE c1 IS NULL AND p3 IS NOT NULL AND c2 IS NOT NULL"),
    "global_summary": q(*BASE, f"SELECT month, round(avg(change_pct), 6) + 0.0 AS mean, round(median(change_pct), 6) + 0.0 AS median, round(stddev_samp(change_pct), 6) + 0.0 AS sd, count(change_pct) AS n, round(avg(CAST(change_pct IS NULL AS INTEGER)), 6) + 0.0 AS missing FROM ({TWENTIETH}) GROUP BY 1"),
    "category_summary": q(*BASE, f"SELECT month, category, round(avg(change_pct), 6) + 0.0 AS mean, round(avg(CAST(change_pct IS NULL AS INTEGER)), 6) + 0.0 AS missing, count(*) AS n FROM ({TWENTIETH}) GROUP BY 1, 2"),
    "trimmed_index": q(*BASE, f"""
, tr AS (SELECT month, change_pct AS x, row_number() OVER (PARTITION BY month ORDER BY change_pct) AS r, count(*) OVER (PARTITION BY month) AS n FROM ({TWENTIETH}) WHERE change_pct IS NOT NULL)
SELECT m.month, coalesce(max(n), 0) AS n, round(avg(CASE WHEN r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN x END), 6) + 0.0 AS trimmed FROM (SELECT DISTINCT month FROM lp) m LEFT JOIN tr USING (month) GROUP BY 1""".lstrip("\n")),
    "geometric_tracker": q(*TIMED, "SELECT month, round(100 * (exp(avg(value) / 100) - 1), 6) + 0.0 AS tracker FROM timing WHERE variant = 'twentieth' GROUP BY 1"),
    "sector_means": q(*TIMED, "SELECT month, sector, round(avg(value), 6) + 0.0 AS mean, round(avg(CAST(value IS NULL AS INTEGER)), 6) + 0.0 AS missing, count(*) AS n FROM timing WHERE variant = 'twentieth' GROUP BY 1, 2"),
    "feature_hash": q(OBS, NOW, "SELECT release_month, sha256(string_agg(DISTINCT ord || ':' || content_sha256, '|' ORDER BY ord || ':' || content_sha256)) AS feature_hash FROM avail GROUP BY 1"),
    "product_dim": q(OBS, NOW, """SELECT product_name, max_by(category, starts) AS category, CAST(min(starts) AS VARCHAR) AS first_seen, CAST(max(starts) AS VARCHAR) AS last_seen, count(*) AS n_obs, 'p_' || substr(sha256('"' || product_name || '|unit"'), 1, 16) AS product_id FROM avail GROUP BY product_name"""),
    "basket_epochs": q(OBS, NOW, EPOCHS, """
SELECT version, CAST(effective_from AS VARCHAR) AS effective_from, CAST(effective_to AS VARCHAR) AS effective_to, array_to_string(products, ',') AS products, array_to_string(list_sort(list_filter(products, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(products, x))), ',') AS removed FROM ep"""),
    "basket_at_date": q(OBS, NOW, EPOCHS, "SELECT CAST(d AS VARCHAR) AS held_on, max(version) AS version, count(version) AS matches FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) LEFT JOIN ep ON effective_from <= d AND (effective_to IS NULL OR d <= effective_to) GROUP BY 1"),
    "basket_membership_qa": q(OBS, NOW, EPOCHS, """
SELECT release_month, ord, CAST(len(list_filter(ep.products, lambda x: NOT list_contains(per.products, x))) AS BIGINT) AS n_missing, CAST(len(list_filter(per.products, lambda x: NOT list_contains(ep.products, x))) AS BIGINT) AS n_extra FROM per JOIN ep ON effective_from <= ends AND (effective_to IS NULL OR ends <= effective_to)"""),
    "basket_spans": q(OBS, NOW, EPOCHS, "SELECT product_name, min(version) AS start_basket, max(version) AS end_basket, count(*) AS n_epochs FROM (SELECT version, unnest(products) AS product_name FROM ep) GROUP BY 1"),
    "surrogate_ids": q(OBS, NOW, """SELECT DISTINCT product_name, category, 'p_' || substr(sha256('"' || product_name || '|' || category || '"'), 1, 16) AS product_id FROM avail"""),
    "release_validation": q(OBS, """
c0 AS (SELECT *, price - lag(price) OVER (PARTITION BY product_name, snapshot ORDER BY release_month, ord) AS change FROM obs),
c1 AS (SELECT *, round(100 * change / (price - change), 1) AS reported, CAST(substr(release_month, 6, 2) AS INTEGER) AS moy FROM c0),
c2 AS (SELECT release_month, ord, snapshot, CASE WHEN num = 11 AND moy = 7 THEN '  ' ELSE product_name END AS product_name, CASE WHEN num = 7 AND moy = 6 THEN -price WHEN num = 13 AND moy = 9 THEN NULL ELSE price END AS price,
         CASE WHEN num IN (7, 13) AND moy IN (6, 9) THEN NULL ELSE change END AS change, reported + CASE WHEN num = 3 AND moy = 4 THEN 2 WHEN num = 5 AND moy = 5 THEN 0.5 ELSE 0 END AS reported, num, moy FROM c1),
c3 AS (FROM c2 UNION ALL FROM c2 WHERE num = 12 AND moy = 8),
rp AS (SELECT *, abs(100 * change / nullif(price - change, 0) - reported) AS gap FROM c3),
rv AS (SELECT release_month, ord, snapshot, count(*) AS n_products, count(*) FILTER (price IS NULL) AS not_numeric, count(*) FILTER (price <= 0) AS not_positive, count(*) FILTER (trim(product_name) = '') AS blank, count(*) - count(DISTINCT product_name) AS duplicates, count(*) FILTER (gap > 1.0) AS wrong_change, count(*) FILTER (gap > 0.25 AND gap <= 1.0) AS odd_change FROM rp GROUP BY 1, 2, 3)""",
        "SELECT *, CASE WHEN not_numeric + not_positive + blank + duplicates + wrong_change > 0 THEN 'error' WHEN n_products < 20 OR odd_change > 0 THEN 'warning' ELSE 'ok' END AS status FROM rv"),
    "coverage_gaps": q(OBS, NOW, "SELECT strftime(m, '%Y-%m') AS release_month, ord FROM (SELECT unnest(generate_series((SELECT CAST(min(release_month) || '-01' AS DATE) FROM avail), (SELECT CAST(max(release_month) || '-01' AS DATE) FROM avail), INTERVAL 1 MONTH)) AS m), (VALUES (1), (2), (3)) o(ord) WHERE (strftime(m, '%Y-%m'), ord) NOT IN (SELECT (release_month, ord) FROM avail)"),
    "panel_diagnostics": q(OBS, NOW, """
, g AS (SELECT p.release_month, p.ord, b.product_name, CAST(a.price IS NOT NULL AS INTEGER) AS here FROM (SELECT DISTINCT release_month, ord FROM avail) p CROSS JOIN (SELECT DISTINCT product_name FROM avail) b LEFT JOIN avail a ON a.release_month = p.release_month AND a.ord = p.ord AND a.product_name = b.product_name),
mv AS (SELECT *, abs(here - lag(here) OVER (PARTITION BY product_name ORDER BY release_month, ord)) AS moved FROM g)
SELECT product_name, round(avg(here), 6) + 0.0 AS coverage, CAST(coalesce(sum(moved), 0) AS BIGINT) AS turnover, avg(here) >= 0.9 AS stable FROM mv GROUP BY 1""".lstrip("\n")),
    "training_matrix_long": q(*MATRICES, "SELECT month, product_name, round(value, 6) + 0.0 AS value, actual_mom_pct, cutoff FROM vals JOIN used USING (month)"),
    "training_exclusions": q(*MATRICES, "SELECT month, coalesce(reason, 'used') AS reason, n_values FROM mx"),
    "eligible_origins": q(*MATRICES, "SELECT month, count(*) AS n_train, max(train_month) AS training_end FROM origins GROUP BY 1"),
    "fold_table": q(*MATRICES, """
, fn AS (SELECT month, row_number() OVER (ORDER BY month) AS r, count(*) OVER () AS n FROM used),
fk AS (SELECT *, least(5, greatest(2, n // 6)) AS k, n // (least(5, greatest(2, n // 6)) + 1) AS size FROM fn),
fe AS (SELECT *, CAST(unnest(range(1, CAST(k + 1 AS BIGINT))) AS INTEGER) AS fold FROM fk),
fp AS (SELECT *, CASE WHEN r <= n - (k - fold) * size - size THEN 'train' WHEN r <= n - (k - fold) * size THEN 'test' END AS part FROM fe)
SELECT fold, part, count(*) AS months, min(month) AS first, max(month) AS last FROM fp WHERE part IS NOT NULL GROUP BY 1, 2""".lstrip("\n")),
    "baseline_forecasts": q(*MATRICES, "SELECT u.month, u.actual_mom_pct, CAST(0.0 AS DOUBLE) AS no_change, max_by(y, train_month) AS persistence, round(sum(y), 6) / count(*) AS expanding_mean, count(*) AS history FROM used u JOIN origins o USING (month) GROUP BY 1, 2"),
    "masked_panel": q(*TIMED, "SELECT product_name, month, masked, CASE WHEN NOT masked THEN round(value, 6) + 0.0 END AS value FROM (SELECT *, CAST('0x' || substr(sha256(product_name || '|' || month), 1, 6) AS BIGINT) % 10 = 0 AS masked FROM timing WHERE variant = 'twentieth')"),
    "error_summary": q(*SCORED, grouped_metrics("model_key, vintage")),
    "metric_bundle": q(*SCORED, grouped_metrics("model_key", ", round(median(abs(error)), 9) + 0.0 AS median_ae, round(max(abs(error)), 9) + 0.0 AS max_ae")),
    "rolling_eval_6_12_24": q(*SCORED, """
, rm AS (SELECT *, CAST(substr(target_month, 1, 4) AS INTEGER) * 12 + CAST(substr(target_month, 6, 2) AS INTEGER) - 1 AS m FROM sc),
rl AS (SELECT *, max(m) OVER (PARTITION BY model_key, vintage) AS last FROM rm)
""".lstrip("\n") + grouped_metrics("model_key, vintage, months", source="rl, (VALUES (6), (12), (24), (0)) s(months) WHERE months = 0 OR m > last - months")),
    "regime_metrics": q(*SCORED, "SELECT model_key, regime, " + METRICS + " FROM (SELECT *, CASE WHEN actual_mom_pct >= 0.5 THEN 'rising' WHEN actual_mom_pct <= -0.5 THEN 'falling' ELSE 'stable' END AS regime FROM sc) GROUP BY 1, 2"),
    "paired_losses": q(*SCORED, "SELECT a.model_key AS model_a, b.model_key AS model_b, count(*) AS n, round(avg(abs(a.error) - abs(b.error)), 9) + 0.0 AS mean_difference, round(avg(CAST(abs(a.error) < abs(b.error) AS INTEGER)), 9) + 0.0 AS win_rate FROM sc a JOIN sc b ON a.target_month = b.target_month AND a.model_key < b.model_key WHERE a.vintage = 'final' AND b.vintage = 'final' GROUP BY 1, 2 HAVING count(*) >= 6"),
    "model_range": q(ACT, FC, "SELECT target_month, vintage, round(median(estimate_mom_pct), 6) + 0.0 AS median, round(min(estimate_mom_pct), 6) + 0.0 AS low, round(max(estimate_mom_pct), 6) + 0.0 AS high, count(*) AS n_models FROM fc GROUP BY 1, 2"),
    "panel_gap": q(ACT, FC, "SELECT s.target_month, s.vintage, round(s.estimate_mom_pct, 6) + 0.0 AS a, round(r.estimate_mom_pct, 6) + 0.0 AS b, round(s.estimate_mom_pct - r.estimate_mom_pct, 6) + 0.0 AS gap FROM fc s JOIN fc r USING (target_month, vintage) WHERE s.model_key = 'sector_first' AND r.model_key = 'product_ridge'"),
    "out_of_range_features": q(*TIMED, """
, ov AS (SELECT * FROM timing WHERE variant = 'twentieth' AND value IS NOT NULL),
op AS (SELECT product_name, min(value) AS lo, max(value) AS hi, count(*) AS history FROM ov WHERE month < '1998-01' GROUP BY 1)
SELECT month, count(*) FILTER (value < lo OR value > hi) AS outside, count(*) FILTER (coalesce(history, 0) < 12) AS short_history, count(*) AS n_values FROM ov LEFT JOIN op USING (product_name) WHERE month >= '1998-01' GROUP BY 1""".lstrip("\n")),
    "registry_conflicts": q(*OFFENDING, "SELECT target_month, vintage, model_key, round(lowest, 6) + 0.0 AS lowest, round(highest, 6) + 0.0 AS highest, round(stored_value, 6) + 0.0 AS stored_value, fault FROM faults"),
    "idempotent_append": q(*OFFENDING, """
after AS (SELECT target_month, vintage, model_key, estimate_mom_pct FROM stored UNION ALL
  SELECT target_month, vintage, model_key, lowest FROM ranges r WHERE NOT EXISTS (FROM stored s WHERE (s.target_month, s.vintage, s.model_key) = (r.target_month, r.vintage, r.model_key)) AND NOT EXISTS (FROM faults f WHERE (f.target_month, f.vintage, f.model_key) = (r.target_month, r.vintage, r.model_key)))""",
        "SELECT model_key, vintage, count(*) AS n, round(sum(estimate_mom_pct), 6) + 0.0 AS total FROM after GROUP BY 1, 2"),
    "appended_actuals": q(ACT, "SELECT target_month, count(*) AS n, round(min_by(actual_mom_pct, published_at), 6) + 0.0 AS first, round(max_by(actual_mom_pct, published_at), 6) + 0.0 AS last FROM act GROUP BY 1"),
    "rebuilt_audit": q(*REGISTRY, "SELECT CASE WHEN s.estimate_mom_pct IS NULL THEN 'added' WHEN i.estimate_mom_pct IS NULL THEN 'removed' ELSE 'changed' END AS change, model_key, count(*) AS n FROM stored s FULL JOIN incoming i USING (target_month, vintage, model_key) WHERE s.estimate_mom_pct IS DISTINCT FROM i.estimate_mom_pct GROUP BY 1, 2"),
    "journal_chain_check": q(JOURNAL, f"""
j1 AS (SELECT * REPLACE (CASE WHEN sequence % 89 = 7 THEN sha256(event_id) ELSE previous_event END AS previous_event, CASE WHEN sequence % 83 = 29 THEN payload || '1' ELSE payload END AS payload) FROM jn WHERE sequence % 101 <> 50),
j2 AS (SELECT * REPLACE (CASE WHEN sequence % 89 = 7 OR sequence % 83 = 29 THEN {OWN} ELSE event_id END AS event_id) FROM j1),
jt AS (SELECT *, {OWN} AS own FROM (SELECT * REPLACE (CASE WHEN sequence % 97 = 13 THEN payload || '0' ELSE payload END AS payload) FROM j2)),
jx AS (SELECT a.sequence, a.kind, CASE WHEN a.event_id <> a.own THEN 'changed' WHEN a.previous_event IS DISTINCT FROM b.event_id AND b.event_id IS NULL THEN 'gap' WHEN a.previous_event IS DISTINCT FROM b.event_id THEN 'forged' END AS fault FROM jt a LEFT JOIN jt b ON a.key = b.key AND a.step = b.step + 1)""", "SELECT sequence, fault, kind FROM jx WHERE fault IS NOT NULL"),
    "journal_replay": q(JOURNAL, "SELECT key, max_by(event_id, sequence) FILTER (kind IN ('initialized', 'adopted', 'promoted')) AS champion, max_by(as_of, sequence) FILTER (kind IN ('trial_decided', 'adopted')) AS completed_at, count(*) AS n_events FROM jn GROUP BY 1"),
    "journal_cycles": q(JOURNAL, """
jf AS (SELECT cycle_id, min(sequence) AS since FROM jn WHERE kind = 'trial_requested' GROUP BY 1),
js AS (SELECT jn.*, CASE kind WHEN 'trial_requested' THEN 'requested' WHEN 'challenger_fitted' THEN 'testing' WHEN 'trial_decided' THEN 'decided' WHEN 'trial_cancelled' THEN 'cancelled' WHEN 'promoted' THEN 'promoted' END AS st FROM jn JOIN jf USING (cycle_id) WHERE sequence >= since)""", "SELECT key, cycle_id, max_by(st, sequence) FILTER (st IS NOT NULL) AS status, max(as_of) FILTER (kind = 'trial_requested') AS requested_at, count(*) FILTER (kind = 'refit_failed') AS n_failed FROM js GROUP BY 1, 2"),
    "drift_trigger": q(*SCORED, SAVED, """
counted AS (SELECT *, row_number() OVER (PARTITION BY model_key, vintage ORDER BY target_month DESC) AS k FROM fresh),
since AS (SELECT * FROM counted WHERE k <= CASE model_key WHEN 'persistence' THEN 3 WHEN 'sector_first' THEN 10 WHEN 'product_ridge' THEN 4 ELSE 1000 END)""", DRIFT.replace("{source}", "since"), "SELECT model_key, vintage, round(recent_mae, 9) + 0.0 AS recent_mae, round(recent_bias, 9) + 0.0 AS recent_bias, outcomes, reference_mae, reasons, reasons <> '' AS triggered FROM dd"),
    "drift_diagnosis": q(*TIMED, f"""
ov AS (SELECT * FROM timing WHERE variant = 'twentieth'),
op AS (SELECT product_name, min(value) AS lo, max(value) AS hi, count(value) AS history FROM ov WHERE month < '{SINCE}' AND value IS NOT NULL GROUP BY 1),
oa AS (SELECT month, count(*) FILTER (value < lo OR value > hi) AS outside, count(*) FILTER (coalesce(history, 0) < 12) AS short_history, count(*) AS n_values FROM ov LEFT JOIN op USING (product_name) WHERE month >= '{SINCE}' AND value IS NOT NULL GROUP BY 1)""", f"SELECT oa.*, structural_missing FROM oa JOIN (SELECT month, count(*) FILTER (value IS NULL) AS structural_missing FROM ov WHERE month >= '{SINCE}' GROUP BY 1) USING (month)"),
    "trial_pairs": q(*SCORED, SAVED, "SELECT c.vintage, c.model_key, c.target_month, round(c.error, 6) + 0.0 AS error, round(b.error, 6) + 0.0 AS old_error FROM fresh c JOIN fresh b USING (vintage, target_month, feature_hash) WHERE b.model_key = 'sector_first' AND c.model_key <> 'sector_first'"),
    "late_forecasts": q(ACT, FC, "SELECT fc.target_month, model_key, vintage, forecast_id FROM fc JOIN (SELECT target_month, min(published_at) AS p FROM act GROUP BY 1) USING (target_month) WHERE as_of >= p"),
    "forecast_audit": q(ACT, FC, "SELECT forecast_id, round(estimate_mom_pct + 0.001, 6) AS saved, round(estimate_mom_pct, 6) + 0.0 AS again FROM fc WHERE CAST(substr(target_month, 6, 2) AS INTEGER) % 7 = 0"),
    "promotion_decision": q(*SCORED, SAVED, PROMOTIONS.replace("{source}", "fresh"), """
SELECT vintage, model_key, n, round(a, 9) + 0.0 AS champion_mae, round(b, 9) + 0.0 AS challenger_mae, round(c, 9) + 0.0 AS champion_rmse, round(d, 9) + 0.0 AS challenger_rmse, round(e, 9) + 0.0 AS champion_bias, round(f, 9) + 0.0 AS challenger_bias, round(g, 9) + 0.0 AS win_rate,
       rule_relative_gain, rule_absolute_gain, rule_rmse_ratio, rule_bias, rule_wins, promoted FROM pd"""),
    "composite_bundle": q(*SCORED, SAVED, PROMOTIONS.replace("{source}", "fresh"), "SELECT vintage || '/' || model_key AS key, CASE WHEN promoted THEN 'trial' ELSE 'first' END AS bundle, true AS active FROM saved LEFT JOIN pd USING (vintage, model_key)"),
    "bundle_checks": q(*MATRICES, FC, SCORES, f"""
specs AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{key}', {'TRUE' if 'early' in vintages else 'FALSE'})" for k, (key, _, _, vintages) in enumerate(SPECS))}) s(position, spec, core)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY target_month DESC) AS k FROM sc WHERE vintage = 'final'),
bundles AS (SELECT * FROM (VALUES ('complete', 'final'), ('core', 'early'), ('no_direct', 'final'), ('no_ridge', 'final'), ('short', 'final'), ('broken', 'final'), ('unlabelled', 'final'), ('few_months', 'final'), ('late', 'final')) b(bundle, vintage)),
fit AS (SELECT bundle, b.vintage, spec, core, count(*) AS n, avg(abs(error)) AS mae FROM bundles b JOIN specs ON b.vintage = 'final' OR core
  JOIN ranked ON model_key = ['no_change', 'persistence', 'sector_first', 'product_ridge', 'boosting'][position % 5 + 1] AND (bundle <> 'short' OR k <= 8)
  WHERE NOT (bundle = 'no_direct' AND spec = 'twentieth_to_twentieth_direct') AND NOT (bundle = 'no_ridge' AND spec = 'product_level_ridge') GROUP BY 1, 2, 3, 4),
bundled AS (SELECT bundle, count(*) AS rows, bool_and(bundle <> 'late' OR month <> (SELECT max(month) FROM used)) AS ok FROM bundles, used WHERE bundle <> 'few_months' OR month < '1997-01' GROUP BY 1),
checks AS (SELECT bundle, rows >= 36 AS at_least_36_months, count(*) = CASE vintage WHEN 'final' THEN 7 ELSE 5 END AS expected_models_fitted, count(*) FILTER (core) = 5 AS core_models_fitted,
  vintage <> 'final' OR count(*) FILTER (NOT core) = 2 AS final_benchmarks_fitted, bool_and(n >= 12) AS enough_predictions, bundle <> 'broken' AS all_metrics_finite, ok AS publication_precedes_actual, bundle <> 'unlabelled' AS label_present FROM fit JOIN bundled USING (bundle) GROUP BY bundle, vintage, rows, ok)""",
        "SELECT *, at_least_36_months AND expected_models_fitted AND core_models_fitted AND final_benchmarks_fitted AND enough_predictions AND all_metrics_finite AND publication_precedes_actual AND label_present AS validated FROM checks"),
    "lifecycle_events": q(*SCORED, SAVED, *CYCLE, "SELECT * FROM cycle"),
    "lifecycle_champions": q(*SCORED, SAVED, *CYCLE, "SELECT vintage, coalesce(min(model_key) FILTER (event_type = 'promotion'), 'sector_first') AS champion FROM cycle GROUP BY 1"),
    "training_matrix_final": trained("final"),
    "training_matrix_early": trained("early"),
    "training_matrix_early_carry": trained("early_carry"),
    "training_exclusions_early": q(*matrix("early"), "SELECT month, coalesce(reason, 'used') AS reason, n_values FROM mx"),
    "imputed_early_values": q(OBS, vintages(2), "SELECT month, product_name, round(100 * (coalesce(c1, ln((exp(p3) + exp(c2)) / 2)) - p1), 6) + 0.0 AS value FROM lpv WHERE now AND substr(month, 6, 2) = '10' AND CAST(substr(month, 1, 4) AS INTEGER) % 3 = 0"),
    "feature_rows": q(OBS, vintages(1), f"""
fr AS (SELECT month, part || '__' || product_name AS name, value FROM (SELECT month, product_name, 'price' AS part, 100 * (c1 - p1) AS value FROM lpv WHERE now UNION ALL SELECT month, product_name, 'carry', 100 * (c1 - p3) FROM lpv WHERE now)),
fs AS (SELECT month, count(*) AS n_sources, string_agg(src, ',' ORDER BY src) AS src FROM (SELECT DISTINCT month, release_month || ':' || CAST(ord AS VARCHAR) || ':' || content_sha256 AS src FROM pick WHERE ord = 1 OR (ord = 3 AND release_month <> month)) GROUP BY 1),
fg AS (SELECT month, count(value) AS n_values, coalesce(string_agg(name, ',' ORDER BY name) FILTER (value IS NULL), '') AS missing, string_agg(name, ',' ORDER BY name) AS names FROM fr GROUP BY 1)""", "SELECT month, n_values, missing, n_sources, sha256('log-change-1|early_carry|false|' || names || '|' || src) AS feature_hash FROM fg JOIN fs USING (month)"),
    "feature_vintages": q(*SURVEYED, f"""
tw AS ({TWENTIETH}),
st AS (SELECT release_month AS month, CASE WHEN bool_or(ord = 0) AND bool_or(ord = 1) AND bool_or(ord = 2) THEN 'final' WHEN bool_or(ord = 0) AND bool_or(ord = 1) THEN 'early' ELSE 'not_ready' END AS state
      FROM (SELECT release_month, ord FROM avail UNION ALL SELECT strftime(CAST(release_month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m'), 0 FROM avail WHERE ord = 3) GROUP BY 1),
so AS (SELECT release_month AS month, string_agg(DISTINCT ord || ':' || content_sha256, '|' ORDER BY ord || ':' || content_sha256) AS src FROM avail GROUP BY 1)""", summary("sv", "survey"), summary("tw", "twentieth"), """
SELECT month, CASE WHEN coalesce(survey_n, 0) = 0 THEN 'pending' ELSE state END AS state, sum_sv.* EXCLUDE (month, survey_n), coalesce(survey_n, 0) AS survey_n, sum_tw.* EXCLUDE (month, twentieth_n), coalesce(twentieth_n, 0) AS twentieth_n, sha256('0.5|0.1|' || src) AS feature_hash FROM so JOIN st USING (month) LEFT JOIN sum_sv USING (month) LEFT JOIN sum_tw USING (month)"""),
    "long_features": q(*SURVEYED, LONG, "SELECT month, feature, round(value, 6) + 0.0 AS value FROM lf"),
    "spec_columns": q(*SURVEYED, LONG, "SELECT position, model_key, label, count(DISTINCT feature) AS n_features FROM lf JOIN (VALUES " + ", ".join(f"({k}, '{s[0]}', '{s[1]}', '{p}')" for k, s in enumerate(SPECS) for p in s[2] if "final" in s[3]) + ") s(position, model_key, label, prefix) ON starts_with(feature, prefix) GROUP BY 1, 2, 3"),
    "saved_order_features": q(*SURVEYED, LONG, """
lw AS (SELECT * FROM lf WHERE starts_with(feature, 'twentieth_product__')),
lo AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS position FROM (SELECT DISTINCT feature FROM lw WHERE month < '1999-01'))""", "SELECT m.month, position, lo.feature, round(value, 6) + 0.0 AS value FROM (SELECT DISTINCT month FROM lw WHERE month >= '1999-01') m CROSS JOIN lo LEFT JOIN lw ON lw.month = m.month AND lw.feature = lo.feature"),
    "benchmark_values_early": benchmark("early"),
    "benchmark_values_final": benchmark("final"),
    "canonical_panel": q(OBS, NOW, CANONICAL, "SELECT product_id, product_name, product_specification, continuity_group, unit, category, absolute_price, observation_period, CAST(starts AS VARCHAR) AS period_start, CAST(ends AS VARCHAR) AS period_end, CAST(CAST(starts + CAST(floor((ends - starts) / 2) AS INTEGER) AS DATE) AS VARCHAR) AS period_midpoint, status FROM cn"),
    "canonical_release_qa": q(OBS, NOW, CANONICAL, "SELECT observation_period, content_sha256, count(*) AS n_rows, count(DISTINCT product_id) AS n_products, count(*) FILTER (status <> 'ok') AS n_bad, count(*) = 25 AND count(DISTINCT product_id) = 25 AND count(*) FILTER (status <> 'ok') = 0 AS passed FROM cn GROUP BY 1, 2"),
    "newest_training_months": q(*MATRICES, "SELECT month, count(*) AS n_train, min(train_month) AS training_start FROM (SELECT * FROM origins QUALIFY row_number() OVER (PARTITION BY month ORDER BY train_month DESC) <= 24) GROUP BY 1"),
    "historical_baselines": q(ACT, FIRST_ACT, """
hb AS (SELECT target_month, actual_mom_pct, row_number() OVER (ORDER BY target_month) AS r, lag(actual_mom_pct) OVER (ORDER BY target_month) AS persistence, round(sum(actual_mom_pct) OVER w, 6) / count(*) OVER w AS expanding_mean FROM first_act WINDOW w AS (ORDER BY target_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "SELECT target_month, actual_mom_pct, CAST(0.0 AS DOUBLE) AS no_change, persistence, expanding_mean FROM hb WHERE r > 12"),
    "html_price_extract": q(*PAGES, "SELECT source_url, category, product_name, unit, price, change, change_pct FROM pg"),
    "ingested_pages": q(OBS, """
sn AS (SELECT DISTINCT source_url || '#' || substr(content_sha256, 1, 8) AS source_url, content_sha256, release_month, "window", published_at FROM obs)""", f"""SELECT source_url, CASE WHEN NOT {ODD} THEN release_month END AS release_month, CASE WHEN NOT {ODD} THEN "window" END AS "window", CASE WHEN NOT {ODD} THEN published_at END AS published_at, CASE WHEN {ODD} THEN 'challenge' ELSE 'stored' END AS outcome FROM sn WHERE {ODD} OR release_month >= '1998'"""),
    "release_links": q(OBS, """
sn AS (SELECT DISTINCT source_url || '#' || substr(content_sha256, 1, 8) AS url, release_month AS month, 'Market prices ' || release_month || ' (' || "window" || ')' AS title FROM obs)""", "SELECT url, title, 'ten_day' AS kind, month FROM sn WHERE month BETWEEN '1996-03' AND '1999-02'"),
    "release_titles": q(OBS, """SELECT DISTINCT 'Prices of goods, ' || substr(release_month, 1, 4) || '–' || CAST(CAST(substr(release_month, 6, 2) AS INTEGER) AS VARCHAR) || ' (' || replace("window", '-', '—') || ')' AS title, release_month AS month, "window" AS "window" FROM obs"""),
    "headline_changes": q(ACT, "SELECT target_month, version, CASE WHEN actual_mom_pct = 0 THEN 0.0 ELSE sign(actual_mom_pct) * CAST(printf('%.2f', abs(actual_mom_pct)) AS DOUBLE) END AS headline FROM act"),
    "page_hosts": "SELECT page_id, coalesce(regexp_extract(url, '^https?://([^/?#:]+)', 1) = 'blog.thths.example.com' AND regexp_matches(url, '^https?://[^/?#]+/'), false) AS allowed, false AS challenge FROM pages",
    "status_counts": q(OBS, ACT, FC, "SELECT 'observations' AS kind, count(*) AS n, max(release_month) AS last FROM obs UNION ALL SELECT 'actuals', count(*), max(target_month) FROM act UNION ALL SELECT 'forecasts', count(*), max(target_month) FROM fc"),
    "direct_tracker_predictions": q(*MATRICES, "SELECT month, round(100 * (exp(avg(value) / 100) - 1), 6) + 0.0 AS estimate_mom_pct, n_train, training_end FROM vals JOIN used USING (month) JOIN (SELECT month, count(*) AS n_train, max(train_month) AS training_end FROM origins GROUP BY 1 HAVING count(*) >= 24) USING (month) GROUP BY 1, 3, 4"),
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS value FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS GROUP BY 1, 2",
    "block_bootstrap_ci": q(*SCORED, """
pairs AS (SELECT x.model_key AS a, y.model_key AS b, x.target_month, abs(x.error) - abs(y.error) AS d FROM sc x JOIN sc y ON x.target_month = y.target_month AND x.model_key < y.model_key WHERE x.vintage = 'final' AND y.vintage = 'final')""",
        bootstrap(3, 1000), "SELECT a AS model_a, b AS model_b, n, mean_difference, low, high FROM bounds"),
    "promotion_interval": q(*SCORED, SAVED, PROMOTIONS.replace("{source}", "fresh"), "pairs AS (SELECT model_key AS a, vintage AS b, target_month, abs(error) - abs(old) AS d FROM pp)",
        bootstrap(2, 2000), "SELECT a AS model_key, b AS vintage, n, mean_difference, low, high FROM bounds"),
    "saved_coefficients": q(*TRIAL, "SELECT version, model_key, product_name, round(centre, 6) + 0.0 AS centre, round(scale, 6) + 0.0 AS scale, round(weight, 6) + 0.0 AS weight, round(bias, 6) + 0.0 AS bias, n_train FROM coef"),
    "matched_forecasts": q(*TRIAL, "SELECT month, feature_hash, model_key AS role, version, model_key, round(estimate, 6) + 0.0 AS estimate, TRUE AS groups_agree FROM made"),
    "reprediction_faults": q(*TRIAL, DAMAGED, "SELECT month, role, version, model_key, round(saved, 6) + 0.0 AS saved, round(again, 6) + 0.0 AS again, fault FROM bad WHERE fault IS NOT NULL"),
    "trial_scores": q(*TRIAL, DAMAGED, """
ok AS (SELECT month, max(saved) FILTER (model_key = 'champion') AS a, max(saved) FILTER (model_key = 'challenger') AS b, max(version) FILTER (model_key = 'challenger') AS version FROM forged WHERE month NOT IN (SELECT month FROM bad WHERE fault IS NOT NULL) GROUP BY 1)""",
        "SELECT month, version, round(a - actual_mom_pct, 6) + 0.0 AS champion_error, round(b - actual_mom_pct, 6) + 0.0 AS challenger_error, abs(b - actual_mom_pct) < abs(a - actual_mom_pct) AS won FROM ok JOIN used USING (month) WHERE cutoff < actual_published_at"),
    "stress_metrics": q(*STRESS, "SELECT model_key, count(*) AS n, round(avg(abs(c)), 6) + 0.0 AS clean_mae, round(sqrt(avg(c * c)), 6) + 0.0 AS clean_rmse, round(avg(c), 6) + 0.0 AS clean_bias, round(avg(abs(s)), 6) + 0.0 AS stressed_mae, round(sqrt(avg(s * s)), 6) + 0.0 AS stressed_rmse, round(avg(s), 6) + 0.0 AS stressed_bias, round(avg(moved), 6) + 0.0 AS mean_change, count(*) FILTER (moved > 1e-9) AS n_moved FROM se GROUP BY 1"),
    "lifecycle_stream": f"""
WITH RECURSIVE ev AS (SELECT event_id AS sequence, CAST(user_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) || '-' || CAST(dayofyear(ts) // 7 AS VARCHAR) AS cycle,
    CASE WHEN event_id % 29 = 6 THEN 'renamed' ELSE {KINDS}[CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS INTEGER) + 1] END AS kind, CASE WHEN event_id % 23 = 4 THEN ts - INTERVAL 5 DAY ELSE ts END AS tm FROM events),
line AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence) AS step FROM ev),
r AS (
  SELECT key, CAST(0 AS BIGINT) AS step, TIMESTAMP '0001-01-01' AS seen, CAST(MAP {{}} AS MAP(VARCHAR, INTEGER)) AS open, CAST(NULL AS BIGINT) AS sequence, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT key FROM line)
  UNION ALL
  SELECT key, step, CASE WHEN outcome = 'accepted' THEN tm ELSE seen END,
    CASE WHEN outcome <> 'accepted' OR kind IN ('initialized', 'adopted', 'trial_decided') OR (kind = 'trial_requested' AND map_contains(open, cycle)) THEN open WHEN kind = 'trial_requested' THEN map_concat(open, MAP {{cycle: 0}})
         WHEN kind IN ('refit_failed', 'challenger_fitted') THEN map_concat(open, MAP {{cycle: refits + 1}}) ELSE CAST(map_from_entries(list_filter(map_entries(open), lambda x: x.key <> cycle)) AS MAP(VARCHAR, INTEGER)) END, sequence, kind, outcome
  FROM (SELECT e.key, e.step, e.tm, e.cycle, e.sequence, e.kind, r.seen, r.open, coalesce(r.open[e.cycle], 0) AS refits,
      CASE WHEN e.kind = 'renamed' THEN 'unknown' WHEN e.tm < r.seen THEN 'late' WHEN e.kind NOT IN ('initialized', 'adopted', 'trial_requested') AND NOT map_contains(r.open, e.cycle) THEN 'no_cycle'
           WHEN e.kind IN ('refit_failed', 'challenger_fitted') AND r.open[e.cycle] >= 2 THEN 'too_many_refits' ELSE 'accepted' END AS outcome
    FROM r JOIN line e ON e.key = r.key AND e.step = r.step + 1))
SELECT sequence, key, kind, outcome FROM r WHERE step > 0""",
    "landed_pages": q(OBS, f"""
lc AS (SELECT *, price - lag(price) OVER (PARTITION BY product_name, snapshot ORDER BY release_month, ord) AS change FROM obs),
lp AS (SELECT source_url || '#' || substr(content_sha256, 1, 8) AS source_url, content_sha256, release_month, "window", {ODD} AS odd, count(change) AS n_prices FROM lc GROUP BY 1, 2, 3, 4, 5)""", """
SELECT source_url, release_month, "window", 'stored' AS outcome, n_prices FROM lp WHERE NOT odd UNION ALL SELECT source_url, NULL, NULL, 'challenge', 0 FROM lp WHERE odd
UNION ALL SELECT DISTINCT coalesce(url, 'none'), NULL, NULL, 'no_release_in_title', 0 FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT DISTINCT NULL, NULL, NULL, 'no_address', 0 FROM pages WHERE page_id % 5 = 0"""),
}
ORACLES["published_bundle"] = f"SELECT key, bundle, 'trial' AS active_bundle FROM ({ORACLES['composite_bundle']})"
MICRO = "product_name || ':' || " + " || ':' || ".join(f"CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)" for c in ("centre", "scale", "{weight}", "bias"))
ORACLES["quality_violations"] = q(*TRIAL, f"""
man AS (SELECT version, model_key, max(train_month) AS training_end, max(u.actual_published_at) AS training_published FROM origins o JOIN kinds ON o.month = version JOIN used u ON u.month = train_month GROUP BY 1, 2),
art AS (SELECT version, model_key, string_agg(a, ',' ORDER BY a) AS saved, string_agg(b, ',' ORDER BY b) AS now FROM (SELECT version, model_key, {MICRO.replace("{weight}", "weight")} AS a, {MICRO.replace("{weight}", "(weight + CASE WHEN version LIKE '1999%' THEN 0.001 ELSE 0 END)")} AS b FROM coef) GROUP BY 1, 2),
asked2 AS (SELECT month, model_key AS role, model_key, CASE WHEN substr(month, 6, 2) = '06' AND model_key = 'challenger' THEN '2001-01' WHEN substr(month, 6, 2) = '09' THEN 'none' ELSE version END AS version, cutoff + INTERVAL 3 DAY AS as_of FROM made JOIN used USING (month)),
src AS (SELECT month, max(greatest(published_at, retrieved_at)) AS last_source FROM pick JOIN (SELECT DISTINCT release_month, ord, content_sha256, published_at, retrieved_at FROM obs) USING (release_month, ord, content_sha256) WHERE ord = 2 GROUP BY 1),
touched AS (SELECT DISTINCT month FROM lng WHERE substr(month, 6, 2) = '03' AND product_name LIKE '%#11' AND value IS NOT NULL),
full_ AS (SELECT f.*, man.training_end, man.training_published, art.saved, art.now, last_source, f.month IN (FROM touched) AS changed FROM asked2 f LEFT JOIN man USING (version, model_key) LEFT JOIN art USING (version, model_key) LEFT JOIN src ON src.month = f.month)""", """
SELECT month, role, version, 'no_model' AS violation FROM full_ WHERE saved IS NULL UNION ALL SELECT month, role, version, 'overlap' FROM full_ WHERE training_end >= month UNION ALL SELECT month, role, version, 'later_target' FROM full_ WHERE training_published > as_of
UNION ALL SELECT month, role, version, 'features' FROM full_ WHERE changed UNION ALL SELECT month, role, version, 'artifact' FROM full_ WHERE saved <> now UNION ALL SELECT month, role, version, 'source' FROM full_ WHERE last_source > as_of""")
ORACLES["reparsed_actuals"] = f"""
WITH h AS ({ORACLES["headline_changes"]}),
w AS (SELECT target_month, version, CASE WHEN CAST(substr(target_month, 6, 2) AS INTEGER) % 5 = 0 THEN -headline ELSE headline END AS was FROM h WHERE substr(target_month, 6, 2) <> '11'),
n AS (SELECT target_month, version, headline AS now FROM h WHERE NOT (substr(target_month, 6, 2) = '02' AND version = 2))
SELECT target_month, version, round(was, 6) + 0.0 AS was, round(now, 6) + 0.0 AS now, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change FROM w FULL JOIN n USING (target_month, version) WHERE was IS DISTINCT FROM now"""
DISCOVERY = "WITH RECURSIVE" + OBS + """,
links AS (SELECT DISTINCT CAST(published_at AS DATE) AS day, source_url AS url FROM obs UNION ALL SELECT DATE '1999-09-09', coalesce(url, '') || '#' || CAST(page_id AS VARCHAR) FROM pages),
days AS (SELECT day, count(DISTINCT url) AS n FROM links GROUP BY 1),
tree AS (
  SELECT min(day) AS s, max(day) AS e, CAST(sum(n) AS BIGINT) AS total FROM days
  UNION ALL SELECT h.s, h.e, CAST((SELECT coalesce(sum(n), 0) FROM days WHERE day BETWEEN h.s AND h.e) AS BIGINT) FROM (
    SELECT unnest([s, CAST(s + CAST((e - s) // 2 AS INTEGER) + 1 AS DATE)]) AS s, unnest([CAST(s + CAST((e - s) // 2 AS INTEGER) AS DATE), e]) AS e FROM tree WHERE total > 20 AND s < e) h),
ranges AS (SELECT s, e, total, CAST(ceil(total / 5) AS BIGINT) AS n_pages FROM tree WHERE total > 0 AND (total <= 20 OR s = e))
"""
ORACLES["bisected_discovery"] = DISCOVERY + 'SELECT CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", total AS n_links, n_pages, n_pages > 4 AS alone FROM ranges'
ORACLES["discovered_once"] = DISCOVERY + "SELECT CAST(1 AS BIGINT) AS ranges, (SELECT count(*) FROM (SELECT DISTINCT day, url FROM links)) AS n_links, (SELECT CAST(sum(n_pages) AS BIGINT) FROM ranges) AS n_pages"
ORACLES["page_links"] = q(OBS, ACT, """
l AS (SELECT url, min(title) AS title FROM (SELECT regexp_extract(a, 'href="([^"]+)"', 1) AS url, trim(regexp_extract(a, '>([^<]*)$', 1)) AS title FROM (SELECT unnest(regexp_extract_all(html, '<a[^>]*href="[^"]+"[^>]*>[^<]*')) AS a FROM pages)) GROUP BY 1),
every_ AS (SELECT url, 'other' AS kind FROM l UNION SELECT source_url || '#' || substr(content_sha256, 1, 8), 'ten_day' FROM obs UNION SELECT target_month || '/' || CAST(version AS VARCHAR), 'ppi' FROM act)""",
    "SELECT kind, count(*) AS n FROM every_ GROUP BY 1")
ORACLES["scalar_texts"] = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, event_id % 5 = 0 AS is_month, strftime(ts, '%B %Y') AS month_name, strftime(ts + INTERVAL 8 HOUR, '%Y-%m') AS publisher_month,
  CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 THEN value END AS number FROM e"""
SAVED_ROWS = "SELECT target_month, vintage, model_key, CASE WHEN NOT (model_key = 'boosting' AND CAST(substr(target_month, 6, 2) AS INTEGER) % 2 = 0) THEN round(estimate_mom_pct, 6) + 0.0 END AS estimate_mom_pct FROM fc"
ORACLES["csv_roundtrip"] = ORACLES["forecast_tree"] = q(ACT, FC, SAVED_ROWS)
ORACLES["write_once_batches"] = q(ACT, FC, """
n AS (SELECT count(*) FILTER (target_month < '1998-01') AS a, count(*) FILTER (target_month BETWEEN '1998-01' AND '1999-12') AS b, count(*) FILTER (target_month <= '1999-12') AS n_stored, round(sum(estimate_mom_pct) FILTER (target_month <= '1999-12'), 6) + 0.0 AS total FROM fc)""",
    "SELECT unnest([0, 1, 2, 3]) AS batch, unnest([a, b, 0, 0]) AS n_new, n_stored, total FROM n")
ORACLES["stored_vintages"] = q(*MATRICES, LNG, "SELECT month, count(*) AS n, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT) AS total, TRUE AS written, FALSE AS again FROM lng GROUP BY 1")
