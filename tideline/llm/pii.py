"""Personal data with DataFrame functions only: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, let, text_rows
from tideline.llm.decontaminate import LOWER, UPPER

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
LEAST_SCORE = 50  # of an added span
BEFORE, AFTER = 48, 24  # code points of context, up to the next proposal of the same pattern
BLOCK = 32
FARTHEST = 2**31 - 1
PROPOSALS = "array<struct<m:string,start:int,end:int,before:string,after:string>>"

# The patterns of the base kinds.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an account number by country (ISO 13616).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 "
    "HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 "
    "SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"
)

# The same languages for a backtracking engine: a run is tried from its start only, and what was taken is not given back, so that no text takes more than linear time.
_RUN = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
EMAIL_LINEAR = _RUN + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_LINEAR = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_LINEAR = r"[0-9](?:[\x20-]?[0-9])++"

# What the method adds. NUMBER takes fused numbers apart: a phone of usual groups, a card in groups, or a whole run of digits.
_SPELT = r"\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]+(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]+)+"
SPELT = r"[A-Za-z0-9._%+-]+" + _SPELT
SPELT_LINEAR = _RUN + _SPELT
NUMBER = (
    r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}"
    r"|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]+"
)
LOCAL = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){2,8}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
WORD_CHAR = r"[A-Za-z0-9]"

# What a text must have for a pattern to match at all: most texts have none of it, and are then read by these alone.
NUMBERS = r"[0-9][0-9\x20().-]{6}"  # seven places, as the shortest address has
NEEDS = {
    EMAIL_LINEAR: lambda t, numbers: t.contains("@"),
    IP_LINEAR: lambda t, numbers: numbers & t.rlike(r"\.[0-9]+\.[0-9]+\.[0-9]"),
    CARD_LINEAR: lambda t, numbers: numbers,
    PHONE: lambda t, numbers: numbers & t.contains("+"),
    SPELT_LINEAR: lambda t, numbers: (t.contains("[") | t.contains("(")) & t.rlike(r"[\[(]\x20?at\x20?[\])]"),
    NUMBER: lambda t, numbers: numbers,
    LOCAL: lambda t, numbers: numbers & t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    IBAN: lambda t, numbers: t.rlike("[A-Z]{2}[0-9]{2}"),
    SSN: lambda t, numbers: numbers & t.rlike("[0-9]-[0-9]{2}-[0-9]"),
}

# Words whose neighbourhood raises or lowers a score, by kind.
FOR = {
    "email": "email|mail|contact|write to|reach|correo|courriel",
    "ip": "ip|address|host|server|client|login|logged|adresse",
    "card": "card|credit|visa|mastercard|amex|payment|paid|cvv|expires|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|telefono|appel|handy",
    "iban": "iban|account|bank|bic|swift|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer|tax id|itin",
}
AGAINST = {
    "email": "example|placeholder|dummy",
    "ip": "version|release|section|chapter|build",
    "card": "order|invoice|tracking|serial|isbn|sku|ticket",
    "phone": "order|invoice|tracking|serial|isbn|sku|part",
    "iban": "sku|serial|isbn",
    "ssn": "part|order|invoice|sku|serial|isbn",
}
RAISE, LOWERED = 30, 30
BASE_SCORE = {"email": 80, "ip": 60, "card": 80, "phone": 70}
SCORE = {"spelt": 60, "phone": 60, "card": 70, "short card": 30, "local": 30, "iban": 80, "ssn": 30}


def running(values: Column, zero: Column, merge) -> Column:
    """For each element the fold of all before it: within blocks, over the blocks' folds, and both together."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, merge)

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)))
        heads = let(blocks, lambda s: F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))))
        inside = lambda h, b: let(F.slice(v, b * BLOCK + 1, BLOCK), lambda w: F.transform(w, lambda _, i: merge(h, fold(F.slice(w, F.lit(1), i)))))
        return F.flatten(F.transform(heads, inside))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def proposals(text: Column, pattern: str, numbers: Column) -> Column:
    """All leftmost matches, in order: m, start, end (code points), and the text between it and its neighbours, cut to the context.

    numbers: whether NUMBERS is in the text, worked out once for all patterns.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(x: Column) -> Column:
        steps = F.transform(x.m, lambda m, i: F.length(m) + F.length(F.get(x.g, i)))

        def at(m: Column, i: Column, before: Column) -> Column:
            start = before + F.length(F.get(x.g, i))
            context = F.right(F.get(x.g, i), F.lit(BEFORE)).alias("before"), F.left(F.get(x.g, i + 1), F.lit(AFTER)).alias("after")
            return F.struct(m.alias("m"), start.alias("start"), (start + F.length(m)).alias("end"), *context)

        return let(running(steps, F.lit(0), lambda a, b: a + b), lambda r: F.transform(x.m, lambda m, i: at(m, i, F.get(r, i))))

    return F.when(NEEDS[pattern](text, numbers), let(found, placed)).otherwise(F.array().cast(PROPOSALS))


def digits(m: Column) -> Column:
    return F.translate(m, "+ ().-", "")


def luhn(m: Column, least: int, most: int) -> Column:
    return F.length(digits(m)).between(least, most) & F.call_function("luhn_check", digits(m))


def whole(x: Column, left: str = WORD_CHAR, right: str = WORD_CHAR) -> Column:
    """No character that goes on is beside the span."""
    return ~F.right(x.before, F.lit(1)).rlike(left) & ~F.left(x.after, F.lit(1)).rlike(right)


def mod97(compact: Column) -> Column:
    """The checksum of an account number: country and check digits last, letters as 10 to 35, modulo 97."""
    values = F.transform(F.split(F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4)), ""), lambda c: (F.instr(F.lit("0123456789" + UPPER), c) - 1).cast("string"))
    return F.aggregate(F.filter(F.split(F.array_join(values, ""), ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def account(x: Column) -> Column:
    """The account number that a proposal begins with, cut to its country's length, as start, end, and whether it holds."""
    pairs = [F.lit(v) for p in IBAN_LENGTHS.split() for v in (p[:2], int(p[2:]))]
    length = F.coalesce(F.element_at(F.create_map(*pairs), F.substring(x.m, 1, 2)), F.lit(99))
    size = F.when(F.instr(x.m, " ") > 0, length + F.ceil(length / 4).cast("int") - 1).otherwise(length)

    def cut(n: Column) -> Column:
        taken = F.left(x.m, n)
        rest = F.concat(F.substr(x.m, n + 1, F.lit(1)), x.after)
        holds = (F.length(taken) == n) & (F.length(F.replace(taken, F.lit(" "), F.lit(""))) == length) & ~F.left(rest, F.lit(1)).rlike(WORD_CHAR) & ~F.right(x.before, F.lit(1)).rlike(WORD_CHAR)
        holds = holds & (mod97(F.replace(taken, F.lit(" "), F.lit(""))) == 1)
        return F.struct(x.m.alias("m"), x.start.alias("start"), (x.start + n).alias("end"), x.before.alias("before"), x.after.alias("after"), F.coalesce(holds, F.lit(False)).alias("holds"))

    return let(size, cut)


def spans_of(found: Column, kind: str, score: Column | int, base: bool = False) -> Column:
    """Spans with their score: the kind's own, raised by words around it, lowered by words before it."""
    score = score if isinstance(score, Column) else F.lit(score)

    def of(x: Column) -> Column:
        word = lambda near, words: F.translate(near, UPPER, LOWER).rlike(f"(^|[^a-z])({words})([^a-z]|$)")
        raised = word(F.concat(x.before, F.lit(" "), x.after), FOR[kind])
        total = score + F.when(raised, RAISE).otherwise(0) - F.when(word(x.before, AGAINST[kind]), LOWERED).otherwise(0)
        total = F.least(F.greatest(total, F.lit(0)), F.lit(100))
        return F.struct(F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), total.alias("score"), F.lit(base).alias("base"))

    return F.transform(found, of)


def base_spans(text: Column, numbers: Column) -> Column:
    """Spans of the four base kinds, by kind and start."""
    octet = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
    kept = {
        "email": proposals(text, EMAIL_LINEAR, numbers),
        "ip": F.filter(proposals(text, IP_LINEAR, numbers), lambda x: F.forall(F.split(x.m, r"\."), lambda p: p.rlike(octet))),
        "card": F.filter(proposals(text, CARD_LINEAR, numbers), lambda x: luhn(x.m, 16, 19)),
        "phone": F.filter(proposals(text, PHONE, numbers), lambda x: F.length(digits(x.m)).between(8, 15)),
    }
    return F.concat(*(spans_of(found, kind, BASE_SCORE[kind], base=True) for kind, found in kept.items()))


def added_spans(text: Column, numbers: Column, least_score: int = LEAST_SCORE) -> Column:
    """Proposals beyond the base kinds whose score reaches the bound."""

    def taken_apart(found: Column) -> Column:
        phone = F.filter(found, lambda x: x.m.startswith("+") & F.length(digits(x.m)).between(8, 15) & whole(x, "[0-9+]", "[0-9]"))
        long = F.filter(found, lambda x: ~x.m.startswith("+") & luhn(x.m, 16, 19) & whole(x))
        short = F.filter(found, lambda x: ~x.m.startswith("+") & luhn(x.m, 13, 15) & whole(x))
        return F.concat(spans_of(phone, "phone", SCORE["phone"]), spans_of(long, "card", SCORE["card"]), spans_of(short, "card", SCORE["short card"]))

    local = F.filter(proposals(text, LOCAL, numbers), lambda x: whole(x, "[A-Za-z0-9+.-]", "[A-Za-z0-9-]"))
    ssn = F.filter(proposals(text, SSN, numbers), lambda x: whole(x, "[A-Za-z0-9-]", "[A-Za-z0-9-]") & ~x.m.rlike("^(000|666|9)") & ~F.substring(x.m, 5, 2).isin("00") & ~x.m.endswith("0000"))
    found = [
        spans_of(proposals(text, SPELT_LINEAR, numbers), "email", SCORE["spelt"]),
        let(proposals(text, NUMBER, numbers), taken_apart),
        spans_of(local, "phone", SCORE["local"]),
        spans_of(F.filter(F.transform(proposals(text, IBAN, numbers), account), lambda x: x.holds), "iban", SCORE["iban"]),
        spans_of(ssn, "ssn", SCORE["ssn"]),
    ]
    return F.filter(F.concat(*found), lambda x: x.score >= least_score)


def without_overlaps(base: Column, added: Column) -> Column:
    """Base spans all stay. An added one goes if it overlaps a base one, or an added one that starts before it, or there and is longer."""
    fields = lambda x: F.struct(x.start.alias("start"), (-x.end).alias("last"), x.ord.alias("ord"), x.kind.alias("kind"), x.end.alias("end"), x.score.alias("score"), x.base.alias("base"))
    most, least = lambda a, b: F.greatest(a, b), lambda a, b: F.least(a, b)

    def kept(x: Column) -> Column:
        ends = let(running(F.transform(x, lambda s: F.when(s.base, s.end).otherwise(0)), F.lit(0), most), lambda r: r)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s.base, s.start).otherwise(FARTHEST))), F.lit(FARTHEST), least))
        others = running(F.transform(x, lambda s: F.when(s.base, 0).otherwise(s.end)), F.lit(0), most)
        free = lambda s, i, e, b, o: s.base | ((F.get(e, i) <= s.start) & (F.get(b, i) >= s.end) & (F.get(o, i) <= s.start))
        return let(F.struct(ends.alias("e"), starts.alias("b"), others.alias("o")), lambda k: F.filter(x, lambda s, i: free(s, i, k.e, k.b, k.o)))

    joined = let(F.array_sort(F.transform(F.concat(base, added), fields)), kept)
    out = F.transform(joined, lambda x: F.struct(x.ord.alias("ord"), x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"), x.score.alias("score"), x.base.alias("base")))
    bare = F.transform(base, lambda x: F.struct(x.ord.alias("ord"), x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"), x.score.alias("score"), x.base.alias("base")))
    return F.when(F.size(added) == 0, bare).otherwise(F.array_sort(out))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: int = LEAST_SCORE) -> DataFrame:
    """One row per document: doc_id and spans, an array of (ord, start, end, kind, score, base) by kind and start.

    Patterns propose spans; cards must pass Luhn, account numbers their country's length and mod 97, addresses and numbers
    their ranges. A score of 0 to 100 follows from the kind, its checksum and words up to 48 code points before and 24
    after. Base spans (email, ip, card, phone as the patterns have them) always stay, whatever their score. Added are,
    from least_score on: phones and cards that stand fused with other numbers or have fewer digits, spelt-out
    addresses, local phone numbers, account numbers and social security numbers; weak ones among these need a word
    beside them. Positions are code points, the end is exclusive.

    Null and empty texts have no spans, repeated rows one result each, an empty table an empty one; other columns are
    not read. There is no shuffle: each text is split by its patterns in its own row, in time linear in its length.
    """
    rows = text_rows(docs, id_col, text_col)
    text = F.col("text")
    both = let(text.rlike(NUMBERS), lambda n: F.struct(base_spans(text, n).alias("base"), added_spans(text, n, least_score).alias("added")))
    return rows.select("doc_id", let(both, lambda x: without_overlaps(x.base, x.added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x.base)
    count = lambda kind: F.size(F.filter("spans", lambda x: x.base & (x.kind == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The DuckDB twin: every match as a row, and plain joins for what overlaps. Its engine needs no rewritten patterns."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "spelt": SPELT, "number": NUMBER, "local": LOCAL, "iban": IBAN, "ssn": SSN}
    found = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS p, regexp_extract_all(t, {quoted(r)}) AS ms, string_split_regex(t, {quoted(r)}) AS gs FROM d WHERE regexp_matches(t, {quoted(r)})" for p, r in patterns.items())
    beside = lambda left, right: f"NOT regexp_matches(right(before, 1), '{left}') AND NOT regexp_matches(left(after, 1), '{right}')"
    near = lambda kind, words, text: f"regexp_matches(translate({text}, '{UPPER}', '{LOWER}'), '(^|[^a-z])({words[kind]})([^a-z]|$)')"
    raised = " ".join(f"WHEN kind = '{k}' AND {near(k, FOR, 'before || chr(32) || after')} THEN {RAISE}" for k in KINDS)
    lowered = " ".join(f"WHEN kind = '{k}' AND {near(k, AGAINST, 'before')} THEN {LOWERED}" for k in KINDS)
    lengths = "MAP {" + ", ".join(f"'{p[:2]}': {p[2:]}" for p in IBAN_LENGTHS.split()) + "}"
    word, dashed = WORD_CHAR, "[A-Za-z0-9-]"
    luhn_ok = "list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN (len(n) - i) % 2 = 1 THEN (2 * CAST(n[i] AS INTEGER)) // 10 + (2 * CAST(n[i] AS INTEGER)) % 10 ELSE CAST(n[i] AS INTEGER) END)) % 10 = 0"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT doc_id, p, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM f),
m AS (SELECT doc_id, p, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS s, right(gs[i], {BEFORE}) AS before, left(gs[i + 1], {AFTER}) AS after,
        regexp_replace(ms[i], '[^0-9]', '', 'g') AS n FROM e),
g AS (SELECT *, s + length(m) AS e FROM m),
iban AS (SELECT * REPLACE (s + size AS e) FROM (SELECT *, {lengths}[m[1:2]] AS want, want + CASE WHEN contains(m, ' ') THEN CAST(ceil(want / 4) AS INTEGER) - 1 ELSE 0 END AS size, replace(m[1:size], ' ', '') AS plain FROM g WHERE p = 'iban')
  WHERE length(m) >= size AND length(plain) = want AND NOT regexp_matches(left(m[size + 1:] || after, 1), '{word}') AND NOT regexp_matches(right(before, 1), '{word}')
    AND list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(plain[5:] || plain[1:4], ''), lambda c: CAST(instr('0123456789{UPPER}', c) - 1 AS VARCHAR)), ''), ''), lambda c: CAST(c AS INTEGER))), lambda a, b: (a * 10 + b) % 97) = 1),
k AS (
  SELECT doc_id, 'email' AS kind, s, e, before, after, {BASE_SCORE["email"]} AS score, TRUE AS base FROM g WHERE p = 'email'
  UNION ALL SELECT doc_id, 'ip', s, e, before, after, {BASE_SCORE["ip"]}, TRUE FROM g WHERE p = 'ip' AND len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INTEGER) > 255)) = 0
  UNION ALL SELECT doc_id, 'card', s, e, before, after, {BASE_SCORE["card"]}, TRUE FROM g WHERE p = 'card' AND len(n) BETWEEN 16 AND 19 AND {luhn_ok}
  UNION ALL SELECT doc_id, 'phone', s, e, before, after, {BASE_SCORE["phone"]}, TRUE FROM g WHERE p = 'phone' AND len(n) BETWEEN 8 AND 15
  UNION ALL SELECT doc_id, 'email', s, e, before, after, {SCORE["spelt"]}, FALSE FROM g WHERE p = 'spelt'
  UNION ALL SELECT doc_id, 'phone', s, e, before, after, {SCORE["phone"]}, FALSE FROM g WHERE p = 'number' AND m LIKE '+%' AND len(n) BETWEEN 8 AND 15 AND {beside("[0-9+]", "[0-9]")}
  UNION ALL SELECT doc_id, 'card', s, e, before, after, CASE WHEN len(n) > 15 THEN {SCORE["card"]} ELSE {SCORE["short card"]} END, FALSE FROM g WHERE p = 'number' AND m NOT LIKE '+%' AND len(n) BETWEEN 13 AND 19 AND {luhn_ok} AND {beside(word, word)}
  UNION ALL SELECT doc_id, 'phone', s, e, before, after, {SCORE["local"]}, FALSE FROM g WHERE p = 'local' AND {beside("[A-Za-z0-9+.-]", dashed)}
  UNION ALL SELECT doc_id, 'iban', s, e, before, after, {SCORE["iban"]}, FALSE FROM iban
  UNION ALL SELECT doc_id, 'ssn', s, e, before, after, {SCORE["ssn"]}, FALSE FROM g WHERE p = 'ssn' AND {beside(dashed, dashed)} AND NOT regexp_matches(m, '^(000|666|9)') AND m[5:6] <> '00' AND m NOT LIKE '%0000'),
scored AS (SELECT doc_id, kind, list_position({KINDS}, kind) AS o, s, e, base, least(100, greatest(0, score + CASE {raised} ELSE 0 END - CASE {lowered} ELSE 0 END)) AS score FROM k),
added AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, -e, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM scored WHERE NOT base AND score >= {LEAST_SCORE}),
spans AS (
  SELECT doc_id, kind, o, s, e, base FROM scored WHERE base
  UNION ALL SELECT doc_id, kind, o, s, e, base FROM added a WHERE reached <= s AND NOT EXISTS (FROM scored b WHERE b.base AND b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in KINDS[:4])},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (base), '')) AS base_sha256, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


SQL = _sql()
