"""Bisected date ranges against plain recursion, and each rule on saved forecasts."""

import datetime as dt
import random

import pytest

from tideline.operators import discovery, quality, saved

DAY = dt.date(2024, 1, 1)


def plain(counts, size, most):
    def split(first, last):
        n = sum(c for d, c in counts.items() if first <= d <= last)
        pages = -(-n // size)
        if not n:
            return []
        if pages <= most or first == last:
            return [(first, last, n, pages, pages > most)]
        middle = first + dt.timedelta(days=(last - first).days // 2)
        return split(first, middle) + split(middle + dt.timedelta(days=1), last)

    return split(min(counts), max(counts)) if counts else []


@pytest.mark.parametrize(("size", "most"), [(20, 25), (2, 3), (1, 1), (5, 1)])
def test_ranges_match_recursion(spark, size, most):
    rng = random.Random(size)
    days = [DAY + dt.timedelta(days=rng.randrange(200)) for _ in range(150)] + [DAY + dt.timedelta(days=77)] * 60
    rows = [(d, f"u{k}") for k, d in enumerate(days)] + [(days[0], "u0")] * 5 + [(None, "lost")]
    df = spark.createDataFrame(rows, "day date, url string")
    counts = {d: days.count(d) for d in set(days)}
    got = sorted(map(tuple, discovery.bisected_ranges(df, size, most).collect()))
    assert got == sorted(plain(counts, size, most))
    assert all(sum(a <= d <= b for a, b, *_ in got) == 1 for d in counts)
    plan = discovery.fetch_plan(discovery.bisected_ranges(df, size, most)).collect()
    assert len(plan) == sum(g[3] for g in got)


def test_few_links(spark):
    none = spark.createDataFrame([], "day date, url string")
    assert discovery.bisected_ranges(none).isEmpty() and discovery.fetch_plan(discovery.bisected_ranges(none)).isEmpty()
    one = spark.createDataFrame([(DAY, f"u{k}") for k in range(9)], "day date, url string")
    assert [tuple(r) for r in discovery.bisected_ranges(one, 2, 4).collect()] == [(DAY, DAY, 9, 5, True)]


def test_each_rule_on_saved_forecasts(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    features = spark.createDataFrame([("2024-03", "p", "S", 1.0), ("2024-04", "p", "S", 2.0)], "month string, product_name string, sector string, value double")
    table = spark.createDataFrame([("v", "m", "p", 0.0, 1.0, 0.5, 0.1, 24), ("w", "m", "p", 0.0, 1.0, 0.5, 0.1, 24)], saved.TABLE)
    hashes = {r.month: r.feature_hash for r in saved.frozen_features(features).collect()}
    art = {r.version: r.artifact_hash for r in quality.artifact_hashes(table).collect()}
    manifest = spark.createDataFrame([("v", "m", "2024-02", at(10), art["v"]), ("w", "m", "2024-03", at(90), art["w"])], "version string, model_key string, training_end string, training_published timestamp_ntz, artifact_hash string")
    make = lambda *rows: spark.createDataFrame(rows, "month string, role string, version string, model_key string, feature_hash string, as_of timestamp_ntz")
    sources = spark.createDataFrame([("2024-03", at(20), at(21)), ("2024-03", at(5), at(40)), ("2024-04", at(20), at(21))], "month string, published_at timestamp_ntz, retrieved_at timestamp_ntz")
    found = lambda f, t=table: sorted(r.violation for r in quality.violations(f, manifest, t, features, sources).collect())
    good = ("2024-03", "champion", "v", "m", hashes["2024-03"], at(50))
    assert found(make(good)) == []
    assert found(make(("2024-03", "champion", "w", "m", hashes["2024-03"], at(50)))) == ["later_target", "overlap"]
    assert found(make(("2024-03", "champion", "v", "m", "other", at(50)))) == ["features"]
    assert found(make(("2024-03", "champion", "v", "m", hashes["2024-03"], at(30)))) == ["source"]
    assert found(make(("2024-03", "champion", "x", "m", hashes["2024-03"], at(50)))) == ["no_model"]
    assert found(make(("2024-05", "champion", "v", "m", None, at(50)))) == ["source"]  # a month without features or sources
    changed = table.selectExpr("version", "model_key", "product_name", "centre", "scale", "weight + 0.01 as weight", "bias", "n_train")
    assert found(make(good), changed) == ["artifact"] and found(make(good), table.limit(0)) == ["artifact"]
