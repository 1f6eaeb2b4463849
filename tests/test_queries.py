"""Every panel query that SQL can express, against its DuckDB twin on the small tables."""

import math
import os

import duckdb
import pytest

from tideline.plans.oracles import ORACLES
from tideline.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in os.listdir(small):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{name}')")
    return db


def rows(frame):
    names = sorted(frame.columns)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" else str(v)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, duck, name):
    got, want = rows(QUERIES[name](spark, small).toPandas()), rows(duck.sql(ORACLES[name]).df())
    assert got == want


FITTED = ["adaptive_window_predictions", "benchmark_ridge_predictions", "nested_cv_predictions", "sector_first_predictions", "stable_panel_predictions", "strength_ridge_predictions"]


@pytest.mark.parametrize("name", FITTED)
def test_fitted_queries(spark, small, name):
    """One row an origin month; what is fitted trained on earlier months only and gives a finite estimate."""
    got = QUERIES[name](spark, small).toPandas()
    origins = QUERIES["eligible_origins"](spark, small).toPandas()
    assert sorted(got["month"]) == sorted(origins["month"])
    fitted = got[got["status"] == "fitted"]
    assert (fitted["training_end"] < fitted["month"]).all() and fitted["estimate_mom_pct"].map(math.isfinite).all() and (fitted["n_train"] >= 24).all()
    assert set(got[got["n_train"] < 24]["status"]) == {"short_history"}
    assert name == "stable_panel_predictions" or len(fitted) > 30


def test_attributions_add_up(spark, small):
    groups = QUERIES["attribution_groups"](spark, small).toPandas().groupby("month")["contribution"].sum()
    top = QUERIES["top_k_attribution"](spark, small).toPandas()
    assert len(groups) > 30 and top.groupby("month")["rank"].max().max() <= 6
    assert (top.sort_values(["month", "rank"])["contribution"].abs().groupby(top["month"]).apply(lambda s: s.is_monotonic_decreasing)).all()


@pytest.mark.parametrize("name", ["ridge_predictions", "forest_predictions", "gbt_predictions"])
def test_split_predictions(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    months = set(got["month"])
    assert len(months) == 20 and min(months) >= "2000-01" and got["estimate_mom_pct"].map(math.isfinite).all()
    if name == "gbt_predictions":  # the hybrid lies between its two
        assert set(got["model_key"]) == {"boosting", "hybrid"}


def test_intervals_hold_their_means(spark, small):
    for name in ("block_bootstrap_ci", "promotion_interval"):
        got = QUERIES[name](spark, small).toPandas()
        assert len(got) and ((got["low"] <= got["mean_difference"]) & (got["mean_difference"] <= got["high"])).all()


def test_refits_are_compared_on_common_months(spark, small):
    got = QUERIES["refit_comparison"](spark, small).toPandas()
    assert len(got) > 30 and got["month"].is_unique and got[["old_error", "new_error"]].map(math.isfinite).all().all()


def test_every_query_is_tested():
    held = {*FITTED, "top_k_attribution", "attribution_groups", "ridge_predictions", "forest_predictions", "gbt_predictions", "refit_comparison"}
    held |= {"boosted_origin_predictions", "forest_origin_predictions", "hybrid_origin_predictions", "tree_attribution"}  # test_trees
    held |= {"stress_metrics_ridge"}  # test_saved
    held |= {"candidate_grid_predictions", "gram_sums"}  # test_gram
    assert set(QUERIES) - set(ORACLES) == held
