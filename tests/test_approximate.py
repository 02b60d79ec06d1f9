"""Mergeable states and out-of-fold encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablecraft.functions import sketches
from tablecraft.functions.statistics import union_all
from tablecraft.operators import cleaning, encoding, insights


def table(spark, n=20_000):
    rng = np.random.default_rng(8)
    rows = [(i, float(v) if i % 11 else None, f"v{i % 3000}") for i, v in enumerate(rng.gamma(2, 10, n))]
    return spark.createDataFrame(rows, "id long, x double, s string")


def estimates(found, probabilities=(0.1, 0.5, 0.9)):
    return {r["p"]: r["estimate"] for r in sketches.quantile_estimates(found, probabilities).collect()}, {r["column"]: r["estimate"] for r in sketches.distinct_estimates(found).collect()}


def test_stored_halves_merge_to_the_whole(spark, tmp_path):
    df = table(spark)
    for i in range(2):
        sketches.states(df.where(F.col("id") % 2 == i), ["x"], ["s", "id"]).write.mode("append").parquet(str(tmp_path / "states"))
    merged = sketches.merge(spark.read.parquet(str(tmp_path / "states")))
    counts = {(r["column"], r["kind"]): (r["n"], r["nulls"]) for r in merged.collect()}
    whole = {(r["column"], r["kind"]): (r["n"], r["nulls"]) for r in sketches.states(df, ["x"], ["s", "id"]).collect()}
    assert counts == whole == {("x", "quantiles"): (18181, 1819), ("s", "distinct"): (20000, 0), ("id", "distinct"): (20000, 0)}
    x = np.sort([r.x for r in df.where("x IS NOT NULL").collect()])
    for found in (merged, sketches.states(df, ["x"], ["s", "id"])):
        q, d = estimates(found)
        assert all(abs(np.searchsorted(x, v) / len(x) - p) < 2 * sketches.rank_error() for p, v in q.items()) and set(q.values()) <= set(x)
        assert abs(d["s"] - 3000) <= 3000 * sketches.distinct_error() and abs(d["id"] - 20000) <= 20000 * sketches.distinct_error()


def test_estimates_stay_near_whatever_the_parts(spark):
    df = table(spark, 4000)
    merged = [sketches.merge(union_all([sketches.states(df.where(F.col("id") % n == i), values=["s"]) for i in range(n)])) for n in (2, 5)]
    assert all(abs(estimates(m)[1]["s"] - 3000) <= 3000 * sketches.distinct_error() for m in merged)


def test_empty_and_missing_columns(spark):
    none = spark.createDataFrame([], "x double, s string")
    df = spark.createDataFrame([(float("nan"), None), (None, None)], "x double, s string")
    for rows, nulls in ((none, 0), (df, 2)):
        found = sketches.merge(sketches.states(rows, ["x"], ["s"]))
        assert [(r["n"], r["nulls"], r["state"]) for r in found.collect()] == [(0, nulls, None)] * 2
        assert estimates(found, [0.5]) == ({0.5: None}, {"s": 0})


def test_states_do_not_shuffle_values(spark):
    plan = sketches.states(table(spark, 10), ["x"], ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "partial_kll" in plan and "partial_hll" in plan


def test_approximate_options(spark):
    df = table(spark)
    exact, near = cleaning.median_fills(df, ["x"]), cleaning.median_fills(df, ["x"], approx=True)
    assert abs(exact["x"] - near["x"]) < 0.5 and cleaning.fill_median(df, approx=True).where("x IS NULL").count() == 0
    got = insights.high_cardinality(df, approximate=True).collect()
    assert [(r["column"], abs(r["n_unique"] - 3000) < 100) for r in got] == [("s", True)]


# --- out-of-fold encoding ----------------------------------------------------------------------


def test_a_noise_category_shows_no_correlation(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"c{i % 3000}", float(y)) for i, y in enumerate(rng.normal(0, 1, 6000))]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    leaky = encoding.target_mean(df, ["c"], "y").transform(df).select(F.corr("c_target_enc", "y")).first()[0]
    fair = encoding.target_mean_out_of_fold(df, ["id"], ["c"], "y").transform(df).select(F.corr("c_target_oof", "y")).first()[0]
    assert leaky > 0.5 and abs(fair) < 0.05


def test_a_row_never_sees_its_own_target(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 7)) for i in range(60)]
    schema = "id long, c string, y double"
    before = encoding.target_mean_out_of_fold(spark.createDataFrame(rows, schema), ["id"], ["c"], "y")
    changed = [(i, c, 1e6 if i == 17 else y) for i, c, y in rows]
    after = encoding.target_mean_out_of_fold(spark.createDataFrame(changed, schema), ["id"], ["c"], "y")
    value = lambda f: f.transform(spark.createDataFrame(rows, schema)).where("id = 17").first().c_target_oof
    assert value(before) == value(after)


def test_missing_unseen_and_new_values(spark):
    rows = [(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, "once", 100.0), (5, "b", None), (6, "a", float("nan"))]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    fitted = encoding.target_mean_out_of_fold(df, ["id"], ["c"], "y", folds=3, smoothing=2.0)
    got = {r.id: r.c_target_oof for r in fitted.transform(df).collect()}
    assert len(got) == 6 and got[4] < 100 and all(v is not None for v in got.values())
    new = spark.createDataFrame([(9, "a"), (10, "new"), (11, None)], "id long, c string")
    mean = 109 / 4
    scored = {r.id: r.c_target_oof for r in fitted.info["score"](new).collect()}
    assert scored == {9: (4 + 2 * mean) / 4, 10: mean, 11: mean}
    nothing = df.where("id = 5")
    assert encoding.target_mean_out_of_fold(nothing, ["id"], ["c"], "y").transform(nothing).first().c_target_oof is None


def test_encoding_of_many_values_keeps_rows(spark):
    df = spark.range(3000).selectExpr("id", "concat('k', id % 700) AS c", "CAST(id % 2 AS double) AS y")
    fitted = encoding.target_mean_out_of_fold(df, ["id"], ["c", "c"], "y")
    assert fitted.transform(df).count() == 3000
