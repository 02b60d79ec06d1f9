"""Edge cases and invariants that the reference SQL does not reach."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecraft.functions import statistics
from tablecraft.functions.special import f_survival
from tablecraft.operators import (
    cleaning,
    comparison,
    creation,
    encoding,
    evaluation,
    extraction,
    insights,
    lookup,
    neighbors,
    preparation,
    profiling,
    selection,
    training,
    transforms,
)
from tablecraft.operators.session import FeatureSession
from tablecraft.sources import files
from tablecraft.streaming.apply import run_available


def column(df, name):
    return [r[name] for r in df.select(F.col(f"`{name}`")).collect()]


def ordered(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


# --- statistics --------------------------------------------------------------------------------


@pytest.mark.parametrize("exact_rows", [20, 10**9])
def test_quantiles_are_exact_whatever_the_path(spark, exact_rows):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=2000), np.full(1500, 0.25), rng.lognormal(8, 4, 500), [-1e12, 1e300]])
    df = spark.createDataFrame(pd.DataFrame({"a": values, "b": np.arange(len(values)) % 7})).repartition(5)
    probs = [0, 0.01, 0.25, 0.5, 0.77, 0.99, 1]
    found = statistics.quantiles(df, ["a", "b"], probs, exact_rows=exact_rows)
    assert np.allclose(found["a"], np.quantile(values, probs), rtol=1e-12)
    assert np.allclose(found["b"], np.quantile(np.arange(len(values)) % 7, probs))


def test_quantiles_when_values_crowd_near_one_end(spark):
    values = [10.0 ** (-k % 290) for k in range(3000)] + [1e280]
    df = ordered(spark, values).repartition(3)
    found = statistics.quantiles(df, ["x"], [0.1, 0.5, 0.9], exact_rows=5)
    assert np.allclose(found["x"], np.quantile(values, [0.1, 0.5, 0.9]), rtol=1e-12)


def test_constant_columns_give_no_error(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (3.0, 3.0), (3.0, 5.0)], "x double, y double")
    assert column(profiling.correlation_matrix(df), "r") == [None]
    stats = {r["column"]: r for r in profiling.numeric_stats(df).collect()}
    assert stats["x"]["skew"] == 0 and stats["x"]["kurtosis"] == 0
    for scale in (transforms.standard, transforms.minmax, transforms.robust):
        assert set(column(scale(df, ["x"]).transform(df), scale(df, ["x"]).columns_out[0])) == {0.0}


def test_correlation_uses_rows_with_both_values(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None, 9], "b": [2.0, 1, None, 5, 7, 8], "c": [1.0, 4, 2, 8, 5, 7]})
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf])
    expected = pdf.corr()
    for r in statistics.correlations(df, statistics.all_pairs(["a", "b", "c"])).collect():
        assert r["r"] == pytest.approx(expected.loc[r["c1"], r["c2"]], abs=1e-12)


def test_moments_match_pandas(spark):
    values = [1.0, 2.0, 2.5, 9.0, -4.0, 11.0]
    row = profiling.numeric_stats(ordered(spark, values).select("x"), digits=9).first()
    assert row["skew"] == pytest.approx(pd.Series(values).skew(), abs=1e-8)
    assert row["kurtosis"] == pytest.approx(pd.Series(values).kurt(), abs=1e-8)


def test_moments_of_extreme_and_short_columns(spark):
    df = spark.createDataFrame([(1e-200, 1e200, None), (3e-200, -2e200, 1.0), (4e-200, 5e200, None), (9e-200, 1e10, 2.0)], "a double, b double, c double")
    seen = statistics.moments(df, ["a", "b", "c"])
    # Squares that underflow count as no spread, as in pandas; squares that overflow have no kurtosis.
    assert seen["a"]["kurtosis"] == pd.Series([1e-200, 3e-200, 4e-200, 9e-200]).kurt() == 0
    assert seen["b"]["kurtosis"] is None
    assert seen["c"]["n"] == 2 and seen["c"]["variance"] == 0.5 and seen["c"]["skew"] is None
    assert statistics.moments(df.limit(0), ["a"])["a"]["variance"] is None


def test_f_survival():
    assert f_survival(3.841459, 1, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert f_survival(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_survival(0.0, 2, 10) == 1.0


# --- cleaning ----------------------------------------------------------------------------------


def test_clean_edge_frame(spark):
    df = spark.createDataFrame(
        [(1.0, " a ", None, "2024-01-05"), (None, "\tb\n", None, "2024-02-06"), (3.0, "nan", None, "2024-03-07"), (None, None, None, None)],
        "x double, s string, e string, d string",
    )
    out, plan = cleaning.clean(df)
    assert plan.empty == ["e"] and plan.empty_rows == 1 and plan.dates == ["d"]
    rows = {r["d_month"]: r for r in out.collect()}
    assert rows[2]["x"] == 2.0 and rows[1]["s"] == "a" and rows[2]["s"] == "b" and rows[3]["s"] == "a"
    assert rows[1]["d_dayofweek"] == 4
    assert out.schema["s"].metadata == {"categorical": True}


def test_nan_counts_as_missing_and_rows_without_values_pass(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (4.0,)], "x double")
    assert sorted(column(cleaning.fill_median(df), "x")) == [2.0, 3.0, 4.0]
    empty = spark.createDataFrame([], "x double, s string")
    out, _ = cleaning.clean(empty)
    assert out.count() == 0


def test_unicode_whitespace(spark):
    df = spark.createDataFrame([(" x　\x1f",), ("",), ("nan",)], "s string")
    assert column(cleaning.strip_whitespace(df), "s") == ["x", "", None]


@pytest.mark.parametrize("text,day", [("2024-03-01", 1), ("3/7/2024 10:05", 7), ("2024/3/9", 9), ("Mar 4, 2024", 4), ("5 Mar 2024", 5), ("2024", None), ("12:30", None), ("x", None)])
def test_date_spellings(spark, text, day):
    from tablecraft.functions.columns import parse_moment

    df = spark.createDataFrame([(text,)], "s string").select(F.dayofmonth(parse_moment(F.col("s"))).alias("d"))
    assert df.first()["d"] == day


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0)], "`a b` double, `a.b` double")
    assert sorted(column(cleaning.fill_median(df), "a.b")) == [4.0, 4.0]
    assert transforms.standard(df, ["a b"]).transform(df).columns[-1] == "a b_scaled"


# --- features ----------------------------------------------------------------------------------


def test_binning_matches_pandas(spark):
    values = [1, 2, 2, 2, 3, 4, 5, 6, 7, 100, None]
    df = ordered(spark, [None if v is None else float(v) for v in values])
    s = pd.Series(values, dtype="float64")
    for strategy, cut in (("quantile", pd.qcut(s, 5, labels=False, duplicates="drop")), ("uniform", pd.cut(s, 5, labels=False))):
        out = transforms.binning(df, ["x"], 5, strategy).transform(df).orderBy("i")
        assert column(out, "x_bin5") == cut.fillna(-1).astype(int).tolist()
    flat = ordered(spark, [3.0, 3.0])
    assert column(transforms.binning(flat, ["x"], 5, "uniform").transform(flat), "x_bin5") == [2, 2]
    assert column(transforms.binning(flat, ["x"], 5, "quantile").transform(flat), "x_bin5") == [-1, -1]


def test_encodings_with_missing_values(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 5.0), (3, None, 11.0)], "i int, k string, y double")
    pick = lambda f, c: column(f.transform(df).orderBy("i"), c)
    assert pick(encoding.target_mean(df, ["k"], "y"), "k_target_enc") == [2.0, 2.0, 5.0, 5.0]
    assert pick(encoding.label(df, ["k"]), "k_label") == [0, 0, 1, 2]
    assert pick(encoding.frequency(df, ["k"]), "k_freq") == pytest.approx([2 / 3, 2 / 3, 1 / 3, 0])
    assert pick(encoding.onehot(df, ["k"]), "k_b") == [0, 0, 1, 0]


def test_large_lookup_agrees_with_small_one(spark):
    keys = [f"k{i % 50:03d}" if i % 3 else "hot" for i in range(600)] + [None] * 200
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").repartition(4)
    small = encoding.label(df, ["k"]).transform(df).orderBy("i").collect()
    object.__setattr__(lookup.SETTINGS, "broadcast_rows", 5)
    object.__setattr__(lookup.SETTINGS, "hot_keys", 2)
    try:
        assert not encoding.label_mapping(df, "k").small
        large = encoding.label(df, ["k"]).transform(df).orderBy("i").collect()
        freq = encoding.frequency(df, ["k"]).transform(df)
    finally:
        object.__setattr__(lookup.SETTINGS, "broadcast_rows", 100_000)
        object.__setattr__(lookup.SETTINGS, "hot_keys", 1_000)
    assert large == small
    shares = {r["k"]: r["k_freq"] for r in freq.collect()}
    assert shares["hot"] == pytest.approx(200 / 600) and shares[None] == 0


def test_onehot_cap_overwrites_source(spark):
    df = spark.createDataFrame([(f"c{i % 25:02d}",) for i in range(60)] + [(None,)], "c string")
    f = encoding.onehot(df, ["c"], max_categories=20)
    out = f.transform(df)
    assert len(f.columns_out) == 20 and "c___OTHER__" in [*f.columns_out, f"c_{f.info['levels']['c'][0]}"]
    assert out.where("c = '__OTHER__'").count() == df.count() - out.where("c <> '__OTHER__'").count()
    assert out.where("c IS NULL").count() == 0


def test_power_lambda_is_the_likelihood_maximum(spark):
    x = np.random.default_rng(3).exponential(2.0, 800)
    lam = transforms.fit_lambdas(ordered(spark, [float(v) for v in x]), ["x"])["x"]

    def loglik(k):
        psi = np.log1p(x) if abs(k) < 1e-12 else ((1 + x) ** k - 1) / k
        return -len(x) / 2 * math.log(psi.var()) + (k - 1) * np.log1p(x).sum()

    grid = np.linspace(-2, 2, 4001)
    assert lam == pytest.approx(grid[np.argmax([loglik(k) for k in grid])], abs=2e-3)
    shifted = ordered(spark, [float(v) for v in x - 3])
    assert column(transforms.power(shifted, ["x"]).transform(shifted), "x_boxcox")


def test_pca_matches_eigenvectors(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    cols = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(m, columns=cols))
    f = extraction.pca(df, cols, 3)
    values, vectors = np.linalg.eigh(np.corrcoef(m.T))
    assert f.info["explained_variance_ratio"] == pytest.approx((values[::-1] / 4)[:3], abs=1e-9)
    for j, p in enumerate(["PC1", "PC2", "PC3"]):
        mine = np.array([f.info["loadings"][p][c] for c in cols])
        assert abs(abs(mine @ vectors[:, -1 - j])) == pytest.approx(1, abs=1e-9)
    scores = np.array([[r["PC1"], r["PC2"]] for r in f.transform(df).collect()])
    assert np.corrcoef(scores.T)[0, 1] == pytest.approx(0, abs=1e-9)


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0, None)], "a double, b double, c double")
    f = creation.polynomial(df, ["a", "b"], 3)
    assert len(creation.polynomial(df, ["a", "b"], 5).columns_out) == 18
    assert f.columns_out == ["a^2", "a_b", "b^2", "a^3", "a^2_b", "a_b^2", "b^3"]
    assert f.transform(df).first()["a^2_b"] == 12.0
    assert creation.row_aggregates(df, ["c"], ["std", "max"]).transform(df).first()["agg_std_c"] == 0.0


# --- selection ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 5))
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(5)])
    pdf["num"] = 3 * x[:, 1] - 2 * x[:, 3] + rng.normal(scale=0.1, size=600)
    pdf["cls"] = np.where(pdf["num"] > 0, "yes", "no")
    return spark.createDataFrame(pdf).cache()


FEATURES = [f"f{i}" for i in range(5)]


@pytest.mark.parametrize("task,target", [("regression", "num"), ("classification", "cls")])
def test_selectors_find_the_planted_columns(planted, task, target):
    for run in (
        lambda: selection.by_f_test(planted, FEATURES, target, task, 2),
        lambda: selection.by_mutual_information(planted, FEATURES, target, task, 2),
        lambda: selection.by_elimination(planted, FEATURES, target, task, 2, step=2, trees=10),
        lambda: selection.by_consensus(planted, FEATURES, target, task, 2),
    ):
        f = run()
        assert set(f.columns_out) == {"f1", "f3"}
        assert f.transform(planted).columns[:2] == ["num", "cls"]


def test_l1_matches_coordinate_descent(planted):
    pdf = planted.toPandas()
    x = ((pdf[FEATURES] - pdf[FEATURES].mean()) / pdf[FEATURES].std(ddof=0)).to_numpy()
    y = (pdf["num"] - pdf["num"].mean()).to_numpy()
    w, alpha, n = np.zeros(5), 0.5, len(y)
    for _ in range(500):
        for j in range(5):
            rho = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / n
            w[j] = math.copysign(max(abs(rho) - alpha, 0), rho)
    found = selection.by_l1(planted, FEATURES, "num", "regression", alpha)
    assert [found.info["coefficients"][c] for c in FEATURES] == pytest.approx(abs(w), abs=1e-4)
    assert set(found.columns_out) == {"f1", "f3"}


def test_constant_feature_has_no_score(spark):
    df = spark.createDataFrame([(1.0, float(i), float(i % 2)) for i in range(50)], "c double, x double, y double")
    assert selection.by_correlation(df, ["c", "x"]).columns_out == []
    assert selection.by_f_test(df, ["c", "x"], "y", "classification", 1).columns_out == ["x"]


# --- insights ----------------------------------------------------------------------------------


def test_report_order_and_severity(spark):
    rows = [(float(i % 17), 1000.0 if i % 7 == 0 else float(i % 3), "x" if i % 20 else "y") for i in range(400)]
    rep = insights.report(spark.createDataFrame(rows, "a double, b double, s string")).collect()
    assert [r["severity"] for r in rep] == sorted((r["severity"] for r in rep), key=insights.SEVERITIES.index)
    assert {r["insight_type"]: r["severity"] for r in rep}["outlier"] == "critical"
    assert next(r for r in rep if r["insight_type"] == "imbalance")["affected_columns"] == ["s"]
    assert rep[-1]["title"] == "Distribution Analysis"


# --- learning ----------------------------------------------------------------------------------


def test_prepared_columns_are_standardised_and_finite(spark):
    df = spark.createDataFrame(
        [(i, float(i), math.inf if i == 3 else float(i * i), None if i % 5 == 0 else f"v{i % 4}", "u" if i % 2 else "w") for i in range(60)],
        "id int, a double, b double, s string, y string",
    )
    p = preparation.prepare(df, "y", "binary_classification", exclude=["id"])
    flat = p.flat(df, ["id"]).toPandas()
    assert set(flat["label"]) == {0.0, 1.0}
    for c in p.features:
        assert abs(flat[c].mean()) < 1e-9 and flat[c].std(ddof=0) == pytest.approx(1)


def test_stratified_split_is_exact_per_class(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(900)], "id int, k string")
    counts = {(r["k"], r["split"]): r["n"] for r in preparation.stratified_split(df, ["id"], "k").groupBy("k", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a", "test"): 120, ("a", "val"): 60, ("a", "train"): 420, ("b", "test"): 60, ("b", "val"): 30, ("b", "train"): 210}


def test_train_save_load_score(spark, planted, tmp_path):
    keyed = planted.withColumn("id", F.monotonically_increasing_id()).drop("num").cache()
    p = preparation.prepare(keyed, "cls", "binary_classification", exclude=["id"])
    parts = preparation.hash_split(p.transform(keyed, ["id"]), ["id"])
    metrics = []
    for name in ("LogisticRegression", "NearestCentroid", "KNeighborsClassifier"):
        t = training.train(name, parts, p.task, p.features, history=name == "LogisticRegression")
        rows = t.metrics()
        metrics.append(rows)
        assert {r["metric"]: r["value"] for r in rows.collect()}["accuracy"] > 0.85
        if name == "LogisticRegression":
            assert t.importances().first()["feature"] in ("f1", "f3") and t.history[-1][1] > 0.9
            training.save(t.model, str(tmp_path / "m"))
            scored = training.score(keyed.drop("cls"), p, training.load(str(tmp_path / "m")), ["id"])
            assert scored.count() == keyed.count()
    best = comparison.best_per_metric(statistics.union_all(metrics))
    assert best.where("metric = 'accuracy'").count() == 1


def test_single_class_is_an_error(spark):
    df = spark.createDataFrame([(i, float(i), "only") for i in range(40)], "id int, x double, y string")
    p = preparation.prepare(df, "y", "binary_classification", exclude=["id"])
    with pytest.raises(ValueError):
        training.train("LogisticRegression", preparation.hash_split(p.transform(df, ["id"]), ["id"]), p.task, p.features)


def test_log_loss(spark):
    df = spark.createDataFrame([(1.0, [0.2, 0.8]), (0.0, [0.9, 0.1]), (1.0, [1.0, 0.0])], "label double, p array<double>")
    expected = -(math.log(0.8) + math.log(0.9) + math.log(2.220446049250313e-16)) / 3
    assert evaluation.log_loss(df, F.col("p")).first()["log_loss"] == pytest.approx(expected)


def test_overfitting_verdicts(spark):
    rows = [("m", e, 0.5 + 0.04 * e, 0.5) for e in range(1, 13)] + [("n", 1, 0.8, 0.79)]
    got = {r["model"]: r for r in comparison.overfitting(spark.createDataFrame(rows, "model string, epoch int, train_score double, val_score double")).collect()}
    assert got["m"]["verdict"] == "significant overfitting" and got["m"]["late_divergence"]
    assert got["n"]["verdict"] == "good generalization" and not got["n"]["late_divergence"]


@pytest.mark.parametrize("pivots,block,chunk", [(None, 20_000, 20_000), (7, 11, 13)])
def test_knn_matches_brute_force(spark, pivots, block, chunk):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (60, 1)), rng.normal(5, 1, size=(40, 6))])
    qs = np.vstack([rng.normal(size=(30, 6)), pts[150:155]])
    make = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id bigint, vector array<double>")
    found = neighbors.knn_join(make(qs), make(pts), 4, pivots, block, chunk).collect()
    d = np.sqrt(((qs[:, None] - pts[None]) ** 2).sum(axis=2))
    expected = {(q, r): int(np.lexsort((np.arange(len(pts)), np.round(d[q], 12)))[r - 1]) for q in range(len(qs)) for r in range(1, 5)}
    assert {(r["query"], r["rank"]): r["point"] for r in found} == expected


# --- session, sources, streams -----------------------------------------------------------------


def test_session_undo_and_reset(spark):
    df = spark.createDataFrame([(1.0, "a"), (4.0, "b")], "x double, s string")
    s = FeatureSession(df)
    s.apply(transforms.log, ["x"])
    s.apply(creation.drop_columns, ["s"])
    assert s.current.columns == ["x", "x_log"] and s.log().count() == 2
    assert s.undo() and s.current.columns == ["x", "s", "x_log"]
    assert s.undo() and not s.undo() and s.current.columns == df.columns
    s.apply(transforms.sqrt, ["x"])
    s.reset()
    assert s.summary()["transforms_applied"] == 0 and s.current is df


def test_readers(spark, tmp_path):
    latin = tmp_path / "l.CSV"
    latin.write_bytes("a,b\n1,caf\xe9\n2,x\n".encode("latin-1"))
    assert sorted(column(files.load(spark, str(latin)), "b")) == ["caf\xe9", "x"]
    array = tmp_path / "r.json"
    array.write_text('[\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]')
    assert files.load(spark, str(array)).count() == 2
    with pytest.raises(ValueError):
        files.load(spark, "t.xlsx")
    df = spark.createDataFrame([(1, 'say "hi", twice'), (2, None)], "a int, b string")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(files.load(spark, str(tmp_path / "out"), "csv").collect()) == sorted(df.collect())
    info = files.file_info(files.load(spark, str(latin))).first()
    assert info["type"] == "csv" and info["size"].endswith("KB")


def test_fitted_transforms_run_on_streams(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/customer.parquet")
    steps = [encoding.frequency(batch, ["c_mktsegment"]), transforms.standard(batch, ["c_acctbal"])]
    source = spark.readStream.schema(batch.schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    run_available(source, steps, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    expected = steps[1].transform(steps[0].transform(batch))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(expected.collect())
