"""Cases that once gave wrong or incomplete results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.functions.statistics import all_pairs, correlations, quantiles
from tablecraft.operators import catalog, comparison, creation, evaluation, neighbors, preparation, profiling, storage, training, transforms
from tablecraft.sources import files


def test_valid_utf8_with_replacement_characters_stays(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\ncafé �,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,n\nthé,2\n".encode("latin-1"))
    rows = {r["n"]: r["name"] for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {1: "café �", 2: "thé"}
    assert files.read_csv(spark, str(tmp_path / "a.csv")).first()["name"] == "café �"


def test_json_layout_is_told_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n[{"x": 1},\n {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3, "y": 1}\n{"x": 4}\n')
    assert sorted(r["x"] for r in files.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_file_info_reads_no_rows(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    info = files.file_info(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(info) == 2 and all(r["type"] == "parquet" and r["bytes"] > 0 for r in info)


def test_quantiles_with_infinities_end(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 3, float("-inf")).when(F.col("id") > 989, float("inf")).otherwise(F.col("id").cast("double")).alias("x"))
    got = quantiles(df, ["x"], [0.0, 0.25, 0.5, 1.0], lambda d, c: F.col(c), exact_rows=5)["x"]
    assert got == [float("-inf"), 249.75, 499.5, float("inf")]


def test_rows_without_label_are_split_too(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("k"))
    counts = {r["split"]: r["n"] for r in preparation.stratified_split(df, ["id"], "k").where("k IS NULL").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"train", "val", "test"} and 60 < counts["test"] < 140


def test_many_classes_are_still_divided(spark):
    df = spark.range(220_220).select("id", (F.col("id") % 10_010).alias("k"))
    split = preparation.stratified_split(df, ["id"], "k").groupBy("k").agg(F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "val").alias("val"))
    assert split.agg(F.min("test"), F.max("test"), F.min("val"), F.max("val")).first()[:] == (4, 4, 3, 3)


def test_nearest_neighbours_far_from_zero(spark):
    rng = np.random.default_rng(5)
    x = 1e7 + rng.random((120, 8))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = {(r["query"], r["rank"]): r["point"] for r in neighbors.knn_join(rows, rows, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        assert [got[i, r] for r in (1, 2, 3, 4)] == np.argsort(np.round(d[i] ** 2, 10), kind="stable")[:4].tolist()


def test_a_far_lambda_is_found(spark):
    rng = np.random.default_rng(1)
    x = 1 + rng.standard_normal(400) * 0.01
    df = spark.createDataFrame([(float(v) ** (1 / 30),) for v in np.exp(x)], "x double")
    fitted = transforms.fit_lambdas(df, ["x"])["x"]
    grid = [fitted - 0.01, fitted, fitted + 0.01]
    low, mid, high = transforms.likelihood_grid(df, ["x"], {"x": grid})["x"]
    assert mid >= low and mid >= high and abs(fitted) > 2


def test_no_column_is_left_out(spark):
    df = spark.range(5).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(12)], *[F.lit("v").alias(f"s{i}") for i in range(8)])
    assert profiling.histogram(df).select("column").distinct().count() == 12
    assert profiling.top_values(df).select("column").distinct().count() == 8
    assert len(creation.polynomial(df, [f"c{i}" for i in range(12)], 2).columns_out) == 78
    nested = df.select("c1", F.array("c1").alias("a"), F.when(F.col("c1") > 1, F.struct("c1")).alias("s"))
    info = {r["column"]: r for r in profiling.column_info(nested).collect()}
    assert (info["a"]["non_null"], info["s"]["nulls_after"], info["s"]["n_unique"]) == (5, 2, None)


def test_confusion_of_many_classes_lists_what_occurs(spark):
    df = spark.range(40).select(F.col("id").cast("double").alias("label"), F.col("id").cast("double").alias("prediction"))
    assert evaluation.confusion_matrix(df).count() == 1600
    assert evaluation.confusion_matrix(df, grid_classes=10).count() == 40


@pytest.fixture(scope="module")
def small_parts(spark):
    df = spark.range(160).select(
        "id", (F.rand(1) * 3).alias("a"), F.rand(2).alias("b"), F.lit(0.0).alias("y"),
        F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "val").otherwise("test").alias("split"))
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    return {
        "classification": out.withColumn("label", (F.col("a") + F.col("b") > 2).cast("double")).select("id", "features", "label", "split").cache(),
        "regression": out.withColumn("label", F.col("a") * 2 + F.col("b")).select("id", "features", "label", "split").cache(),
    }


#: One model of each Spark class behind the catalogue.
FACTORIES = {(m.task_type, m.factory): m.class_name for m in reversed(catalog.CATALOG)}


@pytest.mark.parametrize("kind, factory", sorted(FACTORIES))
def test_every_factory_trains_with_history(spark, small_parts, kind, factory):
    task = "binary_classification" if kind == "classifier" else "regression"
    parts = small_parts["classification" if kind == "classifier" else "regression"]
    out = training.train(FACTORIES[kind, factory], parts, task, ["a", "b"])
    assert out.predictions.count() == parts.where("split = 'test'").count()
    assert out.history and out.history_frame().count() == len(out.history) and out.metrics().count() > 3
    assert any(h[2] is not None for h in out.history)
    if factory.startswith("GBT"):
        assert all(None not in h for h in out.history)
        loss = out.model.evaluateEachIteration(parts.where("split = 'val'"), *([] if kind == "classifier" else [out.model.getOrDefault("lossType")]))
        assert np.allclose([h[4] for h in out.history], np.array(loss) / (2 if kind == "classifier" else 1), rtol=1e-6)


def test_late_divergence_of_a_trained_model(spark, small_parts):
    noisy = small_parts["classification"].withColumn("label", F.when(F.rand(3) < 0.4, 1 - F.col("label")).otherwise(F.col("label"))).cache()
    out = training.train("GradientBoostingClassifier", noisy, "binary_classification", ["a", "b"])
    assert len(out.history) > 10
    verdict = comparison.overfitting(out.history_frame()).first()
    gaps = [h[1] - h[2] for h in out.history]
    assert verdict["late_divergence"] == (gaps[-1] > gaps[len(gaps) // 2] + 0.05) and verdict["gap"] == pytest.approx(gaps[-1], abs=1e-6)
    linear = training.train("HuberRegressor", small_parts["regression"], "regression", ["a", "b"])
    assert comparison.overfitting(linear.history_frame()).first()["late_divergence"] is False


def test_correlations_with_gaps_and_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, 100)) + rng.random((300, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 0.1
    names = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names))
    for pairs in (all_pairs(names), [(n, "c3") for n in names if n != "c3"]):
        for r in correlations(df, pairs).collect():
            a, b = x[:, names.index(r["c1"])], x[:, names.index(r["c2"])]
            both = ~np.isnan(a) & ~np.isnan(b)
            if "c7" in (r["c1"], r["c2"]):
                assert r["r"] is None
            else:
                assert r["r"] == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-9)
    plan = correlations(df, all_pairs(names))._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "Expand" not in plan


def test_stored_preparation_scores_with_class_names(spark, tmp_path):
    df = spark.range(90).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 4).alias("k"),
        F.when(F.col("id") % 4 < 2, "low").otherwise("high").alias("y"))
    prepared = preparation.prepare(df, "y", "binary_classification", exclude=["id"])
    parts = preparation.hash_split(prepared.transform(df, ["id"]), ["id"])
    out = training.train("DecisionTreeClassifier", parts, prepared.task, prepared.features, history=False)
    training.save(out.model, str(tmp_path / "model"))
    storage.save_prepared(prepared, spark, str(tmp_path / "prepared"))
    again, model = storage.load_prepared(spark.newSession(), str(tmp_path / "prepared")), training.load(str(tmp_path / "model"))
    scored = storage.class_names(training.score(df.drop("y"), again, model, ["id"]), again)
    wrong = scored.join(df, "id").where("prediction <> y OR prediction IS NULL").count()
    assert wrong == 0


def test_stored_neighbour_models(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 3), [float(i % 3), float(i) / 50]) for i in range(30)], "label double, features array<double>")
    for name, model in (("c", neighbors.NearestCentroid().fit(df)), ("n", neighbors.NearestNeighbors(3).fit(df))):
        storage.save_neighbors(model, spark, str(tmp_path / name))
        again = storage.load_neighbors(spark, str(tmp_path / name))
        assert again.transform(df).where("prediction <> label").count() == model.transform(df).where("prediction <> label").count() == 0


def test_catalogue_listing(spark):
    rows = catalog.catalog_frame(spark.range(1), "regression").collect()
    assert len(rows) == len(catalog.models_for("regression")) and {r["source"] for r in rows} == {"tablecraft", "pyspark.ml"}
    assert all(r["display_name"] in r["description"] for r in rows) and catalog.catalog_frame(spark.range(1)).count() == len(catalog.CATALOG)


def test_undo_and_reset_wind_the_lineage_count_back(spark):
    from tablecraft.operators.session import FeatureSession

    session = FeatureSession(spark.createDataFrame([(1.0,), (2.0,)], "x double"))
    for _ in range(3):
        session.apply(creation.polynomial, ["x"], 2)
    assert session.undo() and session._since_cut == 2
    session.reset()
    assert session._since_cut == 0 and session.current is session.original


@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 1e6), (1e-20, 0), (1e20, 0), (1e100, 0), (0, 3)])
@pytest.mark.parametrize("copies", [1, 200])
def test_neighbours_screened_in_single_precision_are_exact(scale, shift, copies):
    """Near ties that single precision cannot tell apart, sizes that it cannot hold, and many equal rows."""
    rng = np.random.default_rng(5)
    b = np.repeat(rng.normal(size=(4, 8)), 60, axis=0) + rng.normal(size=(240, 8)) * 1e-6
    b[-copies:] = b[-1]
    a, b = np.r_[b[:40], rng.normal(size=(20, 8))] * scale + shift, b * scale + shift
    pair = neighbors.single_distances(a, b)
    assert (pair is None) == (scale != 1)
    if pair is not None:
        assert np.abs(pair[0] - ((a[:, None] - b[None]) ** 2).sum(-1)).max() <= pair[1]
    want = np.round(((a[:, None] - b[None]) ** 2).sum(-1), 10)
    i, j, _ = neighbors.nearest_exact(a, b, 7)
    assert j.reshape(len(a), 7).tolist() == np.argsort(want, axis=1, kind="stable")[:, :7].tolist()
    assert i.tolist() == np.repeat(np.arange(len(a)), 7).tolist()
