"""Fitted preparations and neighbour models as files, and class names for predictions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.operators import lookup
from tablecraft.operators.extra_trees import ExtraTreesModel, Tree
from tablecraft.operators.neighbors import NearestCentroidModel, NearestNeighbors, NearestNeighborsModel
from tablecraft.operators.preparation import Coercion, Prepared


def _write_facts(spark: SparkSession, facts: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def _read_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()["value"])


def _write_mapping(mapping: lookup.Mapping, path: str) -> bool:
    mapping.table.write.mode("overwrite").parquet(f"{path}/table")
    if mapping.hot is not None:
        mapping.hot.write.mode("overwrite").parquet(f"{path}/hot")
    return mapping.small


def _read_mapping(spark: SparkSession, path: str, small: bool) -> lookup.Mapping:
    table = spark.read.parquet(f"{path}/table")
    return lookup.Mapping(table, small, None if small else spark.read.parquet(f"{path}/hot"))


def save_prepared(prepared: Prepared, spark: SparkSession, path: str) -> None:
    """Everything that scoring in another session needs: plan, medians, scales and every label map."""
    coercion = prepared.coercion
    labels = {c: [i, _write_mapping(m, f"{path}/map_{i}")] for i, (c, m) in enumerate(coercion.labels.items())}
    target = None if prepared.target_labels is None else _write_mapping(prepared.target_labels, f"{path}/target")
    _write_facts(spark, {
        "target": prepared.target, "task": prepared.task, "features": prepared.features, "plan": coercion.plan, "medians": coercion.medians,
        "shifts": {c: list(v) for c, v in prepared.shifts.items()}, "labels": labels, "target_labels": target,
    }, path)


def load_prepared(spark: SparkSession, path: str) -> Prepared:
    facts = _read_facts(spark, path)
    labels = {c: _read_mapping(spark, f"{path}/map_{i}", small) for c, (i, small) in facts["labels"].items()}
    target = facts["target_labels"]
    return Prepared(
        facts["target"], facts["task"], facts["features"], Coercion(facts["plan"], facts["medians"], labels),
        {c: tuple(v) for c, v in facts["shifts"].items()}, None if target is None else _read_mapping(spark, f"{path}/target", target),
    )


def class_names(predictions: DataFrame, prepared: Prepared, columns: tuple[str, ...] = ("prediction",)) -> DataFrame:
    """The number of a class in each of the columns replaced by the class's name; numbers without a class become missing."""
    if prepared.target_labels is None:
        return predictions
    out = predictions
    for c in columns:
        names = prepared.target_labels.table.select(F.col("key").alias("__name"), F.col("value").cast("double").alias("__class"))
        names = F.broadcast(names) if prepared.target_labels.small else names
        out = out.join(names, col(c) == F.col("__class"), "left").drop(c, "__class").withColumnRenamed("__name", c)
    return out.select(*predictions.columns)


def save_neighbors(model: NearestCentroidModel | NearestNeighborsModel, spark: SparkSession, path: str) -> None:
    if isinstance(model, NearestCentroidModel):
        rows = [(float(label), [float(v) for v in center]) for label, center in zip(model.labels, model.centers)]
        spark.createDataFrame(rows, "label double, center array<double>").write.mode("overwrite").parquet(f"{path}/rows")
        _write_facts(spark, {"kind": "centroid", "features": model.features}, path)
    else:
        model.points.write.mode("overwrite").parquet(f"{path}/rows")
        spec = model.spec
        _write_facts(spark, {"kind": "neighbors", "features": spec.features, "k": spec.k, "classify": spec.classify, "label": spec.label}, path)


def load_neighbors(spark: SparkSession, path: str) -> NearestCentroidModel | NearestNeighborsModel:
    facts, rows = _read_facts(spark, path), spark.read.parquet(f"{path}/rows")
    if facts["kind"] == "centroid":  # as many rows as a fitted model may hold
        held = sorted(rows.collect(), key=lambda r: r["label"])
        return NearestCentroidModel(facts["features"], [r["label"] for r in held], np.array([r["center"] for r in held]))
    return NearestNeighborsModel(NearestNeighbors(facts["k"], facts["classify"], facts["features"], facts["label"]), rows)


def save_extra_trees(model: ExtraTreesModel, spark: SparkSession, path: str) -> None:
    rows = [
        (i, node, int(t.feature[node]), float(t.threshold[node]), int(t.left[node]), [float(v) for v in t.value[node]])
        for i, t in enumerate(model.trees) for node in range(len(t.feature))
    ]
    spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, value array<double>").write.mode("overwrite").parquet(f"{path}/rows")
    importance = [[float(v) for v in t.importance] for t in model.trees]
    _write_facts(spark, {"classify": model.classify, "n_features": model.n_features, "features": model.features, "label": model.label, "importance": importance}, path)


def load_extra_trees(spark: SparkSession, path: str) -> ExtraTreesModel:
    facts, held = _read_facts(spark, path), {}
    for r in sorted(spark.read.parquet(f"{path}/rows").collect(), key=lambda r: (r["tree"], r["node"])):  # the nodes of one fitted model
        held.setdefault(r["tree"], []).append(r)
    trees = [
        Tree(*(np.array([r[c] for r in held[i]]) for c in ("feature", "threshold", "left", "value")), np.array(share))
        for i, share in enumerate(facts["importance"])
    ]
    return ExtraTreesModel(trees, facts["classify"], facts["n_features"], facts["features"], facts["label"])
