"""Distinct values by hash, and columns of few values, against plain sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tablecraft.functions.statistics import distinct_counts, distinct_floors, few_valued
from tablecraft.operators import cleaning


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_counts_of_all_kinds(spark):
    nan, schema = float("nan"), "a double, b string, `c.d` float, e date, f boolean, g decimal(9,2), h binary"
    df = spark.createDataFrame([(0.0, "x", 0.5, None, True, None, b"1"), (-0.0, "y", nan, None, False, None, b"2"), (nan, None, None, None, True, None, b"1"), (1.5, "x", 0.25, None, None, None, None)], schema)
    assert {r["column"]: r.n_unique for r in distinct_counts(df, df.columns).collect()} == {"a": 2, "b": 2, "c.d": 2, "e": 0, "f": 2, "g": 0, "h": 2}
    assert {r.n_unique for r in distinct_counts(df.limit(0), df.columns).collect()} == {0} and distinct_counts(df, []).count() == 0


def test_plan_neither_multiplies_rows_nor_groups_by_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = distinct_counts(docs, ["text", "lang", "source", "n_chars"])
    plan = plan_of(counts)
    assert "Expand" not in plan and not any("text#" in line.split("]")[0] for line in plan.splitlines() if "Aggregate" in line)
    want = docs.agg(*[F.count_distinct(c).alias(c) for c in ("text", "lang", "source", "n_chars")]).first().asDict()
    assert {r["column"]: r.n_unique for r in counts.collect()} == want


def test_floors_never_pass_the_truth_and_few_values_are_exact(spark):
    rng = random.Random(6)
    sizes = (1, 3, 19, 20, 21, 30, 200, 1500)
    rows = [tuple(f"v{rng.randrange(n) if i >= n else i}" for n in sizes) + (None,) for i in range(1500)]
    names = [f"c{n}" for n in sizes]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*names, "gone"])).repartition(5)
    for up_to in (1, 20, 50, 300):
        floors = distinct_floors(df, df.columns, up_to)
        assert all(floors[f"c{n}"] <= n for n in sizes) and floors["gone"] == 0 and floors["c1500"] >= up_to
        assert few_valued(df, df.columns, up_to) == {c: n for c, n in [*zip(names, sizes), ("gone", 0)] if n < up_to}
    assert cleaning.category_columns(df, 20) == {"c1": 1, "c3": 3, "c19": 19, "gone": 0}
    assert few_valued(df.limit(0), names, 20) == {c: 0 for c in names}
