"""The most frequent keys without a sort."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.llm.storage import most_frequent


def test_most_frequent_keys_come_first_and_fill_the_limit(spark):
    counts = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("w"), F.greatest(F.lit(1), F.floor(F.lit(3_000_000) / (F.col("id") + 1))).cast("long").alias("n"))
    every = sorted((r.n for r in counts.collect()), reverse=True)
    for limit in (1, 50, 3_000, 15_000):
        got = [r.n for r in most_frequent(counts, limit, "w").collect()]
        assert 0.95 * limit - 1 <= len(got) <= limit
        if len(got) > 1:  # nothing above the step at the cut is left out
            assert sorted(got, reverse=True)[: len(got) * 9 // 10] == every[: len(got) * 9 // 10]


def test_ties_fill_the_limit_up_to_a_group_of_hashes(spark):
    ties = spark.range(50_000).select(F.col("id").alias("h"), F.lit(1).cast("long").alias("n"))
    assert 9_950 <= most_frequent(ties, 10_000, "h").count() <= 10_000
    assert most_frequent(ties, 50_000, "h").count() == 50_000 and most_frequent(ties.limit(0), 5, "h").count() == 0


def test_selection_does_not_follow_the_partitions(spark):
    counts = spark.range(5_000).select(F.col("id").alias("h"), (F.col("id") % 7 + 1).alias("n"))
    a, b = (sorted(r.h for r in most_frequent(counts.repartition(p), 1_000, "h").collect()) for p in (1, 13))
    assert a == b


def test_ordered_ties_are_cut_by_count_and_key(spark):
    rows = [(int(5 + i % 3 if i < 300 else 90_000 + i), f"w{i * 7919 % 1000:03}") for i in range(310)]
    counts = spark.createDataFrame(rows, "n long, w string").repartition(9)
    for limit in (0, 1, 4, 10, 57, 110, 309, 310, 900):
        want = sorted(rows, key=lambda r: (-r[0], r[1]))[:limit]
        assert sorted((r.n, r.w) for r in most_frequent(counts, limit, "w", ordered=True).collect()) == sorted(want)
