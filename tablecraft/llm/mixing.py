"""A mix of sources in given proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.columns import beside, blank_words, whole
from tablecraft.llm.storage import cut

WEIGHTS, BUDGET, REPEATS = (5, 2, 1), 1.5, 2
#: Length of the shared start of the shuffle key that makes a bucket: 16 ** 4 buckets a source.
BUCKET_CHARS = 4


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """One row per source of `sized` (source, size): source_size and target.

    Sources by code point, a missing source last, weigh `weights` in turn. They share `budget` times all sizes by weight; a target stops at
    `repeats` times its source's size, and the excess goes to the others by weight. Sources that fill up first are those with the least
    size for their weight, so sorting by that ratio gives the level in one pass over the small table of sources.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per_source = per_source.withColumn("weight", weight)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    taken_weight = F.coalesce(F.sum("weight").over(before), F.lit(0))
    rest = F.sum("source_size").over(everything) * F.lit(float(budget)) - F.lit(repeats) * full
    level = rest / (F.sum("weight").over(everything) - taken_weight)
    fits = F.col("weight") * level > F.lit(repeats) * F.col("source_size")
    leveled = per_source.withColumns({"level": level, "full": fits})
    #: The first source that does not fill up sets the level for itself and all that follow.
    common = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)
    target = F.when(F.col("full"), F.lit(float(repeats)) * F.col("source_size")).otherwise(F.col("weight") * common["level"])
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, finish and a hash of the text for every row of `docs` (doc_id, source, text, ...).

    Weighted fair queueing: each source is a queue of its documents, shuffled by a hash of the id and repeated up to `repeats` times. A
    copy's virtual finish time is the source's words up to its end divided by the source's target. Served in order of finish time, all
    queues have their targets at time 1, where the total budget is reached and the mix is cut; the copy in service there gives only its
    first words, so a source misses its target by less than one word. finish is the time at which a document's first copy ends.

    No window runs over a source: its documents are dealt to 65,536 buckets by the start of their shuffle key, words are summed per bucket
    before any shuffle of documents, and a running sum within a bucket is added to the sum of the buckets before it.

    A missing text has no words, is taken 0 times and stays in the output. Documents of equal shuffle key follow each other by size and
    text; equal rows then share their source's words in a fixed, otherwise arbitrary order. Nothing is random, so reruns agree.
    Other columns of `docs` are not read. An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", "text").withColumns({
        "size": F.size(blank_words(F.col("text"))).cast("long"), "_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
        "_th": F.xxhash64(whole(F.col("text"))),
    })
    slim = cut(sized.select("doc_id", "source", "size", "_key", "_th").withColumn("bucket", F.substring("_key", 1, BUCKET_CHARS)))  # texts are read once
    per_source = targets(slim, weights, budget, repeats)
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("ahead", F.coalesce(earlier, F.lit(0))).drop("words").withColumnsRenamed({"source": "_bs", "bucket": "_bb"})
    within = Window.partitionBy("source", "bucket").orderBy("_key", "doc_id", "size", "_th").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(buckets, placed["source"].eqNullSafe(buckets["_bs"]) & (placed["bucket"] == buckets["_bb"]))
    per_source = per_source.withColumnRenamed("source", "_ss")
    placed = placed.join(per_source, placed["source"].eqNullSafe(per_source["_ss"]))
    start = F.col("ahead") + F.col("_before")
    limit = F.floor(F.col("target"))

    def served(copy: int) -> Column:
        """Words of the copy that are over by virtual time 1."""
        return F.greatest(F.lit(0), F.least(F.col("size"), limit - (start + F.lit(copy) * F.col("source_size"))))

    taken = sum((served(copy) for copy in range(1, repeats)), served(0))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(F.col("target") > 0, (start + F.col("size")) / F.col("target")).alias("finish"), "_th",
    )


@beside(("doc_id", "source", "text"), ("copy", "size", "words", "target", "position"))
def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of `docs` with one row per copy taken, and copy, size, words (how many of its words the mix takes),
    target and position. position counts the mix's words before the copy in the order of finish times, so sorting by it gives the mix in
    the order in which the queues are served; it never passes the budget. A copy that the cut shortens gives its first words, joined by
    one blank. Columns of `docs` keep their values whatever their names; those named like an added one are replaced. Texts without words
    are in no copy, and an empty table gives an empty mix.

    The global order is made on rows without texts: finish times are dealt to ranges, words are summed by range, and a running sum within
    a range is added to the sum of those before it.
    """
    added = ("copy", "size", "words", "target", "position")
    plan = mix(docs.select("doc_id", "source", "text"), **options).where("taken > 0")
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    copies = copies.withColumns({
        "words": F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")),
        "finish": F.least(F.lit(1.0), F.col("finish") + F.col("copy") * F.col("source_size") / F.col("target")),
    }).withColumn("bucket", F.floor(F.col("finish") * 16**BUCKET_CHARS).cast("int"))
    copies = cut(copies)
    ranges = copies.groupBy("bucket").agg(F.sum("words").alias("w"))
    ranges = ranges.select("bucket", F.coalesce(F.sum("w").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket").orderBy("finish", F.col("source"), "copy", "doc_id", "_th").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("_inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(F.broadcast(ranges), "bucket")  # at most 65,537 ranges
    # Equal rows are numbered on both sides, so that each meets its own copies.
    same = Window.partitionBy("doc_id", "_th", "copy").orderBy("source", "ahead", "_inside")
    placed = placed.withColumn("_n", F.row_number().over(same)).select(
        F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), F.col("source").alias("_s"), "_n", "copy", "size", "words", "target", (F.col("ahead") + F.col("_inside")).cast("long").alias("position"))
    repeated = plan.groupBy("doc_id", "_th").count().where("count > 1").limit(1).count() > 0
    rows = docs.withColumn("_th", F.xxhash64(whole(F.col("text"))))
    rows = rows.withColumn("_m", F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy("source")) if repeated else F.lit(1))
    joined = rows.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")) & (F.col("_m") == F.col("_n")))
    cut_text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(blank_words(F.col("text")), 1, F.col("words").cast("int")), " ")).otherwise(F.col("text"))
    return joined.select(*((cut_text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns), *added)


def op3_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def sql_mix(source: str) -> str:
    w = f"[{', '.join(map(str, WEIGHTS))}]"
    blank = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    sized AS (SELECT doc_id, source, text, len(list_filter(string_split(translate(coalesce(text, ''), {blank}, '     '), ' '), lambda x: x <> '')) AS size,
              md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM {source}),
    per_source AS (SELECT *, {w}[1 + CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} AS INT)] AS weight
                   FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
    leveled AS (SELECT *, (sum(source_size) OVER () * CAST({BUDGET} AS DOUBLE) - {REPEATS} * coalesce(sum(source_size) OVER b, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM per_source
                WINDOW b AS (ORDER BY source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    target AS (SELECT source AS s, source_size, CAST(CASE WHEN weight * level > {REPEATS} * source_size THEN {REPEATS} * source_size
               ELSE weight * first_value(level) OVER (ORDER BY weight * level > {REPEATS} * source_size, source_size / weight, source IS NULL, encode(source)) END AS DOUBLE) AS target
               FROM leveled),
    placed AS (SELECT z.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, z.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
               FROM sized z JOIN target t ON z.source IS NOT DISTINCT FROM t.s),
    mixed AS (SELECT *, CAST({' + '.join(f'greatest(0, least(size, floor(target) - start - {c} * source_size))' for c in range(REPEATS))} AS BIGINT) AS taken FROM placed)"""


SQL = f"WITH {sql_mix('documents')} SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken FROM mixed"
