"""Queries that hold approximate and out-of-fold results against exact ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions import sketches
from tablecraft.functions.columns import col
from tablecraft.functions.statistics import distinct_counts, quantiles, unpivoted
from tablecraft.operators import encoding, vector_index
from tablecraft.operators.profiling import local_rows
from tablecraft.plans.learning import hash_sql
from tablecraft.plans.tables import rounded, scratch, sql_view, table, view

PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)
WIDTHS, NAMES = ("n_chars", "n_words", "n_lines"), ("doc_id", "lang", "source", "text")
FOLDS, SMOOTHING = 5, 10.0


def _documents(spark, sf):
    """Sizes and identities of whole texts."""
    docs = table(spark, sf, "documents")
    words, lines = F.regexp_count("text", F.lit("[^ ]+")), F.size(F.split("text", "\n"))
    return docs.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text"), words.cast("bigint").alias("n_words"), lines.cast("bigint").alias("n_lines"))


def _merged(spark, docs):
    """States of four parts of the table, stored and merged from the files."""
    path = scratch(spark)
    for i in range(4):
        sketches.states(docs.where(F.pmod("doc_id", F.lit(4)) == i), WIDTHS, NAMES).write.mode("append").parquet(path)
    return sketches.merge(spark.read.parquet(path)).persist()


def sketch_quantiles(spark, sf):
    """Exact quantiles beside whether the estimate of merged states has a rank near enough."""
    docs = _documents(spark, sf).persist()
    exact = quantiles(docs, list(WIDTHS), list(PROBABILITIES))
    rows = local_rows(docs, [(c, p, float(v)) for c in WIDTHS for p, v in zip(PROBABILITIES, exact[c])], "column string, p double, exact double")
    found = sketches.quantile_estimates(_merged(spark, docs), PROBABILITIES)
    cells = unpivoted(docs, WIDTHS, lambda d, c: col(c).cast("double")).join(F.broadcast(local_rows(docs, list(enumerate(WIDTHS)), "position int, column string")), "position")
    ranks = cells.groupBy("column", "x").agg(F.count("*").alias("n")).join(F.broadcast(found), "column").groupBy("column", "p").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("x") < F.col("estimate"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("estimate"), F.col("n")).otherwise(0)).alias("upto"))
    near = sketches.rank_error() * 1.5
    ranks = ranks.select("column", "p", ((F.col("below") / F.col("all") - near <= F.col("p")) & (F.col("upto") / F.col("all") + near >= F.col("p"))).alias("near"))
    return rounded(rows.join(ranks, ["column", "p"]))


QUANTILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS p, round(quantile_cont({e}, {p}), 6) AS exact, true AS near FROM documents"
    for c, e in zip(WIDTHS, ("CAST(n_chars AS DOUBLE)", "CAST(len(regexp_extract_all(text, '[^ ]+')) AS DOUBLE)", "CAST(len(string_split(text, chr(10))) AS DOUBLE)")) for p in PROBABILITIES
)


def sketch_distinct(spark, sf):
    """Exact distinct counts beside whether the estimate of merged states is near enough."""
    docs = _documents(spark, sf).persist()
    near = F.abs(F.col("estimate") - F.col("n_unique")) <= F.greatest(F.col("n_unique") * sketches.distinct_error(), F.lit(1.0))
    both = distinct_counts(docs, NAMES).join(sketches.distinct_estimates(_merged(spark, docs)), "column")
    return both.select("column", F.col("n_unique").alias("exact"), near.alias("near"))


DISTINCT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS near FROM documents" for c in NAMES)


def target_encode_out_of_fold(spark, sf):
    df = view(spark, sf, "doc_features")
    fitted = encoding.target_mean_out_of_fold(df, ["doc_id"], ["source", "lang"], "quality", FOLDS, SMOOTHING)
    return rounded(fitted.transform(df).select("doc_id", *[col(c) for c in fitted.columns_out]))


OUT_OF_FOLD_SQL = f"""WITH d AS (SELECT *, {hash_sql('doc_id')} % {FOLDS} AS fold FROM {sql_view('doc_features')}),
p AS (SELECT f.fold, avg(d.quality) AS prior FROM (SELECT unnest(range({FOLDS})) AS fold) f JOIN d ON d.fold <> f.fold GROUP BY 1)
SELECT doc_id, {', '.join(f'''round((coalesce((SELECT sum(o.quality) FROM d o WHERE o.{c} = d.{c} AND o.fold <> d.fold), 0) + {SMOOTHING} * prior)
  / (coalesce((SELECT count(o.quality) FROM d o WHERE o.{c} = d.{c} AND o.fold <> d.fold), 0) + {SMOOTHING}), 6) AS {c}_target_oof''' for c in ('source', 'lang'))}
FROM d JOIN p USING (fold)"""


NEIGHBOURS = 5


def vector_index_recall(spark, sf):
    """Neighbours that the index finds for every fiftieth vector among all of them, and whether nine of ten of the exact ones are there."""
    points = table(spark, sf, "embeddings").select(col("vec_id").alias("id"), col("embedding").cast("array<double>").alias("vector"))
    queries = points.where("id % 50 = 0")
    index = vector_index.build(points)
    got = vector_index.recall(index, points, queries, NEIGHBOURS)
    found = index.search(queries, NEIGHBOURS)
    return found.groupBy().agg(F.count_distinct("query").alias("queries"), F.max("rank").cast("bigint").alias("neighbours"), F.lit(bool(got >= 0.9)).alias("found"))


RECALL_SQL = f"SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, {NEIGHBOURS}::BIGINT AS neighbours, true AS found FROM embeddings"


QUERIES = {
    "vector_index_recall": (vector_index_recall, RECALL_SQL),
    "sketch_quantiles": (sketch_quantiles, QUANTILE_SQL),
    "sketch_distinct": (sketch_distinct, DISTINCT_SQL),
    "target_encode_out_of_fold": (target_encode_out_of_fold, OUT_OF_FOLD_SQL),
}
