"""Lines that many documents repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.columns import BLANK, beside, hex_sha256, lower_az, whole, wide_hash
from tablecraft.llm.decontaminate import small
from tablecraft.llm.storage import cut

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line):
    return F.btrim(lower_az(line), F.lit(BLANK))


@beside(("doc_id", "text"), ("kept_text", "n_lines", "n_dropped"))
def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Adds kept_text, n_lines and n_dropped to the rows of `docs` (doc_id, text, ...).

    A line's key is the line without blanks at both ends and with A-Z lower-cased. A key of at least `min_chars` characters in at least
    `min_docs` different documents loses its lines everywhere except in the largest doc_id that holds it.

    Lines are exploded with their position, a key is counted by a 128-bit hash, and what goes comes back to its document as positions.
    A document sends each of its keys once, so keys meet as one small row per document; the count is combined before its shuffle. The
    dropped keys are written, then broadcast if they were counted to be few; otherwise their join can be split where a key is hot.

    A missing or empty text is one empty line. A document without doc_id keeps every line and counts as no document. Rows that repeat a
    doc_id count once and, where the texts differ, are treated each by its own lines. If every line goes, the text is empty. Columns of
    `docs` keep their values whatever their names; those named like an added one are replaced. An empty table gives an empty result.
    """
    lines = F.split(whole(F.col("text")), "\n")
    rows = docs.withColumn("_th", F.xxhash64("text"))
    numbered = F.filter(
        F.transform(lines, lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos"))),
        lambda s: F.char_length(s["key"]) >= min_chars,
    )
    keyed = rows.where("doc_id IS NOT NULL").select("doc_id", "_th", F.explode(numbered).alias("s"))
    keyed = keyed.select("doc_id", "_th", *wide_hash(F.col("s.key")), F.col("s.pos").alias("pos"))
    per_doc = keyed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    wide = per_doc.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    gone = keyed.join(small(cut(wide)), ["h1", "h2"]).where("doc_id <> keeper")
    gone = gone.groupBy("doc_id", "_th").agg(F.collect_set("pos").alias("_gone")).withColumnsRenamed({"doc_id": "_id", "_th": "_gth"})
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("_th") == F.col("_gth")), "left").withColumn("_lines", lines)
    n = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), whole(F.col("text"))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    return joined.select(
        *(f"`{c}`" for c in docs.columns), kept.alias("kept_text"), n.cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("_gone")), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("kept_text")).alias("kept_sha256"))


def sql_lines(source: str) -> str:
    """DuckDB: doc_id, n_lines, n_dropped, kept text of table `source`."""
    return f"""
    lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source})),
    keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    wide AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    marked AS (SELECT k.*, w.keeper IS NOT NULL AND w.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN wide w USING (key)),
    deduped AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)"""


SQL = f"WITH {sql_lines('documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
