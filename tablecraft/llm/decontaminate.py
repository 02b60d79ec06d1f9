"""Passages of benchmark items inside documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.columns import beside, grams, hex_sha256, let, plain_words, wide_hash
from tablecraft.llm.storage import cut

WINDOW, GRAM = 13, 7
#: A side of a join is broadcast only if it was counted to have at most so many rows of a few numbers; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The rows, marked for broadcast if a count allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fingerprints(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Winnowing: the smallest hash of the grams in each window of words, each once. Two texts that share `window` words share one."""
    width = window - gram + 1

    def lowest(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.array_min(F.slice(h, i, width))))).otherwise(F.array().cast("array<bigint>"))

    return let(grams(words, gram, lambda s: F.xxhash64(s)), lowest)


def windows(words: Column, length: int) -> Column:
    """(len, pos, h1, h2) of every `length` consecutive words."""
    n = F.size(words)
    at = F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.lit(length).alias("len"), i.alias("pos"), *wide_hash(F.slice(words, i + 1, length))))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, h1, h2, item_id) of all windows of all items; an item of fewer words is one window."""
    words = benchmark.select("item_id", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = F.array(F.struct(F.size("w").alias("len"), F.lit(0).alias("pos"), *wide_hash(F.slice("w", 1, window))))
    rows = words.select("item_id", F.explode(F.when(F.size("w") < window, short).otherwise(windows(F.col("w"), window))).alias("s"))
    return rows.select("s.len", "s.h1", "s.h2", "item_id").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, n_hit, items) for every document with a hit; k1 and k2 are a 128-bit hash of doc_id and text.

    Items shorter than a window are sought by a fingerprint of their whole length, one per length that occurs. Fingerprints of documents
    meet those of items; documents with a common one are read again and the hits extended to all their windows, compared by 128 bits of
    the words. Windows of items are reduced to distinct ones before they meet documents.
    """
    key = [c.alias(k) for c, k in zip(wide_hash(F.col("doc_id"), F.col("text")), ("k1", "k2"))]
    items = cut(item_windows(benchmark, window))
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # at most `window` numbers
    words = docs.select(*key, plain_words(F.col("text")).alias("w"))
    item_words = benchmark.select(plain_words(F.col("text")).alias("w"))

    def tagged(values: Column, n: int) -> Column:
        return F.transform(values, lambda v: F.xxhash64(F.lit(n), v))

    def marks(w: Column, own: bool) -> Column:
        """(length, fingerprint) pairs; an item is sought by its own length only."""
        parts = []
        for n in lengths:
            values = fingerprints(w, window, gram) if n == window else F.array_distinct(grams(w, n, lambda s: F.xxhash64(s)))
            if own:
                values = F.when(F.size(w) >= window if n == window else F.size(w) == n, values).otherwise(F.array().cast("array<bigint>"))
            parts.append(tagged(values, n))
        return reduce(F.concat, parts) if parts else F.array().cast("array<bigint>")

    sought = item_words.select(F.explode(let(F.col("w"), lambda w: marks(w, True))).alias("mark")).distinct()
    seen = words.select("k1", "k2", F.explode(let(F.col("w"), lambda w: marks(w, False))).alias("mark"))
    near = cut(seen.join(small(cut(sought)), "mark", "left_semi").select("k1", "k2").distinct())
    # Only documents that share a fingerprint are opened again.
    close = words.join(small(near), ["k1", "k2"], "left_semi")
    every = let(F.col("w"), lambda w: reduce(F.concat, [windows(w, n) for n in lengths])) if lengths else F.array().cast("array<struct<len:int,pos:int,h1:bigint,h2:bigint>>")
    spots = close.select("k1", "k2", F.explode(every).alias("s")).select("k1", "k2", "s.*")
    distinct = items.select("len", "h1", "h2").distinct()
    hits = cut(spots.join(small(distinct), ["len", "h1", "h2"], "left_semi").distinct())
    spans = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spans"))
    swept = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(x["pos"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], x["pos"] + x["len"]).alias("reach")),
    )["n"]
    named = hits.select("k1", "k2", "len", "h1", "h2").distinct().join(items, ["len", "h1", "h2"])
    named = named.select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return spans.select("k1", "k2", swept.cast("long").alias("n_hit")).join(named, ["k1", "k2"])


@beside(("doc_id", "text"), ("n_words", "n_hit", "items", "contaminated"))
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds n_words, n_hit, items and contaminated to the rows of `docs` (doc_id, text, ...).

    A word is hit if it lies inside an occurrence of an item's window; a document is contaminated if hits make up at least 5 % of its words.
    Missing, empty and blank texts have no words and no hits; items without words are sought nowhere; an item without id hits but is not
    listed. Repeated rows get the same result each. Without items nothing is hit. Columns of `docs` keep their values; those named like an
    added one are replaced.
    """
    hits = small(cut(find_hits(docs, benchmark, window, gram)))
    keyed = docs.withColumns(dict(zip(("k1", "k2"), wide_hash(F.col("doc_id"), F.col("text"))))).withColumn("_n", F.size(plain_words(F.col("text"))).cast("long"))
    joined = keyed.join(hits, ["k1", "k2"], "left").withColumns({"_hit": F.coalesce("n_hit", F.lit(0)), "_items": F.coalesce("items", F.array().cast("array<string>"))})
    return joined.select(
        *(f"`{c}`" for c in docs.columns), F.col("_n").alias("n_words"), F.col("_hit").cast("long").alias("n_hit"),
        F.col("_items").alias("items"), ((F.col("_hit") > 0) & (F.lit(20) * F.col("_hit") >= F.col("_n"))).alias("contaminated"),
    )


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
    )


def sql_decontaminated(source: str) -> str:
    letters = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{letters}')"
    return f"""
    dw AS (SELECT doc_id, {words} AS w FROM {source}),
    iw AS (SELECT item_id, {words} AS w FROM benchmark),
    item_spans AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
                   FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM iw WHERE len(w) > 0)),
    lens AS (SELECT DISTINCT n FROM item_spans),
    doc_spans AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
                  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
    hits AS (SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_spans d JOIN item_spans t USING (n, s)),
    words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY encode(t)) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id),
    decontaminated AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        coalesce(items, '') AS items, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN words_hit USING (doc_id) LEFT JOIN named USING (doc_id))"""


SQL = f"WITH {sql_decontaminated('documents')} SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, contaminated FROM decontaminated"
