"""Long word sequences that occur in more than one document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecraft.llm import text as T
from tablecraft.llm.columns import kind

U = np.uint64
WINDOW = 13
#: Words of an anchor: each edge (a window of words) is found by the smallest hash among the anchors inside it.
ANCHOR = 4
#: A path is cut at an anchor whose hash is a multiple of this, so paths have about so many anchors.
PATH = 16


def anchor_of_edges(w: T.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each edge (window) its position and the position of its anchor; edges lie inside one row."""
    inside = np.flatnonzero(T.within(w.doc, window))
    if not len(inside):
        return inside, inside
    a = T.runs(h, ANCHOR)
    return inside, T.sliding_min_at(a, window - ANCHOR + 1)[inside]


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id): the anchors of each row, each once."""

    def work(batches):
        for batch in batches:
            for i, j, w in T.word_slices(batch.column(1), T.BLANK_WORDS, False):
                h = w.hashes()
                _, at = anchor_of_edges(w, h, window)
                at = np.unique(at)
                value, doc = T.runs(h, ANCHOR)[at] if len(at) else np.zeros(0, np.uint64), w.doc[at] if len(at) else np.zeros(0, np.int64)
                order = np.lexsort((value, doc))
                value, doc = value[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), batch.column(0).slice(i, j - i).take(pa.array(doc[new]))], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(work, f"anchor long, doc_id {kind(docs)}")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """The rows (anchor, doc_id) of anchors that more than one document has. Spark sorts by anchor; a task reads its share in order and
    keeps two rows, so a hot anchor is never held."""

    def work(batches):
        tail = None  # the last row, not handed on yet, and whether its anchor is known to be repeated
        for batch in batches:
            ids = batch.column(1).type
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)]
            value, doc = now if tail is None else [np.concatenate([a, b]) for a, b in zip(tail, now)]
            step = np.zeros(len(value) + 1, bool)  # whether row i and row i - 1 are one anchor in two documents
            step[1:-1] = (value[1:] == value[:-1]) & (doc[1:] != doc[:-1])
            start = 0 if tail is None else 1
            stop = max(start, len(value) - 1)
            good = (step[:-1] | step[1:])[start:stop]
            yield pa.RecordBatch.from_arrays([pa.array(value[start:stop][good]), pa.array(doc[start:stop][good], ids)], ["anchor", "doc_id"])
            tail = [value[-2:], doc[-2:]] if len(value) > 1 else [np.r_[value ^ np.int64(1), value], np.r_[doc, doc]]
        if tail is not None and len(tail[0]) > 1 and tail[0][0] == tail[0][1] and tail[1][0] != tail[1][1]:
            yield pa.RecordBatch.from_arrays([pa.array(tail[0][1:]), pa.array(tail[1][1:], ids)], ["anchor", "doc_id"])

    return rows.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(work, f"anchor long, doc_id {kind(rows)}")


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, row, body): texts compressed for the shuffles that they take part in; row numbers rows of one doc_id by their text."""

    def work(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = pa.array([squeeze.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], ["doc_id", "row", "body"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(work, f"doc_id {kind(docs)}, row long, body binary")


def unpack(column: pa.Array) -> pa.Array:
    open_up = zstandard.ZstdDecompressor()
    return pa.array([open_up.decompress(b) for b in column.to_pylist()], pa.large_binary())


def lists(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and rows of a slice of a list column, missing lists empty."""
    part = column.slice(i, j - i)
    part = pa.concat_arrays([part]) if part.offset else part
    sizes = np.nan_to_num(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False)).astype(np.int64)
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(j - i), sizes)


def paths(packed: DataFrame, window: int) -> DataFrame:
    """(p1, p2, doc_id, row, start, edges) from rows (doc_id, row, body, anchors): runs of consecutive edges with repeated anchors, cut
    where the anchor changes to one that ends paths. p1 and p2 hash all words of the path."""

    def work(batches):
        for batch in batches:
            texts = unpack(batch.column(2))
            for i, j, w in T.word_slices(texts, T.BLANK_WORDS, False):
                h = w.hashes()
                edge, at = anchor_of_edges(w, h, window)
                known, owner = lists(batch.column(3), i, j)
                if not len(edge) or not len(known):
                    continue
                value = T.runs(h, ANCHOR)[at]
                tag = lambda v, d: T.mix(v ^ T.mix(d.astype(np.uint64) + U(1)))  # noqa: E731  an anchor of one row
                used = np.isin(tag(value, w.doc[edge]), tag(known.view(np.uint64), owner))
                edge, value, at = edge[used], value[used], at[used]
                if not len(edge):
                    continue
                new = np.ones(len(edge), bool)
                new[1:] = (edge[1:] != edge[:-1] + 1) | (w.doc[edge[1:]] != w.doc[edge[:-1]]) | ((at[1:] != at[:-1]) & (value[1:] % U(PATH) == 0))
                first = np.flatnonzero(new)
                many = np.diff(np.r_[first, len(edge)])
                s, n = edge[first], many + window - 1
                hashes = []
                for kind in ("one", "two"):
                    up, down = T.powers(kind, len(h) + 1)
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(h * up[: len(h)], out=total[1:])
                    hashes.append(T.mix((total[s + n] - total[s]) * down[s] + n.astype(np.uint64)).view(np.int64))
                own = pa.array(w.doc[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[0]), pa.array(hashes[1]), *(batch.column(c).slice(i, j - i).take(own) for c in (0, 1)), pa.array((s - w.at[w.doc[s]]).astype(np.int32)), pa.array(many.astype(np.int32))],
                    ["p1", "p2", "doc_id", "row", "start", "edges"])

    return packed.select("doc_id", "row", "body", "anchors").mapInArrow(work, f"p1 long, p2 long, doc_id {kind(packed)}, row long, start int, edges int")


def spans(column: pa.Array, i: int, j: int, row: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, edges and row index of a slice of a list column of (row, start, edges), as far as they belong to that very row."""
    part = column.slice(i, j - i)
    part = pa.concat_arrays([part]) if part.offset else part
    sizes = np.nan_to_num(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False)).astype(np.int64)
    owner = np.repeat(np.arange(j - i), sizes)
    entry = part.flatten()
    own, start, many = (entry.field(c).to_numpy(zero_copy_only=False) for c in range(3))
    mine = own == row.slice(i, j - i).to_numpy(zero_copy_only=False)[owner]
    return start[mine].astype(np.int64), many[mine].astype(np.int64), owner[mine]


def short(h: np.ndarray) -> np.ndarray:
    return (h >> U(32)).astype(np.uint32).view(np.int32)


def edges_of(opened: DataFrame, window: int) -> DataFrame:
    """(e1, e2, doc_id) of the different edges of the paths in rows (doc_id, row, body, paths)."""

    def work(batches):
        for batch in batches:
            texts = unpack(batch.column(2))
            for i, j, w in T.word_slices(texts, T.BLANK_WORDS, False):
                start, many, owner = spans(batch.column(3), i, j, batch.column(1))
                if not len(start):
                    continue
                h = w.hashes()
                at = np.repeat(w.at[owner] + start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                e1 = T.runs(h, window)[at]
                _, first = np.unique(e1 ^ T.mix(w.doc[at].astype(np.uint64) + U(1)), return_index=True)
                at, e1 = at[first], e1[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(e1.view(np.int64)), pa.array(short(T.runs(h, window, "two")[at])), batch.column(0).slice(i, j - i).take(pa.array(w.doc[at]))], ["e1", "e2", "doc_id"])

    return opened.select("doc_id", "row", "body", "paths").mapInArrow(work, f"e1 long, e2 int, doc_id {kind(opened)}")


def finish(marked: DataFrame, window: int, texts_out: bool) -> DataFrame:
    """Removes the covered words from rows (doc_id, row, body, paths, edges): those of whole paths, and of every edge with a listed hash."""

    def work(batches):
        for batch in batches:
            texts = unpack(batch.column(2))
            for i, j, w in T.word_slices(texts, T.BLANK_WORDS, False):
                gone = np.zeros(len(w.doc), bool)
                start, many, owner = spans(batch.column(3), i, j, batch.column(1))
                if len(start):
                    gone |= T.covered(w.at[owner] + start, many + window - 1, len(w.doc))
                listed, owner = lists(batch.column(4), i, j)
                if len(listed):
                    edge = np.flatnonzero(T.within(w.doc, window))
                    tag = lambda v, d: v ^ T.mix(d.astype(np.uint64) + U(1))
                    edge = edge[np.isin(tag(T.runs(w.hashes(), window)[edge], w.doc[edge]), tag(listed.view(np.uint64), owner))]
                    gone |= T.covered(edge, np.full(len(edge), window), len(w.doc))
                n, lost = np.diff(w.at), np.bincount(w.doc[gone], minlength=j - i)
                kept = ~gone
                # The kept words of all rows side by side, one blank after each, copied bytewise.
                size = (w.past - w.first)[kept] + 1
                out = np.full(int(size.sum()), 32, np.uint8)
                place, body = np.cumsum(size) - size, size - 1
                step = np.arange(body.sum()) - np.repeat(np.cumsum(body) - body, body)
                out[np.repeat(place, body) + step] = w.data[np.repeat(w.first[kept], body) + step]
                ends = np.r_[0, np.cumsum(np.bincount(w.doc[kept], size, minlength=j - i).astype(np.int64))]
                rows = [out[s : max(s, e - 1)].tobytes() for s, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(n), pa.array(lost), pa.array([hashlib.sha256(r).hexdigest() for r in rows]),
                    pa.array([r.decode() if texts_out else None for r in rows], pa.string())], ["doc_id", "row", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return marked.select("doc_id", "row", "body", "paths", "edges").mapInArrow(
        work, f"doc_id {kind(marked)}, row long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, texts_out: bool = True) -> DataFrame:
    """doc_id, row (hash of the text), n_words, n_removed, kept_sha256 and kept_text of every row of `docs` (doc_id, text, ...).

    Windows of `window` words are the edges of a De Bruijn graph. An edge is first found by an anchor, the smallest hash among the four-word
    sequences inside it; equal edges have equal anchors, and only every fifth word starts one. Edges whose anchor occurs in one document
    alone are not repeated and go no further. Consecutive other edges compact into paths, cut at places that the words decide, and equal
    paths meet in a join: a path whose words start in a document with a smaller id goes as a whole, without looking at its edges. Only the
    first document of each path opens it; its edges meet those of all other different paths, and those that start in a smaller document
    come back to be marked in the text. Paths are compared by 128 bits of their words, edges by 96.

    Texts are compressed and dealt by doc_id once; all three joins that need them read that exchange.

    Missing, empty and blank texts have no words. A row without doc_id keeps all its words and takes none from others. Rows that repeat a
    doc_id do not take words from each other. Other columns of `docs` are not read. Ids may be
    numbers or texts. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    packed = pack(docs)
    repeated = repeated_anchors(anchors(known, window)).groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    found = paths(packed.join(repeated, "doc_id", "left").where("anchors IS NOT NULL"), window)
    owner = found.groupBy("p1", "p2").agg(F.min("doc_id").alias("owner"))
    owned = found.join(owner, ["p1", "p2"])
    path = F.struct("row", "start", "edges")
    opened = owned.where("doc_id = owner").groupBy("doc_id").agg(F.collect_list(path).alias("paths"))
    edges = edges_of(packed.join(opened, "doc_id", "left").where("paths IS NOT NULL"), window)
    again = edges.withColumn("least", F.min("doc_id").over(Window.partitionBy("e1", "e2"))).where("doc_id > least")
    whole = owned.where("doc_id > owner").select("doc_id", path.alias("path"), F.lit(None).cast("long").alias("edge"))
    again = again.select("doc_id", F.lit(None).cast("struct<row:bigint,start:int,edges:int>").alias("path"), F.col("e1").alias("edge"))
    gone = whole.unionByName(again).groupBy("doc_id").agg(F.collect_list("path").alias("paths"), F.collect_list("edge").alias("edges"))
    return finish(packed.join(gone, "doc_id", "left"), window, texts_out)


def op4_substring_dedup(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs, texts_out=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


_B = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH dw AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), {_B}, '     '), ' '), lambda x: x <> '') AS w FROM documents),
spans AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM dw WHERE len(w) >= {WINDOW})),
firsts AS (SELECT md5(s) AS m, min(doc_id) AS least FROM spans GROUP BY m HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM spans JOIN firsts ON m = md5(s) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
kept AS (SELECT doc_id, count(*) AS n_removed_not, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_removed_not, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)"""
