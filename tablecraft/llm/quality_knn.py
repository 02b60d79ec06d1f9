"""Quality scores by the labels of similar documents in a latent semantic space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tablecraft.llm import text as T
from tablecraft.llm.columns import beside, kind, training_row

#: Terms: hashed three-byte sequences, sequences of four character kinds, and a few shares of repetition.
HASHED, KINDS = 3072, 6
TERMS = HASHED + KINDS**4 + 4
#: Labelled rows that the classifier is fitted on, at most; latent dimensions; neighbours that vote; power of similarity in a vote.
SAMPLE, RANK, NEIGHBOURS, SHARPNESS = 6_000, 96, 25, 6
CUT, PARTS, HELD = 0.3, 5, 0

_KIND = np.full(256, 5, np.uint8)  # other signs
_KIND[list(b" \t\n\x0b\f\r")] = 0
_KIND[list(range(97, 123)) + list(range(128, 256))] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[list(b".,;:'\"-()")] = 4


def term_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, past row, rows x TERMS counts) over whole texts, a slice at a time."""
    data, ends = T.column_bytes(texts)
    for i, j in T.slices(ends, 1 << 19):
        raw, at = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        rows, n = j - i, len(raw)
        for lo in range(0, rows, 256):  # many short rows: bound the dense matrix
            hi = min(rows, lo + 256)
            part, edges = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            yield i + lo, i + hi, _dense(part, edges)


def _dense(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    rows, n = len(ends) - 1, len(raw)
    out = np.zeros((rows, TERMS), np.float32)
    if n < 4:
        return out
    doc = np.repeat(np.arange(rows, dtype=np.int32), np.diff(ends))
    b = raw.astype(np.uint32)
    code = ((b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)) >> np.uint32(8)
    inside = doc[:-2] == doc[2:]
    cell = doc[:-2].astype(np.int64) * HASHED + code % np.uint32(HASHED)
    out[:, :HASHED] = np.bincount(cell[inside], minlength=rows * HASHED).reshape(rows, HASHED)
    kind = _KIND[raw].astype(np.int64)
    code = ((kind[:-3] * KINDS + kind[1:-2]) * KINDS + kind[2:-1]) * KINDS + kind[3:]
    inside, width = doc[:-3] == doc[3:], KINDS**4
    out[:, HASHED : HASHED + width] = np.bincount((doc[:-3].astype(np.int64) * width + code)[inside], minlength=rows * width).reshape(rows, width)
    words = T.split_words(raw, ends, T.BLANK_WORDS, True)
    n_words = np.maximum(np.diff(words.at), 1).astype(np.float32)
    h = words.hashes()
    same = np.bincount(words.doc[1:][(h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=rows) if len(h) else np.zeros(rows)
    out[:, -4] = 60 * same / n_words
    for column, k in ((-3, 1), (-2, 3)):
        pairs = T.runs(h, k)[T.within(words.doc, k)] ^ T.mix(words.doc[: max(0, len(h) - k + 1)][T.within(words.doc, k)].astype(np.uint64))
        owner = words.doc[: max(0, len(h) - k + 1)][T.within(words.doc, k)]
        _, first = np.unique(pairs, return_index=True)
        distinct = np.bincount(owner[first], minlength=rows)
        total = np.maximum(np.bincount(owner, minlength=rows), 1)
        out[:, column] = 30 * (1 - distinct / total)
    return out


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows of length 1 from counts, in place. One common term gives even an empty text a direction."""
    np.log1p(counts, out=counts)
    counts *= weight
    counts[:, -1] = 0.05
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return counts


@dataclass
class Voters:
    weight: np.ndarray  # of each term
    axes: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled rows x RANK, of length 1
    labels: np.ndarray
    prior: float

    def turn(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def place(self, counts: np.ndarray) -> np.ndarray:
        return self.turn(weighted(counts, self.weight))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Exact cosine products with all labelled rows, a block at a time; the most similar vote with the power of their similarity."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.place(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.clip(np.take_along_axis(near, best, 1), 1e-6, 1).astype(np.float64) ** SHARPNESS
        return np.clip((vote * self.labels[best]).sum(1) / vote.sum(1), 0, 1)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of all documents each term occurs; tasks send one row per term."""

    def count(batches):
        total = np.zeros(TERMS, np.int64)
        for batch in batches:
            for _, _, x in term_counts(batch.column(0)):
                total += (x > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS)), pa.array(total)], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, parts: int = PARTS, held: int = HELD) -> Voters:
    """Term weights from all documents; axes and voters from at most `sample` labelled rows outside the held-out fold, those with the
    smallest hash of their id."""
    frequency = document_frequencies(docs)
    n_docs = max(1.0, frequency.max())
    weight = (np.log((1 + n_docs) / (1 + frequency)) + 0.2).astype(np.float32)
    weight[-4:] = 1.0
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & training_row(F.col("doc_id"), parts, held))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")

    def vectors(batches):
        for batch in batches:
            ids, quality = batch.column(0), batch.column(2)
            for i, j, x in term_counts(batch.column(1)):
                kept = [zlib.compress(r.tobytes(), 1) for r in x]  # mostly zeros
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), quality.slice(i, j - i).cast(pa.int32()), pa.array(kept, pa.binary())], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(vectors, f"doc_id {kind(rows)}, quality int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(sample)
    kept = list(got.toLocalIterator())
    if not kept:
        return Voters(weight, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    y = np.array([r["quality"] for r in kept], float)
    x = np.empty((len(kept), TERMS), np.float32)
    for row, r in enumerate(kept):
        x[row] = np.frombuffer(zlib.decompress(r["x"]), np.float32)
    del kept
    x = weighted(x, weight)
    rank = min(RANK, len(x), TERMS)
    rng = np.random.default_rng(7)  # a randomised range finder with two power steps
    basis = np.linalg.qr(x.T @ (x @ rng.standard_normal((TERMS, rank), dtype=np.float32)))[0]
    for _ in range(2):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    voters = Voters(weight, basis.astype(np.float32), np.zeros((0, rank), np.float32), y, float(y.mean()))
    voters.vectors = voters.turn(x).astype(np.float32)
    return voters


@beside(("text",), ("score", "predicted"))
def score_quality(docs: DataFrame, voters: Voters, cut: float = CUT) -> DataFrame:
    """Adds score and predicted to the rows of `docs` (text, ...). Missing and empty texts get the score of the texts nearest to nothing;
    each row is scored by its text alone, so repeated rows agree. Without labelled rows every score is 0.5. Other
    columns stay, but those named like an added one are replaced; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)  # bounded: SAMPLE x RANK and TERMS x RANK numbers

    def score(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            out = np.zeros(batch.num_rows)
            for i, j, x in term_counts(texts):
                out[i:j] = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= cut).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, StructType([*docs.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op2_quality_knn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", (~training_row(F.col("doc_id"), PARTS, HELD)).alias("held_out"), "score", "predicted")
