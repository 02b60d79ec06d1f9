"""Document fingerprints against a plain version, exact overlaps and odd tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablecraft.llm import fingerprints as P

EMPTY = hashlib.sha256(b"").hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str) -> set[tuple[str, ...]]:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def chained(parts, seed: int = 42) -> int:
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed=seed)
    return signed(seed)


def long_bytes(n: int) -> bytes:
    return (n % 2**64).to_bytes(8, "little")


def int_bytes(n: int) -> bytes:
    return (n % 2**32).to_bytes(4, "little")


def plain_fingerprint(text: str) -> str:
    """The same method, bin by bin."""
    hashes = {chained(w.encode() for w in s) for s in shingles(text)}
    if not hashes:
        return ""
    bins: list[int | None] = [None] * P.BINS
    for h in hashes:
        b = (h >> 56) + P.BINS // 2
        bins[b] = h if bins[b] is None else min(bins[b], h)
    bits = []
    for b, h in enumerate(bins):
        if h is None:
            asked = [chained((int_bytes(b), int_bytes(t))) % P.BINS for t in range(P.PROBES)]
            h = next((bins[a] for a in asked if bins[a] is not None), None)
            if h is None:
                h = min((chained((int_bytes(b), long_bytes(x >> 56))), x) for x in bins if x is not None)[1]
            bits.append(chained((long_bytes(h), int_bytes(b))) % 2**P.BITS)
        else:
            bits.append(h % 2**P.BITS)
    words = [sum(v << P.BITS * k for k, v in enumerate(bits[i : i + P.PER_WORD])) for i in range(0, P.BINS, P.PER_WORD)]
    return "".join(f"{w:016x}" for w in words)


def plain(rows) -> dict:
    """doc_id -> (n_chars, sha of the edited text, edited text, next id), for different ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        j, other = rows[(k + 1) % len(rows)]
        third = len(t) // 3
        edited = t[: len(t) - third] + other[:third]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, j)
    return out


def test_query_equals_the_plain_version(spark, docs, texts):
    got = P.op13_fingerprints(docs).collect()
    want = plain(texts.items())
    assert len(got) == len(want)
    errors = []
    for r in got:
        n, sha, edited, j = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.next_id) == (n, sha, j)
        assert r.fingerprint == plain_fingerprint(texts[r.doc_id] or "") and r.edited_fingerprint == plain_fingerprint(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [r.near_edited - jaccard(texts[r.doc_id] or "", edited), r.near_next - jaccard(texts[r.doc_id] or "", texts[j] or "")]
    errors = np.array(errors)
    assert np.abs(errors).mean() < 0.04 and np.abs(errors).max() < 0.25


def test_estimates_are_not_biased(spark, frame):
    """Overlaps from 0 to 1 at several sizes, also with far fewer shingles than bins."""
    rng, rows, true = np.random.default_rng(5), [], {}
    for i in range(240):
        n, share = (12, 60, 400)[i % 3], i / 239
        a = [f"w{v}" for v in rng.integers(0, 10**9, n)]
        b = a[: round(n * share)] + [f"v{v}" for v in rng.integers(0, 10**9, n - round(n * share))]
        rows.append((i, " ".join(a), " ".join(b)))
        true[i] = jaccard(rows[-1][1], rows[-1][2])
    pairs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    got = pairs.select("doc_id", P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))).alias("j")).collect()
    for part in range(3):
        error = np.array([r.j - true[r.doc_id] for r in got if r.doc_id % 3 == part])
        assert abs(error.mean()) < 0.03 and error.std() < (0.16, 0.09, 0.06)[part]


def test_odd_rows(frame):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "a"), (5, "one two three"), (4, "ÄÖ " * 4), (3, "x" * 10), (2, "Same words stand HERE again and again"), (1, "same WORDS stand here again and again")]
    got = {r.doc_id: r for r in P.op13_fingerprints(frame(rows)).collect()}
    want = plain(rows)
    for i, (n, sha, edited, j) in want.items():
        assert (got[i].n_chars, got[i].edited_sha256, got[i].next_id) == (n, sha, j)
        assert got[i].edited_fingerprint == plain_fingerprint(edited)
    assert got[9].fingerprint == got[8].fingerprint == got[7].fingerprint == "" and got[9].edited_sha256 == EMPTY
    assert got[9].near_next == 1 and got[7].near_next == 0 and got[9].near_edited == 1
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1


def test_repeated_rows_ties_and_missing_ids(frame):
    rows = [(3, "c " * 30), (3, "c " * 30), (3, "other text of the same number"), (1, "a b c d e f g"), (None, "no number at all in this row"), (None, None)]
    got = P.compare_edited(frame(rows)).collect()
    assert len(got) == 6
    same = [r for r in got if r.doc_id == 3 and r.n_chars == 60]
    assert len(same) == 2 and same[0] == same[1]
    by = {(r.doc_id, r.n_chars): r.next_id for r in got}
    assert by[(1, 13)] is None and sorted(str(v) for v in by.values()) == ["1", "3", "3", "None", "None"]
    alone = P.compare_edited(frame([(1, "abcdef")])).first()
    assert (alone.next_id, alone.edited_text) == (1, "abcdab")


def test_nothing_and_a_very_long_text(frame):
    assert P.op13_fingerprints(frame([])).count() == 0
    long = "".join(f"word{i % 977} " for i in range(300_000))
    got = {r.doc_id: r for r in P.op13_fingerprints(frame([(1, long), (2, "short text")])).collect()}
    assert got[1].n_chars == len(long) and got[1].fingerprint == plain_fingerprint(long)


@pytest.mark.parametrize("name", ["fingerprint", "k1", "take", "next_id", "gift", "a`b", "n_chars"])
def test_other_columns(frame, spark, name):
    from tablecraft.functions.columns import quote

    rows = frame([(i, f"text number {i} of a few") for i in range(6)]).withColumn(name, F.create_map(F.lit("x"), F.lit(1)))
    assert P.compare_edited(rows).count() == 6
    added = P.add_fingerprints(rows)
    assert added.columns.count("fingerprint") == 1 and added.select(F.col(quote(name))).count() == 6


def test_text_ids(spark):
    rows = spark.createDataFrame([(c, f"text {c}") for c in "abc"], "doc_id string, text string")
    assert {(r.doc_id, r.next_id) for r in P.compare_edited(rows).collect()} == {("c", "b"), ("b", "a"), ("a", "c")}


def test_texts_are_shuffled_once_and_no_python_runs(docs):
    plan = P.op13_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    with_text = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(k1#\d+L, k2#\d+L", line)]
    assert with_text
