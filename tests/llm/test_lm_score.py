"""The language model's tables and readings."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import lm_score

TEXTS = ["the sun and the moon", None, "the Sun", "", "a moon \n\t moon", "the the the sun 12 and x" * 30]


def test_one_reading_gives_subwords_and_the_base(spark, frame):
    encode, size = lm_score.encoder(lm_score.default_vocabulary())
    docs = frame(list(enumerate(TEXTS))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 2 == 0).alias("held_out"))
    counts = {r["h"]: r["n"] for r in lm_score.word_counts(docs.select("text")).collect()}
    hot_h = np.sort(np.array([h for h, n in counts.items() if n >= 3], np.int64).view(np.uint64))
    hot_n = np.array([counts[int(h)] for h in hot_h.view(np.int64)])
    got = {r["doc_id"]: r for r in lm_score.coded(docs, lm_score.default_vocabulary(), size + 1, spark.sparkContext.broadcast((hot_h, hot_n))).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        r, words = got[i], re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (np.frombuffer(r["ids"], np.uint16) == encode(t or "")).all() and r["n"] == len(encode(t or ""))
        assert r["held_out"] == (i % 2 == 0) and r["n_tokens"] == len(words) + 1 == r["hot_known"] + len(r["tail"])
        tail = sum(np.log10(counts[h] + 1) for h in r["tail"])
        plain = [w.lower() for s in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", s or "")]
        want = sum(np.log10(plain.count(w.lower()) + 1) for w in words) + np.log10(len(TEXTS) + 1)
        assert r["hot_sum"] + tail == pytest.approx(want)


def test_scores_do_not_read_the_texts_again(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(t):
        seen.add(1)
        return t

    docs = spark.range(40).select(F.col("id").alias("doc_id"), read(F.concat(F.lit("some words and number "), F.col("id").cast("string"))).alias("text"))
    assert lm_score.score_texts(docs, steps=1).count() == 40
    trains = sum(not r["held_out"] for r in lm_score.score_texts(docs.withColumn("text", F.lit("x")), steps=1).collect())
    assert seen.value <= 40 + 3 * trains  # words, then subwords of all texts, and two readings for passages


def test_neighbours_across_texts_are_not_counted():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 300, n) for n in (40, 0, 1, 7, 0, 300)]
    marks = np.arange(lm_score.MARKS)
    want = np.zeros((300, 2 * (lm_score.MARKS + 1)), np.int64)
    for t in texts:
        for a, b in zip(t[:-1], t[1:]):
            want[b, min(a, lm_score.MARKS)] += 1
            want[a, lm_score.MARKS + 1 + min(b, lm_score.MARKS)] += 1
    table = lm_score.beside(texts, marks, 300)
    assert (table == want).all() and (lm_score.beside(texts, marks, 300, table) == 2 * want).all()
    assert not lm_score.beside([], marks, 300).any() and not lm_score.beside([np.zeros(0, int)], marks, 300).any()


def test_projections_of_all_subwords_are_made_once():
    rng = np.random.default_rng(6)
    model = lm_score.train([rng.integers(0, 59, 300)], 60, steps=2)
    model.log_share = np.zeros(60)
    texts = [rng.integers(0, 59, n) for n in (0, 3, 47, 48, 200, 1000)]
    first = lm_score.window_scores(model, texts, 60)
    made = model.joined
    assert made.shape == (60, 3 * lm_score.WIDTH)
    assert lm_score.window_scores(model, texts[::-1], 60)[::-1] == pytest.approx(first, rel=1e-6) and model.joined is made


def test_a_pass_moves_as_adam_does():
    rng = np.random.default_rng(8)
    start = lm_score.train([rng.integers(0, 59, 300)], 60, steps=2)
    chunks = [rng.integers(0, 60, n) for n in (481, 481, 200, 2) for _ in range(4)]
    got, read = lm_score.refined(start, chunks, 60, 3)
    ids, following, weight = lm_score.windows_of(chunks, 59)
    p = {k: v.astype(np.float64) for k, v in start.p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = np.random.default_rng(3).permutation(len(ids))
    steps = -(-len(order) // lm_score.BATCH)
    for step in range(1, steps + 1):
        at = order[(step - 1) * lm_score.BATCH : step * lm_score.BATCH]
        _, g = lm_score.Attention(p, start.class_of).gradients(ids[at], start.class_of[following[at]], weight[at])
        on = np.unique(ids[at])
        for name, d in g.items():
            rows = on if name == "embed" else slice(None)
            first[name][rows] += 0.1 * (d[rows] - first[name][rows])
            second[name][rows] += 0.01 * (d[rows] ** 2 - second[name][rows])
            rate = lm_score.RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
            p[name][rows] -= rate / (1 - 0.9**step) * first[name][rows] / (np.sqrt(second[name][rows] / (1 - 0.99**step)) + 1e-7)
    assert steps > 2 and read.sum() == sum(len(c) - 1 for c in chunks)
    for name in p:
        assert got[name] == pytest.approx(p[name], abs=2e-4), name
