"""Columns of any name and type beside those an operator needs, and ids of other types."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablecraft.llm import conversations, decontaminate, fingerprints, jaccard_join, license_scan, line_dedup, lm_score, mixing, quality_knn, quality_rules, secret_scan, substring_dedup

LINE = "a line that is long enough to be counted as one that repeats"
PASSAGE = " ".join(f"word{i}" for i in range(30))
ROWS = [(i, f"{LINE}\nnumber {i} {PASSAGE} {i}") for i in range(6)] + [(6, None), (7, ""), (8, "all rights reserved here"), (8, "all rights reserved here")]
#: Names that operators add or use inside, one in other case, and one with signs.
NAMES = [
    "_th", "_id", "_gone", "_lines", "_gth", "k1", "k2", "_n", "_hit", "_items", "_keep", "_m", "_key", "bucket", "_upper", "_h", "_s", "th", "row", "node",
    "key", "n", "h1", "h2", "pos", "given column 0", "a `quoted` name", "a.b",
]


@pytest.fixture(scope="module")
def operators(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    bench = spark.createDataFrame([("b1", PASSAGE)], "item_id string, text string")
    return {
        "line dedup": (line_dedup.dedup_lines, ["kept_text", "n_lines", "n_dropped"]),
        "quality classifier": (lambda d: quality_knn.score_quality(d, quality_knn.fit(d, labels)), ["score", "predicted"]),
        "mixing": (lambda d: mixing.mixed_texts(d).where("copy = 0").orderBy("position"), ["copy", "size", "words", "target", "position"]),
        "license scan": (license_scan.scan, list(license_scan.ADDED)),
        "quality rules": (lambda d: quality_rules.judge(d, []), list(quality_rules.JUDGED)),
        "Jaccard join": (jaccard_join.one_of_each, []),
        "decontamination": (lambda d: decontaminate.decontaminate(d, bench), ["n_words", "n_hit", "items", "contaminated"]),
        "fingerprints": (fingerprints.add_fingerprints, ["fingerprint"]),
    }


def plain(rows, names):
    return sorted(repr([r[n] for n in names]) for r in rows)


@pytest.mark.parametrize("name", ["line dedup", "quality classifier", "mixing", "license scan", "quality rules", "Jaccard join", "decontamination", "fingerprints"])
def test_given_columns_stay_and_added_ones_replace(frame, operators, name):
    apply, added = operators[name]
    docs = frame(ROWS)
    expected = apply(docs)
    more = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES), F.create_map(F.lit("k"), F.col("doc_id")).alias("a map"))
    clashing = more.select("*", *(F.lit("mine").alias(a.upper() if i % 2 else a) for i, a in enumerate(added)))
    got = apply(clashing)
    assert got.columns == [*more.columns, *added]
    rows = got.collect()
    assert plain(rows, [*docs.columns, *added]) == plain(expected.collect(), expected.columns)
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES) and all(r["a map"] == {"k": r["doc_id"]} for r in rows)
    assert apply(clashing.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["line dedup", "quality rules", "Jaccard join", "decontamination", "mixing", "license scan", "fingerprints"])
def test_ids_as_texts(frame, operators, name):
    apply, added = operators[name]
    docs = frame(ROWS)
    got = apply(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert dict(got.dtypes)["doc_id"] == "string"
    if name != "mixing":  # a copy's position follows the text of the id in any case
        assert plain(got.withColumn("doc_id", F.col("doc_id").cast("long")).collect(), got.columns) == plain(apply(docs).collect(), got.columns)


@pytest.mark.parametrize("query", [substring_dedup.dedup_substrings, jaccard_join.jaccard_groups, secret_scan.scan_secrets, fingerprints.compare_edited])
def test_operators_with_tables_of_their_own_take_texts_as_ids_and_extra_columns(frame, query):
    docs = frame(ROWS)
    more = docs.select("*", *(F.lit("mine").alias(n) for n in NAMES if n != "row"), F.lit(1).alias("n_words"))
    got = query(more.withColumn("doc_id", F.col("doc_id").cast("string")))
    back = got.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "component_id", "next_id") if c in got.columns})
    names = [c for c in got.columns if c != "row"]  # the hash of a row
    assert plain(back.collect(), names) == plain(query(docs).collect(), names)


def test_language_model_takes_texts_as_ids(frame):
    docs = frame(ROWS)
    got = lm_score.score_texts(docs.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("n_tokens", F.lit(1)), sample=10, steps=2)
    assert dict(got.dtypes)["doc_id"] == "string" and got.count() == len(ROWS)


def test_maps_of_repeated_rows_are_compared(spark):
    rows = [(1, PASSAGE, {"a": 1}), (1, PASSAGE, {"a": 1}), (1, PASSAGE, {"a": 2})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    assert sorted(r.m["a"] for r in jaccard_join.one_of_each(docs).collect()) == [1, 2]


def test_conversation_repair_keeps_to_its_columns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Hi.")]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    more = talk.select("*", F.lit("x").alias("row"), F.lit("x").alias("audit"), F.lit("x").alias("cost"))
    assert conversations.repair_summaries(more).collect() == conversations.repair_summaries(talk).collect()
