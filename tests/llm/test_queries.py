"""What is registered, and the pipeline stage by stage."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_free import groups_of
from tests.llm.test_native import hits


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, sf_dir, docs, tmp_path):
    columns, at, kept = docs.columns, docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, sf_dir).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        kept[i] = at.collect()
        assert kept[i] and (i == 4 or at.columns == columns), name
    lines = [(r.doc_id, r.text) for r in kept[1]]
    assert {r.doc_id for r in kept[2]} == {c for _, _, c in groups_of(lines)}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {h[0] for h in hits([(r.doc_id, r.text) for r in kept[2]], items) if not h[-1]}
    assert {r.doc_id for r in kept[3]} == clean
    total = sum(len((r.text or "").split()) for r in kept[3])
    assert abs(sum(r.words for r in kept[4]) - 1.5 * total) <= len({r.source for r in kept[3]})


def test_pipeline_of_odd_rows(frame, spark, sf_dir):
    at = frame([(1, None), (2, ""), (3, "x y"), (4, "clean words stand here and there in a text that is long enough"), (4, "clean words stand here and there in a text that is long enough"), (None, None)])
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir)
    assert {r.doc_id for r in at.collect()} <= {4}
