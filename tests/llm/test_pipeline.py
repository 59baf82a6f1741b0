"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from terrashift.llm import decontaminate, near_dedup, toxicity

DATA = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, DATA), "test-stage")
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(kept["mix"]) == set(kept["decontaminate"]) < set(kept["near_dedup"]) < set(kept["toxicity"])
    assert near_dedup.near_groups(docs.dropDuplicates(["doc_id"])).where("not kept").count() == 0
    assert decontaminate.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in last) == sorted(kept["mix"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "tokens"]
    assert toxicity.ToxicSpec().rows == 10_000
    assert corpus_pipeline.run(spark, DATA).count() == len(last)


ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, rank int, component_id bigint"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", s, None, 0.5, False, k, 9) for k, (i, t, s) in enumerate(rows)], ODD_SCHEMA)


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns named like results pass through the stages."""
    some = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, "a"), (2, "", None), (3, "  ", "b"), (None, some, "a"), (None, None, None), (4, some, "a"), (4, some, "a"), (5, some + " end", "b"), (6, "word " * 200_000, "c")]
    docs = odd_docs(spark, rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        got = corpus_pipeline.cut(out, "odd-stage")
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in got.collect())
        docs = got if name != "mix" else docs
    everything = sorted((i is None, i or 0, len(t or "")) for i, t, _ in rows)
    assert kept["toxicity"] == everything
    # Document 5 repeats document 4, whose two rows are one document; rows without an id stay.
    assert kept["near_dedup"] == [r for r in everything if r[:2] != (False, 5)]
    assert kept["decontaminate"] == kept["near_dedup"]
    assert set(kept["mix"]) == set(kept["near_dedup"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(last) == len(kept["near_dedup"]) and min(r.start for r in last) == 0


def test_stages_on_an_empty_table(spark):
    docs = odd_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0 and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 0
