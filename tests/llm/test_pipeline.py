"""The pipeline, stage by stage, and the registered queries."""

import corpus_pipeline
from noctua.llm import queries

import __spark_entry__

DATA = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = queries.table(spark, DATA, "documents")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        n.append(docs.count())
    assert n[0] > n[1] > n[2] > n[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    rows = last.collect()
    assert len(rows) == docs.count() and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def test_stages_take_odd_rows(spark, odd):
    base = queries.table(spark, DATA, "documents")
    docs = odd.select(*base.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert docs.columns == base.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
