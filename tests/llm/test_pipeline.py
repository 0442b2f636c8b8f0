from helpers import frame, odd_rows

import corpus_pipeline
from canopy.llm import common
from canopy.llm.queries import QUERIES


def test_stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == columns, name
        path = common.scratch(spark, "stage")
        new.write.parquet(path)
        new = spark.read.parquet(path)
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, new))
        assert after <= before
        if name == "quality classifier":
            lost = [d for d in before - after if labels.get(d) == 1]
            assert len(lost) <= 0.02 * len(before) and not [d for d in after if labels.get(d) == 0][20:]
        if name == "near duplicates":
            texts = [r.text for r in new.select("text").collect()]
            assert len(texts) == len(set(texts))
        docs = new
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.columns[0] == "doc_id" and pieces.count() >= docs.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "mixture", "sequences"]


def test_empty_and_odd_rows(spark, sf):
    for docs in (frame(spark, odd_rows()), frame(spark, odd_rows()).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_queries_are_numbered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


def test_native_plans_have_no_python(spark, sf):
    for name in ("op5_rules", "op8_licenses", "op10_mixing"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
