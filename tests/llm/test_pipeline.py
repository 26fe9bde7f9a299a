"""The pipeline against brute force, stage by stage, and its registration."""

import corpus_pipeline
from pyspark.sql import functions as F

from copyloom.llm import quality
from copyloom.session import cut

from . import test_decontaminate, test_jaccard, test_secrets
from .test_mixing import check


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_on_whole_tables(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert 4 <= len(names) <= 5

    good = cut(stages[names[0]](spark, docs, middle))
    model = quality.fit(docs, spark.read.parquet(f"{middle}/labels.parquet"))
    accepted = {r.doc_id for r in quality.scored(docs, model).where("predicted = 1").collect()}
    assert {i for i, _ in rows(good)} == accepted and 0 < len(accepted) < docs.count()

    single = cut(stages[names[1]](spark, good, middle))
    assert sorted(i for i, _ in rows(single)) == sorted({c for _, _, c in test_jaccard.brute(rows(good))})

    clean = cut(stages[names[2]](spark, single, middle))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{middle}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows(clean)) == sorted(r[0] for r in test_decontaminate.brute(rows(single), items) if not r[5])

    masked = cut(stages[names[3]](spark, clean, middle))
    assert dict(rows(masked)) == {i: test_secrets.masked(t) for i, t in rows(clean)}
    assert any(a != b for a, b in zip(sorted(rows(masked)), sorted(rows(clean)), strict=True))
    for step in (good, single, clean, masked):
        assert step.schema == docs.schema

    last = check(masked, stages[names[4]](spark, masked, middle))
    whole = corpus_pipeline.run(spark, middle).toPandas()
    by_id = lambda t: t.sort_values("doc_id").reset_index(drop=True)
    assert by_id(whole).equals(by_id(last))


def test_stages_survive_odd_rows(spark, small):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (2, "token = abcdefabcdefabcd x y z", "en", None, 9)]
    for table in (spark.createDataFrame(odd, columns), spark.createDataFrame([], columns)):
        docs = table.withColumn("row", F.lit("clash"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, small))
            assert docs.columns == [*table.columns, "row"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()
