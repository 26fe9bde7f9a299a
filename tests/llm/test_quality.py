import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from copyloom.llm import wordhash
from copyloom.llm.quality import STATISTICS, Rule, accepted, fit, fit_rules, scored, statistics_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def stats(texts):
    import pyarrow as pa

    return statistics_of(*wordhash.buffers(pa.array(texts, pa.string())))


def test_statistics():
    rows = stats(["the the cat ÉÉ!\nA1", "", None, "  \n"])
    row = dict(zip(STATISTICS, rows[0], strict=True))
    assert row["words"] == pytest.approx(np.log1p(5)) and row["chars"] == pytest.approx(np.log1p(18))
    assert row["repeated_words"] == 0.2 and row["distinct_words"] == 0.8 and row["beyond_ascii_share"] == pytest.approx(2 / 18)
    assert row["upper_share"] == pytest.approx(1 / 18) and row["words_a_line"] == 2.5
    assert not rows[1].any() and not rows[2].any()


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 7] <= 0.7)).astype(float)
    model = fit_rules(x, y)
    new = rng.random((2000, len(STATISTICS)))
    truth = (new[:, 3] > 0.4) & (new[:, 7] <= 0.7)
    assert ((model.scores(new) >= 0.5) == truth).mean() > 0.95
    assert str(Rule(((0, True, 1.0), (1, False, 2.0)))) == "chars > 1 and words <= 2"


def test_held_out_accuracy_and_compiled_column(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    out = scored(docs, model)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.98
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    auc = (good.values[:, None] > bad.values[None, :]).mean() + 0.5 * (good.values[:, None] == bad.values[None, :]).mean()
    assert auc > 0.99
    assert set(rows.doc_id) == {i for i in rows.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    some = docs.orderBy("doc_id").limit(50).collect()
    by_hand = model.scores(stats([r.text for r in some]))
    there = {r.doc_id: r.score for r in out.where("doc_id < 1000").collect()}
    assert [there[r.doc_id] for r in some] == pytest.approx(list(by_hand))


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_nulls_ties_and_long_texts(spark):
    rows = [(i, "good words in a row " * 3, "en", "s", 1) for i in range(60)] + [(100 + i, "### $$$ " * 9, "en", "s", 1) for i in range(60)]
    rows += [(None, None, None, None, None), (7, "", "x", "x", 0), (7, "", "x", "x", 0), (8, "ok " * 200_000, "x", "x", 0)]
    docs = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("stats", F.lit(1)).withColumn("quality", F.lit(5))
    labels = [(i, 1, 0) for i in range(60)] * 2 + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, None), (5, None, None), (999, 1, 1)]
    model = fit(docs.drop("quality"), spark.createDataFrame(labels, LABELS))
    out = scored(docs, model).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and out.held_out[out.doc_id.isna()].all()
    assert out.predicted[out.doc_id.between(100, 200)].eq(0).all() and out.predicted[out.doc_id.between(10, 59)].eq(1).all()
    assert accepted(docs, model).columns == docs.columns


def test_labels_of_one_class_or_none(spark):
    docs = frame(spark, [(i, f"text {i}", None, None, None) for i in range(30)])
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in scored(docs, fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    assert {r.predicted for r in scored(docs, fit(docs, ones)).collect()} == {1}
    empty = frame(spark, [])
    assert scored(empty, fit(empty, ones)).count() == 0
