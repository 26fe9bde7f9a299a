import re

import pytest
from pyspark.sql import functions as F

from copyloom.llm.decontaminate import contamination, decontaminated, items_digest, judged, longest_matches, with_verdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if item_id is None else str(item_id))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), items_digest(list(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("blocks", [1, 3])
def test_whole_table(spark, middle, blocks):
    docs, items = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    expected = brute(*rows)
    assert any(r[5] for r in expected)
    if blocks == 1:
        assert result(contamination(docs, items)) == expected
        kept = decontaminated(docs, items)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in expected if not r[5])
    else:
        size = sum(len(t.encode()) for _, t in rows[1])
        found = with_verdict(judged(docs.select("doc_id", "text"), items, block_bytes=size // 3 + 1)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), items_digest(r["items"]), r.contaminated) for r in found), key=str) == expected


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_short_items_ties_nulls_and_borders(spark):
    items = [(1, "a"), (2, "a b"), (3, LONG), (3, LONG), (4, LONG.upper()), (None, "é-É"), (5, ""), (6, None), (7, "..."), (8, "a a a a a")]
    docs = [(1, "x a. b a"), (1, "x a. b a"), (2, None), (3, ""), (None, LONG), (4, "zero " + LONG + " " + LONG), (5, "É é"), (6, "é é-É")]
    docs += [(7, " ".join(LONG.split()[:12])), (8, " ".join(LONG.split()[2:])), (9, "a " * 50), (10, "w " * 300 + LONG), (11, LONG[:-3]), (12, "q " * 100_000)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).withColumn("items", F.lit("clash")).withColumn("n_hit", F.lit(1))
    assert result(contamination(frame, spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_words_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(i, w, None, None, None) for i, w in enumerate(LONG.split())], DOCS).coalesce(1)
    assert contamination(docs, spark.createDataFrame([(1, LONG)], ITEMS)).where("contaminated").count() == 0


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", None, None, None)], DOCS)
    assert contamination(docs, spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    assert result(contamination(some, items)) == brute([(1, "a b")], [])
    assert decontaminated(some, items).count() == 1


def test_longest_matches(spark):
    docs = {"1": "zero " + LONG + " end", "2": "six " + " ".join(LONG.split()[:14]), "3": " ".join(LONG.split()[1:14])}
    frame = spark.createDataFrame([(int(i), t, None, None, None) for i, t in docs.items()], DOCS).coalesce(1)
    found = [tuple(r) for r in longest_matches(frame, spark.createDataFrame([(9, LONG)], ITEMS)).collect()]
    assert found == [("1", 1, 15, "9", 0)]
    apart = [tuple(r) for r in longest_matches(frame.repartition(3, "doc_id").sortWithinPartitions("doc_id"), spark.createDataFrame([(9, LONG)], ITEMS)).collect()]
    for doc, word, n, _, at in apart:
        assert n >= 13 and words(docs[doc])[word : word + n] == words(LONG)[at : at + n]
    assert ("1", 1, 15, "9", 0) in apart


def test_periodic_items_take_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from copyloom.llm.decontaminate import _covered, _shards, benchmark_block

    items = [(f"i{k}", " ".join(["same"] * 300)) for k in range(20)] + [("short", "same same"), ("mixed", "same other " * 40)]
    test = benchmark_block(items)
    column = pa.array([" ".join(["same"] * 20_000), "same other " * 400, "nothing"], pa.string())
    tracemalloc.start()
    found = [(low, *_covered(shard)) for low, shard in _shards(column, test)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    (_, covered, docs, hit), = found
    assert covered.tolist() == [True] * 20_800 + [False]
    first = {test.ids[i] for d, i in zip(docs, hit, strict=True) if d == 0}
    assert first == {f"i{k}" for k in range(20)} | {"short"}
    assert {test.ids[i] for d, i in zip(docs, hit, strict=True) if d == 1} == {"mixed"}
    assert isinstance(covered, np.ndarray)
