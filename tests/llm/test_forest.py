import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from copyloom.llm import forest
from copyloom.llm.forest import HASHES, Bitmaps, _regions, least_linked, may_link, near_duplicates, parity, signatures

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, j in {p for h in holders.values() for p in combinations(h, 2)}:
        common = len(sets[i] & sets[j])
        if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    ids = [least.get(root(i)) if s else d for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
    return sorted(((d, len(s), c, None if d is None or c is None else d == c) for (d, _), s, c in zip(docs, sets, ids, strict=True)), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in docs], COLUMNS)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def family(rng, n, words, edits, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = rng.choice(vocabulary)
        yield " ".join(copy)


def mixed_docs(rng):
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c", "A b\tc", "a b c d e f g h i j", "a b c d e f g h i j k", "ä b c d e f g h"]
    for _ in range(12):
        texts += family(rng, rng.randrange(2, 40), rng.choice([8, 15, 40, 200]), 3, vocabulary)
    texts += [texts[20]] * 30
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 11, 30]))) for _ in range(60)]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [{}, {"region_rows": 2, "run_rows": 8, "block_rows": 3}])
def test_against_brute_force(spark, sizes):
    docs = mixed_docs(random.Random(21))
    assert result(near_duplicates(frame(spark, docs).repartition(5), **sizes)) == brute(docs)


def test_variants_that_only_their_base_links(spark):
    rng = random.Random(22)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(5, 115), 3):
            words[at] = f"v{k}-{at}"
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    assert result(near_duplicates(frame(spark, docs))) == brute(docs)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert result(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_ids_ties_and_columns(spark):
    long = " ".join(f"x{i}" for i in range(50))
    docs = [(5, long), (5, long), (None, long), (2, long + " y"), (None, None), (9, "z"), (None, "z"), (8, ""), (8, "")]
    table = frame(spark, docs).withColumn("node", F.lit("clash")).withColumn("number", F.lit(1)).withColumn("n", F.lit(7))
    assert result(near_duplicates(table)) == brute(docs)
    assert near_duplicates(frame(spark, [])).count() == 0
    assert result(near_duplicates(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]


def test_small_sets_link_only_with_equals():
    assert least_linked(85) == 6
    for n in range(1, 6):
        assert 100 * n < 85 * (n + 1)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (600, 300):
        a, b = np.sort(words[:1000]), np.sort(words[1000 - share : 2000 - share])
        rows = signatures([a, b])
        expected = share / (2000 - share)
        assert abs((rows[0] == rows[1]).mean() - expected) < 4 * (expected * (1 - expected) / HASHES) ** 0.5


def test_long_runs_come_out_at_full_depth():
    key = np.sort(np.repeat(np.arange(4), [3, 500, 1, 40])).astype(np.int64)
    rest = np.concatenate([[1, 2, 3], np.sort(np.arange(500) % 50), [5], np.sort(np.arange(40) << 32)]).astype(np.int64)
    rows = {"key": key, "rest": rest, "node": np.arange(544), "n": np.full(544, 9)}
    table = pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in rows.items()})
    for step in (544, 100, 7):
        parts = [table.slice(k, step) for k in range(0, 544, step)]
        found = pa.Table.from_batches(list(_regions(8, 64)(iter(parts)))).to_pandas()
        sizes = found.groupby("region").node.apply(len)
        together = found[found.node.isin([0, 1, 2])].region.nunique()
        assert together == 1 and sizes.max() == 10 and 503 not in found.node.tolist()
        assert found[(found.node >= 3) & (found.node < 503)].region.nunique() == 50


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    sets = [np.sort(words[a : a + n]) for a in range(0, 300, 7) for n in (20, 100, 505, 520, 2000)]
    bitmaps = Bitmaps([parity(s) for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets)), indexing="ij"))
    size = np.array([len(s) for s in sets])
    ok = may_link(size[i], size[j], bitmaps.differing(i, j), 85)
    linked = np.zeros(len(i), dtype=bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        linked[k] = 100 * common >= 85 * (len(sets[x]) + len(sets[y]) - common)
    assert (ok | ~linked).all()
    assert ok.sum() < 1.6 * linked.sum()


@pytest.mark.parametrize("plenty", [1000, 0])
def test_few_candidates_take_one_round(spark, monkeypatch, plenty):
    calls = []

    def counted(*args):
        calls.append(1)
        return confirmed(*args)

    confirmed = forest.confirmed
    monkeypatch.setattr(forest, "confirmed", counted)
    text = {i: " ".join(f"w{i}x{k}" for k in range(20)) for i in [*range(20), *range(100, 120), 500, 501]}
    text[119] = text[500] = text[19]
    texts = spark.createDataFrame(list(text.items()), "number long, text string")
    together = spark.createDataFrame([(i, i // 100 * 100) for i in [*range(20), *range(100, 120)]], "node long, component long")
    pairs = [(a, b) for a in range(20) for b in range(100, 120)] + [(19, 500), (0, 501)]
    candidates = spark.createDataFrame(pairs, "a long, b long")
    out = forest.settled(candidates, together, texts, 3, 85, plenty)
    found = sorted((r.node, r.component) for r in out.collect())
    assert found == [(i, 0) for i in [*range(20), *range(100, 120), 500]]
    assert (len(calls) == 1) == (plenty == 1000)
