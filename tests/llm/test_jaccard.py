import random
import re
import tracemalloc
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from copyloom.llm.components import components
from copyloom.llm.jaccard import TOKEN, _blocks, _joined, first_of_each, group_pairs, near_duplicates

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = {p for h in holders.values() for p in combinations(h, 2)}
    for i, j in seen:
        common = len(sets[i] & sets[j])
        if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in docs], COLUMNS)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def family(rng, n, words, edits, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        yield " ".join(copy)


@pytest.mark.parametrize("run_rows", [20_000, 20])
def test_families_passages_and_chains(spark, run_rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    docs = [t for n, words, edits in ((60, 120, 6), (40, 60, 4), (30, 200, 12), (5, 40, 1)) for t in family(rng, n, words, edits, vocabulary)]
    docs += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))) for _ in range(80)]
    chain = [rng.choice(vocabulary) for _ in range(100)]
    docs += [" ".join(chain[i : i + 60]) for i in range(0, 40, 4)]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    assert result(near_duplicates(frame(spark, docs), run_rows=run_rows)) == brute(docs)


def test_nulls_ties_and_long_texts(spark):
    docs = [(1, None), (2, ""), (2, " \n"), (3, "one two"), (4, "One TWO"), (4, "one two"), (None, "one\ttwo"), (None, "alone here"), (5, "É a"), (6, "é a")]
    docs += [(9, "x " * 100_000), (8, "x " * 50), (7, "x x x x"), (20, " ".join(map(str, range(30_000)))), (10, " ".join(map(str, range(29_000))))]
    df = frame(spark, docs).withColumn("n", F.lit("clash")).withColumn("node", F.lit("clash")).withColumn("group", F.lit(1))
    assert result(near_duplicates(df)) == brute(docs)
    kept = first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 2, 3, None, 5, 6, 8, 7, 10], key=str)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0 and first_of_each(frame(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def token_rows(components):
    n = len(components)
    columns = ([7] * n, range(n), [100] * n, [0] * n, components)
    return pa.RecordBatch.from_pydict({c: pa.array(list(x), pa.int64()) for c, x in zip(TOKEN, columns, strict=True)})


def test_run_of_a_family_stays_small():
    batch = token_rows([1] * 6000 + [2, 2, 3])
    tracemalloc.start()
    found = [tuple(sorted(p)) for out in _joined(75, 20_000)(iter([batch])) for p in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == sorted([(i, j) for i in range(6000) for j in (6000, 6001, 6002)] + [(6000, 6002), (6001, 6002)])
    assert peak < 100 << 20


@pytest.mark.parametrize("run_rows", [20_000, 50])
def test_long_runs_pair_components(spark, run_rows):
    rng = random.Random(9)
    components = [1] * 150 + [2] * 120 + [rng.randrange(3, 90) for _ in range(170)]
    rows = [(7, i, 100, 0, c) for i, c in enumerate(components)] + [(8, 1000 + i, 100, 0, 5) for i in range(200)]
    tokens = spark.createDataFrame(rows, "token long, group long, n long, place int, component long")
    found = sorted(tuple(r) for r in group_pairs(tokens, 75, run_rows).collect())
    assert found == sorted((i, j) for i, j in combinations(range(len(components)), 2) if components[i] != components[j])


def test_blocks_leave_out_pairs_inside_a_component(spark):
    rows = [(7, i, 100, 0, 1 if i < 1000 else i) for i in range(1003)] + [(8, i, 100, 0, 1) for i in range(300)]
    blocks = _blocks(spark.createDataFrame(rows, "token long, group long, n long, place int, component long"), 50)
    assert blocks.where("token = 8").count() == 0 and 1003 <= blocks.count() <= 1000 + 3 * 25
