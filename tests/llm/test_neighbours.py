import numpy as np
import pytest
from pyspark.sql import functions as F

from copyloom.llm.neighbours import EF_SEARCH, SHARD_ROWS, Searcher, build_graph, layers_of, neighbours
from copyloom.llm.queries import op8_neighbours

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, queries, k):
    wide = vectors.astype(np.float64)
    out = {}
    for q in queries:
        scores = wide @ wide[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def recall(found, expected):
    hits = total = 0
    for query, best in expected.items():
        hits += sum(s >= best[-1][1] - 1e-9 for _, s in found[query])
        total += len(best)
    return hits / total


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard_rows", [None, 500])
def test_recall_on_whole_table(spark, shard_rows):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float32)
    expected = brute(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    found = collected(op8_neighbours(spark, folder) if shard_rows is None else neighbours(table, table.where("vec_id % 20 = 0"), shard_rows=shard_rows))
    assert set(found) == set(expected) and all(len(v) == 20 for v in found.values())
    assert recall(found, expected) >= 0.93
    place = {int(i): n for n, i in enumerate(ids)}
    for q, best in found.items():
        assert best == sorted(best, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in best]
        for i, s in best:
            assert s == pytest.approx(float(vectors[place[i]].astype(float) @ vectors[place[q]].astype(float)), abs=1e-12)


def test_graph_is_flat_and_bounded():
    rng = np.random.default_rng(0)
    graph = build_graph(np.arange(600), rng.normal(size=(600, 8)), links=6)
    layers = list(layers_of(graph))
    assert len(layers[0][0]) == 600 and sum(len(n) for n, _ in layers) == len(graph.neighbours)
    for nodes, links in layers:
        assert links.shape[1] == 12 and set(links[links >= 0].tolist()) <= set(nodes.tolist())


def test_vectors_of_different_length():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(1500, 12)) * rng.lognormal(size=(1500, 1))).astype(np.float32)
    ids = np.arange(1500)
    searcher = Searcher(build_graph(ids, vectors))
    expected = brute(ids, vectors, range(0, 1500, 20), 20)
    found = {q: list(zip(*(x.tolist() for x in searcher.nearest(vectors[q], q, 20, EF_SEARCH)), strict=True)) for q in expected}
    assert recall(found, expected) >= 0.9


def test_nulls_copies_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], 0) for i in range(100, 140)] + [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (20, [0.0, 2.0], 1), (7, [0.5, 0.5], 1)]
    rows += [(40, None, 0), (60, [], 0), (80, [0.0, -0.0], 0), (1, [nan, 1.0], 0), (2, [inf, 1.0], 0), (3, [None, 1.0], 0), (None, [9.0, 9.0], 0)]
    rows += [(200, [1.0, 2.0, 3.0], 0), (220, [-1.0, 0.0, 0.0], None), (240, [5.0], None)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("shard", F.lit("clash")).withColumn("dim", F.lit("clash"))
    found = collected(neighbours(df, df.where("vec_id % 20 = 0"), 20))
    assert found[0] == [(i, 1.0) for i in range(100, 120)]
    assert found[100] == [(0, 1.0)] + [(i, 1.0) for i in range(101, 120)]
    assert found[20][:2] == [(7, 1.0), (0, 0.0)] and len(found[20]) == 20
    assert found[200] == [(220, -1.0)] and found[220] == [(200, -1.0)]
    assert set(found) == {0, 20, 100, 120, 200, 220}


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    some = spark.createDataFrame([(20, [1.0], 0)], COLUMNS)
    assert neighbours(empty, empty).count() == neighbours(empty, some).count() == neighbours(some, some).count() == 0


@pytest.mark.parametrize("kind", ["double", "float"])
def test_scores_are_those_of_the_given_numbers(spark, kind):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 4))
    if kind == "float":
        vectors = vectors.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, label int")
    found = collected(neighbours(df, df.where("vec_id % 50 = 0"), 5, shard_rows=64))
    expected = brute(np.arange(300), vectors, range(0, 300, 50), 5)
    assert set(found) == set(expected) and recall(found, expected) >= 0.9
    for q, best in found.items():
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))
        for i, s in best:
            assert s == pytest.approx(float(vectors[i] @ vectors[q]), rel=1e-15)


def test_a_shard_is_large_and_finds_what_lies_in_it():
    """Queries from outside the shard, over as many rows as four shards had before; walks were too dear for that."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(SHARD_ROWS + 200, 32)).astype(np.float32)
    assert SHARD_ROWS >= 16_384
    searcher = Searcher(build_graph(np.arange(SHARD_ROWS), vectors[:SHARD_ROWS]))
    scores = vectors[SHARD_ROWS:].astype(float) @ vectors[:SHARD_ROWS].astype(float).T
    expected = {q: [(int(i), float(scores[q, i])) for i in np.argsort(-scores[q])[:20]] for q in range(200)}
    found = searcher.nearest_of(vectors[SHARD_ROWS:], np.full(200, -1), 20, EF_SEARCH)
    assert recall({q: list(zip(*(x.tolist() for x in f), strict=True)) for q, f in enumerate(found)}, expected) >= 0.9
