"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards of about `SHARD_ROWS` by a hash. A task builds the layered graph of one shard over its distinct
vectors, links chosen layer by layer from products of blocks, and stores it as one row of flat arrays: ids, vectors, and for each layer the nodes in it and a fixed number of
neighbours each, -1 where there are fewer. Vectors get one more component that gives them equal length, so that the
largest inner product is the nearest point. Queries go in blocks, in which `WALKS` walk a graph in step, to every shard of their dimension; each shard returns its
best, scored in double precision on the original vectors (the walk through the graph compares in single precision), and the best of all shards are the result.

Every row is indexed. Graph and search are approximate; `ef_search` trades time for recall. Nulls and edge cases: vectors
that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id; equal vectors
are one node and come out as all their ids; equal rows count once; several vectors under one id are rows of their own, but
never a result of a query with that id; vectors of another dimension are no candidates; ties go to the smaller id; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyloom.session import cut

SHARD_ROWS = 16_384
QUERY_ROWS = 4096
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 144
UPPER_BEAM = 8
EXPANDED = 8  # nodes of a beam that a step expands
WALKS = 128  # queries that walk a graph in step
INSERTED = 512  # nodes that get their neighbours at once
SEED = 11
GRAPH = "dim int, shard int, ids binary, first binary, vectors binary, layer_nodes binary, layer_first binary, neighbours binary"
FOUND = "query long, query_id long, vec_id long, score double"


@dataclass
class Graph:
    """Layered graph over distinct vectors as flat arrays. Layer 0 has all nodes; `links` holds a row of neighbours for
    each entry of `layer_nodes`, whose layers begin at `layer_first`."""

    ids: np.ndarray  # of rows, by node, ascending within a node
    first: np.ndarray  # where a node's ids begin
    vectors: np.ndarray  # as given, single or double precision, one row per node
    layer_nodes: np.ndarray
    layer_first: np.ndarray
    neighbours: np.ndarray

    def stored(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.first, self.vectors, self.layer_nodes, self.layer_first, self.neighbours)]

    @staticmethod
    def restored(dim: int, stored: list[bytes]) -> Graph:
        number = np.dtype(f"f{len(stored[2]) // max(1, dim * (len(stored[1]) // 8 - 1))}")  # `first` ends with the number of rows
        kinds = [np.int64, np.int64, number, np.int32, np.int64, np.int32]
        ids, first, vectors, nodes, layers, links = (np.frombuffer(b, dtype=k) for b, k in zip(stored, kinds, strict=True))
        return Graph(ids, first, vectors.reshape(-1, dim), nodes, layers, links.reshape(len(nodes), -1))


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of the `most` largest scores of each row, in no order."""
    if scores.shape[1] <= most:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most :]


def _walk(points: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, links: np.ndarray, expanded: int = EXPANDED) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and likeness of the best `ef` nodes that each query reaches over `links` (a row of neighbours for each node, -1
    where there are fewer) from its node in `entry`, best first; -1 where there are fewer. All queries go in step; each of
    them expands its best unexpanded nodes until its beam has none."""
    count, n = len(queries), len(points)
    nodes = np.full((count, ef), -1, dtype=np.int64)
    scores = np.full((count, ef), -np.inf, dtype=np.float32)
    nodes[:, 0], scores[:, 0] = entry, np.einsum("ij,ij->i", points[entry], queries)
    waiting = np.zeros((count, ef), dtype=bool)
    waiting[:, 0] = True
    seen = np.zeros(count * n, dtype=bool)
    winner = np.zeros(count * n, dtype=np.int32)
    seen[np.arange(count) * n + entry] = True
    active = np.arange(count)
    while len(active):
        open_ = np.where(waiting[active], scores[active], -np.inf)
        at = _best(open_, expanded)
        ok = np.take_along_axis(open_, at, 1) > -np.inf
        chosen = nodes[active[:, None], at]
        waiting[active[:, None], at] = False
        near = np.where(ok[:, :, None], links[np.where(ok, chosen, 0)], -1).reshape(len(active), -1)
        row, column = np.nonzero(near >= 0)
        place = active[row] * n + near[row, column]
        new = ~seen[place]
        row, column, place = row[new], column[new], place[new]
        winner[place] = np.arange(len(place))  # a node met twice in a step counts once
        new = winner[place] == np.arange(len(place))
        row, column, place = row[new], column[new], place[new]
        seen[place] = True
        found = near[row, column]
        likeness = np.full(near.shape, -np.inf, dtype=np.float32)
        likeness[row, column] = np.einsum("ij,ij->i", points[found], queries[active[row]])
        all_scores = np.concatenate([scores[active], likeness], axis=1)
        keep = _best(all_scores, ef)
        scores[active] = np.take_along_axis(all_scores, keep, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near], axis=1), keep, 1)
        fresh = np.concatenate([waiting[active], likeness > -np.inf], axis=1)
        waiting[active] = np.take_along_axis(fresh, keep, 1)
        active = active[waiting[active].any(axis=1)]
    order = np.argsort(-scores, axis=1, kind="stable")
    scores = np.take_along_axis(scores, order, 1)
    return np.where(scores > -np.inf, np.take_along_axis(nodes, order, 1), -1), scores


def _spread(points: np.ndarray, nodes: np.ndarray, likeness: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates, best first (likeness -inf: none), those nearer to the point than to any one taken before;
    then the best of the others; -1 where there are fewer than `most`."""
    own = points[np.maximum(nodes, 0)]
    between = own @ own.transpose(0, 2, 1)
    there = likeness > -np.inf
    blocked, taken = ~there, np.zeros_like(there)
    count = np.zeros(len(nodes), dtype=np.int64)
    for i in range(nodes.shape[1]):
        take = ~blocked[:, i] & (count < most)
        taken[:, i] = take
        count += take
        blocked |= take[:, None] & (between[:, i] > likeness)
    order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((len(nodes), most), -1, dtype=np.int64)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(there, order, 1), np.take_along_axis(nodes, order, 1), -1)
    return out


def _ordered(nodes: np.ndarray, likeness: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` best candidates of each row, best first."""
    keep = _best(likeness, most)
    nodes, likeness = np.take_along_axis(nodes, keep, 1), np.take_along_axis(likeness, keep, 1)
    order = np.argsort(-likeness, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(likeness, order, 1)


def _layer(points: np.ndarray, links: int, most: int, ef: int) -> np.ndarray:
    """Neighbours of the nodes of a layer, whose points come in order of insertion: each node is linked to near and spread-out
    nodes before it, out of its `ef` nearest ones, and these back to it; more than `most` are thinned out likewise."""
    n = len(points)
    forward = np.full((n, links), -1, dtype=np.int64)
    for low in range(0, n, INSERTED):
        high = min(n, low + INSERTED)
        likeness = points[low:high] @ points[:high].T
        likeness[np.arange(high)[None, :] >= np.arange(low, high)[:, None]] = -np.inf
        nodes, likeness = _ordered(np.broadcast_to(np.arange(high), likeness.shape), likeness, ef)
        forward[low:high] = _spread(points, nodes, likeness, links)
    row, column = np.nonzero(forward >= 0)
    source, target = np.concatenate([row, forward[row, column]]), np.concatenate([forward[row, column], row])
    likeness = np.einsum("ij,ij->i", points[source], points[target])
    order = np.lexsort((-likeness, target))
    source, target, likeness = source[order], target[order], likeness[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    some = rank < 2 * most  # a node that many others chose: the nearest of them are looked at
    wide = np.full((n, 2 * most), -1, dtype=np.int64)
    near = np.full((n, 2 * most), -np.inf, dtype=np.float32)
    wide[target[some], rank[some]], near[target[some], rank[some]] = source[some], likeness[some]
    out = wide[:, :most].copy()
    many = np.flatnonzero(wide[:, most] >= 0)
    for low in range(0, len(many), INSERTED):
        at = many[low : low + INSERTED]
        out[at] = _spread(points, wide[at], near[at], most)
    return out


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component that gives all of them the length of the longest."""
    wide = vectors.astype(np.float64)
    square = (wide**2).sum(axis=1)
    lift = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    scale = np.sqrt(square.max(initial=1.0)) or 1.0
    return (np.column_stack([wide, lift]) / scale).astype(np.float32)


def build_graph(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = SEED) -> Graph:
    """Layers of the distinct vectors in a random order of insertion, each linked to near and spread-out nodes before it. What a
    vector is linked to is chosen from its true nearest in the shard: products of blocks cost less than walks there."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + vectors.dtype.type(0)  # no negative zeros
    _, first_row, node_of = np.unique(vectors.view(f"V{vectors.shape[1] * vectors.itemsize}").ravel(), return_index=True, return_inverse=True)
    by_node = np.argsort(node_of, kind="stable")
    counts = np.bincount(node_of, minlength=len(first_row))
    own = vectors[first_row]
    points, n = _lifted(own), len(first_row)
    rng = np.random.default_rng([seed, n])
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 30)
    inserted = rng.permutation(n)
    nodes, flat = [], []
    for layer in range(level.max(initial=0) + 1):
        members = inserted[level[inserted] >= layer]  # the first of the top layer is where walks begin
        found = _layer(points[members], links, 2 * links if layer == 0 else links, ef)
        wide = np.full((len(members), 2 * links), -1, dtype=np.int32)
        wide[:, : found.shape[1]] = np.where(found >= 0, members[found], -1)
        nodes.append(members.astype(np.int32))
        flat.append(wide)
    return Graph(
        ids[by_node], np.concatenate([[0], np.cumsum(counts)]), own, np.concatenate(nodes), np.concatenate([[0], np.cumsum([len(x) for x in nodes])]), np.concatenate(flat)
    )


class Searcher:
    """Walks a stored graph."""

    def __init__(self, graph: Graph) -> None:
        self.graph, self.points = graph, _lifted(graph.vectors)
        n, self.layers = len(graph.vectors), []
        for low, high in zip(graph.layer_first[:-1], graph.layer_first[1:], strict=True):
            links = np.full((n, graph.neighbours.shape[1]), -1, dtype=np.int32)
            links[graph.layer_nodes[low:high]] = graph.neighbours[low:high]
            self.layers.append(links)
        self.entry = int(graph.layer_nodes[graph.layer_first[-2]])

    def nearest(self, query: np.ndarray, own_id: int, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best `k` rows found, without those with the query's own id."""
        return self.nearest_of(np.asarray(query)[None, :], np.array([own_id]), k, ef)[0]

    def nearest_of(self, queries: np.ndarray, own_ids: np.ndarray, k: int, ef: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for many queries."""
        out = []
        for low in range(0, len(queries), WALKS):
            wide = queries[low : low + WALKS].astype(np.float64)
            length = np.maximum(np.sqrt((wide**2).sum(axis=1, keepdims=True)), 1e-300)
            walkers = np.column_stack([wide / length, np.zeros(len(wide))]).astype(np.float32)
            near = np.full((len(wide), 1), self.entry)
            for layer in range(len(self.layers) - 1, -1, -1):
                near, _ = _walk(self.points, walkers, near[:, 0], max(ef, k + 1) if layer == 0 else UPPER_BEAM, self.layers[layer], EXPANDED if layer == 0 else 1)
            out += [self._rows(query, nodes[nodes >= 0], own, k) for query, nodes, own in zip(wide, near, own_ids[low : low + WALKS].tolist(), strict=True)]
        return out

    def _rows(self, query: np.ndarray, nodes: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `k` rows of some nodes, scored in double precision on the vectors as given."""
        graph = self.graph
        scores = (graph.vectors[nodes].astype(np.float64) * query).sum(axis=1)
        sizes = np.minimum(graph.first[nodes + 1] - graph.first[nodes], k + 1)  # ids of a node ascend: the rest cannot be wanted
        at = np.repeat(graph.first[nodes], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids, scores = graph.ids[at], np.repeat(scores, sizes)
        other = ids != own_id
        ids, scores = ids[other], scores[other]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, dim of rows that take part, each distinct row once. Components stay floats if they are, all others
    become doubles, so that scores are those of the vectors as given."""
    exact = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    number = F.transform(F.col("embedding"), lambda x: x.cast(exact))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(~bad & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("dim", F.size("embedding")).dropDuplicates(["vec_id", "embedding"])


def _dealt(key: Column, pieces: dict[int, int]) -> Column:
    """A piece by hash, as many as the row's dimension has."""
    number = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in pieces.items()), F.lit(1))
    return F.pmod(key, number).cast("int")


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, ef: int = EF_BUILD) -> tuple[DataFrame, dict[int, int]]:
    """The graphs of all shards, written to the shared folder, and the number of shards of each dimension."""
    rows = cut(usable(vectors))
    shards = {r["dim"]: -(-r["count"] // shard_rows) for r in rows.groupBy("dim").count().collect()}  # a row per dimension

    def build(group: pd.DataFrame) -> pd.DataFrame:
        graph = build_graph(group.vec_id.to_numpy(np.int64), np.stack(group.embedding.to_numpy()), links, ef)
        row = [int(group.dim.iloc[0]), int(group.shard.iloc[0]), *graph.stored()]
        return pd.DataFrame([row], columns=[f.split()[0] for f in GRAPH.split(", ")])

    rows = rows.withColumn("shard", _dealt(F.xxhash64("vec_id", "embedding"), shards))
    # Small as a shard is, it takes long to build: tasks by number of shards rather than by bytes.
    rows = rows.repartition(max(1, 2 * sum(shards.values())), "dim", "shard")
    return cut(rows.groupBy("dim", "shard").applyInPandas(build, GRAPH)), shards


def search(graphs: DataFrame, shards: dict[int, int], queries: DataFrame, k: int, ef: int = EF_SEARCH, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every usable row of `queries` its `k` nearest rows of the index."""
    rows = cut(usable(queries).withColumn("query", F.xxhash64("vec_id", "embedding")))
    blocks = {r["dim"]: -(-r["count"] // query_rows) for r in rows.groupBy("dim").count().collect()}
    known = {d: n for d, n in shards.items() if d in blocks}
    spark = graphs.sparkSession
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of = lambda counts: F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in counts.items()))
    left = graphs.where(F.col("dim").isin(*known)).withColumn("block", every(of({d: blocks[d] for d in known})))
    right = rows.where(F.col("dim").isin(*known)).withColumn("block", _dealt(F.col("query"), blocks)).withColumn("shard", every(of(known)))

    def find(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or queries.empty:
            return pd.DataFrame({f.split()[0]: [] for f in FOUND.split(", ")})
        row = graph.iloc[0]
        searcher = Searcher(Graph.restored(int(row.dim), [row[c] for c in ("ids", "first", "vectors", "layer_nodes", "layer_first", "neighbours")]))
        found = searcher.nearest_of(np.stack(queries.embedding.to_numpy()), queries.vec_id.to_numpy(), k, ef)
        sizes = [len(ids) for ids, _ in found]
        columns = {"query": np.repeat(queries["query"].to_numpy(), sizes), "query_id": np.repeat(queries.vec_id.to_numpy(), sizes)}
        return pd.DataFrame(columns | {"vec_id": np.concatenate([x for x, _ in found]), "score": np.concatenate([x for _, x in found])})

    keys = ["dim", "shard", "block"]
    tasks = max(1, 2 * sum(known[d] * blocks[d] for d in known))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, FOUND)
    best = W.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    # An id with several vectors is one result, by its nearest.
    found = found.groupBy("query", "query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """Builds the index over all of `vectors` and searches it."""
    graphs, shards = build_index(vectors, **options)
    return search(graphs, shards, queries, k)


def layers_of(graph: Graph) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each layer its nodes and their neighbours, -1 where there are fewer."""
    for low, high in zip(graph.layer_first[:-1], graph.layer_first[1:], strict=True):
        yield graph.layer_nodes[low:high], graph.neighbours[low:high]
