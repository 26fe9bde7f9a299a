"""Groups of samples by density: mutual reachability, its spanning tree, a condensed hierarchy, the most stable groups.

The core distance of a sample is that to its `min_samples`-th nearest other sample. Two samples reach each other at their
distance or the larger of their core distances, whichever is more. The minimum spanning tree of these distances, taken
apart from its longest edges on, is the hierarchy: a group splits where both parts have `min_cluster_size` samples or
more, otherwise the smaller part falls out of it. A group's stability is the sum over its samples of how long they stay,
in inverse distance; a group wins over the groups inside it if it is at least as stable as the best choice among them.

Everything is a table. The tree grows by Boruvka rounds, each a pass over blocks of sample pairs that keeps the best edge
per component. Merge sizes along the tree come from halving the ranks of its edges: the lower half falls into pieces, the
upper half joins these pieces, and both go on alone, until a piece has at most `CHUNK` edges and a task replays it. Groups,
stabilities and choices follow by pointer jumping and by rounds along the hierarchy.

Edges are ordered by (weight, a, b), so ties have one result. Distances are floored to 1e-9, inverse ones are at most 1e9.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators.cohort import MIN_CLUSTER_SIZE, NOISE, connected_components
from copyloom.session import cut

BLOCK = 1024
CHUNK = 4096
STEP_NUMBERS = 1 << 22
LEAST_DISTANCE = 1e-9


def sample_vectors(points: DataFrame) -> DataFrame:
    """(sample_name, v) from long points (sample_name, dim, v); every sample has a value in every dimension."""
    entries = F.sort_array(F.collect_list(F.struct("dim", F.col("v").cast("double").alias("v"))))
    return points.groupBy("sample_name").agg(entries.alias("entries")).select("sample_name", F.col("entries.v").alias("v"))


def _paired(rows: DataFrame, blocks: int) -> DataFrame:
    """Every row once for each pair (lo, hi) of blocks that its own block takes part in."""
    own = F.pmod(F.hash("sample_name"), F.lit(blocks))
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")


def _sides(pdf: pd.DataFrame) -> list[tuple[pd.DataFrame, pd.DataFrame]]:
    """The two blocks of a pair, each as rows against the other, in order of name."""
    pdf = pdf.sort_values("sample_name", ignore_index=True)
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    first, second = (pdf[pdf["own"] == k].reset_index(drop=True) for k in (lo, hi))
    return [(first, second)] if lo == hi else [(first, second), (second, first)]


def _distances(rows: pd.DataFrame, others: pd.DataFrame):
    """Distances of some rows at a time to all others: (first row, matrix); from coordinates, so equal from both sides."""
    x, y = np.vstack(rows["v"].tolist()), np.vstack(others["v"].tolist())
    step = max(1, STEP_NUMBERS // max(1, y.size))
    for k in range(0, len(x), step):
        apart = np.sqrt(((x[k : k + step, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        yield k, np.floor(apart / LEAST_DISTANCE) * LEAST_DISTANCE


def block_count(vectors: DataFrame, block: int) -> int:
    return max(1, -(-vectors.count() // block))


def core_distances(vectors: DataFrame, min_samples: int, block: int = BLOCK) -> DataFrame:
    """(sample_name, v, core): the distance to the `min_samples`-th nearest other sample, or to the farthest of fewer."""

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, others in _sides(pdf):
            if rows.empty or others.empty:
                continue
            for k, apart in _distances(rows, others):
                names = rows["sample_name"].iloc[k : k + len(apart)]
                apart[names.to_numpy()[:, None] == others["sample_name"].to_numpy()[None, :]] = np.inf
                best = np.sort(apart, axis=1)[:, :min_samples]
                out.append(pd.DataFrame({"sample_name": names.to_numpy(), "near": [b[np.isfinite(b)] for b in best]}))
        return pd.concat(out) if out else pd.DataFrame({"sample_name": [], "near": []})

    blocks = block_count(vectors, block)
    found = _paired(vectors, blocks).groupBy("lo", "hi").applyInPandas(nearest, "sample_name string, near array<double>")
    near = F.sort_array(F.flatten(F.collect_list("near")))
    core = F.get(near, F.least(F.size(near), F.lit(min_samples)) - 1)
    cores = found.groupBy("sample_name").agg(core.alias("core"))
    return vectors.join(cores, "sample_name", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))


def spanning_tree(cores: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, weight), a < b: the minimum spanning tree of mutual reachability, from rows (sample_name, v, core).

    A round finds the best edge out of every component and joins what these edges connect; components at least halve.
    """
    schema = "component string, other string, weight double, a string, b string"

    def leaving(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, others in _sides(pdf):
            if rows.empty or others.empty:
                continue
            for k, apart in _distances(rows, others):
                mine = rows.iloc[k : k + len(apart)]
                reach = np.maximum(np.maximum(apart, mine["core"].to_numpy()[:, None]), others["core"].to_numpy()[None, :])
                reach[mine["component"].to_numpy()[:, None] == others["component"].to_numpy()[None, :]] = np.inf
                best = reach.argmin(axis=1)  # names ascend: ties go to the smaller one
                weight = reach[np.arange(len(best)), best]
                names, far = mine["sample_name"].to_numpy(), others["sample_name"].to_numpy()[best]
                a, b = np.where(names < far, names, far), np.where(names < far, far, names)
                columns = {"component": mine["component"].to_numpy(), "other": others["component"].to_numpy()[best], "weight": weight, "a": a, "b": b}
                out.append(pd.DataFrame(columns)[np.isfinite(weight)])
        if not out:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return pd.concat(out).sort_values(["weight", "a", "b"]).drop_duplicates("component")

    blocks = block_count(cores, block)
    names = cut(cores.select("sample_name", F.col("sample_name").alias("component")))
    edges = cores.sparkSession.createDataFrame([], "a string, b string, weight double")
    while True:
        rows = _paired(cores.join(names, "sample_name"), blocks)
        found = rows.groupBy("lo", "hi").applyInPandas(leaving, schema)
        best = cut(found.groupBy("component").agg(F.min(F.struct("weight", "a", "b", "other")).alias("e")).select("component", "e.*"))
        if best.isEmpty():
            return edges
        edges = cut(edges.unionByName(best.select("a", "b", "weight").distinct()))
        nodes = names.select(F.col("component").alias("sample_name")).distinct()
        joined = connected_components(nodes, best.select(F.col("component").alias("a"), F.col("other").alias("b")))
        joined = joined.select(F.col("sample_name").alias("component"), "root")
        names = cut(names.join(joined, "component").select("sample_name", F.col("root").alias("component")))


# --- merges along the tree


def ranked(edges: DataFrame) -> DataFrame:
    """Edges with their rank by (weight, a, b), from 0: ranges of the order, counted, and the counts before them."""
    ordered = cut(edges.orderBy("weight", "a", "b").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = ordered.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = (F.col("id").bitwiseAND((1 << 33) - 1) + F.col("offset")).alias("rank")
    return ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select("a", "b", "weight", rank)


MERGE = "rank long, weight double, top_a long, top_b long, sample_a string, sample_b string, size_a long, size_b long"


def _replayed(edges: pd.DataFrame, vertices: pd.DataFrame) -> pd.DataFrame:
    """Joins the vertices of one piece along its edges by rank, and tells for each edge what it joins."""
    columns = [f.split()[0] for f in MERGE.split(", ")]
    at = {v: k for k, v in enumerate(vertices["vertex"])}
    parent = list(range(len(at)))
    size, top = vertices["size"].tolist(), [None if pd.isna(t) else int(t) for t in vertices["top"]]
    names = vertices["vertex"].tolist()

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for e in edges.sort_values("rank").itertuples():
        x, y = root(at[e.a]), root(at[e.b])
        alone = [names[k] if top[k] is None else None for k in (x, y)]
        out.append((e.rank, e.weight, top[x], top[y], *alone, size[x], size[y]))
        x, y = (x, y) if size[x] >= size[y] else (y, x)
        parent[y] = x
        size[x] += size[y]
        top[x] = e.rank
    frame = pd.DataFrame(out, columns=columns)
    return frame.astype({"top_a": "Int64", "top_b": "Int64"})


def merges(edges: DataFrame, samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per edge of the tree in the order in which it joins groups: what it joins, as the rank of the last merge of
    either side or, where that is a sample alone, its name, and how many samples."""
    edges = cut(ranked(edges).select(F.lit(0).cast("long").alias("piece"), "rank", "weight", "a", "b"))
    start = samples.select(F.lit(0).cast("long").alias("piece"), F.col("sample_name").alias("vertex"))
    vertices = start.withColumns({"size": F.lit(1).cast("long"), "top": F.lit(None).cast("long")})
    key = lambda v: F.concat(F.col("piece").cast("string"), F.lit("\x01"), F.col(v))
    while True:
        bounds = cut(edges.groupBy("piece").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n")).where(F.col("n") > chunk))
        if bounds.isEmpty():
            break
        half = bounds.select("piece", F.floor((F.col("lo") + F.col("hi")) / 2).alias("middle"))
        edges = cut(edges.join(half, "piece", "left").withColumn("lower", F.coalesce(F.col("rank") <= F.col("middle"), F.lit(False))))
        splits, rest = vertices.join(half.select("piece"), "piece", "left_semi"), vertices.join(half.select("piece"), "piece", "left_anti")
        lower = edges.where("lower")
        nodes = splits.select(key("vertex").alias("sample_name"))
        roots = connected_components(nodes, lower.select(key("a").alias("a"), key("b").alias("b"))).withColumnRenamed("sample_name", "key")
        roots = cut(roots.select("key", "root", F.xxhash64("root").alias("below"), F.substring_index("root", "\x01", -1).alias("name")))
        splits = cut(splits.withColumn("key", key("vertex")).join(roots, "key"))
        at = lambda v: roots.select(F.col("key").alias(f"key_{v}"), F.col("below").alias(f"below_{v}"), F.col("name").alias(f"name_{v}"))
        placed = edges.withColumns({"key_a": key("a"), "key_b": key("b")}).join(at("a"), "key_a", "left").join(at("b"), "key_b", "left")
        cutting = F.col("middle").isNotNull()
        upper = cutting & ~F.col("lower")
        edges = cut(
            placed.select(
                F.when(F.col("lower"), F.col("below_a")).otherwise(F.col("piece")).alias("piece"), "rank", "weight",
                F.when(upper, F.col("name_a")).otherwise(F.col("a")).alias("a"), F.when(upper, F.col("name_b")).otherwise(F.col("b")).alias("b"), "lower",
            )
        )
        last = edges.where("lower").groupBy(F.col("piece").alias("below")).agg(F.max("rank").alias("last"))
        above = splits.groupBy("piece", "name", "below").agg(F.sum("size").alias("size"), F.max("top").alias("top")).join(last, "below", "left")
        above = above.select("piece", F.col("name").alias("vertex"), "size", F.coalesce("last", "top").alias("top"))
        inside = splits.join(last.select("below"), "below", "left_semi").select(F.col("below").alias("piece"), "vertex", "size", "top")
        edges, vertices = edges.drop("lower"), cut(rest.unionByName(above).unionByName(inside))
    pieces = edges.groupBy("piece").cogroup(vertices.join(edges.select("piece").distinct(), "piece", "left_semi").groupBy("piece"))
    return cut(pieces.applyInPandas(_replayed, MERGE))


# --- the condensed hierarchy


def jumped(pointers: DataFrame) -> DataFrame:
    """(at, next) with every pointer followed to its end, where next = at; rounds grow with the log of the longest way."""
    rows = cut(pointers)
    while True:
        further = rows.select(F.col("at").alias("next"), F.col("next").alias("then"))
        moved = cut(rows.join(further, "next").select("at", F.col("then").alias("next"), (F.col("then") != F.col("next")).alias("moved")))
        rows = moved.select("at", "next")
        if moved.where("moved").isEmpty():
            return rows


def condensed(merged: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE) -> tuple[DataFrame, DataFrame]:
    """The groups (cluster, parent, size, birth, stability) of the hierarchy, and the group that each sample leaves last
    (sample_name, cluster). A group goes by the rank of the merge that completes it."""
    large = lambda c: F.col(c) >= min_cluster_size
    lam = 1 / F.greatest("weight", F.lit(LEAST_DISTANCE))
    rows = merged.withColumns({"splits": large("size_a") & large("size_b"), "lam": lam, "size": F.col("size_a") + F.col("size_b")})
    above = rows.select(F.explode(F.array("top_a", "top_b")).alias("rank"), F.col("rank").alias("above"), F.col("splits").alias("above_splits"), F.col("lam").alias("above_lam"))
    rows = cut(rows.join(above.where("rank IS NOT NULL"), "rank", "left"))
    ends = F.col("above").isNull() | F.col("above_splits")
    tops = jumped(rows.select(F.col("rank").alias("at"), F.when(ends, F.col("rank")).otherwise(F.col("above")).alias("next")))
    tops = tops.select(F.col("at").alias("rank"), F.col("next").alias("cluster"))
    rows = rows.join(tops, "rank")
    leave = lambda c: F.when(F.col("splits") | ~large(c), F.col(c)).otherwise(0)
    left = rows.where(large("size")).groupBy("cluster").agg(F.sum((leave("size_a") + leave("size_b")) * F.col("lam")).alias("left"))
    births = rows.where((F.col("rank") == F.col("cluster")) & large("size")).select("cluster", "above", "size", F.coalesce("above_lam", F.lit(0.0)).alias("birth"))
    parents = tops.select(F.col("rank").alias("above"), F.col("cluster").alias("parent"))
    clusters = births.join(left, "cluster").join(parents, "above", "left")
    clusters = clusters.select("cluster", "parent", "size", "birth", (F.col("left") - F.col("size") * F.col("birth")).alias("stability"))
    of = [F.struct(F.col(f"sample_{s}").alias("sample_name"), F.col("cluster")) for s in ("a", "b")]
    samples = rows.select(F.explode(F.array(*of)).alias("e")).select("e.*").where("sample_name IS NOT NULL")
    return cut(clusters), cut(samples)


def chosen(clusters: DataFrame, single: bool = False) -> DataFrame:
    """(cluster, chosen): for every group the chosen group that it lies in, itself included, or NULL.

    Choices go up the hierarchy in rounds, one for each of its levels. The group of all samples can be chosen if `single`.
    """
    open_ones = clusters.select("cluster", "parent", "stability")
    inner = open_ones.where("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("children"))
    state = cut(open_ones.join(inner, "cluster", "left").select("*", F.lit(None).cast("double").alias("best"), F.lit(False).alias("wins")))
    while not state.where("best IS NULL").isEmpty():
        below = state.where("best IS NOT NULL AND parent IS NOT NULL").groupBy(F.col("parent").alias("cluster"))
        below = below.agg(F.count("*").alias("done"), F.sum("best").alias("inside"))
        ready = F.col("best").isNull() & (F.coalesce("done", F.lit(0)) == F.coalesce("children", F.lit(0)))
        allowed = F.lit(True) if single else F.col("parent").isNotNull()
        wins = allowed & (F.col("stability") >= F.coalesce("inside", F.lit(0.0)))
        best = F.when(wins, F.col("stability")).otherwise(F.coalesce("inside", F.lit(0.0)))
        joined = state.join(below, "cluster", "left").withColumns({"_best": F.when(ready, best).otherwise(F.col("best")), "_wins": F.when(ready, wins).otherwise(F.col("wins"))})
        state = cut(joined.select("cluster", "parent", "stability", "children", F.col("_best").alias("best"), F.col("_wins").alias("wins")))
    # The highest winner on the way up: what lies above wins over what lies below.
    ways = cut(state.select("cluster", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("chosen")))
    while not ways.where("up IS NOT NULL").isEmpty():
        further = ways.select(F.col("cluster").alias("up"), F.col("up").alias("then"), F.col("chosen").alias("higher"))
        ways = cut(ways.join(further, "up", "left").select("cluster", F.col("then").alias("up"), F.coalesce("higher", "chosen").alias("chosen")))
    return ways.select("cluster", "chosen")


def density_groups(
    points: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int | None = None, single: bool = False, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """(sample_name, label): groups by density, numbered by size, ties by their first name; samples in no group are noise.

    `points` is long (sample_name, dim, v). `min_samples` is the minimum size if not given, which has to be 2 or more.
    """
    if min_cluster_size < 2:
        raise ValueError("a group has two samples or more")
    cores = cut(core_distances(cut(sample_vectors(points)), min_samples or min_cluster_size, block))
    merged = merges(spanning_tree(cores, block), cores, chunk)
    clusters, samples = condensed(merged, min_cluster_size)
    found = cut(samples.join(chosen(clusters, single), "cluster").where("chosen IS NOT NULL").select("sample_name", "chosen"))
    sizes = found.groupBy("chosen").agg(F.count("*").alias("size"), F.min("sample_name").alias("first"))
    # One row per group, at most samples / min_cluster_size of them.
    number = (F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).cast("int").alias("label")
    labels = found.join(sizes.select("chosen", number), "chosen").select("sample_name", "label")
    return cores.select("sample_name").join(labels, "sample_name", "left").select("sample_name", F.coalesce("label", F.lit(NOISE)).alias("label"))
