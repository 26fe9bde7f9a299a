"""Latent factors of the null model, fitted to counts as counts.

n ~ Poisson(expected x exp(sum over factors of sample weight x region weight)), for each group and contig on its own and for every
number of factors asked for. The fit alternates: with the sample weights held, every region takes a Newton step, a weighted
least squares of its counts on the sample weights; then every sample one on the region weights. The k x k normal equations are
sums over rows, so that neither a region nor a sample has to fit in a task. A row's step is the best of a whole one, shorter
ones and none by the likelihood of its own counts, hence the deviance never rises. The start is the leading eigenvectors of the
log residual; rounds end when no model gains more than a share of its log-likelihood.

Cells lie in blocks: a piece of a part's regions with all its samples, as matrices. A region's step needs its own block only, and a
block gives its share of the samples' sums with it. Where a part has too many samples or most cells are missing, a cell is a row.

Weights are then turned to orthogonal factors by falling strength. One that a single sample carries to `LONE_SHARE` of its
square is that sample's copy number and left out, and the region weights are fitted once more to those that stay.

Rows with a NULL or non-positive expected count must be left out before; a NULL count is no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators import blocks
from copyloom.operators.poisson_caller import LATENT_FACTORS, LONE_SHARE
from copyloom.session import BROADCAST_ROWS, cut, small_table

ROUNDS = 10
# Rounds end when every model's log-likelihood gains less than this share of it.
GAIN = 1e-7
STEPS = (1.0, 0.5, 0.25, 0.0625)
SHARES = (0.0, *STEPS)  # the first of equals: no step without a gain
# Largest log ratio a model may reach, so that exponentials stay finite.
LARGEST_SHIFT = 30.0

# Cells of a block, and of a task's blocks; a part with more samples is not laid out in blocks.
BLOCK_CELLS = 1 << 15
TASK_CELLS = 1 << 21
BLOCK_SAMPLES = 512
# Parts whose sums a task holds at a time.
HELD_PARTS = 64


def _dot(a: Column, b: Column) -> Column:
    shift = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-LARGEST_SHIFT), F.least(F.lit(LARGEST_SHIFT), shift))


def newton_steps(gram: pd.Series, slope: pd.Series) -> pd.Series:
    """Solves the normal equations of each row: `gram` holds a symmetric k x k matrix by rows, `slope` k numbers."""
    if gram.empty:
        return pd.Series([], dtype=object)
    b = np.stack(slope.to_numpy())
    size = b.shape[1]
    return pd.Series(list(_solved(np.stack(gram.to_numpy()).reshape(-1, size, size), b)))


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Factors left out are rows of zeros; their slope and so their step is zero.
    small = 1e-10 * np.trace(a, axis1=-2, axis2=-1) + 1e-300
    step = np.linalg.solve(a + small[..., None, None] * np.eye(b.shape[-1]), b[..., None])[..., 0]
    return np.where(np.isfinite(step), step, 0.0)


def _packed(rows: DataFrame, key: str, **names: str) -> DataFrame:
    """A row for each (part, key): its models `ks` in order and their weights behind each other, under new names."""
    models = F.sort_array(F.collect_list(F.struct("k", *names)))
    rows = rows.groupBy("part", key).agg(models.alias("m"))
    flat = [F.flatten(f"m.{c}").alias(name) for c, name in names.items()]
    return small_table(rows.select("part", key, F.col("m.k").alias("ks"), *flat))


def _sums(key: str, most: int, wide: list[str], terms, names: list[str], kept: list[str]):
    """Sums of `terms` over the rows of each (part, key) in a batch, a row for each model; `kept` are weights of the key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, own = batch.column("part").dictionary_encode(), batch.column(key).dictionary_encode()
            code = part.indices.to_numpy().astype(np.int64) * len(own.dictionary) + own.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            first = pa.array(np.repeat(order[starts], models := len(batch.column("ks")[0])))
            n, expected = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[order, None] for c in ("n", "expected"))
            weights = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, models, most) for c in wide}
            with np.errstate(all="ignore"):
                found = [np.add.reduceat(t, starts, axis=0).ravel() for t in terms(n, expected, *(weights[c][order] for c in wide))]
            out = {"part": batch.column("part").take(first), "k": pa.array(np.tile(batch.column("ks")[0].as_py(), len(starts)), pa.int32())}
            out |= {key: batch.column(key).take(first)}
            out |= {c: pa.array(list(weights[c][order[starts]].reshape(-1, most)), pa.list_(pa.float64())) for c in kept}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(f) for c, f in zip(names, found, strict=True)})

    return add


def _shift(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("rki,rki->rk", x, w), -LARGEST_SHIFT, LARGEST_SHIFT)


def half_round(cells: DataFrame, held: DataFrame, held_key: str, moved: DataFrame, moved_key: str, most: int) -> DataFrame:
    """A step of all weights of one side: (part, k, moved_key, w, ll), `ll` the log-likelihood of its counts afterwards.

    `cells` holds part, sample_name, region_id, n, expected; `held` and `moved` hold part, k, their key and weights `w`. A cell
    is one row that meets the weights of all models at once; a batch adds up what it holds of a key.
    """
    solve = F.pandas_udf(newton_steps, "array<double>")
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    key = ["part", "k", moved_key]
    kind = f"part string, k int, {moved_key} {dict(cells.dtypes)[moved_key]}"
    held = _packed(held, held_key, w="x").drop("ks")
    rows = cells.select("part", "sample_name", "region_id", F.col("n").cast("double").alias("n"), "expected").join(held, ["part", held_key])

    def equations(n, expected, x, w):
        mu = expected * np.exp(_shift(x, w))
        missing = n - mu
        there = np.nan_to_num(mu)
        yield from (there * x[:, :, i] * x[:, :, j] for i, j in pairs)
        yield from (np.nan_to_num(missing) * x[:, :, i] for i in range(most))

    names = [f"_a{i}_{j}" for i, j in pairs] + [f"_b{i}" for i in range(most)]
    now = rows.join(_packed(moved, moved_key, w="w"), ["part", moved_key])
    found = now.mapInArrow(_sums(moved_key, most, ["x", "w"], equations, names, ["w"]), f"{kind}, w array<double>, {', '.join(f'{c} double' for c in names)}")
    found = found.groupBy(*key).agg(F.first("w").alias("w"), *[F.sum(c).alias(c) for c in names])
    gram = F.array(*[f"_a{min(i, j)}_{max(i, j)}" for i in range(most) for j in range(most)])
    steps = found.select(*key, "w", solve(gram, F.array(*[f"_b{i}" for i in range(most)])).alias("step"))
    tried = rows.join(_packed(steps, moved_key, w="w", step="step"), ["part", moved_key])

    def values(n, expected, x, w, step):
        log = np.log(np.where(expected > 0, expected, np.nan))
        for share in SHARES:
            shift = _shift(x, w + share * step)
            yield np.nan_to_num(n * (log + shift) - expected * np.exp(shift))

    names = [f"_l{i}" for i in range(len(SHARES))]
    schema = f"{kind}, w array<double>, step array<double>, {', '.join(f'{c} double' for c in names)}"
    found = tried.mapInArrow(_sums(moved_key, most, ["x", "w", "step"], values, names, ["w", "step"]), schema)
    found = found.groupBy(*key).agg(F.first("w").alias("w"), F.first("step").alias("step"), *[F.sum(c).alias(c) for c in names])
    best = F.greatest(*names)

    def weights(share: float) -> Column:
        return F.zip_with("w", "step", lambda w, s: w + share * s)

    chosen = F.coalesce(*[F.when(F.col(c) == best, weights(s)) for c, s in zip(names, SHARES, strict=True)])
    return cut(found.select(*key, chosen.alias("w"), best.alias("ll")))


class Cells:
    """Rounds over a row for each cell."""

    def __init__(self, cells: DataFrame, samples: DataFrame, regions: DataFrame, most: int):
        # In order of either key, so that a batch holds many rows of few keys; ranges of both, so that no key needs a task alone.
        self.by_region, self.by_sample = (
            cut(cells.repartitionByRange(*order).sortWithinPartitions(*order))
            for order in (("part", "region_id", "sample_name"), ("part", "sample_name", "region_id"))
        )
        self.samples, self.regions, self.most = samples, regions, most

    def moved_regions(self, samples: DataFrame, regions: DataFrame) -> DataFrame:
        return half_round(self.by_region, samples, "sample_name", regions, "region_id", self.most).drop("ll")

    def round(self) -> DataFrame:
        """Moves regions, then samples; the log-likelihood of every part and model."""
        self.regions = self.moved_regions(self.samples, self.regions)
        stepped = half_round(self.by_sample, self.regions, "region_id", self.samples, "sample_name", self.most)
        self.samples = stepped.drop("ll")
        return cut(stepped.groupBy("part", "k").agg(F.sum("ll").alias("ll")))

    def weights(self) -> tuple[DataFrame, DataFrame]:
        return self.samples, self.regions


def _numbers(lists: pa.Array, i: int, *shape: int) -> np.ndarray:
    return lists[i].values.to_numpy(zero_copy_only=False).reshape(*shape)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.ravel() for a in arrays], pa.list_(pa.float64()))


def _outer(x: np.ndarray) -> np.ndarray:
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def _means(e: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return e * np.exp(np.clip(shift, -LARGEST_SHIFT, LARGEST_SHIFT))


def _values(n: np.ndarray, e: np.ndarray, shift: np.ndarray, step: np.ndarray, axis: int) -> np.ndarray:
    """Log-likelihoods after each share of a step, summed along an axis, but for the terms that no weight changes."""
    tried = (np.clip(shift + share * step, -LARGEST_SHIFT, LARGEST_SHIFT) for share in SHARES)
    return np.stack([(n * t - e * np.exp(t)).sum(axis=axis) for t in tried], axis=-1)


def moved_block(n: np.ndarray, e: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Region weights of a block after a step, and what the block adds to the normal equations of its samples.

    `n` and `e` are regions x samples, zeros where there is no cell; `h` and `g` are regions and samples x models x factors.
    """
    most = h.shape[2]
    h, sums = h.copy(), np.empty((*g.shape[:2], most * most + most))
    for k in range(h.shape[1]):
        held, moved = g[:, k], h[:, k]
        shift = moved @ held.T
        mu = _means(e, shift)
        step = _solved((mu @ _outer(held)).reshape(-1, most, most), (n - mu) @ held)
        best = _values(n, e, shift, step @ held.T, 1).argmax(axis=1)
        h[:, k] = moved = moved + np.take(SHARES, best)[:, None] * step
        mu = _means(e, moved @ held.T)
        sums[:, k, : most * most] = mu.T @ _outer(moved)
        sums[:, k, most * most :] = (n - mu).T @ moved
    return h, sums


class Blocks:
    """Rounds over blocks of cells: (part, block, region_id, n, expected, fixed, w), the first a list of the block's regions.

    `fixed` holds, for each sample, the sum of its terms that no weight changes. Samples are a row for each part: (part,
    sample_name, w), lists in order of the names.
    """

    def __init__(self, cells: DataFrame, sizes: DataFrame, tasks: int, broadcast: bool, samples: DataFrame, regions: DataFrame, models: list[int]):
        kind = dict(cells.dtypes)["region_id"]
        self.models, self.most, self.sizes, self.tasks, self.broadcast = models, max(models), sizes, tasks, broadcast
        self.sample_type, self.region_type = dict(cells.dtypes)["sample_name"], kind
        order = F.row_number().over(Window.partitionBy("part").orderBy("sample_name")) - 1  # at most BLOCK_SAMPLES of a part
        places = small_table(cells.select("part", "sample_name").distinct().withColumn("i", order))
        placed = self._with_block(cells).join(places, ["part", "sample_name"])
        placed = placed.select("part", "block", "samples", "i", "region_id", F.col("n").cast("double").alias("n"), "expected")

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            width, i = int(pdf["samples"].iloc[0]), pdf["i"].to_numpy()
            ids, r = np.unique(pdf["region_id"].to_numpy(), return_inverse=True)
            n, e = pdf["n"].to_numpy(float), pdf["expected"].to_numpy(float)
            there = (e > 0) & ~np.isnan(n)
            at, n, e = (r * width + i)[there], n[there], e[there]
            sums = [np.bincount(at, x, len(ids) * width) for x in (n, e)]
            fixed = np.bincount(i[there], n * np.log(e), width)
            key = {"part": pdf["part"].iloc[0], "block": pdf["block"].iloc[0]}
            return pd.DataFrame([key | {"region_id": ids, "n": sums[0], "expected": sums[1], "fixed": fixed}])

        self.key = f"part string, block int, region_id array<{kind}>, n array<double>, expected array<double>, fixed array<double>"
        self.cells = cut(placed.groupBy("part", "block").applyInPandas(pack, self.key))
        self.samples = self._by_part(samples)
        self.regions = self._by_block(regions)

    def _with_block(self, rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(self.sizes) if self.broadcast else self.sizes, "part")
        return rows.withColumn("block", F.pmod(F.hash("region_id"), F.col("blocks")))

    def _by_part(self, samples: DataFrame) -> DataFrame:
        models = F.sort_array(F.collect_list(F.struct("sample_name", "k", "w")))
        rows = samples.where("sample_name IS NOT NULL").groupBy("part").agg(models.alias("m"))
        return cut(rows.select("part", F.transform(F.filter("m", lambda x: x.k == self.models[0]), lambda x: x.sample_name).alias("sample_name"), F.flatten("m.w").alias("w")))

    def _by_block(self, regions: DataFrame) -> DataFrame:
        """The blocks with region weights, in tasks by number of cells."""
        models = F.sort_array(F.collect_list(F.struct("region_id", "k", "w")))
        rows = self._with_block(regions).groupBy("part", "block").agg(models.alias("m"))
        rows = self.cells.join(rows.select("part", "block", F.flatten("m.w").alias("w")), ["part", "block"])
        return cut(rows.repartition(self.tasks, "part", "block"))

    def _with_samples(self, blocks: DataFrame, samples: DataFrame) -> DataFrame:
        return blocks.join(F.broadcast(samples) if self.broadcast else samples, "part")

    def _moved(self, blocks: DataFrame, samples: DataFrame) -> DataFrame:
        models, most = len(self.models), self.most

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                weights, sums = [], []
                for i in range(batch.num_rows):
                    g, h = (_numbers(batch.column(c), i, -1, models, most) for c in ("g", "w"))
                    found = moved_block(*(_numbers(batch.column(c), i, -1, len(g)) for c in ("n", "expected")), h, g)
                    weights.append(found[0])
                    sums.append(found[1])
                kept = {c: batch.column(c) for c in ("part", "block", "region_id", "n", "expected", "fixed")}
                yield pa.RecordBatch.from_pydict(kept | {"w": _lists(weights), "sums": _lists(sums)})

        rows = self._with_samples(blocks, samples.select("part", F.col("w").alias("g")))
        return cut(rows.mapInArrow(move, f"{self.key}, w array<double>, sums array<double>"))

    def _totals(self, rows: DataFrame, terms) -> DataFrame:
        """(part, total): the sum of what `terms(batch, row)` gives for the rows of a part, added up in each task first."""

        def out(held: dict[str, np.ndarray]) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.string()), "total": _lists(list(held.values()))})
            held.clear()
            return batch

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                for i, part in enumerate(batch.column("part").to_pylist()):
                    found = terms(batch, i)
                    held[part] = held[part] + found if part in held else found
                    if len(held) > HELD_PARTS:
                        yield out(held)
            yield out(held)

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"part": pdf["part"].iloc[0], "total": np.sum(np.stack(pdf["total"].to_numpy()), axis=0)}])

        schema = "part string, total array<double>"
        return rows.mapInArrow(add, schema).groupBy("part").applyInPandas(together, schema)

    def moved_regions(self, samples: DataFrame, regions: DataFrame) -> DataFrame:
        return self._rows(self._moved(self._by_block(regions), self._by_part(samples)), "region_id", self.region_type)

    def round(self) -> DataFrame:
        """Moves regions, then samples; the log-likelihood of every part and model."""
        models, most, shares = len(self.models), self.most, len(SHARES)
        self.regions = self._moved(self.regions, self.samples)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                totals = [_numbers(batch.column("total"), i, -1, models, most * most + most) for i in range(batch.num_rows)]
                steps = [_solved(t[..., : most * most].reshape(*t.shape[:2], most, most), t[..., most * most :]) for t in totals]
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("part", "sample_name", "w")} | {"step": _lists(steps)})

        def values(batch: pa.RecordBatch, i: int) -> np.ndarray:
            h, g, step = (_numbers(batch.column(c), i, -1, models, most) for c in ("w", "g", "step"))
            n, e = (_numbers(batch.column(c), i, -1, len(g)) for c in ("n", "expected"))
            found = [_values(n, e, h[:, k] @ g[:, k].T, h[:, k] @ step[:, k].T, 0) for k in range(models)]
            return (np.stack(found, axis=1) + _numbers(batch.column("fixed"), i, -1, 1, 1)).ravel()

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                weights, best = [], []
                for i in range(batch.num_rows):
                    w, step = (_numbers(batch.column(c), i, -1, models, most) for c in ("w", "step"))
                    total = _numbers(batch.column("total"), i, -1, models, shares)
                    weights.append(w + np.take(SHARES, total.argmax(axis=2))[..., None] * step)
                    best.append(total.max(axis=2).sum(axis=0))
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("part", "sample_name")} | {"w": _lists(weights), "ll": _lists(best)})

        schema = f"part string, sample_name array<{self.sample_type}>, w array<double>"
        sums = self._totals(self.regions.select("part", "sums"), lambda batch, i: _numbers(batch.column("sums"), i, -1).copy())
        stepped = cut(self.samples.join(sums, "part").mapInArrow(solve, f"{schema}, step array<double>"))
        tried = self._with_samples(self.regions.drop("sums"), stepped.select("part", F.col("w").alias("g"), "step"))
        moved = cut(stepped.join(self._totals(tried, values), "part").mapInArrow(choose, f"{schema}, ll array<double>"))
        self.samples = moved.drop("ll")
        k = F.array(*[F.lit(k) for k in self.models])
        return moved.select("part", F.explode(F.arrays_zip(k.alias("k"), "ll")).alias("m")).select("part", "m.k", "m.ll")

    def _rows(self, packed: DataFrame, key: str, kind: str) -> DataFrame:
        """A row for each part, model and key: (part, k, key, w)."""
        models, most = self.models, self.most

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    names, w = batch.column(key)[i].values, batch.column("w")[i].values
                    at = np.repeat(np.arange(len(names)), len(models))
                    columns = {"part": pa.repeat(batch.column("part")[i], len(at)), "k": pa.array(np.tile(models, len(names)), pa.int32())}
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, most), pa.int32()), w)
                    yield pa.RecordBatch.from_pydict(columns | {key: names.take(pa.array(at)), "w": lists})

        return cut(packed.select("part", key, "w").mapInArrow(unpack, f"part string, k int, {key} {kind}, w array<double>"))

    def weights(self) -> tuple[DataFrame, DataFrame]:
        return self._rows(self.samples, "sample_name", self.sample_type), self._rows(self.regions, "region_id", self.region_type)


def laid_out(cells: DataFrame, samples: DataFrame, regions: DataFrame, models: list[int]) -> Cells | Blocks:
    """Blocks, or a row for each cell where a part has many samples or most cells of the table are missing."""
    known = cells.dropna(subset=["part", "sample_name", "region_id"])
    sizes = known.groupBy("part").agg(F.count("*").alias("cells"), F.countDistinct("sample_name").alias("samples"), F.countDistinct("region_id").alias("regions"))
    whole = F.col("samples") * F.col("regions")
    sizes = cut(sizes.withColumn("blocks", F.ceil(whole / BLOCK_CELLS).cast("int")))
    found = sizes.agg(F.sum("cells").alias("cells"), F.max("samples").alias("widest"), F.sum(whole).alias("whole"), F.sum("samples").alias("samples"), F.sum("blocks").alias("blocks")).head()
    if not found.cells or found.widest > BLOCK_SAMPLES or 2 * found.cells < found.whole:
        return Cells(cells, samples, regions, max(models))
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.whole // TASK_CELLS))
    return Blocks(known, sizes.select("part", "samples", "blocks"), min(tasks, found.blocks), found.samples <= BROADCAST_ROWS, samples, regions, models)


def start_weights(cells: DataFrame, factors: list[int], lone_share: float) -> tuple[DataFrame, DataFrame]:
    """Sample and region weights of every model: the leading eigenvectors of the log residual, and its projections on them."""
    most = max(factors)
    residual = cut(cells.withColumn("residual", F.ln((F.col("n") + 0.5) / (F.col("expected") + 0.5))))
    found = blocks.components(residual, "part", "sample_name", "region_id", "residual", most)
    place = F.row_number().over(Window.partitionBy("part", "sample_name").orderBy("component"))  # at most `most` rows
    lone = F.max(F.col("u") * F.col("u")).over(Window.partitionBy("part", "component")) > lone_share
    found = found.withColumns({"i": place, "u": F.when(lone, 0.0).otherwise(F.col("u"))})
    vectors = found.groupBy("part", "sample_name").agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("u"))), F.lit(0.0)) for i in range(1, most + 1)]).alias("us")
    )
    vectors = cut(cells.select("part", "sample_name").distinct().join(vectors, ["part", "sample_name"], "left")).withColumn(
        "us", F.coalesce("us", F.array_repeat(F.lit(0.0), most))
    )
    projected = residual.join(small_table(vectors), ["part", "sample_name"])
    projected = projected.groupBy("part", "region_id").agg(
        F.array(*[F.sum(F.col("residual") * F.get("us", F.lit(i))) for i in range(most)]).alias("us")
    )

    def model(k: int) -> Column:
        return F.struct(F.lit(k).alias("k"), F.transform("us", lambda u, i: F.when(i < k, u).otherwise(0.0)).alias("w"))

    def models(rows: DataFrame, key: str) -> DataFrame:
        exploded = rows.select("part", key, F.explode(F.array(*[model(k) for k in factors])).alias("m"))
        return cut(exploded.select("part", "m.k", key, "m.w"))

    return models(vectors, "sample_name"), models(projected, "region_id")


def orthogonal(samples: DataFrame, regions: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The same models with orthonormal sample weights and orthogonal region weights, the strongest factor first.

    Only the k x k products of each side's weights are needed, sums over its rows.
    """

    def products(rows: DataFrame, name: str) -> DataFrame:
        w = [F.get("w", F.lit(i)) for i in range(most)]
        return rows.groupBy("part", "k").agg(F.array(*[F.sum(w[i] * w[j]) for i in range(most) for j in range(most)]).alias(name))

    def turns(g: pd.Series, h: pd.Series) -> pd.DataFrame:
        left, right = [], []
        for a, b in zip(g, h, strict=True):
            values, vectors = np.linalg.eigh(np.reshape(a, (most, most)))
            root = np.sqrt(np.clip(values, 0, None))
            inverse = np.divide(1.0, root, out=np.zeros_like(root), where=root > 1e-9 * max(root.max(), 1e-300))
            half, unhalf = (vectors * root) @ vectors.T, (vectors * inverse) @ vectors.T
            _, q = np.linalg.eigh(half @ np.reshape(b, (most, most)) @ half)
            q = q[:, ::-1]
            left.append((unhalf @ q).ravel().tolist())
            right.append((half @ q).ravel().tolist())
        return pd.DataFrame({"t_samples": left, "t_regions": right})

    turn = F.pandas_udf(turns, "t_samples array<double>, t_regions array<double>")
    found = products(samples, "g").join(products(regions, "h"), ["part", "k"])
    found = small_table(found.select("part", "k", turn("g", "h").alias("t")).select("part", "k", "t.*"))

    def turned(rows: DataFrame, key: str, name: str) -> DataFrame:
        w = [
            sum((F.get("w", F.lit(i)) * F.get(name, F.lit(i * most + j)) for i in range(most)), F.lit(0.0)) for j in range(most)
        ]
        return rows.join(found, ["part", "k"]).select("part", "k", key, F.array(*w).alias("w"))

    return turned(samples, "sample_name", "t_samples"), cut(turned(regions, "region_id", "t_regions"))


def without_lone(samples: DataFrame, lone_share: float) -> DataFrame:
    """Orthonormal sample weights, those of factors that one sample carries set to zero."""
    samples = cut(samples)
    largest = samples.select("part", "k", F.posexplode("w").alias("i", "u")).groupBy("part", "k", "i")
    largest = largest.agg(F.max(F.col("u") * F.col("u")).alias("most")).where(F.col("most") > lone_share)
    lone = small_table(largest.groupBy("part", "k").agg(F.collect_set("i").alias("lone")))
    kept = F.transform("w", lambda u, i: F.when(F.array_contains("lone", i), 0.0).otherwise(u))
    return cut(samples.join(lone, ["part", "k"], "left").select("part", "k", "sample_name", F.when(F.col("lone").isNull(), F.col("w")).otherwise(kept).alias("w")))


def fit(
    cells: DataFrame, factors: list[int], rounds: int = ROUNDS, gain: float = GAIN, lone_share: float = LONE_SHARE
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Sample weights, region weights, and the log-likelihood of every part and model after each round."""
    most = max(factors)
    layout = laid_out(cells, *start_weights(cells, factors, lone_share), sorted(set(factors)))
    history: list[DataFrame] = []
    for _ in range(rounds):
        history.append(layout.round())
        if len(history) > 1:
            before = history[-2].withColumnRenamed("ll", "before")
            gained = history[-1].join(before, ["part", "k"]).where((F.col("ll") - F.col("before")) > gain * F.abs("before"))
            if gained.isEmpty():
                break
    samples, regions = orthogonal(*layout.weights(), most)
    samples = without_lone(samples, lone_share)
    regions = layout.moved_regions(samples, regions)
    return samples, regions, history


def poisson_models(k0: DataFrame, factors: tuple[int, ...] = LATENT_FACTORS, lone_share: float = LONE_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Expected counts under each number of factors, as an array over `factors`; rows as `poisson_caller.latent_models` gives."""
    part = F.concat_ws("/", F.col("label").cast("string"), "contig")
    cells = cut(k0.select(part.alias("part"), "label", "sample_name", "region_id", "contig", "start_bp", "end_bp", "n", "expected"))
    asked = sorted({k for k in factors if k > 0})
    if not asked:
        return cells.withColumn("models", F.array(*[F.col("expected") for _ in factors])).drop("part")
    samples, regions, _ = fit(cells.select("part", "sample_name", "region_id", "n", "expected"), asked, rounds, lone_share=lone_share)

    def by_model(rows: DataFrame, key: str, name: str) -> DataFrame:
        return small_table(rows.groupBy("part", key).agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias(name)))

    rows = cells.join(by_model(samples, "sample_name", "g"), ["part", "sample_name"]).join(by_model(regions, "region_id", "h"), ["part", "region_id"])
    fitted = [
        F.col("expected") * F.exp(_dot(F.element_at("g", F.lit(k)), F.element_at("h", F.lit(k)))) if k > 0 else F.col("expected") for k in factors
    ]
    return rows.withColumn("models", F.array(*fitted)).drop("part", "g", "h")
