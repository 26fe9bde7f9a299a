"""Sample-by-sample products in blocks: Gram matrix, nearest neighbours, correlations, leading components.

The table stays long (group, sample, region, value). Samples are hashed into row blocks and regions into column
blocks; a task multiplies two row blocks over one column block. No task holds more than two blocks, and pairs
leave a task as arrays or as the best few per sample, never as one row per pair and region.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.session import cut, small_table

ROW_BLOCK = 512
COLUMN_BLOCK = 4096

# Up to this many samples a group's Gram matrix (32 MB) is decomposed in one task.
DENSE_SAMPLES = 2000
GUARD_VECTORS = 8

PARTIAL = (
    "lo int, hi int, n long, row_names array<string>, col_names array<string>, "
    "dot array<double>, row_sum array<double>, row_sq array<double>, col_sum array<double>, col_sq array<double>"
)


def with_blocks(
    values: DataFrame, group: str, sample: str, dim: str, value: str, row_block: int, column_block: int
) -> DataFrame:
    """(grp, sample, dim, v, lo, hi, cb): every row once per pair of row blocks that its own block takes part in."""
    sizes = small_table(
        values.groupBy(F.col(group).alias("grp")).agg(
            F.countDistinct(sample).alias("_samples"), F.countDistinct(dim).alias("_dims")
        )
    )
    rows = values.select(
        F.col(group).alias("grp"), F.col(sample).alias("sample"), F.col(dim).alias("dim"), F.col(value).alias("v")
    ).join(sizes, "grp")
    row_blocks = F.ceil(F.col("_samples") / row_block).cast("int")
    column_blocks = F.ceil(F.col("_dims") / column_block).cast("int")
    own = F.pmod(F.hash("sample"), F.col("_rb"))
    return (
        rows.withColumns({"_rb": row_blocks, "_cb": column_blocks})
        .withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("_rb") - 1))})
        .select(
            "grp",
            "sample",
            "dim",
            "v",
            "own",
            F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"),
            F.pmod(F.hash("dim"), F.col("_cb")).alias("cb"),
        )
    )


def block_product(pdf: pd.DataFrame) -> pd.DataFrame:
    """Dot products and sums of the two row blocks of one group, over its column block."""
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    dims, dim_at = np.unique(pdf["dim"].to_numpy(), return_inverse=True)

    def matrix(part: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, name_at = np.unique(part["sample"].to_numpy().astype(str), return_inverse=True)
        m = np.zeros((len(names), len(dims)))
        m[name_at, at] = part["v"].to_numpy()
        return names, m

    in_lo = (pdf["own"] == lo).to_numpy()
    in_hi = (pdf["own"] == hi).to_numpy()
    row_names, rows = matrix(pdf[in_lo], dim_at[in_lo])
    col_names, cols = matrix(pdf[in_hi], dim_at[in_hi])
    return pd.DataFrame(
        {
            "grp": [pdf["grp"].iloc[0]],
            "lo": [lo],
            "hi": [hi],
            "n": [len(dims)],
            "row_names": [row_names],
            "col_names": [col_names],
            "dot": [(rows @ cols.T).ravel()],
            "row_sum": [rows.sum(axis=1)],
            "row_sq": [(rows * rows).sum(axis=1)],
            "col_sum": [cols.sum(axis=1)],
            "col_sq": [(cols * cols).sum(axis=1)],
        }
    )


def add_blocks(pdf: pd.DataFrame) -> dict:
    """Sum of the partial products of one block pair, aligned by sample name."""
    row_names = np.unique(np.concatenate(pdf["row_names"].tolist()).astype(str))
    col_names = np.unique(np.concatenate(pdf["col_names"].tolist()).astype(str))
    total = {
        "row_names": row_names,
        "col_names": col_names,
        "n": int(pdf["n"].sum()),
        "dot": np.zeros((len(row_names), len(col_names))),
        "row_sum": np.zeros(len(row_names)),
        "row_sq": np.zeros(len(row_names)),
        "col_sum": np.zeros(len(col_names)),
        "col_sq": np.zeros(len(col_names)),
    }
    for part in pdf.itertuples():
        r = np.searchsorted(row_names, np.asarray(part.row_names).astype(str))
        c = np.searchsorted(col_names, np.asarray(part.col_names).astype(str))
        total["dot"][np.ix_(r, c)] += np.asarray(part.dot).reshape(len(r), len(c))
        for name, at in (("row_sum", r), ("row_sq", r), ("col_sum", c), ("col_sq", c)):
            total[name][at] += np.asarray(getattr(part, name))
    return total


def pair_blocks(
    values: DataFrame,
    group: str,
    sample: str,
    dim: str,
    value: str,
    finish,
    schema: str,
    row_block: int = ROW_BLOCK,
    column_block: int = COLUMN_BLOCK,
) -> DataFrame:
    """Run `finish` on the summed products of every pair of row blocks of every group.

    `finish(total)` gets names, dot products and sums for one pair of blocks, seen from its rows; it returns a
    frame with `schema`. A pair of two different blocks is shown to it from both sides.
    """
    group_type = dict(values.dtypes)[group]
    blocked = with_blocks(values, group, sample, dim, value, row_block, column_block)
    partial = blocked.groupBy("grp", "lo", "hi", "cb").applyInPandas(block_product, f"grp {group_type}, {PARTIAL}")

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        total = add_blocks(pdf)
        frames = [finish(total)]
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            swapped = {
                "n": total["n"],
                "dot": total["dot"].T,
                **{f"row_{k}": total[f"col_{k}"] for k in ("names", "sum", "sq")},
                **{f"col_{k}": total[f"row_{k}"] for k in ("names", "sum", "sq")},
            }
            frames.append(finish(swapped))
        out = pd.concat(frames, ignore_index=True)
        out.insert(0, group, pdf["grp"].iloc[0])
        return out

    return partial.groupBy("grp", "lo", "hi").applyInPandas(finished, f"{group} {group_type}, {schema}")


def matrix_rows(
    values: DataFrame, group: str, sample: str, dim: str, value: str, entry, name: str, **sizes
) -> DataFrame:
    """One row per sample with the names of its partners and `entry` for each, as two arrays sorted by name."""

    def finish(total: dict) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "sample": total["row_names"],
                "partners": [total["col_names"]] * len(total["row_names"]),
                "entries": list(entry(total)),
            }
        )

    pieces = pair_blocks(
        values, group, sample, dim, value, finish, "sample string, partners array<string>, entries array<double>", **sizes
    )
    zipped = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("partners", "entries"))))
    return (
        pieces.groupBy(group, "sample")
        .agg(zipped.alias("z"))
        .select(
            group,
            F.col("sample").alias("sample_name"),
            F.col("z.partners").alias("partners"),
            F.col("z.entries").alias(name),
        )
    )


def gram(values: DataFrame, group: str, sample: str, dim: str, value: str, **sizes) -> DataFrame:
    return matrix_rows(values, group, sample, dim, value, lambda total: total["dot"], "dots", **sizes)


def correlations(values: DataFrame, group: str, sample: str, dim: str, value: str, **sizes) -> DataFrame:
    """Pearson correlation over the dims; NULL entries (NaN) where a sample is constant."""

    def entry(total: dict) -> np.ndarray:
        n = total["n"]
        covariance = n * total["dot"] - np.outer(total["row_sum"], total["col_sum"])
        row_var = n * total["row_sq"] - total["row_sum"] ** 2
        col_var = n * total["col_sq"] - total["col_sum"] ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return covariance / np.sqrt(np.outer(row_var, col_var))

    return matrix_rows(values, group, sample, dim, value, entry, "corrs", **sizes)


def nearest(values: DataFrame, group: str, sample: str, dim: str, value: str, k: int, **sizes) -> DataFrame:
    """The k nearest other samples of every sample by Euclidean distance, ties by name.

    Distances are floored to 1e-9 first, so that rounding in sums cannot turn a tie. Each block pair keeps the k
    best per sample; the best k of those are the best k of all.
    """

    def finish(total: dict) -> pd.DataFrame:
        rows, cols = total["row_names"], total["col_names"]
        squares = total["row_sq"][:, None] + total["col_sq"][None, :] - 2 * total["dot"]
        distance = np.floor(np.sqrt(np.maximum(squares, 0)) * 1e9) / 1e9
        distance[rows[:, None] == cols[None, :]] = np.inf
        # Names ascend, so that a stable order leaves ties to the smaller one.
        best = np.argsort(distance, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(distance, best, axis=1)
        out = pd.DataFrame({"sample": np.repeat(rows, best.shape[1]), "neighbour": cols[best.ravel()], "distance": found.ravel()})
        return out[np.isfinite(out["distance"])]

    found = pair_blocks(
        values, group, sample, dim, value, finish, "sample string, neighbour string, distance double", **sizes
    )
    order = Window.partitionBy(group, "sample").orderBy("distance", "neighbour")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumnRenamed("sample", "sample_name")
    )


def fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Turn each column so that its largest entry in size is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def dense_components(gram_rows: DataFrame, group: str, k: int) -> DataFrame:
    """Leading k eigenvectors of each group's Gram matrix, one group per task."""
    group_type = dict(gram_rows.dtypes)[group]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_name")
        matrix = np.vstack(pdf["dots"].tolist())
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        top = np.argsort(values)[::-1][: min(k, max(1, len(values) - 1))]
        vectors = fixed_signs(vectors[:, top])
        return pd.DataFrame(
            {
                group: pdf[group].iloc[0],
                "sample_name": np.repeat(pdf["sample_name"].to_numpy(), len(top)),
                "component": np.tile(np.arange(1, len(top) + 1), len(matrix)),
                "u": vectors.ravel(),
                "eigenvalue": np.tile(np.maximum(values[top], 0), len(matrix)),
            }
        )

    return gram_rows.groupBy(group).applyInPandas(
        solve, f"{group} {group_type}, sample_name string, component int, u double, eigenvalue double"
    )


def iterated_components(
    values: DataFrame, sample: str, dim: str, value: str, wanted: int, k: int, rounds: int = 1000, tolerance: float = 1e-12
) -> DataFrame:
    """Leading `wanted` left singular vectors of one large matrix by orthogonal iteration on k >= wanted vectors.

    Rounds go on until the eigenvalues settle; if they do not within `rounds`, that is an error. The vectors stay a table with one row per sample. Each round is two joins and two sums over the long table;
    only k x k matrices reach the driver. The vectors beyond the wanted ones speed up convergence.
    """
    rows = cut(values.select(F.col(sample).alias("sample"), F.col(dim).alias("dim"), F.col(value).alias("v")))
    # A deterministic start: pseudo-random numbers from the sample name.
    start = [((F.xxhash64("sample", F.lit(j)) % 10007) / 10007.0).alias(f"q{j}") for j in range(k)]
    q = rows.select("sample").distinct().select("sample", *start)
    names = [f"q{j}" for j in range(k)]
    schema = "sample string, " + ", ".join(f"{c} double" for c in names)

    def products(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        """left^T right over all rows, summed from one small matrix per task."""

        def partial(batches):
            total = np.zeros((len(left), len(right)))
            for pdf in batches:
                total += pdf[left].to_numpy().T @ pdf[right].to_numpy()
            yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

        summed = df.select(*dict.fromkeys(left + right)).mapInPandas(partial, "at int, x double")
        out = np.zeros(len(left) * len(right))
        for row in summed.groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[row["at"]] = row["x"]
        return out.reshape(len(left), len(right))

    def times(df: DataFrame, factor: np.ndarray) -> DataFrame:
        def multiply(batches):
            for pdf in batches:
                turned = pd.DataFrame(pdf[names].to_numpy() @ factor, columns=names)
                turned.insert(0, "sample", pdf["sample"].to_numpy())
                yield turned

        return df.select("sample", *names).mapInPandas(multiply, schema)

    def step(vectors: DataFrame) -> DataFrame:
        """Gram matrix times vectors, without the Gram matrix."""
        z = rows.join(vectors, "sample").groupBy("dim").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in names])
        return rows.join(z, "dim").groupBy("sample").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in names])

    def orthonormal(vectors: DataFrame) -> DataFrame:
        lower = np.linalg.cholesky(products(vectors, names, names) + 1e-300 * np.eye(k))
        return times(vectors, np.linalg.inv(lower).T)

    q = cut(orthonormal(cut(q)))
    before = np.zeros(k)
    for _ in range(rounds):
        y = cut(step(q))
        paired = q.join(y.withColumnsRenamed({c: f"y_{c}" for c in names}), "sample")
        h = products(paired, names, [f"y_{c}" for c in names])
        eigenvalues, turn = np.linalg.eigh((h + h.T) / 2)
        eigenvalues, turn = eigenvalues[::-1], turn[:, ::-1]
        if np.all(np.abs(eigenvalues - before)[:wanted] <= tolerance * max(eigenvalues[0], 1e-300)):
            break
        before = eigenvalues
        q = cut(orthonormal(y))
    else:
        raise RuntimeError(f"the leading {wanted} components have not settled after {rounds} rounds")
    turned = times(q, turn)
    signs = turned.agg(*[F.max_by(F.signum(c), F.abs(F.col(c))).alias(c) for c in names]).first()
    entries = [
        F.struct(
            F.lit(j + 1).alias("component"),
            (F.col(c) * (signs[c] or 1.0)).alias("u"),
            F.lit(float(max(eigenvalues[j], 0))).alias("eigenvalue"),
        )
        for j, c in enumerate(names[:wanted])
    ]
    return turned.select(F.col("sample").alias("sample_name"), F.explode(F.array(*entries)).alias("e")).select(
        "sample_name", "e.*"
    )


def components(
    values: DataFrame, group: str, sample: str, dim: str, value: str, k: int, dense: int = DENSE_SAMPLES
) -> DataFrame:
    """Leading k eigenvectors u (over samples) of each group, with eigenvalues.

    Groups of up to `dense` samples are decomposed from their Gram matrix, one group per task; larger ones, of
    which there are at most (samples / dense), by orthogonal iteration.
    """
    sizes = values.groupBy(group).agg(F.countDistinct(sample).alias("samples")).where(F.col("samples") > dense)
    large = {row[group]: row["samples"] for row in sizes.collect()}
    small = values.where(~F.col(group).isin(list(large))) if large else values
    found = dense_components(gram(small, group, sample, dim, value), group, k)
    for label, samples in large.items():
        part = values.where(F.col(group) == F.lit(label))
        one = iterated_components(part, sample, dim, value, k, min(samples, k + GUARD_VECTORS))
        one = one.withColumn(group, F.lit(label))
        found = found.unionByName(one.select(found.columns))
    return found
