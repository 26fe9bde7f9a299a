"""Whitening of embeddings by an eigendecomposition that grows row by row.

A vector c becomes the integers x = floor(1024 * c) + 100000. The components are the unit eigenvectors of the covariance of
all x; whitened values are the centred x on a component, over the root of its eigenvalue.

1. Each partition keeps mean, eigenvalues and eigenvectors of the scatter of the rows it has seen. A row is a centred
   rank-one update: its coordinates in the present eigenvectors and the present eigenvalues make a secular equation, whose
   roots are the new eigenvalues (`rank_one`). Coordinates that vanish and eigenvalues that agree are deflated first. Rows
   that repeat within a slice of a batch are one update with their number as weight. Sums of the x are kept as integers.
2. Spectra of partitions are combined, `FAN_IN` at a time: one takes in the eigenpairs of the other, and the difference of
   the means, each as a rank-one update.
3. The combined spectrum is refined: a pass over all rows multiplies the centred covariance with the leading vectors and
   `GUARD` more, a small eigenproblem gives Ritz values and vectors, and what they leave as residual is solved for in the
   rest of the combined spectrum and added to the basis, until the residual is down to `TOLERANCE` of the largest
   eigenvalue, or rounding keeps it from falling further.
4. One pass measures the covariance of the whitened values, one writes the rows.

Nulls and edge cases: vectors that are null, or hold null or non-finite entries, take no part; a shorter vector, an empty
one too, counts as if zeros followed, up to the longest; an x beyond 2**53 in size counts as 2**53 from 100000; rows
without an id, repeated rows and repeated ids are rows of their own. With fewer dimensions than components there are as
many components as dimensions. A component without variance has no whitened value (null) and no part in the error; without
any variance `explained` is null. `deviation` is null where it does not fit a long. Ties of eigenvalues give some basis of
their space. An empty table gives an empty result; further columns are ignored. Some d x d numbers must fit in a task and
on the driver, for vectors of d entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.session import cut

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GUARD = 8
TOLERANCE = 1e-14
ROUNDS = 6
FAN_IN = 8
SLICE_NUMBERS = 1 << 19
FLAT = 1e-12  # an eigenvalue below this share of the largest is no variance
LARGEST = float(1 << 53)

EPS = np.finfo(float).eps
LOW_BITS = 26
SPECTRUM = "no long, n long, high array<long>, low array<long>, mean array<double>, values array<double>, vectors array<double>"


# --- one rank-one update


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - root)) = 0 for rising poles and positive weights, and poles - root for each.

    Root i lies between poles i and i + 1. It is found as its distance from the nearer of the two, by two-pole
    interpolation kept inside a shrinking bracket, for all roots at once.
    """
    m = len(poles)
    gap = np.append(np.diff(poles), weights.sum())
    at = np.arange(m)
    half = gap / 2
    middle = 1 + (weights / (poles[None, :] - poles[:, None] - half[:, None])).sum(axis=1)
    near_left = middle >= 0
    near_left[-1] = True
    origin = at + ~near_left
    delta = poles[None, :] - poles[origin][:, None]
    low, high = np.where(near_left, 0.0, -half), np.where(near_left, half, 0.0)
    if middle[-1] < 0:
        low[-1], high[-1] = half[-1], gap[-1]
    below = at[None, :] <= at[:, None]
    tau = (low + high) / 2
    for _ in range(80):
        t = delta - tau[:, None]
        ratio = weights / t
        slope = ratio / t
        f = 1 + ratio.sum(axis=1)
        done = (np.abs(f) <= EPS * m * (1 + np.abs(ratio).sum(axis=1))) | (high - low <= 2 * EPS * np.abs(tau))
        if done.all():
            break
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        left = np.where(below, slope, 0).sum(axis=1)
        right = slope.sum(axis=1) - left
        p = t[at, at]
        q = np.append(t[at[:-1], at[1:]], 1.0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            c = f - p * left - q * right
            a = (p + q) * f - p * q * (left + right)
            b = p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = p[-1] * f[-1] / (f[-1] - p[-1] * left[-1])
            new = tau + step
            inside = (new > low) & (new < high)
        tau = np.where(done, tau, np.where(inside, new, (low + high) / 2))
    return poles[origin] + tau, delta - tau[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of `vectors` diag(`values`) `vectors`' + `weight` v v'."""
    z = v @ vectors
    length = np.sqrt(z @ z)
    rho = weight * length * length
    if not rho > 0:
        return values, vectors
    z = z / length
    tiny = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    close = np.diff(values) <= tiny
    if close.any():
        # A reflection within a run of equal eigenvalues leaves one of them with all of z.
        vectors = vectors.copy()
        starts = np.flatnonzero(np.concatenate([[True], ~close]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
            part = z[a:b].copy()
            size = np.sqrt(part @ part)
            if b - a == 1 or size == 0:
                continue
            sign = 1.0 if part[-1] >= 0 else -1.0
            part[-1] += sign * size
            part /= np.sqrt(part @ part)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ part, part)
            z[a:b] = 0
            z[b - 1] = -sign * size
    live = np.flatnonzero(rho * np.abs(z) > tiny)
    if not len(live):
        return values, vectors
    poles, zs = values[live], z[live]
    values = values.copy()
    if len(live) == 1:
        values[live] = poles + rho * zs * zs
    else:
        roots, apart = secular_roots(poles, rho * zs * zs)
        # The z for which the computed roots are exact makes the new vectors orthogonal (Gu and Eisenstat, 1994).
        between = poles[None, :] - poles[:, None]
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.abs(np.prod(-apart.T / between, axis=1))) * np.where(zs < 0, -1.0, 1.0)
        turn = exact[:, None] / apart.T
        turn /= np.sqrt((turn * turn).sum(axis=0))
        vectors = vectors.copy()
        vectors[:, live] = vectors[:, live] @ turn
        values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


# --- spectra of partitions


@dataclass
class Spectrum:
    """Number, sums (shifted, exact), mean and scatter (by eigenvalues and eigenvectors) of some rows."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(d), np.zeros(d), np.eye(d))

    def widen(self, d: int) -> None:
        """Dimensions that no row had so far: zero in all of them."""
        more = d - len(self.mean)
        if more <= 0:
            return
        self.high, self.low, self.mean = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.high, self.low, self.mean))
        vectors = np.zeros((d, d))
        vectors[d - more :, :more] = np.eye(more)
        vectors[: d - more, more:] = self.vectors
        self.values = np.concatenate([np.zeros(more), self.values])
        self.vectors = vectors
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def add(self, rows: np.ndarray) -> None:
        """Takes in rows of shifted integers."""
        self.widen(rows.shape[1])
        if rows.shape[1] < len(self.mean):
            rows = np.pad(rows, ((0, 0), (0, len(self.mean) - rows.shape[1])))
        self.high += (rows >> LOW_BITS).sum(axis=0)
        self.low += (rows & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if not rows.shape[1]:
            self.n += len(rows)
            return
        distinct, counts = np.unique(rows, axis=0, return_counts=True)
        for row, count in zip(distinct.astype(np.float64), counts.tolist(), strict=True):
            apart = row - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * count / (self.n + count))
            self.mean = self.mean + apart * (count / (self.n + count))
            self.n += count

    def take(self, other: Spectrum) -> None:
        """Takes in the rows of another spectrum, an eigenpair at a time."""
        d = max(len(self.mean), len(other.mean))
        self.widen(d)
        other.widen(d)
        if d:
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
            apart = other.mean - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * other.n / (self.n + other.n))
            self.mean = self.mean + apart * (other.n / (self.n + other.n))
        self.n += other.n
        self.high += other.high
        self.low += other.low

    def sums(self) -> list[int]:
        return [(h << LOW_BITS) + l for h, l in zip(self.high.tolist(), self.low.tolist(), strict=True)]

    def stored(self, no: int) -> pd.DataFrame:
        row = {"no": no, "n": self.n, "high": self.high, "low": self.low, "mean": self.mean, "values": self.values, "vectors": self.vectors.ravel()}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    @staticmethod
    def restored(row) -> Spectrum:
        d = len(row["mean"])
        high, low = (np.array(row[c], dtype=np.int64) for c in ("high", "low"))
        mean, values, vectors = (np.array(row[c], dtype=np.float64) for c in ("mean", "values", "vectors"))
        return Spectrum(int(row["n"]), high, low, mean, values, vectors.reshape(d, d))


def shifted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of a column of vectors: the places of the usable ones in the column, and their x - 100000."""
    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (wrong[offsets[1:]] == wrong[offsets[:-1]]))
    lengths = (offsets[1:] - offsets[:-1])[good]
    step = max(1, SLICE_NUMBERS // max(1, int(lengths.max(initial=1))))
    for k in range(0, len(good), step):
        places, own = good[k : k + step], lengths[k : k + step]
        rows = np.zeros((len(places), int(own.max(initial=0))), dtype=np.int64)
        for length in np.unique(own).tolist():
            some = np.flatnonzero(own == length)
            entries = flat[offsets[places[some]][:, None] + np.arange(length)]
            with np.errstate(over="ignore"):
                rows[some, :length] = np.clip(np.floor(SCALE * entries), -LARGEST, LARGEST).astype(np.int64)
        yield places, rows


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Spectrum.empty(0)
    for batch in batches:
        for _, rows in shifted(batch.column("embedding")):
            found.add(rows)
    if found.n:
        yield pa.RecordBatch.from_pandas(found.stored(TaskContext.get().partitionId()), preserve_index=False)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    rows = [Spectrum.restored(row) for _, row in group.sort_values("no").iterrows()]
    for other in rows[1:]:
        rows[0].take(other)
    return rows[0].stored(int(group.no.iloc[0]) // FAN_IN)


def spectrum(vectors: DataFrame) -> Spectrum | None:
    """The spectrum of all rows, combined from those of the partitions; none if there is no row."""
    parts = cut(vectors.select("embedding").mapInArrow(_spectra, SPECTRUM))
    last = parts.agg(F.max("no")).head()[0]
    if last is None:
        return None
    while last > 0:
        parts = parts.groupBy((F.col("no") / FAN_IN).cast("long").alias("group")).applyInPandas(_merged, SPECTRUM)
        last //= FAN_IN
    return Spectrum.restored(parts.toPandas().iloc[0])


# --- refinement and result


def _padded(rows: np.ndarray, mean: np.ndarray) -> np.ndarray:
    out = np.tile(-mean, (len(rows), 1))
    out[:, : rows.shape[1]] += rows
    return out


def _summed(vectors: DataFrame, part, height: int, width: int) -> np.ndarray:
    """Sum over all slices of the height x width matrices that `part(rows)` gives; a row of it per task is shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            for _, rows in shifted(batch.column("embedding")):
                total += part(rows)
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "x"])

    rows = vectors.select("embedding").mapInArrow(sums, "at int, x array<double>")
    out = np.zeros((height, width))
    for row in rows.groupBy("at").agg(F.array(*(F.sum(F.col("x")[j]) for j in range(width))).alias("x")).collect():
        out[row["at"]] = row["x"]
    return out


def refined(vectors: DataFrame, found: Spectrum, k: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues of the covariance and their vectors, from a spectrum that may be inexact."""
    d, n = len(found.mean), found.n
    mean = np.array([s / n for s in found.sums()])
    m = min(d, k + guard)
    values, rest_values = found.values[::-1] / n, found.values[: d - m] / n
    basis, rest = np.linalg.qr(found.vectors[:, ::-1][:, :m])[0], found.vectors[:, : d - m]
    best = np.inf
    for _ in range(ROUNDS):

        def product(rows: np.ndarray, q: np.ndarray = basis) -> np.ndarray:
            centred = _padded(rows, mean)
            return centred.T @ (centred @ q)

        image = _summed(vectors, product, d, basis.shape[1]) / n
        small = basis.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        leading = basis @ turn
        residual = (image @ turn - leading * ritz)[:, :k]
        size = np.abs(residual).max(initial=0)
        if size < best / 2:
            values, chosen, best = ritz[:k], leading[:, :k], size
        else:
            break
        if size <= TOLERANCE * max(ritz[0], 0) or basis.shape[1] == d:
            break
        distance = ritz[:k][None, :] - rest_values[:, None]
        floor = EPS * max(ritz[0], np.finfo(float).tiny)
        distance = np.where(np.abs(distance) < floor, floor, distance)
        correction = rest @ ((rest.T @ residual) / distance)
        basis = np.linalg.qr(np.hstack([leading[:, :m], correction]))[0][:, : min(d, m + k)]
    top = np.abs(chosen).argmax(axis=0)
    return np.maximum(values[:k], 0), chosen * np.where(chosen[top, np.arange(k)] < 0, -1.0, 1.0)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = embeddings.select("vec_id", "embedding").where("embedding is not null")
    found = spectrum(vectors)
    k = 0 if found is None else min(components, len(found.mean))
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums = found.n, found.sums()
    mean = np.array([s / n for s in sums])
    values, basis = refined(vectors, found, k)
    total = found.values.sum() / n
    real = values > FLAT * max(values[0], np.finfo(float).tiny)
    turn = np.where(real, basis / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def products(rows: np.ndarray) -> np.ndarray:
        z = _padded(rows, mean) @ turn
        return np.vstack([z.T @ z, z.sum(axis=0)])

    moments = _summed(vectors, products, k + 1, k) / n
    covariance = moments[:k] - np.outer(moments[k], moments[k])
    error = np.abs(covariance - np.eye(k))[np.ix_(real, real)].max(initial=0)
    explained = values / total if total > 0 else np.full(k, np.nan)
    wrapped = np.array([s % (1 << 64) for s in sums], dtype=np.uint64)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, rows in shifted(batch.column("embedding")):
                z = (_padded(rows, mean) @ turn).ravel()
                wide = np.zeros((len(rows), len(mean)), dtype=np.int64)
                wide[:, : rows.shape[1]] = rows
                # Integers wrap, which changes nothing if the sum fits a long.
                apart = wide.astype(np.uint64) * np.uint64(n % (1 << 64)) - wrapped
                exact = (apart * apart).sum(axis=1, dtype=np.uint64).astype(np.int64)
                about = ((wide * float(n) - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
                count = len(rows)
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(places, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, n)),
                    pa.array(np.repeat(exact, k), mask=np.repeat(about >= 2.0**63 * (1 - 1e-9), k)),
                    pa.array(z, mask=np.tile(~real, count)),
                    pa.array(np.tile(explained, count), mask=np.tile(np.isnan(explained), count)),
                    pa.array(np.full(count * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return vectors.mapInArrow(write, schema)
