import numpy as np
import pytest
from pyspark.sql import functions as F

from copyloom.llm.queries import op11_whitening
from copyloom.llm.whitening import Spectrum, rank_one, spectrum, whitened

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(vectors, components=8):
    """x, mean, eigenvalues and vectors of the covariance, trace, exact deviations."""
    d = max((len(v) for v in vectors), default=0)
    c = np.array([[*map(float, v), *[0.0] * (d - len(v))] for v in vectors]).reshape(len(vectors), d)
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    centred = x - x.mean(axis=0)
    covariance = centred.T @ centred / len(x)
    values, basis = np.linalg.eigh(covariance)
    k = min(components, d)
    n, total = len(x), [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return centred, values[::-1][:k], basis[:, ::-1][:, :k], np.trace(covariance), deviation


def check(result, ids, vectors, least_gap=1e-4):
    rows = result.orderBy("vec_id", "component").toPandas()
    centred, values, basis, trace, deviation = brute(vectors)
    k, order = len(values), np.argsort(ids, kind="stable")
    assert len(rows) == len(ids) * k
    assert rows.vec_id.tolist() == np.repeat(np.array(ids)[order], k).tolist()
    assert rows.component.tolist() == list(range(1, k + 1)) * len(ids)
    assert set(rows.n) == {len(ids)}
    assert rows.deviation.tolist() == np.repeat([deviation[i] for i in order], k).tolist()
    found = rows.whitened.to_numpy().reshape(len(ids), k)
    expected = (centred @ basis / np.sqrt(values))[order]
    gaps = np.abs(np.diff(values)) / values[0]
    for j in range(k):
        near = min([gaps[j - 1]] if j else [1], default=1)
        if min(near, gaps[j] if j < k - 1 else 1) < least_gap:
            continue
        sign = np.sign(found[:, j] @ expected[:, j])
        assert np.abs(found[:, j] * sign - expected[:, j]).max() < 1e-7
    assert np.allclose(rows.explained.to_numpy().reshape(len(ids), k), values / trace, rtol=1e-10)
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    assert np.abs(np.cov(found.T, bias=True) - np.eye(k)).max() == pytest.approx(rows.identity_error[0], abs=1e-10)


def test_rank_one_updates_hold_with_deflation():
    rng = np.random.default_rng(5)
    for d in (1, 2, 5, 33):
        values = np.sort(rng.integers(0, 3, d).astype(float))
        vectors = np.linalg.qr(rng.normal(size=(d, d)))[0]
        whole = vectors @ np.diag(values) @ vectors.T
        for v in (rng.normal(size=d), vectors[:, 0], np.zeros(d), vectors[:, -1] * 1e-9, rng.normal(size=d) * 1e6):
            values, vectors = rank_one(values, vectors, v, 0.7)
            whole = whole + 0.7 * np.outer(v, v)
            assert (np.diff(values) >= 0).all()
            assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
            assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() <= 1e-13 * max(1, values[-1])


def test_combined_spectra_are_those_of_all_rows():
    rng = np.random.default_rng(6)
    x = rng.integers(-400, 400, (900, 12))
    x[::3] = x[0]
    parts = []
    for rows in (x[:100], x[100:101], x[101:]):
        parts.append(Spectrum.empty(0))
        parts[-1].add(rows)
    for other in parts[1:]:
        parts[0].take(other)
    centred = x - x.mean(axis=0)
    assert parts[0].n == 900 and parts[0].sums() == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].values, np.linalg.eigvalsh(centred.T @ centred), rtol=1e-12)


def test_whole_table(spark, middle):
    table = spark.read.parquet(f"{middle}/embeddings.parquet")
    rows = table.collect()
    check(op11_whitening(spark, middle), [r.vec_id for r in rows], [r.embedding for r in rows])
    apart = whitened(table.repartition(19))
    assert apart.count() == 8 * len(rows)
    check(apart, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_an_inexact_spectrum_is_refined(spark, middle):
    from copyloom.llm.whitening import refined

    table = spark.read.parquet(f"{middle}/embeddings.parquet")
    found = spectrum(table)
    rng = np.random.default_rng(7)
    d = len(found.mean)
    found.vectors = np.linalg.qr(found.vectors + 1e-5 * rng.normal(size=(d, d)))[0]
    values, basis = refined(table, found, 8)
    _, exact, exact_basis, _, _ = brute([r.embedding for r in table.collect()])
    assert np.allclose(values, exact, rtol=1e-12)
    assert np.abs(np.abs((basis * exact_basis).sum(axis=0)) - 1).max() < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(i, rng.normal(size=12).tolist(), 0) for i in range(40)]
    good += [(3, good[3][1], 1), (None, good[5][1], 1), (50, good[0][1][:4], 0), (51, [], 0)]
    bad = [(60, None, 0), (61, [1.0, None], 0), (62, [float("nan")] * 12, 0), (63, [float("inf")] * 12, 0)]
    table = spark.createDataFrame(good + bad, COLUMNS).withColumn("n", F.lit("clash")).withColumn("component", F.lit(1))
    result = whitened(table).cache()
    assert result.where("vec_id is null").count() == 8
    known = [r for r in good if r[0] is not None]
    centred, values, basis, trace, _ = brute([[float(np.float32(x)) for x in r[1]] for r in good])
    assert result.count() == 8 * len(good)
    first = result.where("component = 1 and vec_id is not null").orderBy("vec_id").toPandas()
    assert first.vec_id.tolist() == sorted(r[0] for r in known)
    assert np.allclose(first.explained, values[0] / trace)
    assert first.identity_error.max() < 1e-9


def test_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], COLUMNS)
    rows = whitened(same).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(2, 0, None, None, 0.0)] * 4
    for empty in ([], [(1, None, 0)], [(1, [], 0)]):
        assert whitened(spark.createDataFrame(empty, COLUMNS)).count() == 0


def test_flat_dimensions_and_large_entries(spark):
    rows = [(i, [float(i % 7), 1.0, 3.0e38 if i == 0 else 0.0], 0) for i in range(20)]
    out = whitened(spark.createDataFrame(rows, COLUMNS)).toPandas()
    assert len(out) == 60
    assert out[out.component == 1].whitened.notna().all()
    assert out.deviation.isna().any()
