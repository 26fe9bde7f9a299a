"""Latent factors fitted as Poisson counts, against NumPy on whole matrices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.queries import qc_passed
from copyloom.operators import poisson_caller as pc
from copyloom.operators import poisson_factors as pf
from copyloom.session import cut

CELLS = "part string, sample_name string, region_id long, n long, expected double"


def table(spark, parts):
    rows = [
        (part, f"S{s:03}", r, int(n[s, r]), float(e[s, r]))
        for part, (n, e) in parts.items()
        for s in range(n.shape[0])
        for r in range(n.shape[1])
    ]
    return cut(spark.createDataFrame(rows, CELLS))


def planted(seed, samples=12, regions=40, factors=2, depth=60.0):
    rng = np.random.default_rng(seed)
    e = rng.uniform(0.5, 1.5, size=(samples, 1)) * rng.uniform(0.3 * depth, depth, size=(1, regions))
    shift = rng.normal(scale=0.35, size=(samples, factors)) @ rng.normal(size=(factors, regions))
    return rng.poisson(e * np.exp(shift)), e


def loglik(n, e, shift):
    return (n * (np.log(e) + shift) - e * np.exp(shift)).sum()


def rounds_in_numpy(n, e, k, rounds):
    """The same alternation on whole matrices; log-likelihoods after each round."""
    u, s, v = np.linalg.svd(np.log((n + 0.5) / (e + 0.5)), full_matrices=False)
    g, h, out = u[:, :k], (s[:k, None] * v[:k]).T, []

    def step(held, moved, n, e):
        moved = moved.copy()
        for r in range(len(moved)):
            mu = e[:, r] * np.exp(held @ moved[r])
            d = np.linalg.lstsq(held.T @ (mu[:, None] * held), held.T @ (n[:, r] - mu), rcond=None)[0]
            tried = [moved[r] + a * d for a in (0.0, *pf.STEPS)]
            moved[r] = max(tried, key=lambda w: loglik(n[:, r], e[:, r], held @ w))
        return moved

    for _ in range(rounds):
        h = step(g, h, n, e)
        g = step(h, g, n.T, e.T)
        out.append(loglik(n, e, g @ h.T))
    return out


def test_rounds_against_numpy_and_falling_deviance(spark):
    parts = {"a": planted(1), "b": planted(2, samples=9, regions=25, depth=8.0)}
    *_, history = pf.fit(table(spark, parts), [1, 2, 3], rounds=4, gain=0.0, lone_share=1.1)
    found = [{(r.part, r.k): r.ll for r in h.collect()} for h in history]
    for part, (n, e) in parts.items():
        for k in (1, 2, 3):
            mine = [f[part, k] for f in found]
            assert np.allclose(mine, rounds_in_numpy(n, e, k, len(mine)), rtol=1e-8)
            assert all(b >= a - 1e-9 * abs(a) for a, b in zip(mine, mine[1:]))
    assert len(found) > 1


def test_models_find_the_planted_number_and_beat_the_log_residual(spark):
    n, e = planted(5, samples=16, regions=60, depth=25.0)
    cells = table(spark, {"0/1": (n, e)}).select(
        F.lit(0).alias("label"), "sample_name", "region_id", F.lit("1").alias("contig"), (100 * F.col("region_id")).alias("start_bp"),
        (100 * F.col("region_id") + 50).alias("end_bp"), "n", "expected",
    )
    factors = (0, 1, 2, 3)
    mine = cut(pf.poisson_models(cells, factors))
    assert set(mine.columns) == set(pc.latent_models(cells, factors).columns)
    bic = {r.k: r.bic for r in pc.latent_bic(mine, factors).collect()}
    old = {r.k: r.bic for r in pc.latent_bic(pc.latent_models(cells, factors), factors).collect()}
    assert max(bic, key=bic.get) == 2 and bic[0] == pytest.approx(old[0])
    assert all(bic[k] > old[k] for k in (1, 2, 3))
    chosen = pc.expected_counts(cells, factors, lambda *_: mine)
    assert chosen.count() == n.size and chosen.select("k").distinct().collect() == [(2,)]


def test_orthogonal_factors_give_the_same_models(spark):
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=(7, 3)), rng.normal(size=(11, 3))
    g[:, 2] = h[:, 2] = 0  # a factor left out
    samples = spark.createDataFrame([("p", 3, f"S{i}", row.tolist()) for i, row in enumerate(g)], "part string, k int, sample_name string, w array<double>")
    regions = spark.createDataFrame([("p", 3, i, row.tolist()) for i, row in enumerate(h)], "part string, k int, region_id long, w array<double>")
    s, r = pf.orthogonal(samples, regions, 3)
    gs = np.array([x.w for x in s.orderBy("sample_name").collect()])
    hs = np.array([x.w for x in r.orderBy("region_id").collect()])
    assert np.allclose(gs @ hs.T, g @ h.T)
    assert np.allclose(gs.T @ gs, np.diag([1, 1, 0]), atol=1e-9)
    assert np.allclose(np.sort((hs**2).sum(axis=0))[::-1], np.linalg.svd(g @ h.T)[1][:3] ** 2, atol=1e-9)


def test_a_lone_sample_keeps_its_deletion(spark):
    rng = np.random.default_rng(3)
    e = np.full((10, 60), 200.0)
    copies = np.ones((10, 60))
    copies[2, 20:40] = 0.5
    cells = table(spark, {"0/1": (rng.poisson(e * copies), e)}).select(
        F.lit(0).alias("label"), "sample_name", "region_id", F.lit("1").alias("contig"), (100 * F.col("region_id")).alias("start_bp"),
        (100 * F.col("region_id") + 50).alias("end_bp"), "n", "expected",
    )
    calls = pc.call_poisson_scan(pc.chains(pc.expected_counts(cells, (1, 2), pf.poisson_models))).toPandas()
    assert [(c.sample_name, c.cnv) for c in calls.itertuples()] == [("S002", "del")]
    assert abs(calls.st_exon[0] - 21) <= 1 and abs(calls.ed_exon[0] - 40) <= 1


def test_empty_and_zero_counts(spark):
    none = spark.createDataFrame([], "label int, sample_name string, region_id long, contig string, start_bp long, end_bp long, n long, expected double")
    assert pf.poisson_models(none, (0, 1)).count() == 0 and pf.poisson_models(none, (0,)).count() == 0
    zeros = np.zeros((4, 6), dtype=int), np.ones((4, 6))
    samples, regions, history = pf.fit(table(spark, {"z": zeros}), [1, 2], rounds=2)
    assert samples.count() == 8 and regions.count() == 12
    assert all(np.isfinite(r.ll) for h in history for r in h.collect())


def test_whole_fixture(spark, middle):
    passed, factors = qc_passed(spark, middle)
    k0 = cut(pc.expected_k0(passed, factors))
    tried = (0, 1, 2)
    bic = {(r.label, r.contig, r.k): r.bic for r in pc.latent_bic(pf.poisson_models(k0, tried, rounds=2), tried).collect()}
    parts = k0.select("label", "contig").distinct().count()
    assert len(bic) == 3 * parts and all(np.isfinite(b) for b in bic.values())


def test_a_cell_is_one_row_for_all_models():
    rng = np.random.default_rng(8)
    rows, models, most = 50, 2, 3
    keys, parts = rng.integers(0, 4, rows), rng.choice(["a", "b"], rows)
    x = rng.normal(size=(rows, models, most))
    w = rng.normal(size=(8, models, most))[2 * keys + (parts == "b")]
    flat = lambda v: pa.array(list(v.reshape(rows, -1)), pa.list_(pa.float64()))
    n = [None if i == 7 else float(i) for i in range(rows)]
    columns = {"part": pa.array(parts.tolist()), "region_id": pa.array(keys), "n": pa.array(n, pa.float64()), "expected": pa.array(rng.uniform(1, 2, rows))}
    batch = pa.RecordBatch.from_pydict(columns | {"ks": pa.array([[1, 3]] * rows, pa.list_(pa.int32())), "x": flat(x), "w": flat(w)}).slice(5)

    def terms(n, expected, x, w):
        yield np.nan_to_num(n * (x * w).sum(axis=2))

    (out,) = pf._sums("region_id", most, ["x", "w"], terms, ["total"], ["w"])(iter([batch]))
    found = {(r["part"], r["k"], r["region_id"]): (r["total"], r["w"]) for r in out.to_pylist()}
    assert len(found) == out.num_rows == 2 * len({*zip(parts[5:], keys[5:])})
    for (part, k, key), (total, own) in found.items():
        at = [i for i in range(5, rows) if parts[i] == part and keys[i] == key]
        m = [1, 3].index(k)
        assert total == pytest.approx(sum((n[i] or 0.0) * float(x[i, m] @ w[i, m]) for i in at))
        assert own == w[at[0], m].tolist()


def gappy(spark):
    """Parts of different width and string keys; cells missing, twice and without a sample."""
    rows = []
    for part, (n, e) in {"a": planted(1), "b": planted(2, samples=9, regions=25, depth=8.0)}.items():
        cells = [(part, f"S{s:03}", f"R{r}", int(n[s, r]), float(e[s, r])) for s in range(n.shape[0]) for r in range(n.shape[1])]
        rows += [c for i, c in enumerate(cells) if i % 11 != 4] + cells[:3] + [(part, None, "R1", 5, 5.0)]
    return cut(spark.createDataFrame(rows, "part string, sample_name string, region_id string, n long, expected double"))


def test_blocks_agree_with_a_row_for_each_cell(spark, monkeypatch):
    cells = gappy(spark)
    found = []
    for most_samples, layout in ((pf.BLOCK_SAMPLES, pf.Blocks), (0, pf.Cells)):
        monkeypatch.setattr(pf, "BLOCK_SAMPLES", most_samples)
        monkeypatch.setattr(pf, "BLOCK_CELLS", 100)
        assert isinstance(pf.laid_out(cells, *pf.start_weights(cells, [1, 3], 1.1), [1, 3]), layout)
        samples, regions, history = pf.fit(cells, [1, 3], rounds=2, gain=0.0, lone_share=1.1)
        assert (samples.count(), regions.count()) == (2 * (12 + 9), 2 * (40 + 25))
        w = {(r.part, r.k, r[2]): np.array(r.w) for side in (samples, regions) for r in side.collect()}
        shifts = {(p, k, s, r): w[p, k, s] @ w[p, k, r] for p, k, s in w if s[0] == "S" for q, j, r in w if (q, j) == (p, k) and r[0] == "R"}
        found.append((shifts, [{(r.part, r.k): r.ll for r in h.collect()} for h in history]))
    (shifts, lls), (plain_shifts, plain_lls) = found
    assert shifts.keys() == plain_shifts.keys() and [h.keys() for h in lls] == [h.keys() for h in plain_lls]
    assert all(shifts[k] == pytest.approx(plain_shifts[k], abs=1e-6) for k in shifts)
    assert all(h[k] == pytest.approx(g[k], rel=1e-9) for h, g in zip(lls, plain_lls) for k in h)


def test_blocks_are_many_and_mostly_missing_cells_stay_rows(spark, monkeypatch):
    monkeypatch.setattr(pf, "BLOCK_CELLS", 100)
    cells = gappy(spark)
    layout = pf.laid_out(cells, *pf.start_weights(cells, [2], 1.1), [2])
    assert layout.cells.where("part = 'a'").count() > 2 and layout.cells.where("size(region_id) * 12 > 400").isEmpty()
    sparse = cells.where("pmod(hash(sample_name, region_id), 3) = 0")
    assert isinstance(pf.laid_out(sparse, *pf.start_weights(sparse, [2], 1.1), [2]), pf.Cells)
