"""Beta-binomial counts: log-gamma, fitted strengths, calls on overdispersed samples."""

import math

import numpy as np
from pyspark.sql import functions as F

from copyloom.operators import dispersion as ds
from copyloom.operators import ratio_caller as rc
from copyloom.session import cut


def test_log_gamma(spark):
    values = [1e-3, 0.5, 1.0, 2.5, 7.0, 33.3, 1e4, 1e6]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", ds.log_gamma(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.lgamma(r.x)) <= 1e-10 * max(1, abs(r.y)) for r in rows)


def loglik(x, t, p, s):
    lg = np.vectorize(math.lgamma)
    return (lg(x + p * s) - lg(p * s) + lg(t - x + (1 - p) * s) - lg((1 - p) * s) - lg(t + s) + lg(s)).sum()


def planted(rng, strength, regions=600, deleted=range(200, 240)):
    """Counts of a case whose share varies by a beta distribution, with half the share in some regions."""
    t = rng.integers(300, 500, regions)
    p = np.full(regions, 0.2)
    p[list(deleted)] = 0.2 * 0.5 / (0.8 + 0.2 * 0.5)
    x = rng.binomial(t, rng.beta(p * strength, (1 - p) * strength))
    return x, t


def test_strengths_and_calls(spark):
    rng = np.random.default_rng(17)
    rows, cases = [], {}
    for sample, strength in (("S1", 30.0), ("S2", 80.0), ("S3", 1e9)):
        x, t = cases[sample] = planted(rng, strength)
        rows += [(0, sample, i, int(x[i]), int(t[i] - x[i])) for i in range(len(x))]
    rows += [(0, "S4", i, 0, 50) for i in range(5)] + [(0, "S5", 0, 0, 0)]
    table = cut(spark.createDataFrame(rows, "label int, sample_name string, region_id long, n long, ref_n long"))
    found = {r.sample_name: r.strength for r in ds.case_strengths(table).collect()}
    assert found.keys() == cases.keys()
    for sample, (x, t) in cases.items():
        p = x.sum() / t.sum()
        grid = np.exp(np.linspace(0, math.log(1e6), 4000))
        best = grid[np.argmax([loglik(x, t, p, s) for s in grid[::40]]) * 40]
        assert loglik(x, t, p, found[sample]) >= loglik(x, t, p, best) - 1e-6
    assert found["S1"] < found["S2"] < found["S3"]
    targets = spark.createDataFrame([(i, "1", 300 * i, 300 * i + 100) for i in range(600)], "region_id long, contig string, start_bp long, end_bp long")
    calls = {flag: rc.call_read_ratio(table, targets, overdispersed=flag).where("sample_name <> 'S3'").collect() for flag in (False, True)}

    def wrong(some):
        return sum(not (c.type == "deletion" and c.start_bp < 300 * 240 and c.end_bp > 300 * 200) for c in some)

    assert wrong(calls[True]) < wrong(calls[False]) / 4
    for sample in ("S1", "S2"):
        hits = [c for c in calls[True] if c.sample_name == sample and c.type == "deletion" and c.start_bp < 300 * 225 and c.end_bp > 300 * 215]
        assert hits and max(c.nexons for c in hits) >= 25


def test_rises_keep_their_digits_at_large_strengths(spark):
    """Against the sum of logarithms that the rise is; differences of log-gammas are 1e-9 off at 1e6."""

    def rise(a, x):
        return math.fsum(math.log(a + j) for j in range(x))

    asked = [(x, t, p, s) for s in (1.0, 300.0, 27000.0, 1e6) for x, t, p in ((9, 105, 0.083), (0, 40, 0.5), (40, 40, 0.2))]
    rows = spark.createDataFrame([(float(x), float(t), p, s) for x, t, p, s in asked], "x double, t double, p double, s double")
    found = [r.y for r in rows.select(ds.beta_binomial(*map(F.col, "xtps")).alias("y")).collect()]
    for y, (x, t, p, s) in zip(found, asked, strict=True):
        assert abs(y - (rise(p * s, x) + rise((1 - p) * s, t - x) - rise(s, t))) <= 5e-11


def test_nearly_binomial_cases_settle(spark):
    """Strengths of many thousands on many regions: the top of the likelihood is flat."""
    rng = np.random.default_rng(5)
    rows = []
    for sample, strength in (("S1", 20000.0), ("S2", 40000.0), ("S3", 300000.0), ("S4", 1e9)):
        t = rng.integers(80, 130, 12000)
        x = rng.binomial(t, rng.beta(0.083 * strength, 0.917 * strength, 12000))
        rows += [(0, sample, i, int(a), int(b - a)) for i, (a, b) in enumerate(zip(x, t, strict=True))]
    table = cut(spark.createDataFrame(rows, "label int, sample_name string, region_id long, n long, ref_n long"))
    found = {r.sample_name: r.strength for r in ds.case_strengths(table).collect()}
    assert found.keys() == {"S1", "S2", "S3", "S4"}
    assert all(1000 < s <= 1e6 * (1 + 1e-9) for s in found.values())
