"""Overdispersion of caller A: the share of a case varies from region to region, more than a binomial allows.

With total t and expected share p of a region, the case's count x is beta-binomial with parameters p s and (1 - p) s. The
strength s is one number per case, fitted by maximum likelihood on all its regions: Newton steps in ln(s) for all cases at
once, each of them one aggregate over the counts. The larger s, the closer to the binomial. Log-gamma is a column
expression, Stirling's series eight steps up from its argument; its rises are computed as such, as differences of the large
values would lose the digits that decide a strength of many thousands. Slopes seen so far bound a strength from both sides: a step
that leaves the bounds halves them instead, as does every one after `NEWTON_STEPS`, so that all cases settle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.session import broadcast_if_small, cut

START, LEAST, MOST = math.log(100.0), 0.0, math.log(1e6)
WIDTH = 0.01
LONGEST_STEP = 2.0
TOLERANCE = 1e-5
STEPS = 60
NEWTON_STEPS = 35
UP = 8


def _tail(y: Column) -> Column:
    """What Stirling's series adds at `y`."""
    square = y * y
    return (((-1 / (1680 * square) + 1 / 1260) / square - 1 / 360) / square + 1 / 12) / y


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) of a positive number, to some 1e-11 of its terms."""
    y = x + UP
    below = x
    for k in range(1, UP):
        below = below * (x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + _tail(y) - F.ln(below)


def log_gamma_rise(a: Column, x: Column) -> Column:
    """ln(gamma(a + x)) - ln(gamma(a)) of a positive a and an x of at least 0; the digits are those of the rise, not of its ends."""
    y = a + UP
    ratio = 1 + x / a
    for k in range(1, UP):
        ratio = ratio * (1 + x / (a + k))
    return (y - 0.5) * F.log1p(x / y) + x * F.ln(y + x) - x + _tail(y + x) - _tail(y) - F.ln(ratio)


def beta_binomial(x: Column, t: Column, p: Column, s: Column) -> Column:
    """Log-likelihood of x of t without the term that only x and t decide."""
    return log_gamma_rise(p * s, x) + log_gamma_rise((1 - p) * s, t - x) - log_gamma_rise(s, t)


def case_strengths(with_refs: DataFrame) -> DataFrame:
    """(label, sample_name, strength) for every case with reads on both sides, from rows (label, sample_name, n, ref_n).

    A strength that the data do not bound ends at 1e6, one that falls without end at 1.
    """
    keys = ["label", "sample_name"]
    x, t = F.col("n").cast("double"), (F.col("n") + F.col("ref_n")).cast("double")
    rows = cut(with_refs.select(*keys, x.alias("x"), t.alias("t")).where("t > 0"))
    state = rows.groupBy(*keys).agg((F.sum("x") / F.sum("t")).alias("p")).where("p > 0 AND p < 1")
    state = state.select("*", F.lit(START).alias("theta"), F.lit(1.0).alias("step"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    state = cut(state)
    for done in range(STEPS):
        moving = state.where(F.abs("step") > TOLERANCE)
        if moving.isEmpty():
            return state.select(*keys, F.exp("theta").alias("strength"))
        at = [
            F.sum(beta_binomial(F.col("x"), F.col("t"), F.col("p"), F.exp(F.col("theta") + d * WIDTH))).alias(name)
            for d, name in ((-1, "left"), (0, "here"), (1, "right"))
        ]
        asked = broadcast_if_small(moving.select(*keys, "p", "theta", "low", "high"))
        found = rows.join(asked, keys).groupBy(*keys, "p", "theta", "low", "high").agg(*at)
        slope = (F.col("right") - F.col("left")) / (2 * WIDTH)
        bend = (F.col("right") - 2 * F.col("here") + F.col("left")) / WIDTH**2
        newton = F.when(bend < 0, -slope / bend).otherwise(F.signum(slope))
        step = F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), newton))
        there = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("theta") + step))
        bounds = {"low": F.when(slope > 0, F.col("theta")).otherwise(F.col("low")), "high": F.when(slope < 0, F.col("theta")).otherwise(F.col("high"))}
        found = found.select(*keys, "p", "theta", there.alias("there"), *[b.alias(name) for name, b in bounds.items()])
        inside = F.col("there").between(F.col("low"), F.col("high")) & F.lit(done < NEWTON_STEPS)
        then = F.when(inside, F.col("there")).otherwise((F.col("low") + F.col("high")) / 2)
        moved = found.select(*keys, "p", then.alias("theta"), (then - F.col("theta")).alias("step"), "low", "high")
        state = cut(state.where(F.abs("step") <= TOLERANCE).unionByName(moved))
    raise RuntimeError(f"the strengths of some cases have not settled after {STEPS} steps")
