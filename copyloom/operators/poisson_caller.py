"""Caller B: expected counts from a null model, and a Poisson scan for windows that depart from them.

Null model: size factor of the sample x median over samples of the region x median of the GC bin, then K latent
factors of the log residual, K chosen by BIC, for each group and contig on its own. A factor that a single sample
carries is its copy number rather than noise of the group, and is left out. A window with raw sum y and expected sum l scores
lratio = y ln(y / l) - (y - l). Its integer copy number is 2 y / l, rounded half to even; windows at copy number 2
are no candidates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.functions.columns import length_kb
from copyloom.operators import blocks
from copyloom.operators.medians import medians
from copyloom.operators.ratio_caller import chain_positions
from copyloom.session import cut, small_table

# Longest window in regions, numbers of latent factors tried, width of a GC bin in percent.
LONGEST_WINDOW = 400
LATENT_FACTORS = (0, 1, 2, 3, 4, 5)
GC_BIN = 5
# Least score of a candidate window, an argument of every step. Zero leaves the choice to the modified BIC alone, whose
# price for a segment is small on short chains.
MIN_LRATIO = 5.0
# A latent factor is shared by samples: one that a single sample carries to this share of its square is left out.
LONE_SHARE = 0.5

CHUNK = 2048


def copy_number(raw: Column, expected: Column) -> Column:
    return F.bround(2 * raw / expected).cast("int")


def lratio(raw: Column, expected: Column) -> Column:
    return F.when(raw > 0, raw * F.ln(raw / expected)).otherwise(0.0) - (raw - expected)


def expected_k0(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Expected counts without latent factors, for the regions that half of the group's samples have reads in.

    `counts` holds label, sample_name, region_id, n, gc; `factors` holds label, sample_name, size_factor. A GC bin
    in which half of a sample's regions are empty gets no correction.
    """
    scaled = counts.join(small_table(factors.where("size_factor > 0")), ["label", "sample_name"])
    per_region = medians(scaled, ["label", "region_id"], F.col("n") / F.col("size_factor"), "region_effect").where("region_effect > 0")
    bins = scaled.join(per_region, ["label", "region_id"]).withColumns(
        {"gc_bin": F.floor(F.col("gc") / GC_BIN), "base": F.col("size_factor") * F.col("region_effect")}
    )
    bins = cut(bins)
    gc_effect = medians(bins, ["label", "sample_name", "gc_bin"], F.col("n") / F.col("base"), "gc_effect")
    return (
        bins.join(gc_effect, ["label", "sample_name", "gc_bin"])
        .withColumn("gc_effect", F.when(F.col("gc_effect") > 0, F.col("gc_effect")).otherwise(1.0))
        .withColumn("expected", F.col("base") * F.col("gc_effect"))
        .drop("gc_bin")
    )


def loglik(n: Column, expected: Column) -> Column:
    return F.sum(n * F.ln(expected) - expected)


def null_model_bic(k0: DataFrame) -> DataFrame:
    """BIC of three nested null models per group: sample only, + region effect, + GC effect (k = 0, 1, 2).

    A parameter costs ln(samples x regions). The sample-only model spreads the group's mean over the regions.
    """
    mean_ratio = k0.groupBy("label").agg((F.sum("n") / F.sum("size_factor")).alias("mean_ratio"))
    gc_bins = F.countDistinct(F.floor(F.col("gc") / GC_BIN))
    per_group = (
        k0.join(mean_ratio, "label")
        .groupBy("label")
        .agg(
            F.countDistinct("sample_name").alias("samples"),
            F.countDistinct("region_id").alias("regions"),
            gc_bins.alias("bins"),
            loglik(F.col("n"), F.col("size_factor") * F.col("mean_ratio")).alias("l0"),
            loglik(F.col("n"), F.col("base")).alias("l1"),
            loglik(F.col("n"), F.col("expected")).alias("l2"),
        )
    )
    cost = F.ln(F.col("samples") * F.col("regions"))
    parameters = [
        F.col("samples"),
        F.col("samples") + F.col("regions"),
        F.col("samples") * (F.col("bins") + 1) + F.col("regions"),
    ]
    models = [
        F.struct(F.lit(k).alias("k"), (2 * F.col(f"l{k}") - parameters[k] * cost).alias("bic")) for k in range(3)
    ]
    return per_group.select("label", F.explode(F.array(*models)).alias("m")).select("label", "m.k", "m.bic")


def best_k(bic: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """The k with the largest BIC per group, ties to the smaller k."""
    return bic.groupBy(*by).agg(F.max_by("k", F.struct("bic", -F.col("k"))).alias("k"), F.max("bic").alias("bic"))


def latent_models(k0: DataFrame, factors: tuple[int, ...] = LATENT_FACTORS, lone_share: float = LONE_SHARE) -> DataFrame:
    """Expected counts with the leading latent factors of each group and contig, as an array over `factors`.

    The log residual is projected on the leading eigenvectors of its sample x sample products; the factors
    enter as one array per sample, and a window over the samples of a region sums the projections.
    """
    most = max(factors)
    residual = k0.withColumn("residual", F.ln((F.col("n") + 0.5) / (F.col("expected") + 0.5)))
    residual = residual.withColumn("part", F.concat_ws("/", F.col("label").cast("string"), "contig"))
    residual = cut(
        residual.select("part", "label", "sample_name", "region_id", "contig", "start_bp", "end_bp", "n", "expected", "residual")
    )
    if most > 0:
        found = blocks.components(residual, "part", "sample_name", "region_id", "residual", most)
        lone = F.max(F.col("u") * F.col("u")).over(Window.partitionBy("part", "component")) > lone_share
        vectors = (
            found.withColumn("u", F.when(lone, 0.0).otherwise(F.col("u")))
            .groupBy("part", "sample_name")
            .agg(F.sort_array(F.collect_list(F.struct("component", "u"))).alias("us"))
        )
        residual = residual.join(vectors, ["part", "sample_name"], "left")
    else:
        residual = residual.withColumn("us", F.array().cast("array<struct<component:int,u:double>>"))
    region = Window.partitionBy("label", "region_id")
    u = [F.coalesce(F.get("us", F.lit(i))["u"], F.lit(0.0)) for i in range(most)]
    parts = {f"_part{i}": u[i] * F.sum(F.col("residual") * u[i]).over(region) for i in range(most)}
    fitted = residual.withColumns(parts) if parts else residual

    def shift(k: int) -> Column:
        return sum((F.col(f"_part{i}") for i in range(k)), F.lit(0.0))

    models = F.array(*[F.col("expected") * F.exp(shift(k)) for k in factors])
    return fitted.withColumn("models", models).drop("part", "us", "residual", *parts)


def latent_bic(models: DataFrame, factors: tuple[int, ...] = LATENT_FACTORS) -> DataFrame:
    """BIC per group, contig and number of latent factors; a factor costs (samples + regions) ln(samples x regions)."""
    logliks = [loglik(F.col("n"), F.get("models", F.lit(i))).alias(f"l{i}") for i in range(len(factors))]
    per_group = models.groupBy("label", "contig").agg(
        F.countDistinct("sample_name").alias("s"), F.countDistinct("region_id").alias("r"), *logliks
    )
    cost = (F.col("s") + F.col("r")) * F.ln(F.col("s") * F.col("r"))
    rows = [
        F.struct(F.lit(k).alias("k"), (2 * F.col(f"l{i}") - k * cost).alias("bic")) for i, k in enumerate(factors)
    ]
    return per_group.select("label", "contig", F.explode(F.array(*rows)).alias("m")).select("label", "contig", "m.k", "m.bic")


def expected_counts(
    k0: DataFrame, factors: tuple[int, ...] = LATENT_FACTORS, models: Callable[..., DataFrame] = latent_models
) -> DataFrame:
    """Expected counts under the best number of latent factors of each group and contig.

    `models` fits them: `latent_models`, or `poisson_factors.poisson_models`, which fits counts as counts.
    """
    models = cut(models(k0, factors))
    chosen = best_k(latent_bic(models, factors), ("label", "contig")).select("label", "contig", "k")
    at = F.array_position(F.array(*[F.lit(k) for k in factors]), F.col("k")).cast("int")
    return (
        models.join(chosen, ["label", "contig"])
        .withColumn("expected", F.element_at("models", at))
        .drop("models")
    )


def score_windows(y: np.ndarray, l: np.ndarray) -> np.ndarray:
    """lratio of windows with raw sums y and expected sums l; -inf where the copy number is 2."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(y > 0, y * np.log(y / l), 0.0) - (y - l)
    return np.where(np.rint(2 * y / l) == 2, -np.inf, score)


def best_windows(
    n: np.ndarray, expected: np.ndarray, starts: int, lmax: int, least: float, stop: np.ndarray | None = None
) -> pd.DataFrame:
    """Best window from each of the first `starts` regions, and the farthest end of a candidate window.

    A window from region i ends before region `stop[i]`, if that is given.
    """
    y, l = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(expected)])
    best = np.full(starts, -np.inf)
    width = np.zeros(starts, dtype=np.int64)
    reach = np.full(starts, -1, dtype=np.int64)
    for w in range(1, min(lmax, len(n)) + 1):
        valid = min(starts, len(n) - w + 1)
        at = np.arange(valid)
        score = score_windows((y[at + w] - y[at]).astype(float), l[at + w] - l[at])
        if stop is not None:
            score = np.where(at + w <= stop[:valid], score, -np.inf)
        better = score > best[:valid]
        best[:valid][better] = score[better]
        width[:valid][better] = w
        reach[:valid][score >= least] = w - 1
    return pd.DataFrame({"at": np.arange(starts), "width": width, "reach": reach, "lratio": best}).assign(
        raw_cov=y[np.arange(starts) + width] - y[:starts], norm_cov=l[np.arange(starts) + width] - l[:starts]
    )


CHAIN = ["label", "sample_name", "contig"]


def chains(expected: DataFrame) -> DataFrame:
    """Expected counts with the position of each region in its chain; every sample of a group has the same regions."""
    regions = expected.select("label", "contig", "region_id", "start_bp", "end_bp").distinct()
    places = chain_positions(regions, by=("label",)).select("label", "region_id", "ord")
    return expected.join(places, ["label", "region_id"]).select(
        *CHAIN, "region_id", "ord", "start_bp", "end_bp", "n", "expected"
    )


WINDOWS = "region_id long, st_ord long, ed_ord long, reach_ord long, raw_cov double, norm_cov double, lratio double"


def _key_types(rows: DataFrame) -> str:
    types = dict(rows.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in CHAIN)


def _scan_cells(chained: DataFrame, lmax: int, chunk: int) -> DataFrame:
    """Every region under the chunk of its position and under those whose windows can reach it."""
    first = F.greatest(F.lit(0), F.floor((F.col("ord") - (lmax - 1)) / chunk))
    return chained.select(*CHAIN, "region_id", "ord", "n", "expected").withColumn(
        "chunk", F.explode(F.sequence(first, F.floor(F.col("ord") / chunk)))
    )


def _scan_chunk(pdf: pd.DataFrame, lmax: int, least: float, chunk: int, taken: pd.DataFrame | None = None) -> pd.DataFrame:
    """Best window from every start of one chunk; none goes into a window of `taken`."""
    pdf = pdf.sort_values("ord", ignore_index=True)
    own, stop = int((pdf["ord"] // chunk == pdf["chunk"]).sum()), None
    if taken is not None and len(taken) and len(pdf):
        place = pdf["ord"].to_numpy()
        stop = np.full(len(pdf), len(pdf))
        for st, ed in zip(taken["st_ord"], taken["ed_ord"], strict=True):
            a, b = np.searchsorted(place, st), np.searchsorted(place, ed, side="right")
            stop[a:b] = np.arange(a, b)
        stop = np.minimum.accumulate(stop[::-1])[::-1]
    found = best_windows(pdf["n"].to_numpy(), pdf["expected"].to_numpy(), own, lmax, least, stop)
    out = pdf.loc[: own - 1, [*CHAIN, "region_id"]].copy()
    out["st_ord"] = pdf["ord"].iloc[:own]
    out["ed_ord"] = out["st_ord"] + found["width"] - 1
    out["reach_ord"] = np.where(found["reach"] >= 0, out["st_ord"] + found["reach"], -1)
    for c in ("raw_cov", "norm_cov", "lratio"):
        out[c] = found[c]
    return out[found["width"].to_numpy() > 0]


def scan_windows(
    chained: DataFrame, lmax: int = LONGEST_WINDOW, least: float = MIN_LRATIO, chunk: int = CHUNK
) -> DataFrame:
    """Best window of up to lmax regions from every region of every chain.

    A task takes a chunk of start positions and the lmax - 1 regions after it, so the work per task is bounded and
    windows are never turned into rows.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        return _scan_chunk(pdf, lmax, least, chunk)

    return _scan_cells(chained, lmax, chunk).groupBy(*CHAIN, "chunk").applyInPandas(scan, f"{_key_types(chained)}, {WINDOWS}")


def best_scan_window(windows: DataFrame) -> DataFrame:
    """The best window of each chain, ties to the first start."""
    best = F.max_by(
        F.struct("st_ord", "ed_ord", "raw_cov", "norm_cov"), F.struct("lratio", -F.col("st_ord"))
    )
    return (
        windows.groupBy(*CHAIN)
        .agg(best.alias("w"), F.max("lratio").alias("lratio"))
        .select(*CHAIN, "w.*", "lratio", copy_number(F.col("w.raw_cov"), F.col("w.norm_cov")).alias("copy_no"))
    )


def unbeaten(start: np.ndarray, end: np.ndarray, reach: np.ndarray, score: np.ndarray, own: np.ndarray, lmax: int) -> np.ndarray:
    """Which of the windows marked by `own` no start's best window beats, among starts with a candidate that touches them.

    There is one window a start, its best; the larger score wins, then the first start. Among windows that share a start the best
    decides for all of them, so a start that reaches a window is compared by its best window, though that may end before it.
    """
    first = start.min()
    size = int(start.max() - first) + 1
    at = np.full(size, -np.inf)
    far = np.full(size, -1, dtype=np.int64)
    at[start - first], far[start - first] = score, reach
    s, e, mine = start[own] - first, end[own] - first, score[own]
    lost = np.zeros(len(s), dtype=bool)
    for d in range(1 - lmax, lmax):
        if d == 0:
            continue
        t = s + d
        inside = (t >= 0) & (t < size) & (t <= e)
        t = np.clip(t, 0, size - 1)
        touches = inside & (far[t] >= s + first)
        lost |= touches & ((at[t] > mine) | ((at[t] == mine) & (d < 0)))
    out = np.zeros(len(start), dtype=bool)
    out[np.flatnonzero(own)[~lost]] = True
    return out


def _near_chunks(windows: DataFrame, before: Column, after: Column, chunk: int) -> DataFrame:
    """Windows under every chunk of start positions from `before` to `after`."""
    first = F.greatest(F.lit(0), F.floor(before / chunk))
    return windows.withColumn("chunk", F.explode(F.sequence(first, F.floor(after / chunk))))


def pick_windows(
    chained: DataFrame, lmax: int = LONGEST_WINDOW, least: float = MIN_LRATIO, chunk: int = CHUNK
) -> DataFrame:
    """(*CHAIN, st_ord, ed_ord, lratio): the windows a greedy choice takes, best first, none touching another.

    In a round every window is taken that is the best among those it touches: nothing a greedy choice takes earlier can touch it.
    Starts near the taken ones are scanned again for what is left beside them, until no window of the least score is left. A
    task sees one chunk of start positions and the `lmax` positions on either side; the overall best is taken in every round.
    """
    names = ["st_ord", "ed_ord", "reach_ord", "lratio"]
    key_types = _key_types(chained)
    where = [*CHAIN, "chunk"]
    windows = cut(scan_windows(chained, lmax, least, chunk).where("reach_ord >= 0").select(*CHAIN, *names))
    occupied = windows.select(*CHAIN, F.floor(F.col("st_ord") / chunk).alias("chunk")).distinct()
    cells = cut(_scan_cells(chained, lmax, chunk).join(small_table(occupied), where, "left_semi"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["st_ord"].to_numpy()
        own = start // chunk == pdf["chunk"].to_numpy()
        good = unbeaten(start, pdf["ed_ord"].to_numpy(), pdf["reach_ord"].to_numpy(), pdf["lratio"].to_numpy(), own, lmax)
        return pdf.loc[good, [*CHAIN, "st_ord", "ed_ord", "lratio"]]

    def scan_again(pdf: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*CHAIN, *names])
        out = _scan_chunk(pdf, lmax, least, chunk, taken)
        return out.loc[out["reach_ord"] >= 0, [*CHAIN, *names]]

    picked = None
    while not windows.isEmpty():
        around = _near_chunks(windows, F.col("st_ord") - (lmax - 1), F.col("st_ord") + (lmax - 1), chunk)
        found = cut(around.groupBy(*where).applyInPandas(choose, f"{key_types}, st_ord long, ed_ord long, lratio double"))
        picked = found if picked is None else picked.unionByName(found)
        touched = _near_chunks(found, F.col("st_ord") - (lmax - 1), F.col("ed_ord"), chunk).select(*where).distinct()
        touched = small_table(touched)
        taken = _near_chunks(picked, F.col("st_ord") - (lmax - 1), F.col("ed_ord"), chunk).join(touched, where, "left_semi")
        again = (
            cells.join(touched, where, "left_semi")
            .groupBy(*where)
            .cogroup(taken.groupBy(*where))
            .applyInPandas(scan_again, f"{key_types}, st_ord long, ed_ord long, reach_ord long, lratio double")
        )
        kept = windows.withColumn("chunk", F.floor(F.col("st_ord") / chunk)).join(touched, where, "left_anti").drop("chunk")
        windows = cut(kept.unionByName(again))
    return windows.select(*CHAIN, "st_ord", "ed_ord", "lratio") if picked is None else picked


def modified_bic(starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, regions: int) -> np.ndarray:
    """mBIC after 0, 1, 2, ... segments of one chain, taken by falling score.

    Sum of scores - 1/2 sum of ln(distance between neighbouring breakpoints) + (1/2 - breakpoints) ln(regions).
    """
    out = []
    for m in range(len(starts) + 1):
        tau = np.unique(np.concatenate([[0, max(regions - 1, 1)], starts[:m], ends[:m]]))
        gaps = np.log(np.diff(tau)).sum()
        out.append(scores[:m].sum() - 0.5 * gaps + (0.5 - (len(tau) - 2)) * np.log(max(regions, 2)))
    return np.array(out)


def call_poisson_scan(
    chained: DataFrame, lmax: int = LONGEST_WINDOW, least: float = MIN_LRATIO, chunk: int = CHUNK
) -> DataFrame:
    """Caller B's table: non-overlapping windows, best first, as many per chain as the modified BIC allows."""
    chained = cut(chained)
    picked_schema = (
        f"{_key_types(chained)}, st_ord long, ed_ord long, st_bp long, ed_bp long, raw_cov double, norm_cov double, lratio double"
    )
    places = pick_windows(chained, lmax, least, chunk).withColumn("ord", F.explode(F.sequence("st_ord", "ed_ord")))
    picked = (
        chained.join(small_table(places), [*CHAIN, "ord"])
        .groupBy(*CHAIN, "st_ord", "ed_ord", "lratio")
        .agg(
            F.min_by("start_bp", "ord").alias("st_bp"),
            F.max("end_bp").alias("ed_bp"),
            F.sum("n").cast("double").alias("raw_cov"),
            F.sum("expected").alias("norm_cov"),
        )
        .select(*CHAIN, "st_ord", "ed_ord", "st_bp", "ed_bp", "raw_cov", "norm_cov", "lratio")
    )
    lengths = chained.groupBy("label", "contig").agg((F.max("ord") + 1).alias("regions"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lratio", "st_ord"], ascending=[False, True], ignore_index=True)
        scores = modified_bic(
            pdf["st_ord"].to_numpy(), pdf["ed_ord"].to_numpy(), pdf["lratio"].to_numpy(), int(pdf["regions"].iloc[0])
        )
        return pdf.assign(mbic=scores[1:]).iloc[: int(scores.argmax())].drop(columns="regions")

    kept = picked.join(lengths, ["label", "contig"]).select(*picked.columns, "regions")
    return (
        kept.groupBy(*CHAIN)
        .applyInPandas(keep, f"{picked_schema}, mbic double")
        .select(
            "label",
            "sample_name",
            F.col("contig").alias("chr"),
            F.when(F.col("raw_cov") < F.col("norm_cov"), "del").otherwise("dup").alias("cnv"),
            "st_bp",
            "ed_bp",
            length_kb(F.col("st_bp"), F.col("ed_bp")).alias("length_kb"),
            (F.col("st_ord") + 1).alias("st_exon"),
            (F.col("ed_ord") + 1).alias("ed_exon"),
            "raw_cov",
            "norm_cov",
            copy_number(F.col("raw_cov"), F.col("norm_cov")).alias("copy_no"),
            "lratio",
            "mbic",
        )
    )
