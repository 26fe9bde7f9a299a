"""Caller A: read ratio of a sample against reference samples of its own group.

Model: with test count x and reference count r of a region, t = x + r, x is binomial in t. A copy ratio q
changes the share p of the sample to p_q = q p / (1 - p + q p). States: ratio 1, 0.5 and 1.5. The state path of
a (sample, contig) chain is the most likely one under a fixed switching probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.functions.columns import region_label
from copyloom.operators import blocks
from copyloom.operators.dispersion import beta_binomial, case_strengths
from copyloom.operators.intervals import annotate_overlaps
from copyloom.operators.numbering import dense_numbers
from copyloom.session import broadcast_if_small, cut, small_table

# States with their copy ratio, switching probability.
STATES = ["normal", "deletion", "duplication"]
RATIOS = [1.0, 0.5, 1.5]
TRANSITION = 1e-4

CHUNK = 2048
CASE_BLOCK = 256
REGION_BLOCK = 1024


def chain_positions(targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Position of each region on its contig, from 0."""
    return dense_numbers(targets, ["start_bp", "end_bp", "region_id"], "ord", (*by, "contig"))


def leave_one_out(counts: DataFrame) -> DataFrame:
    """Reference count of a sample = all other samples of its group, from the group's total per region."""
    rest = F.sum("n").over(Window.partitionBy("label", "region_id")) - F.col("n")
    return counts.select("label", "sample_name", "region_id", "n", rest.alias("ref_n"))


def sample_correlation(counts: DataFrame) -> DataFrame:
    """Correlation of every sample with every other sample of its group, one row per sample (partners, corrs)."""
    return blocks.correlations(counts, "label", "sample_name", "region_id", "n")


def case_correlation(counts: DataFrame, samples: list[str]) -> DataFrame:
    """The same rows as `sample_correlation` for the named samples only: work grows with the cohort, not with its square.

    The counts of the named samples go to the others' by region; one sum of products per pair is shuffled. A region that a sample has
    no row for counts as zero.
    """
    n = F.col("n").cast("double")
    cases = cut(counts.where(F.col("sample_name").isin(samples)).select("label", "region_id", F.col("sample_name").alias("case"), n.alias("x")))
    group = counts.join(small_table(cases.select("label").distinct()), "label", "left_semi")
    dots = group.join(broadcast_if_small(cases), ["label", "region_id"]).groupBy("label", "case", "sample_name").agg(F.sum(n * F.col("x")).alias("dot"))
    regions = small_table(group.groupBy("label").agg(F.countDistinct("region_id").cast("double").alias("regions")))
    sums = group.groupBy("label", "sample_name").agg(F.sum(n).alias("s"), F.sum(n * n).alias("q")).join(regions, "label")
    sums = cut(sums.withColumn("v", F.col("regions") * F.col("q") - F.col("s") * F.col("s")))
    own = sums.where(F.col("sample_name").isin(samples)).select("label", F.col("sample_name").alias("case"), F.col("s").alias("case_s"), F.col("v").alias("case_v"))
    pairs = sums.join(own, "label").join(dots, ["label", "case", "sample_name"], "left")
    shared = F.col("regions") * F.coalesce("dot", F.lit(0.0)) - F.col("case_s") * F.col("s")
    r = F.coalesce(F.try_divide(shared, F.sqrt(F.col("case_v") * F.col("v"))), F.lit(float("nan")))
    entries = F.sort_array(F.collect_list(F.struct(F.col("sample_name").alias("partners"), r.alias("corrs"))))
    return (
        pairs.groupBy("label", "case")
        .agg(entries.alias("e"))
        .select("label", F.col("case").alias("sample_name"), F.col("e.partners").alias("partners"), F.col("e.corrs").alias("corrs"))
    )


def thinned(counts: DataFrame, max_regions: int) -> DataFrame:
    """Every s-th region by its place in the table, so that at most max_regions are left; for callers that ask for it."""
    regions = cut(counts.select("region_id").distinct())
    step = -(-regions.count() // max_regions)
    if step <= 1:
        return counts
    place = F.row_number().over(Window.orderBy("region_id")) - 1  # one row per region
    kept = regions.withColumn("_place", place).where(F.col("_place") % step == 0).select("region_id")
    return counts.join(kept, "region_id", "left_semi")


def reference_rank(correlation: DataFrame) -> DataFrame:
    """The other samples of the group by falling correlation (floored to 1e-9), ties by name."""
    pairs = F.arrays_zip("partners", "corrs")
    others = F.filter(pairs, lambda e: e["partners"] != F.col("sample_name"))
    keyed = F.transform(
        others,
        lambda e: F.struct(
            F.coalesce(-F.floor(F.nanvl(e["corrs"], F.lit(-2.0)) * 1e9), F.lit(2 * 10**9)).alias("key"),
            e["partners"].alias("ref"),
        ),
    )
    return correlation.select("label", "sample_name", F.sort_array(keyed)["ref"].alias("refs"))


def per_case_block(counts: DataFrame, lists: DataFrame, function, schema: str) -> DataFrame:
    """Run `function(cases, names, regions, matrix)` on blocks of cases and regions of each group.

    `lists` holds one row per case with an array of reference names. A task holds the counts of one region
    block for the whole group (samples x 1024 regions) and the lists of about 256 cases.
    """
    sizes = small_table(
        counts.groupBy("label").agg(
            F.ceil(F.countDistinct("sample_name") / CASE_BLOCK).cast("int").alias("_cases"),
            F.ceil(F.countDistinct("region_id") / REGION_BLOCK).cast("int").alias("_regions"),
        )
    )
    keys = ["label", "cb", "rb"]
    left = (
        counts.select("label", "sample_name", "region_id", "n")
        .join(sizes, "label")
        .withColumn("rb", F.pmod(F.hash("region_id"), F.col("_regions")))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("_cases") - 1)))
        .drop("_cases", "_regions")
    )
    right = (
        lists.join(sizes, "label")
        .withColumn("cb", F.pmod(F.hash("sample_name"), F.col("_cases")))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("_regions") - 1)))
        .drop("_cases", "_regions")
    )

    columns = ["label", *[field.split()[0] for field in schema.split(", ")]]

    def run(block: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
        if block.empty or cases.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
        names, at_name = np.unique(block["sample_name"].to_numpy().astype(str), return_inverse=True)
        regions, at_region = np.unique(block["region_id"].to_numpy(), return_inverse=True)
        matrix = np.zeros((len(regions), len(names)))
        matrix[at_region, at_name] = block["n"].to_numpy()
        out = function(cases, names, regions, matrix)
        out.insert(0, "label", block["label"].iloc[0])
        return out

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"label int, {schema}")


def prefix_sums(cases: pd.DataFrame, names: np.ndarray, regions: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
    """Sums over one region block for a case against its first 1, 2, ... references."""
    rows = []
    for case in cases.itertuples():
        x = matrix[:, np.searchsorted(names, case.sample_name)]
        order = np.searchsorted(names, np.asarray(case.refs, dtype=str))
        reference = np.cumsum(matrix[:, order], axis=1)
        total = reference + x[:, None]
        squares = np.divide((x * x)[:, None], total, out=np.zeros_like(total), where=total > 0)
        rows.append((case.sample_name, x.sum(), reference.sum(axis=0), squares.sum(axis=0), (total > 0).sum(axis=0)))
    return pd.DataFrame(rows, columns=["sample_name", "x", "ref", "x2t", "used"])


def reference_prefix_sums(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per case, arrays over the number m of references taken in rank order.

    ref: reference reads, x2t: sum of x^2/t, used: regions with reads; x: the case's own reads.
    """
    partial = per_case_block(
        counts,
        ranks,
        prefix_sums,
        "sample_name string, x double, ref array<double>, x2t array<double>, used array<double>",
    )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "label": [pdf["label"].iloc[0]],
                "sample_name": [pdf["sample_name"].iloc[0]],
                "x": [pdf["x"].sum()],
                **{c: [np.sum(np.vstack(pdf[c].tolist()), axis=0)] for c in ("ref", "x2t", "used")},
            }
        )

    return partial.groupBy("label", "sample_name").applyInPandas(
        add, "label int, sample_name string, x double, ref array<double>, x2t array<double>, used array<double>"
    )


def choice_score(x: Column, ref: Column, x2t: Column, used: Column) -> Column:
    """Expected log10 Bayes factor of a 0.5 ratio, divided by the overdispersion that the references leave.

    Overdispersion is Pearson's chi-square per degree of freedom, at least 1: more references add reads, badly
    matching ones add dispersion.
    """
    total = x + ref
    p = x / total
    half = 0.5 * p / (1 - p + 0.5 * p)
    gain = half * F.ln(half / p) + (1 - half) * F.ln((1 - half) / (1 - p))
    chi_square = (x2t - p * x) / (p * (1 - p))
    dispersion = F.greatest(F.lit(1.0), chi_square / F.greatest(used - 1, F.lit(1.0)))
    score = total * gain / dispersion / math.log(10)
    return F.when((x > 0) & (ref > 0), score).otherwise(F.lit(0.0))


def scored_prefixes(sums: DataFrame) -> DataFrame:
    """The arrays with a score per prefix, entries (score, m)."""
    zipped = F.arrays_zip("ref", "x2t", "used")
    scores = F.transform(
        zipped,
        lambda e, i: F.struct(choice_score(F.col("x"), e["ref"], e["x2t"], e["used"]).alias("score"), (i + 1).alias("m")),
    )
    return sums.withColumn("scores", scores)


def select_references(
    counts: DataFrame, max_regions: int | None = None, samples: list[str] | None = None
) -> DataFrame:
    """Per case the chosen references: the best-scoring prefix of its ranked list, ties to the shorter one.

    All regions count unless `max_regions` asks for fewer. With `samples` references are chosen for those cases only.
    """
    counts = cut(counts.select("label", "sample_name", "region_id", "n"))
    if max_regions is not None:
        counts = cut(thinned(counts, max_regions))
    ranks = cut(reference_rank(sample_correlation(counts) if samples is None else case_correlation(counts, samples)))
    scored = scored_prefixes(reference_prefix_sums(counts, ranks))
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["m"]).alias("less"))))
    return (
        scored.withColumn("_best", best)
        .select("label", "sample_name", (-F.col("_best.less")).alias("m"), F.col("_best.score").alias("score"))
        .join(ranks, ["label", "sample_name"])
        .withColumn("refs", F.slice("refs", F.lit(1), F.col("m")))
    )


def reference_totals(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sum of the chosen references per case and region: a 0/1 matrix of choices times the counts, in blocks."""

    def totals(cases: pd.DataFrame, names: np.ndarray, regions: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
        picked = np.zeros((len(names), len(cases)))
        for i, refs in enumerate(cases["refs"]):
            picked[np.searchsorted(names, np.asarray(refs, dtype=str)), i] = 1
        own = np.searchsorted(names, cases["sample_name"].to_numpy().astype(str))
        return pd.DataFrame(
            {
                "sample_name": np.repeat(cases["sample_name"].to_numpy(), len(regions)),
                "region_id": np.tile(regions, len(cases)),
                "n": matrix[:, own].T.ravel().astype("int64"),
                "ref_n": (matrix @ picked).T.ravel().astype("int64"),
            }
        )

    schema = "sample_name string, region_id long, n long, ref_n long"
    return per_case_block(counts, chosen.select("label", "sample_name", "refs"), totals, schema)


def state_likelihoods(with_refs: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """Log-likelihood of each state per region; regions without a read in case and references say nothing and go.

    Binomial, or beta-binomial with the `strengths` (label, sample_name, strength) of the cases; a case without one goes.
    """
    share = small_table(
        with_refs.groupBy("label", "sample_name").agg(F.try_divide(F.sum("n"), F.sum(F.col("n") + F.col("ref_n"))).alias("p"))
    )
    x, t, p = F.col("n"), F.col("n") + F.col("ref_n"), F.col("p")

    def loglik(ratio: float) -> Column:
        shifted = ratio * p / (1 - p + ratio * p)
        if strengths is not None:
            return beta_binomial(x.cast("double"), t.cast("double"), shifted, F.col("strength"))
        return x * F.ln(shifted) + (t - x) * F.ln(1 - shifted)

    if strengths is not None:
        share = share.join(strengths.select("label", "sample_name", "strength"), ["label", "sample_name"])
    return (
        with_refs.join(share, ["label", "sample_name"])
        .where((t > 0) & (p > 0) & (p < 1))
        .withColumns({"expected": p * t, **{f"ll_{s}": loglik(q) for s, q in zip(STATES, RATIOS)}})
    )


def most_likely_state() -> Column:
    """Index of the best state region by region; ties to the normal one."""
    best = F.greatest(*[F.col(f"ll_{s}") for s in STATES])
    picks = [F.when(F.col(f"ll_{s}") == best, F.lit(i)) for i, s in enumerate(STATES)]
    return F.coalesce(*picks)


def stitch_runs(runs: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Join neighbouring runs of equal state; runs carry state, first_ord and last_ord and leave no gaps."""
    order = Window.partitionBy(*keys).orderBy("first_ord")
    starts = F.when(F.lag("state").over(order) == F.col("state"), 0).otherwise(1)
    return (
        runs.withColumn("_starts", starts)
        .withColumn("_run", F.sum("_starts").over(order))
        .groupBy(*keys, "_run", "state")
        .agg(
            F.min("first_ord").alias("first_ord"),
            F.max("last_ord").alias("last_ord"),
            F.min("start_bp").alias("start_bp"),
            F.max("end_bp").alias("end_bp"),
            *[F.sum(s).alias(s) for s in sums],
        )
        .drop("_run")
    )


def state_segments(states: DataFrame, keys: list[str], sums: list[str], chunk: int = CHUNK) -> DataFrame:
    """Runs of equal state: gaps and islands inside chunks of positions, then joined across chunk bounds."""
    chunked = states.withColumn("_chunk", F.floor(F.col("ord") / chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("ord")
    same = Window.partitionBy(*keys, "_chunk", "state").orderBy("ord")
    runs = (
        chunked.withColumn("_island", F.row_number().over(inside) - F.row_number().over(same))
        .groupBy(*keys, "_chunk", "state", "_island")
        .agg(
            F.min("ord").alias("first_ord"),
            F.max("ord").alias("last_ord"),
            F.min("start_bp").alias("start_bp"),
            F.max("end_bp").alias("end_bp"),
            F.count("*").alias("nexons"),
            *[F.sum(s).alias(s) for s in sums],
        )
    )
    return stitch_runs(runs.drop("_chunk", "_island"), keys, ["nexons", *sums])


def switching(transition: float) -> np.ndarray:
    """Log switching matrix [from, to]: any other state with the same probability."""
    size = len(STATES)
    return np.log(np.where(np.eye(size, dtype=bool), 1 - (size - 1) * transition, transition))


def best_path(ll: np.ndarray, moves: np.ndarray, entry: int, leave: int | None = None) -> np.ndarray:
    """Most likely states of one chain, given the state before it and optionally the last state."""
    score = moves[entry] + ll[0]
    back = np.zeros(ll.shape, dtype=np.int8)
    for i in range(1, len(ll)):
        options = score[:, None] + moves
        back[i] = options.argmax(axis=0)
        score = options.max(axis=0) + ll[i]
    path = np.empty(len(ll), dtype=np.int64)
    path[-1] = score.argmax() if leave is None else leave
    for i in range(len(ll) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def chunk_scores(ll: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best score through a chunk for every state before it and every last state."""
    score = moves + ll[0]
    for row in ll[1:]:
        score = (score[:, :, None] + moves[None, :, :]).max(axis=1) + row
    return score


def bound_states(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, chunk, entry_state, leave_state): the states between which each chunk's part of its chain's best path runs.

    `scored` has a table of scores per chunk, by state before and at the end of it, row by row. Neighbouring tables are
    combined in rounds, the best middle state for every pair of outer ones, until a chain has one; then the states are
    handed down the same way. The rounds grow with the logarithm of the chunks of a chain; a chunk without any region
    may be missing. Ties go to the first state.
    """
    states = range(len(STATES))

    def first_best(values: list[Column]) -> Column:
        found = F.array(*values)
        return (F.array_position(found, F.array_max(found)) - 1).cast("int")

    def score(table: str, before: Column | int, after: Column | int) -> Column:
        return F.get(table, F.lit(before) * len(STATES) + F.lit(after))

    rows = cut(scored.select(*keys, F.col("chunk").cast("long").alias("node"), "scores"))
    last = rows.agg(F.max("node")).head()[0] or 0
    levels = []
    while last:
        sides = [F.max(F.when(F.col("node") % 2 == k, F.col("scores"))).alias(name) for k, name in enumerate(("left", "right"))]
        pairs = cut(rows.groupBy(*keys, F.shiftright("node", 1).alias("above")).agg(*sides).withColumnRenamed("above", "node"))
        levels.append(pairs)
        both = F.array(*[F.greatest(*[score("left", a, m) + score("right", m, b) for m in states]) for a in states for b in states])
        joined = F.when(F.col("left").isNull(), F.col("right")).when(F.col("right").isNull(), F.col("left")).otherwise(both)
        rows = pairs.select(*keys, "node", joined.alias("scores"))
        last >>= 1
    way = rows.select(*keys, "node", F.lit(0).alias("entry_state"), first_best([score("scores", 0, b) for b in states]).alias("leave_state"))
    for pairs in reversed(levels):
        entry, leave, node = F.col("entry_state"), F.col("leave_state"), F.col("node")
        middle = first_best([score("left", entry, m) + score("right", m, leave) for m in states])
        inner = F.when(F.col("right").isNull(), leave).when(F.col("left").isNull(), entry).otherwise(middle)
        parts = F.array(
            F.struct((2 * node).alias("node"), entry.alias("entry_state"), F.col("inner").alias("leave_state"), F.col("left").isNotNull().alias("there")),
            F.struct((2 * node + 1).alias("node"), F.col("inner").alias("entry_state"), leave.alias("leave_state"), F.col("right").isNotNull().alias("there")),
        )
        handed = pairs.join(way, [*keys, "node"]).withColumn("inner", inner)
        way = handed.select(*keys, F.explode(parts).alias("p")).where("p.there").select(*keys, "p.node", "p.entry_state", "p.leave_state")
    return way.withColumnRenamed("node", "chunk")


def most_likely_paths(
    likelihoods: DataFrame, keys: list[str], sums: list[str], transition: float = TRANSITION, chunk: int = CHUNK
) -> DataFrame:
    """Runs of equal state along the most likely path of each chain.

    Chains are cut in chunks of positions, so that no task holds a whole chain. Per chunk the best score for
    every pair of bounding states is found first; these small tables are combined pairwise, which fixes the states at
    the chunk bounds; then each chunk finds its own path between them. The result is the one of the whole chain.
    """
    chunked = likelihoods.withColumn("chunk", F.floor(F.col("ord") / chunk))
    lls = [f"ll_{s}" for s in STATES]
    moves = switching(transition)
    key_types = ", ".join(f"{k} {dict(likelihoods.dtypes)[k]}" for k in keys)
    size = len(STATES)

    def score_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        ll = pdf.sort_values("ord")[lls].to_numpy()
        return pd.DataFrame(
            {**{k: [pdf[k].iloc[0]] for k in [*keys, "chunk"]}, "scores": [chunk_scores(ll, moves).ravel()]}
        )

    def chunk_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        path = best_path(
            pdf[lls].to_numpy(), moves, int(pdf["entry_state"].iloc[0]), int(pdf["leave_state"].iloc[0])
        )
        pdf = pdf.assign(state=path, nexons=1, _run=np.cumsum(np.diff(path, prepend=path[0]) != 0))
        runs = pdf.groupby("_run", as_index=False).agg(
            **{k: (k, "first") for k in keys},
            state=("state", "first"),
            first_ord=("ord", "min"),
            last_ord=("ord", "max"),
            start_bp=("start_bp", "min"),
            end_bp=("end_bp", "max"),
            nexons=("nexons", "sum"),
            **{s: (s, "sum") for s in sums},
        )
        return runs.drop(columns="_run")

    scored = chunked.select(*keys, "chunk", "ord", *lls).groupBy(*keys, "chunk").applyInPandas(
        score_chunk, f"{key_types}, chunk long, scores array<double>"
    )
    bounds = bound_states(scored, keys)
    wanted = [*keys, "chunk", "ord", "start_bp", "end_bp", *dict.fromkeys([*lls, *sums])]
    runs = (
        chunked.select(*wanted)
        .join(bounds, [*keys, "chunk"])
        .groupBy(*keys, "chunk")
        .applyInPandas(
            chunk_runs,
            f"{key_types}, state int, first_ord long, last_ord long, start_bp long, end_bp long, nexons long, "
            + ", ".join(f"{s} double" for s in sums),
        )
    )
    return stitch_runs(runs, keys, ["nexons", *sums])


def segment_calls(segments: DataFrame) -> DataFrame:
    """Caller A's table out of the segments that are not normal."""
    state = F.col("state")
    ll = F.when(state == 1, F.col("ll_deletion")).otherwise(F.col("ll_duplication"))
    return segments.where(state > 0).select(
        "sample_name",
        (F.col("first_ord") + 1).alias("start_p"),
        (F.col("last_ord") + 1).alias("end_p"),
        F.concat(F.lit("chr"), region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp"))).alias("id"),
        F.when(state == 1, STATES[1]).otherwise(STATES[2]).alias("type"),
        F.col("nexons").cast("int").alias("nexons"),
        "start_bp",
        "end_bp",
        F.col("contig").alias("chromosome"),
        ((ll - F.col("ll_normal")) / math.log(10)).alias("bf"),
        F.col("expected").alias("reads_expected"),
        F.col("observed").cast("long").alias("reads_observed"),
        (F.col("observed") / F.col("expected")).alias("reads_ratio"),
    )


SEGMENT_KEYS = ["label", "sample_name", "contig"]
SEGMENT_SUMS = ["ll_normal", "ll_deletion", "ll_duplication", "expected", "observed"]


def positioned(likelihoods: DataFrame, targets: DataFrame) -> DataFrame:
    """Likelihoods with contig, bounds and position of the region."""
    places = chain_positions(targets).select("region_id", "contig", "start_bp", "end_bp", "ord")
    return likelihoods.join(places, "region_id").withColumn("observed", F.col("n").cast("double"))


def call_read_ratio(
    with_refs: DataFrame,
    targets: DataFrame,
    transition: float = TRANSITION,
    samples: list[str] | None = None,
    chunk: int = CHUNK,
    overdispersed: bool = False,
) -> DataFrame:
    """Deletions and duplications of every case, or of the given samples only.

    With `overdispersed` the counts are beta-binomial, with a strength that is fitted for each case.
    """
    cases = with_refs if samples is None else with_refs.where(F.col("sample_name").isin(samples))
    strengths = broadcast_if_small(case_strengths(cases)) if overdispersed else None
    likelihoods = positioned(state_likelihoods(cases, strengths), targets)
    return segment_calls(most_likely_paths(likelihoods, SEGMENT_KEYS, SEGMENT_SUMS, transition, chunk))


def annotated_calls(calls: DataFrame, common: DataFrame | None = None, exons: DataFrame | None = None) -> DataFrame:
    """Caller A's full table: common variants that cover half of a call, and the exons it touches, joined by commas.

    `common` and `exons` hold name, contig, start_bp, end_bp; without one of them its column is NULL.
    """
    keyed = calls.withColumn("call_key", F.concat_ws("/", "sample_name", "id"))
    places = keyed.select("call_key", F.col("chromosome").alias("contig"), "start_bp", "end_bp")
    for track, share, name in ((common, 0.5, "common_cnv"), (exons, 0.0001, "exon_names")):
        if track is None:
            keyed = keyed.withColumn(name, F.lit(None).cast("string"))
        else:
            found = annotate_overlaps(places, track, share, name).select("call_key", name)
            keyed = keyed.join(found, "call_key", "left")
    return keyed.drop("call_key")
