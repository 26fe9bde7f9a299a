"""The whole chain: reads to grouped samples to both callers' tables, over all samples, groups and contigs at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.operators import cohort as co
from copyloom.operators import coverage as cov
from copyloom.operators import density as de
from copyloom.operators import intervals as iv
from copyloom.operators import poisson_caller as pc
from copyloom.operators import poisson_factors as pf
from copyloom.operators import ratio_caller as rc
from copyloom.operators import reads as rd
from copyloom.operators.genes import unprocessed
from copyloom.session import cut, small_table


def count_reads(targets: DataFrame, reads: DataFrame) -> DataFrame:
    """Counts of usable, well-mapped reads per region and sample. The reads are scanned, never shuffled."""
    samples = small_table(rd.read_samples(reads))
    chosen = rd.read_intervals(rd.min_mapq(rd.usable_reads(reads, samples=samples)))
    return iv.count_overlaps(targets, chosen, samples)


class CohortCalls(NamedTuple):
    """What the chain gives: both callers' tables, the samples' labels, and the samples with too little coverage."""

    ratio: DataFrame
    poisson: DataFrame
    labels: DataFrame
    failed: DataFrame


def group_samples(
    counts: DataFrame,
    min_mean_rc: float = cov.MIN_MEAN_COUNT,
    min_cluster_size: int = co.MIN_CLUSTER_SIZE,
    neighbours: int = co.NEIGHBOURS,
    profile_regions: int | None = None,
    by_density: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Label and nearest cluster of every sample with enough coverage, and the samples without.

    Neighbours are found on the z-scored profile of all regions, or of the first `profile_regions`; with `by_density` the
    groups are those of the density hierarchy over the leading components instead. Noise samples take the cluster with the
    nearest members on the two leading components.
    """
    used = counts if profile_regions is None else cov.first_regions(counts, profile_regions)
    passed, failed = cov.split_by_coverage(used, min_mean_rc)
    z = cut(cov.zscore_by_region(cov.scale_profiles(passed)))
    scores = cut(co.profile_components(z, co.COMPONENTS if by_density else 2))
    positions = scores.select("sample_name", F.col("component").alias("dim"), F.col("score").alias("v"))
    found = de.density_groups(positions, min_cluster_size) if by_density else co.batch_samples(co.sample_neighbours(z, neighbours), min_cluster_size, z)
    labels = cut(found)
    positions = positions.where(F.col("dim") <= 2)
    return cut(co.assign_noise(co.noise_distances(positions, labels), labels)), cut(failed)


def cohort_calls(
    targets: DataFrame,
    reads: DataFrame,
    done: DataFrame | None = None,
    min_mean_rc: float = cov.MIN_MEAN_COUNT,
    min_cluster_size: int = co.MIN_CLUSTER_SIZE,
    neighbours: int = co.NEIGHBOURS,
    coverage: tuple[float, float] = cov.COVERAGE_LIMITS,
    factors: tuple[int, ...] = pc.LATENT_FACTORS,
    include_likely: bool = False,
    profile_regions: int | None = None,
    by_density: bool = False,
    max_regions: int | None = None,
    overdispersed: bool = False,
    poisson_factors: bool = False,
    longest_window: int = pc.LONGEST_WINDOW,
    min_lratio: float = pc.MIN_LRATIO,
    common: DataFrame | None = None,
    exons: DataFrame | None = None,
) -> CohortCalls:
    """Calls of both callers, sample labels, and failed samples. `done` names samples that already have results.

    All regions count for grouping and for the choice of references unless `profile_regions` or `max_regions` ask for
    fewer. `overdispersed` lets caller A's counts vary more than a binomial does; `poisson_factors` fits caller B's latent factors to
    counts instead of log residuals. Caller B covers autosomes, as its model takes two copies for granted; its size factors are genome-wide.
    Caller A's table names `common` variants and `exons` (name, contig, start_bp, end_bp) where they are given.
    """
    counts = cut(count_reads(targets, reads))
    labels, failed = group_samples(counts, min_mean_rc, min_cluster_size, neighbours, profile_regions, by_density)
    column = "likely" if include_likely else "label"
    members = labels.where(F.col(column) != co.NOISE).select("sample_name", F.col(column).alias("label"))
    if done is not None:
        wanted = unprocessed(labels, done).select("label").union(unprocessed(labels, done).select("likely")).distinct()
        members = members.join(wanted, "label", "left_semi")
    grouped = cut(counts.join(members, "sample_name").select("label", "sample_name", "region_id", "n"))

    with_refs = cut(rc.reference_totals(grouped, rc.select_references(grouped, max_regions)))
    ratio_calls = rc.annotated_calls(rc.call_read_ratio(with_refs, targets, overdispersed=overdispersed), common, exons)

    qc = cov.region_qc(grouped, targets, coverage=coverage, by=("label",))
    passed = cut(cov.qc_counts(grouped, qc, by=("label",)))
    k0 = cov.autosomes(pc.expected_k0(passed, cov.library_size_factor(passed, by=("label",))))
    expected = pc.chains(cut(pc.expected_counts(k0, factors, pf.poisson_models if poisson_factors else pc.latent_models)))
    poisson_calls = pc.call_poisson_scan(expected, longest_window, min_lratio)
    return CohortCalls(ratio_calls, poisson_calls, labels, failed)


def one_case(targets: DataFrame, counts: DataFrame, sample: str, max_regions: int | None = None) -> DataFrame:
    """Caller A's table of a single case against the samples of its group; references are chosen for it alone.

    `counts` holds label, sample_name, region_id, n.
    """
    own = counts.where(F.col("sample_name") == sample).select("label").distinct()
    group = cut(counts.join(F.broadcast(own), "label", "left_semi"))  # one label
    with_refs = rc.reference_totals(group, rc.select_references(group, max_regions, [sample]))
    return rc.call_read_ratio(with_refs, targets, samples=[sample])


def both_callers(ratio_calls: DataFrame, poisson_calls: DataFrame) -> DataFrame:
    """The two call tables under common columns."""
    by_ratio = ratio_calls.select(
        F.lit("ratio").alias("caller"),
        "sample_name",
        F.col("chromosome").alias("contig"),
        "start_bp",
        "end_bp",
        F.substring("type", 1, 3).alias("kind"),
    )
    by_poisson = poisson_calls.select(
        F.lit("poisson").alias("caller"),
        "sample_name",
        F.col("chr").alias("contig"),
        F.col("st_bp").alias("start_bp"),
        F.col("ed_bp").alias("end_bp"),
        F.col("cnv").alias("kind"),
    )
    return by_ratio.unionByName(by_poisson)
