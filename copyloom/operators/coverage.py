"""Coverage tables: sample and region QC, scaling, size factors. All in long form (sample_name, region_id, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.functions.columns import is_autosome
from copyloom.operators.medians import medians
from copyloom.session import small_table

# Default QC limits.
MIN_MEAN_COUNT = 20
COVERAGE_LIMITS = (20, 4000)
LENGTH_LIMITS = (20, 2000)
MIN_MAPPABILITY = 0.9
GC_LIMITS = (20, 80)
PROFILE_REGIONS = 10000


def sample_coverage(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_name").agg(F.sum("n").alias("sum_rc"), F.avg("n").alias("mean_rc"))


def split_by_coverage(counts: DataFrame, min_mean_rc: float = MIN_MEAN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Counts of the samples strictly above the minimum, and the failed samples with their mean.

    A sample whose count file holds no row, or only unreadable counts, is among the failed ones with NULL.
    """
    coverage = sample_coverage(counts)
    enough = F.coalesce(F.col("mean_rc") > min_mean_rc, F.lit(False))
    passed = coverage.where(enough).select("sample_name")
    failed = coverage.where(~enough).select("sample_name", "mean_rc")
    return counts.join(passed, "sample_name", "left_semi"), failed


def first_regions(counts: DataFrame, regions: int = PROFILE_REGIONS, first: int = 0) -> DataFrame:
    """The first regions in target order, for callers that ask for it; region ids are dense and start at `first`."""
    return counts.where(F.col("region_id") < first + regions)


def autosomes(df: DataFrame, contig: str = "contig") -> DataFrame:
    return df.where(is_autosome(F.col(contig)))


def region_qc(
    counts: DataFrame,
    targets: DataFrame,
    coverage: tuple[float, float] = COVERAGE_LIMITS,
    length: tuple[int, int] = LENGTH_LIMITS,
    min_mapp: float = MIN_MAPPABILITY,
    gc: tuple[float, float] = GC_LIMITS,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row per region with its median coverage over samples and a pass flag."""
    median = medians(counts, [*by, "region_id"], F.col("n"), "median_rc")
    width = F.col("end_bp") - F.col("start_bp") + 1
    return median.join(targets, "region_id").select(
        *by,
        "region_id",
        "contig",
        "start_bp",
        "end_bp",
        "gc",
        "mapp",
        "median_rc",
        width.alias("width"),
        (
            F.col("median_rc").between(*coverage)
            & width.between(*length)
            & (F.col("mapp") >= min_mapp)
            & F.col("gc").between(*gc)
        ).alias("pass"),
    )


def annotate_targets(targets: DataFrame, gc: DataFrame, mapp: DataFrame) -> DataFrame:
    """GC percentage and mappability as columns of the targets, NULL where not known."""
    return targets.join(gc.select("region_id", "gc"), "region_id", "left").join(
        mapp.select("region_id", "mapp"), "region_id", "left"
    )


def qc_counts(counts: DataFrame, qc: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the regions that passed, with contig and GC of the region."""
    passed = qc.where("pass").select(*by, "region_id", "contig", "start_bp", "end_bp", "gc")
    return counts.join(passed, [*by, "region_id"])


def scale_profiles(counts: DataFrame) -> DataFrame:
    """Counts in parts per thousand of the sample's total, without regions that are zero in every sample.

    Totals are one row per sample and go to the counts; one shuffle brings a region's samples together, and
    `zscore_by_region` needs no other.
    """
    totals = small_table(counts.groupBy("sample_name").agg(F.sum("n").alias("total")).where("total > 0"))
    return (
        counts.join(totals, "sample_name")
        .select("sample_name", "region_id", (F.col("n") * 1000.0 / F.col("total")).alias("v"))
        .withColumn("most", F.max("v").over(Window.partitionBy("region_id")))
        .where("most > 0")
        .drop("most")
    )


def zscore_by_region(profiles: DataFrame) -> DataFrame:
    """Each region to mean 0 and population sd 1 over the samples; a constant region becomes 0."""
    region = Window.partitionBy("region_id")
    mean, sd = F.avg("v").over(region), F.stddev_pop("v").over(region)
    return profiles.select("sample_name", "region_id", "v", mean.alias("mean_v"), sd.alias("sd_v")).select(
        "sample_name",
        "region_id",
        F.when(F.col("sd_v") > 1e-12, (F.col("v") - F.col("mean_v")) / F.col("sd_v")).otherwise(0.0).alias("z"),
    )


def library_size_factor(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Median over regions of count / geometric mean, from the regions that no sample has at zero.

    Genome-wide by design: computed before any chromosome filter. The window holds one region over its samples.
    """
    region = Window.partitionBy(*by, "region_id")
    ratio = F.col("n") / F.exp(F.avg(F.ln("n")).over(region))
    used = counts.select(*by, "sample_name", "region_id", "n", F.min("n").over(region).alias("least")).where("least > 0")
    return medians(used.withColumn("ratio", ratio), [*by, "sample_name"], F.col("ratio"), "size_factor")


def counts_wide(counts: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Count matrix, regions by samples; only for export."""
    return counts.groupBy("region_id").pivot("sample_name", samples).agg(F.sum("n"))
