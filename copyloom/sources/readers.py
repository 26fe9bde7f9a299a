"""Readers of the pipeline's input files and hand-over files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom import schemas
from copyloom.functions.columns import name_from_path, region_label, strip_chr
from copyloom.operators.numbering import dense_numbers
from copyloom.sources.count_files import listed_samples, load_count_files


def number_targets(targets: DataFrame, contig_order: DataFrame | None = None, bed_zero_based: bool = False) -> DataFrame:
    """Targets in (contig, start, end) order with dense region ids from 0.

    `contig_order` (contig, ordinal) fixes the order of the contigs; without it numbers come before names, as
    numbers. Ids are counted in ranges of places, so no task sorts a whole contig. A target without a contig has no
    place and gets no id; it goes.
    """
    if bed_zero_based:
        targets = targets.withColumn("start_bp", F.col("start_bp") + 1)
    if contig_order is not None:
        ranked = targets.join(contig_order.select("contig", F.col("ordinal").cast("long").alias("_rank")), "contig", "left")
    else:
        ranked = targets.withColumn("_rank", strip_chr(F.col("contig")).try_cast("long"))
    ranked = ranked.withColumn("_rank", F.coalesce("_rank", F.lit(2**62))).where(F.col("contig").isNotNull())
    return dense_numbers(ranked, ["_rank", "contig", "start_bp", "end_bp"], "region_id").drop("_rank")


def read_bed(spark: SparkSession, path: str, schema: str = schemas.BED) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, comment="#")


def read_targets(
    spark: SparkSession, path: str, contig_order: DataFrame | None = None, bed_zero_based: bool = False
) -> DataFrame:
    """Target regions from a BED file without header; starts are used as they are unless told otherwise."""
    return number_targets(read_bed(spark, path), contig_order, bed_zero_based)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment table in Parquet; filters and column choice reach the scan."""
    return spark.read.schema(schemas.ALIGNMENTS).parquet(path)


def read_counts(spark: SparkSession, folder: str, targets: DataFrame) -> DataFrame:
    """Counts of all whole count files of a folder, joined with the targets by region label.

    The sample is named by the file. A file that breaks off or holds other lines gives no row at all;
    `failed_count_files` and `count_file_report` list it.
    """
    return load_count_files(spark, folder, targets).counts


def read_count_table(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """Counts as `write_counts` leaves them: one folder per sample, rows under the region label."""
    labels = targets.select(region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp")).alias("region"), "region_id")
    rows = spark.read.schema("region STRING, n BIGINT, sample_name STRING").parquet(path)
    return rows.join(labels, "region").select("sample_name", "region_id", "n")


def discover_samples(spark: SparkSession, folder: str, prefix: str, suffix: str) -> DataFrame:
    """Sample name, path and modification time of every file with the suffix that holds a byte; contents are not read."""
    listing = spark.read.format("binaryFile").load(f"{folder}/*{suffix}").select("path", "modificationTime")
    return listing.select(
        name_from_path(F.col("path"), suffix, prefix).alias("sample_name"), "path", "modificationTime"
    )


def failed_count_files(spark: SparkSession, folder: str, counts: DataFrame) -> DataFrame:
    """Samples whose count file gave no row at all."""
    return listed_samples(spark, folder).join(counts.select("sample_name").distinct(), "sample_name", "left_anti")


def count_file_report(spark: SparkSession, folder: str, targets: DataFrame) -> DataFrame:
    """For every count file its rows, those whose label is among the targets, and whether it covers every target once.

    `load_count_files` gives counts and report, there with the fault of a file, from one scan.
    """
    return load_count_files(spark, folder, targets).report.drop("fault")


def settled_files(listing: DataFrame, now: Column, seconds: int = 3600, modified: str = "modificationTime") -> DataFrame:
    """Files whose last change is more than `seconds` old; a plain comparison, so the source can skip data."""
    return listing.where(F.col(modified) < now - F.expr(f"INTERVAL '{seconds}' SECOND"))


def snake(name: str) -> str:
    return re.sub(r"\W+|(?<=[a-z])(?=[A-Z])", "_", name.strip()).lower()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sample sheet; column names come back in lower case with underscores."""
    raw = spark.read.csv(path, header=True)
    sheet = raw.toDF(*[snake(c) for c in raw.columns])
    return sheet.withColumn("paired_reads_exclude", F.upper("paired_reads_exclude").isin("TRUE", "T"))


def gtf_attribute(name: str) -> Column:
    value = F.regexp_extract("attributes", rf'(?:^|;\s*){name} "?([^";]*)"?', 1)
    return F.when(value != "", value).alias(name)


def read_gtf(spark: SparkSession, path: str, feature: str, canonical: DataFrame | None = None) -> DataFrame:
    """Features of one type with their attributes as columns; the attributes not in the file are NULL."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schemas.GTF, quote="")
    found = rows.where(F.col("feature") == feature).select(
        "contig", "source", "start_bp", "end_bp", *[gtf_attribute(a) for a in schemas.GTF_ATTRIBUTES]
    )
    found = found.withColumn("exon_number", F.col("exon_number").cast("int"))
    if canonical is None:
        return found
    listed = canonical.select("transcript_id").distinct().withColumn("is_canonical", F.lit("YES"))
    return found.join(listed, "transcript_id", "left")


def read_gene_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("symbol")).where("symbol <> ''")


def read_gene_scores(spark: SparkSession, path: str) -> DataFrame:
    """Constraint scores per gene symbol; oe_lof_upper is absent in some releases."""
    raw = spark.read.csv(path, sep="\t", header=True)
    scores = [c for c in schemas.GENE_SCORES[1:] if c in raw.columns]
    return raw.select("gene", *[F.col(c).try_cast("double").alias(c) for c in scores])


def parse_hi_scores(rows: DataFrame) -> DataFrame:
    """Split the packed name field into gene, score and percentile."""
    parts = F.split("name_field", "[|]")
    return rows.select(
        parts.getItem(0).alias("gene_name"),
        parts.getItem(1).try_cast("double").alias("hi_score"),
        parts.getItem(2).alias("pc"),
    )


def read_hi_scores(spark: SparkSession, path: str) -> DataFrame:
    """HI scores from a BED whose first line is skipped, highest score first."""
    rows = spark.read.csv(path, sep="\t", schema=schemas.BED4, header=True, enforceSchema=True)
    return parse_hi_scores(rows.where(F.col("name_field").isNotNull())).orderBy(F.desc("hi_score"))


def read_external_counts(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Another cohort's counts per gene: the three columns are renamed by position."""
    raw = spark.read.csv(path, sep="\t", header=True)
    named = raw.toDF("gene_name", f"{prefix}sample_hom_cnt", f"{prefix}sample_het_cnt")
    return named.select("gene_name", *[F.col(c).cast("long").alias(c) for c in named.columns[1:]])


def read_poisson_calls(spark: SparkSession, pattern: str) -> DataFrame:
    """Caller B tables of all clusters and chromosomes in one scan, with the cluster label from the file name."""
    label = F.regexp_extract(F.input_file_name(), r"cls(-?\d+)_", 1).cast("int")
    return spark.read.csv(pattern, sep="\t", header=True, schema=schemas.POISSON_CALLS).withColumn("label", label)


def read_calls(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Per-sample call files of either caller in one scan; the file names the sample. Empty files give no row."""
    suffix, schema = {
        "poisson": (schemas.POISSON_SUFFIX, schemas.POISSON_CALLS),
        "ratio": (schemas.RATIO_SUFFIX, schemas.RATIO_CALLS),
    }[kind]
    rows = spark.read.csv(f"{folder}/*{suffix}", sep="\t", header=True, schema=schema, nullValue="NA")
    return rows.withColumn("sample_name", name_from_path(F.input_file_name(), suffix))


def parse_clusters(rows: DataFrame) -> DataFrame:
    """One row per sample out of label and comma-joined members."""
    return rows.select(F.col("label").cast("int").alias("label"), F.explode(F.split("members", ",")).alias("sample_name"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return parse_clusters(spark.read.csv(path, sep="\t", schema=schemas.CLUSTER_FILE))


def read_reference_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Common variants or exons to annotate calls with: contig, start, end, name."""
    return read_bed(spark, path, schemas.BED4).withColumnRenamed("name_field", "name")
