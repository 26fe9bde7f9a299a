"""Call labels, union of two call sets, annotation with genes, per-sample statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.functions.columns import length_kb, region_label, short_type, sorted_distinct
from copyloom.operators.intervals import overlap_join, union_intervals
from copyloom.session import cut

# Output columns of the unpacked labels, in their order.
POISSON_COLUMNS = [
    "CODEX2_pos",
    "CDX_type",
    "CDX_length(Kbp)",
    "CDX_raw_coverage",
    "CDX_normalized_coverage",
    "CDX_copy_number",
    "CDX_likelihood",
]
RATIO_COLUMNS = [
    "ExomeDepth_pos",
    "EDP_type",
    "EDP_length(Kbp)",
    "EDP_reads_expected",
    "EDP_reads_observed",
    "EDP_reads_ratio",
    "EDP_BayesFactor",
    "EDP_num_exons",
    "EDP_Common_CNV",
]
STATS_NAMES = {
    "label": "cluster_label",
    "likely": "closest_cluster_label",
    "call_count": "CODEX2_cnv_count",
}
POISSON_VALUES = ["raw_cov", "norm_cov", "copy_no", "lratio", "mbic"]
RATIO_VALUES = ["reads_expected", "reads_observed", "reads_ratio", "bf", "nexons", "common_cnv"]


def plain_number(value: Column) -> Column:
    """A number as a table shows it: whole ones without a point, none with an exponent."""
    wide = F.regexp_replace(value.cast("decimal(38,9)").cast("string"), r"\.?0+$", "")
    text = F.when(F.abs(value).between(1e-3, 1e7), value.cast("string")).otherwise(wide)
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(text)


def text_or_na(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("NA")
    value = F.col(name)
    return F.coalesce(plain_number(value) if dict(df.dtypes)[name] == "double" else value.cast("string"), F.lit("NA"))


def pack(df: DataFrame, kind: Column, values: list[str]) -> Column:
    contig, start, end = F.col("contig"), F.col("start_bp"), F.col("end_bp")
    head = [region_label(contig, start, end), kind, plain_number(length_kb(start, end))]
    return F.concat_ws("|", *head, *[text_or_na(df, v) for v in values])


def pack_poisson(calls: DataFrame) -> DataFrame:
    """Intervals with the call's fields in one label; contigs keep the caller's naming inside the label."""
    return calls.withColumn("label", pack(calls, F.col("cnv"), POISSON_VALUES))


def pack_ratio(calls: DataFrame) -> DataFrame:
    return calls.withColumn("label", pack(calls, short_type(F.col("type")), RATIO_VALUES))


def unpack(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Label fields as columns; a missing label gives NA in each of them."""
    parts = F.split(label, "[|]")
    fields = {c: F.coalesce(F.get(parts, i), F.lit("NA")) for i, c in enumerate(columns)}
    return df.withColumns(fields)


def annotate_calls_with_genes(calls: DataFrame, exons: DataFrame) -> DataFrame:
    """Calls that touch an exon, with copy type, copy number, gene names and gene ids collapsed per call interval."""
    hits = overlap_join(
        calls.select("sample_name", "contig", "start_bp", "end_bp", "cnv", "copy_no"),
        exons.select("contig", "start_bp", "end_bp", "gene_id", "gene_name"),
    )
    return hits.groupBy("sample_name", "contig", "start_bp", "end_bp").agg(
        sorted_distinct(F.col("cnv")).alias("copy_type"),
        sorted_distinct(F.col("copy_no").cast("string")).alias("copy_number"),
        sorted_distinct(F.col("gene_name")).alias("gene_names"),
        sorted_distinct(F.col("gene_id")).alias("gene_ids"),
    )


def annotate_genes_full_split(segments: DataFrame, genes: DataFrame, half_open: bool = False) -> DataFrame:
    """One "full" row per segment with all its genes, and one "split" row per gene it touches.

    `segments` carries segment_id, contig, start_bp, end_bp and anything else, which both kinds of rows repeat. A segment's
    genes are collected once, as many as lie on it, and both kinds of rows come from that list. Genes are closed intervals; the end of a
    half-open segment belongs to the next one. Of a gene with several entries the longest overlap counts.
    """
    last = F.col("end_bp") - 1 if half_open else F.col("end_bp")
    shared = F.least("end_bp", "track_end") - F.greatest("start_bp", "track_start") + 1
    listed = (
        overlap_join(
            segments.select("segment_id", "contig", "start_bp", last.alias("end_bp")),
            genes.select("gene_id", "gene_name", "contig", "start_bp", "end_bp"),
        )
        .groupBy("segment_id")
        .agg(F.sort_array(F.collect_list(F.struct("gene_name", shared.alias("overlap_bp")))).alias("_listed"))
    )
    # Entries of a gene lie side by side, the longest one last.
    longest = F.filter(
        "_listed", lambda hit, i: (i + 1 == F.size("_listed")) | ~F.get("_listed", i + 1)["gene_name"].eqNullSafe(hit["gene_name"])
    )
    hits = listed.select("segment_id", longest.alias("_hits"))

    def row(mode: str, name: Column, count: Column, overlap: Column) -> Column:
        return F.struct(name.alias("gene_name"), count.cast("long").alias("gene_count"), overlap.cast("long").alias("overlap_bp"), F.lit(mode).alias("annotation_mode"))

    found = F.coalesce("_hits", F.array().cast("array<struct<gene_name:string,overlap_bp:bigint>>"))
    names = F.when(F.col("_hits").isNotNull(), F.concat_ws(",", F.col("_hits.gene_name")))
    full = row("full", names, F.size(found), F.aggregate(found, F.lit(0).cast("long"), lambda total, hit: total + hit["overlap_bp"]))
    split = F.transform(found, lambda hit: row("split", hit["gene_name"], F.lit(1), hit["overlap_bp"]))
    return (
        segments.join(hits, "segment_id", "left")
        .withColumn("_row", F.explode(F.concat(F.array(full), split)))
        .select("segment_id", *[c for c in segments.columns if c != "segment_id"], "_row.*")
    )


def annotate_sample_calls(poisson: DataFrame, ratio: DataFrame, genes: DataFrame) -> DataFrame:
    """Both call sets laid over each other per sample, cut at every breakpoint, annotated and unpacked.

    The whole cohort in one plan; a sample that only one caller reports on goes the same way. Statistics of a
    call that is cut in several pieces are repeated; the first field of its label identifies it.
    """
    pieces = union_intervals(
        pack_poisson(poisson).select("sample_name", "contig", "start_bp", "end_bp", "label"),
        pack_ratio(ratio).select("sample_name", "contig", "start_bp", "end_bp", "label"),
    )
    named = pieces.withColumn(
        "segment_id",
        F.concat_ws("/", "sample_name", region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp"))),
    )
    rows = annotate_genes_full_split(cut(named), genes, half_open=True)
    rows = unpack(unpack(rows, "label_a", POISSON_COLUMNS), "label_b", RATIO_COLUMNS)
    return rows.withColumn("length_kb", length_kb(F.col("start_bp"), F.col("end_bp"))).drop(
        "segment_id", "label_a", "label_b"
    )


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("sample_name").agg(F.count("*").alias("call_count"))


def sample_stats(samples: DataFrame, coverage: DataFrame, labels: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per sample: mean count, cluster, nearest cluster and number of calls.

    A sample without a label failed QC and stays NULL; one that was labelled and has no call has 0 calls.
    """
    return (
        samples.select("sample_name", "bam_file")
        .join(coverage.select("sample_name", F.col("mean_rc").alias("mean_read_count")), "sample_name", "left")
        .join(labels.select("sample_name", "label", "likely"), "sample_name", "left")
        .join(call_counts(calls), "sample_name", "left")
        .withColumn("call_count", F.coalesce("call_count", F.when(F.col("label").isNotNull(), F.lit(0))))
        .withColumnsRenamed(STATS_NAMES)
    )


def calls_by_sample(calls: DataFrame, labels: DataFrame) -> DataFrame:
    """Calls of each cluster's own samples, matched by exact sample name and label."""
    return calls.join(labels.select("label", "sample_name"), ["label", "sample_name"], "left_semi")
