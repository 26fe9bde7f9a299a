"""Calls against genes, and the cohort table of deletions per gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.functions.columns import region_label, strip_chr
from copyloom.operators.intervals import overlap_join, track_fits

# Annotation sources that are used, and the columns of the cohort table in their order.
CURATED_SOURCES = ["ensembl", "ensembl_havana", "havana"]
GENE_TABLE_COLUMNS = [
    "call_id",
    "gene_id",
    "gene_name",
    "sample_name",
    "sample_cnt",
    "in_gene_panel",
    "codex_lratio",
    "codex_copy_number",
    "exomedepth_bf",
    "exomedepth_ratio",
    "hi_score",
    "pLI",
    "pRec",
    "pNull",
    "oe_lof_upper",
    "gene_biotype",
]
POISSON_FIELDS = {"lratio": "codex_lratio", "copy_no": "codex_copy_number"}
RATIO_FIELDS = {"bf": "exomedepth_bf", "reads_ratio": "exomedepth_ratio"}

CALL_KEY = ["sample_name", "gene_id", "call_id"]

# Scores of one symbol that a row of the score table holds.
HI_SCORES_TOGETHER = 1000


def curated_exons(exons: DataFrame) -> DataFrame:
    return exons.where(F.col("source").isin(CURATED_SOURCES))


def deletions(poisson_calls: DataFrame, ratio_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    return poisson_calls.where("cnv = 'del'"), ratio_calls.where("type = 'deletion'")


def active_samples(manifest: DataFrame) -> DataFrame:
    return manifest.where(~F.col("paired_reads_exclude")).select("sample_name", "sample_project_name").distinct()


def calls_for_samples(calls: DataFrame, samples: DataFrame) -> DataFrame:
    return calls.join(samples.select("sample_name"), "sample_name", "left_semi")


def unprocessed(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples that have no result yet."""
    return samples.join(done.select("sample_name"), "sample_name", "left_anti")


def poisson_intervals(calls: DataFrame) -> DataFrame:
    return calls.withColumnsRenamed({"chr": "contig", "st_bp": "start_bp", "ed_bp": "end_bp"}).withColumn(
        "contig", strip_chr(F.col("contig"))
    )


def ratio_intervals(calls: DataFrame) -> DataFrame:
    return calls.withColumnRenamed("chromosome", "contig").withColumn("contig", strip_chr(F.col("contig")))


def with_call_id(calls: DataFrame) -> DataFrame:
    return calls.withColumn("call_id", region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp")))


def exon_hits(exons: DataFrame, calls: DataFrame, small: bool | None = None) -> DataFrame:
    """Every exon with every call that overlaps it; contig names lose their "chr" on both sides."""
    track = exons.withColumn("contig", strip_chr(F.col("contig")))
    return overlap_join(with_call_id(calls), track, small=small)


def gene_hits(exons: DataFrame, calls: DataFrame, fields: dict[str, str], small: bool | None = None) -> DataFrame:
    """(sample, gene, call, scores) for every exon of a gene that a call touches, with repeats.

    Transcripts share exons: each (gene, interval) is matched once, however many transcripts list it.
    """
    small = track_fits(exons) if small is None else small
    intervals = exons.where("gene_id IS NOT NULL").select("gene_id", "contig", "start_bp", "end_bp").distinct()
    wanted = calls.select(
        "sample_name", "contig", "start_bp", "end_bp", *[F.col(c).alias(name) for c, name in fields.items()]
    )
    return exon_hits(intervals, wanted, small).select(*CALL_KEY, *fields.values())


def gene_calls(exons: DataFrame, calls: DataFrame, fields: dict[str, str], small: bool | None = None) -> DataFrame:
    """Distinct (sample, gene, call, scores) rows of the calls that touch an exon."""
    return gene_hits(exons, calls, fields, small).distinct()


def call_keys(poisson_genes: DataFrame, ratio_genes: DataFrame) -> DataFrame:
    return poisson_genes.select(*CALL_KEY).unionByName(ratio_genes.select(*CALL_KEY)).distinct()


def calls_by_key(poisson_genes: DataFrame, ratio_genes: DataFrame) -> DataFrame:
    """Per (sample, gene, call) the sets of either caller's scores.

    One shuffle, combined before it, does the work of making both sides distinct and joining them; the inputs
    may repeat rows. A set has one entry per differing call at identical coordinates, usually one.
    """
    p_type = poisson_genes.select(F.struct(*POISSON_FIELDS.values()).alias("s")).schema["s"].dataType
    r_type = ratio_genes.select(F.struct(*RATIO_FIELDS.values()).alias("s")).schema["s"].dataType
    p = poisson_genes.select(*CALL_KEY, F.struct(*POISSON_FIELDS.values()).alias("p"), F.lit(None).cast(r_type).alias("r"))
    r = ratio_genes.select(*CALL_KEY, F.lit(None).cast(p_type).alias("p"), F.struct(*RATIO_FIELDS.values()).alias("r"))
    return p.unionByName(r).groupBy(*CALL_KEY).agg(F.collect_set("p").alias("ps"), F.collect_set("r").alias("rs"))


def merge_callers(by_key: DataFrame, genes: DataFrame) -> DataFrame:
    """Both callers side by side per (sample, gene, call), with the gene's name and biotype.

    The same rows as a full join of the two callers on the key.
    """
    info = genes.select("gene_id", "gene_name", "gene_biotype")
    return (
        by_key.withColumn("p", F.explode_outer("ps"))
        .withColumn("r", F.explode_outer("rs"))
        .select(*CALL_KEY, "p.*", "r.*")
        .join(info, "gene_id")
    )


def gene_sample_counts(by_key: DataFrame, genes: DataFrame) -> DataFrame:
    """Number of samples with a deletion per gene, over both callers.

    Asking for the sets keeps this branch on the very shuffle that the rows come from, so it runs once.
    """
    found = (F.size("ps") + F.size("rs")) > 0
    pairs = by_key.groupBy("gene_id", "sample_name").agg(F.max(found).alias("found"))
    counts = pairs.where("found").groupBy("gene_id").agg(F.count("*").alias("sample_cnt"))
    return counts.join(genes.select("gene_id", "gene_name").distinct(), "gene_id")


def optional(df: DataFrame, name: str) -> Column:
    """A score column under its output name, NULL where the score file lacks it."""
    found = {c.lower(): c for c in df.columns}
    column = F.col(found[name.lower()]) if name.lower() in found else F.lit(None)
    return column.cast("double").alias(name)


def add_constraint_scores(counts: DataFrame, pli: DataFrame) -> DataFrame:
    """Left join on the gene symbol; one that is listed twice multiplies rows."""
    scores = pli.select(
        F.col("gene").alias("gene_name"), *[optional(pli, c) for c in ("pLI", "pRec", "pNull", "oe_lof_upper")]
    )
    return counts.join(scores, "gene_name", "left")


def hi_by_symbol(hi: DataFrame) -> DataFrame:
    """All scores of a symbol, in rows of at most some `HI_SCORES_TOGETHER`: (gene_name, hi_scores)."""
    rows = hi.where("gene_name IS NOT NULL").select("gene_name", "hi_score")
    sizes = rows.groupBy("gene_name").agg(F.ceil(F.count("*") / HI_SCORES_TOGETHER).cast("int").alias("_parts"))
    part = F.pmod(F.hash("hi_score"), F.col("_parts")).alias("_part")
    # As structs, since a list leaves NULLs out.
    scores = F.collect_list(F.struct("hi_score")).alias("hi_scores")
    return rows.join(sizes, "gene_name").groupBy("gene_name", part).agg(scores).drop("_part")


def add_hi_scores(rows: DataFrame, by_symbol: DataFrame) -> DataFrame:
    """Left join with the scores of `hi_by_symbol`: a row for each score of the symbol, made where the row lies."""
    joined = rows.join(by_symbol, "gene_name", "left").withColumn("_score", F.explode_outer("hi_scores"))
    return joined.select(*rows.columns, F.col("_score.hi_score").alias("hi_score"))


def add_gene_scores(counts: DataFrame, pli: DataFrame, hi: DataFrame, dedupe: str | None = None) -> DataFrame:
    """Left joins on the gene symbol. A symbol listed twice multiplies rows unless dedupe="max" is asked for."""
    his = hi.select("gene_name", "hi_score")
    if dedupe == "max":
        his = his.groupBy("gene_name").agg(F.max("hi_score").alias("hi_score"))
    return add_constraint_scores(counts, pli).join(his, "gene_name", "left")


def flag_in_panel(genes: DataFrame, panel: DataFrame) -> DataFrame:
    listed = panel.select(F.col("symbol").alias("gene_name"), F.lit(True).alias("_listed")).distinct()
    return genes.join(listed, "gene_name", "left").select(
        *genes.columns, F.coalesce("_listed", F.lit(False)).alias("in_gene_panel")
    )


def add_external_counts(genes: DataFrame, external: DataFrame) -> DataFrame:
    """Counts of another cohort, by gene symbol."""
    return genes.join(external, "gene_name", "left")


def flag_canonical(exons: DataFrame, canonical: DataFrame) -> DataFrame:
    """is_canonical = YES on exons of a canonical transcript, NULL otherwise."""
    listed = canonical.select("transcript_id").distinct().withColumn("is_canonical", F.lit("YES"))
    return exons.join(listed, "transcript_id", "left")


def protein_coding(table: DataFrame) -> DataFrame:
    return table.where("gene_biotype = 'protein_coding'").drop("gene_biotype")
