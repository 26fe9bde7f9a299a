"""Explicit schemas of the file formats, as DDL text."""

# The file formats' columns in their order.
BED = "contig STRING, start_bp BIGINT, end_bp BIGINT"
BED4 = "contig STRING, start_bp BIGINT, end_bp BIGINT, name_field STRING"
ALIGNMENTS = "sample_name STRING, contig STRING, pos BIGINT, qwidth BIGINT, mapq INT, flag INT"
COUNT_FILE = "region STRING, n BIGINT"
CLUSTER_FILE = "label STRING, members STRING"
GTF = (
    "contig STRING, source STRING, feature STRING, start_bp BIGINT, end_bp BIGINT, "
    "score STRING, strand STRING, frame STRING, attributes STRING"
)
POISSON_CALLS = (
    "sample_name STRING, chr STRING, cnv STRING, st_bp BIGINT, ed_bp BIGINT, length_kb DOUBLE, st_exon BIGINT, "
    "ed_exon BIGINT, raw_cov DOUBLE, norm_cov DOUBLE, copy_no INT, lratio DOUBLE, mbic DOUBLE"
)
RATIO_CALLS = (
    "start_p BIGINT, end_p BIGINT, type STRING, nexons INT, start_bp BIGINT, end_bp BIGINT, chromosome STRING, "
    "id STRING, bf DOUBLE, reads_expected DOUBLE, reads_observed DOUBLE, reads_ratio DOUBLE, common_cnv STRING, "
    "exon_names STRING"
)
GENE_SCORES = ["gene", "pLI", "lof_z", "mis_z", "pRec", "pNull", "oe_lof_upper"]
GTF_ATTRIBUTES = [
    "gene_id",
    "gene_name",
    "gene_biotype",
    "transcript_id",
    "exon_number",
    "transcript_biotype",
    "ccds_id",
]

# File name endings.
COUNT_SUFFIX = "_exome_RC.csv.gz"
POISSON_SUFFIX = "_CODEX2.tsv"
RATIO_SUFFIX = "_ExomeDepth.tsv"
