"""Registered queries: every operator on the fixture views of a driver folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copyloom.fixtures import table, view
from copyloom.functions import columns as c
from copyloom.operators import annotate as an
from copyloom.operators import cohort as co
from copyloom.operators import cohort_store as cs
from copyloom.operators import coverage as cov
from copyloom.operators import density as de
from copyloom.operators import dispersion as ds
from copyloom.operators import genes as g
from copyloom.operators import intervals as iv
from copyloom.operators import poisson_caller as pc
from copyloom.operators import poisson_factors as pf
from copyloom.operators import ratio_caller as rc
from copyloom.operators import reads as rd
from copyloom.plans import gene_table, pipeline
from copyloom.session import cut, handover_path
from copyloom.sources import readers, writers

QUERIES = {}

# The fixtures hold about nine reads per region and sample.
MIN_MEAN = 8
COVERAGE = (4, 4000)
NEIGHBOURS = 8
MIN_CLUSTER = 8


def query(function):
    QUERIES[function.__name__] = function
    return function


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: c.round6(F.col(n)) for n in names})


def micros(values: Column) -> Column:
    """An array of numbers as text, in millionths."""
    return F.concat_ws(",", F.transform(values, lambda v: F.floor(v * 1e6 + 0.5).cast("string")))


# ---- shared inputs


def usable(spark: SparkSession, sf: str) -> DataFrame:
    return rd.usable_reads(view(spark, sf, "fx_reads"))


def counted(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.count_reads(view(spark, sf, "fx_targets"), view(spark, sf, "fx_reads"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return counted(spark, sf).join(view(spark, sf, "fx_clusters"), "sample_name")


def zscores(spark: SparkSession, sf: str) -> DataFrame:
    return cov.zscore_by_region(cov.scale_profiles(cut(counted(spark, sf))))


def qc_passed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Counts of the regions that pass QC per group, and size factors per group."""
    counts = cut(labelled(spark, sf))
    qc = cov.region_qc(counts, view(spark, sf, "fx_targets"), coverage=COVERAGE, by=("label",))
    passed = cut(cov.qc_counts(counts, qc, by=("label",)))
    return passed, cov.library_size_factor(passed, by=("label",))


def k0(spark: SparkSession, sf: str) -> DataFrame:
    return pc.expected_k0(*qc_passed(spark, sf))


def poisson(spark: SparkSession, sf: str) -> DataFrame:
    return g.poisson_intervals(view(spark, sf, "fx_poisson_calls"))


def ratio(spark: SparkSession, sf: str) -> DataFrame:
    return g.ratio_intervals(view(spark, sf, "fx_ratio_calls"))


def exons(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_exons")


def points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "fx_points").withColumn("sample_name", F.col("sample_id").cast("string"))
    long = rows.select("sample_name", F.posexplode("embedding").alias("dim", "e"))
    return long.select("sample_name", "dim", F.col("e").cast("double").alias("v")), rows.select("sample_name", "label")


def gene_level(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    dels = g.deletions(view(spark, sf, "fx_poisson_calls"), view(spark, sf, "fx_ratio_calls"))
    curated = g.curated_exons(exons(spark, sf))
    return (
        g.gene_calls(curated, g.poisson_intervals(dels[0]), g.POISSON_FIELDS),
        g.gene_calls(curated, g.ratio_intervals(dels[1]), g.RATIO_FIELDS),
    )


def hi(spark: SparkSession, sf: str) -> DataFrame:
    return readers.parse_hi_scores(view(spark, sf, "fx_hi"))


def sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    return g.gene_sample_counts(g.calls_by_key(*gene_level(spark, sf)), view(spark, sf, "fx_genes"))


# ---- sources and sinks


@query
def targets_sorted(spark, sf):
    order = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("contig"), (-F.col("n_nationkey")).alias("ordinal")
    )
    bare = view(spark, sf, "fx_targets").select("contig", "start_bp", "end_bp")
    return readers.number_targets(bare, order)


@query
def counts_roundtrip(spark, sf):
    path = handover_path(spark, "counts")
    targets = view(spark, sf, "fx_targets")
    writers.write_counts(counted(spark, sf), targets, path)
    return readers.read_count_table(spark, path, targets)


@query
def counts_labelled(spark, sf):
    return writers.labelled_counts(counted(spark, sf), view(spark, sf, "fx_targets"))


@query
def alignments_read(spark, sf):
    path = handover_path(spark, "alignments")
    view(spark, sf, "fx_reads").write.parquet(path)
    reads = readers.read_alignments(spark, path)
    sums = [F.sum(c_).cast("long").alias(f"{c_}_sum") for c_ in ("pos", "qwidth", "mapq", "flag")]
    return reads.groupBy("sample_name", "contig").agg(F.count("*").alias("reads"), *sums)


def count_files(spark: SparkSession, sf: str) -> str:
    path = handover_path(spark, "count-files")
    writers.write_count_files(counted(spark, sf), view(spark, sf, "fx_targets"), path)
    return path


@query
def count_files_read(spark, sf):
    return readers.read_counts(spark, count_files(spark, sf), view(spark, sf, "fx_targets"))


@query
def count_files_reported(spark, sf):
    return readers.count_file_report(spark, count_files(spark, sf), view(spark, sf, "fx_targets"))


@query
def samples_discovered(spark, sf):
    return readers.discover_samples(spark, count_files(spark, sf), "S", "_exome_RC.csv.gz").select("sample_name")


@query
def manifest_read(spark, sf):
    path = handover_path(spark, "manifest")
    rows = view(spark, sf, "fx_manifest").withColumn("paired_reads_exclude", F.upper(F.col("paired_reads_exclude").cast("string")))
    rows.toDF("Sample Name", "SampleProjectName", "Paired reads.exclude").write.option("header", True).csv(path)
    return readers.read_manifest(spark, path)


@query
def gene_panel_read(spark, sf):
    path = handover_path(spark, "panel")
    view(spark, sf, "fx_panel").select(F.concat(F.lit(" "), "symbol", F.lit("  "))).write.text(path)
    return readers.read_gene_panel(spark, path)


@query
def gene_scores_read(spark, sf):
    path = handover_path(spark, "scores")
    rows = view(spark, sf, "fx_pli").select("gene", F.col("pli").alias("pLI"), F.col("prec").alias("pRec"), F.lit("NA").alias("pNull"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_gene_scores(spark, path)


def hi_scores_from_file(spark, sf):
    path = handover_path(spark, "hi")
    rows = view(spark, sf, "fx_hi").select(F.lit("chr1").alias("a"), F.lit(1).alias("b"), F.lit(2).alias("c"), "name_field")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_hi_scores(spark, path)


@query
def hi_scores_highest(spark, sf):
    """All scores of the file with their rank from the highest down."""
    found = hi_scores_from_file(spark, sf)
    return found.select("gene_name", "hi_score", F.rank().over(Window.orderBy(F.desc_nulls_last("hi_score"))).cast("long").alias("rank"))


@query
def hi_scores_read(spark, sf):
    """All scores of the file."""
    return hi_scores_from_file(spark, sf)


@query
def poisson_call_files(spark, sf):
    """Caller B's files as its reader takes them, the sample from the file's name."""
    path = handover_path(spark, "poisson-files")
    calls = view(spark, sf, "fx_poisson_calls").withColumns({"st_exon": F.lit(1), "ed_exon": F.lit(2), "mbic": F.lit(None).cast("double")})
    calls = calls.withColumn("length_kb", c.length_kb(F.col("st_bp"), F.col("ed_bp")))
    writers.write_poisson_calls(calls, path)
    return readers.read_calls(spark, path, "poisson").drop("st_exon", "ed_exon", "mbic")


@query
def ratio_call_files(spark, sf):
    path = handover_path(spark, "ratio-files")
    writers.write_ratio_calls(view(spark, sf, "fx_ratio_calls"), path)
    kept = ["sample_name", "chromosome", "type", "nexons", "start_bp", "end_bp", "bf", "reads_ratio", "common_cnv"]
    return readers.read_calls(spark, path, "ratio").select(*kept)


@query
def cluster_call_files(spark, sf):
    """Caller B's files of all clusters in one scan, the label from the file's name."""
    path = handover_path(spark, "cluster-files")
    calls = view(spark, sf, "fx_poisson_calls").join(view(spark, sf, "fx_clusters"), "sample_name")
    calls = calls.withColumns({"st_exon": F.lit(1), "ed_exon": F.lit(2), "mbic": F.lit(0.5), "length_kb": F.lit(1.5)})
    columns = ["sample", *writers.names(writers.schemas.POISSON_CALLS)[1:]]
    files = calls.withColumnRenamed("sample_name", "sample").withColumn("sample_name", F.concat(F.lit("cls"), F.col("label").cast("string")))
    writers.write_sample_files(files, path, "_1.tsv", columns, ["sample", "st_bp"])
    return readers.read_poisson_calls(spark, f"{path}/*.tsv").select("sample_name", "label", "chr", "st_bp", "ed_bp", "cnv", "lratio")


@query
def reference_intervals_read(spark, sf):
    path = handover_path(spark, "intervals")
    rows = view(spark, sf, "fx_common_cnvs").select("contig", "start_bp", "end_bp", "name")
    rows.write.option("sep", "\t").csv(path)
    return readers.read_reference_intervals(spark, path)


@query
def region_qc_written(spark, sf):
    path = handover_path(spark, "qc")
    writers.write_region_qc(region_qc(spark, sf), path)
    writers.write_region_qc(region_qc(spark, sf).limit(0), path)  # an existing table is left alone
    return spark.read.parquet(path)


@query
def gene_table_written(spark, sf):
    path = handover_path(spark, "gene-table")
    rows = gene_deletion_table(spark, sf)
    writers.write_gene_table(rows, path)
    return spark.read.csv(path, sep="\t", header=True, schema=rows.schema)


@query
def annotated_written(spark, sf):
    path = handover_path(spark, "annotated")
    rows = calls_with_genes(spark, sf)
    writers.write_annotated(rows, path)
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False).select(
        "sample_name", "contig", F.col("start_bp").cast("long"), F.col("end_bp").cast("long"), "copy_type", "copy_number", "gene_names", "gene_ids"
    )


@query
def annotated_written_in_order(spark, sf):
    """Rows of each file that come before one with a smaller start on the same contig; there are none."""
    path = handover_path(spark, "annotated")
    writers.write_annotated(calls_with_genes(spark, sf), path)
    rows = spark.read.csv(path, sep="\t", header=True).select(
        "contig", F.col("start_bp").cast("long").alias("start_bp"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("i")
    )
    along = Window.partitionBy("file", "contig").orderBy("i")
    wrong = F.lead("start_bp").over(along) < F.col("start_bp")
    return rows.withColumn("wrong", wrong).agg(F.count("*").alias("rows"), F.count_if("wrong").alias("out_of_order"))


@query
def sample_stats_written(spark, sf):
    path = handover_path(spark, "stats")
    rows = sample_stats(spark, sf)
    writers.write_sample_stats(rows, path)
    return spark.read.csv(path, sep="\t", header=True, schema=rows.schema, nullValue="NA")


@query
def sample_names_parsed(spark, sf):
    listing = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("file:/bams/run%201/WES_"), "c_name", F.lit("_dup.bam")).alias("path")
    )
    return listing.select("c_custkey", readers.name_from_path(F.col("path"), "_dup.bam", "WES_").alias("sample_name"))


@query
def gtf_attributes(spark, sf):
    def line(feature: str, attributes: list[tuple[str, str]]) -> Column:
        text = [F.concat(F.lit(f'{name} "'), F.col(column).cast("string"), F.lit('";')) for name, column in attributes]
        fields = ["contig", "source", F.lit(feature), F.col("start_bp").cast("string"), F.col("end_bp").cast("string")]
        return F.concat_ws("\t", *fields, F.lit("."), F.lit("+"), F.lit("."), F.concat_ws(" ", *text)).alias("value")

    gene = [("gene_id", "gene_id"), ("gene_name", "gene_name"), ("gene_biotype", "gene_biotype")]
    exon = [*gene, ("transcript_id", "transcript_id"), ("exon_number", "exon_number")]
    path = handover_path(spark, "gtf")
    genes = view(spark, sf, "fx_genes").withColumn("source", F.lit("havana"))
    exons(spark, sf).select(line("exon", exon)).unionByName(genes.select(line("gene", gene))).write.text(path)
    return readers.read_gtf(spark, path, "exon")


@query
def hi_scores_parsed(spark, sf):
    return hi(spark, sf)


@query
def canonical_flag(spark, sf):
    canonical = table(spark, sf, "supplier").select(
        F.concat(F.lit("ENST"), F.col("s_suppkey").cast("string")).alias("transcript_id")
    )
    return g.flag_canonical(exons(spark, sf), canonical).select("transcript_id", "gene_id", "is_canonical")


@query
def external_counts_joined(spark, sf):
    external = (
        table(spark, sf, "customer")
        .groupBy(F.concat(F.lit("GENE"), (F.col("c_custkey") % 300).cast("string")).alias("gene_name"))
        .agg(
            F.count_if(F.col("c_acctbal") < 0).alias("ext_sample_hom_cnt"),
            F.count_if(F.col("c_acctbal") >= 0).alias("ext_sample_het_cnt"),
        )
    )
    return g.add_external_counts(view(spark, sf, "fx_genes").select("gene_id", "gene_name"), external)


@query
def calls_per_sample(spark, sf):
    calls = view(spark, sf, "fx_poisson_calls").withColumn("label", (F.col("st_bp") % 2).cast("int"))
    return an.calls_by_sample(calls, view(spark, sf, "fx_clusters")).select(
        "sample_name", "label", "chr", "st_bp", "ed_bp", "cnv"
    )


@query
def clusters_exploded(spark, sf):
    path = handover_path(spark, "clusters")
    writers.write_clusters(points(spark, sf)[1], path)
    return readers.read_clusters(spark, path)


@query
def sample_stats(spark, sf):
    samples = view(spark, sf, "fx_manifest").select("sample_name").distinct()
    samples = samples.withColumn("bam_file", F.concat(F.lit("bams/"), "sample_name", F.lit(".bam")))
    labels = view(spark, sf, "fx_clusters").withColumn("likely", F.col("label"))
    coverage = cov.sample_coverage(counted(spark, sf))
    stats = an.sample_stats(samples, coverage, labels, view(spark, sf, "fx_poisson_calls"))
    return r6(stats, "mean_read_count")


@query
def counts_wide(spark, sf):
    return cov.counts_wide(counted(spark, sf))


@query
def settled_files(spark, sf):
    listing = table(spark, sf, "events").select("event_id", "ts")
    now = F.lit("2024-01-16 00:00:00").cast(dict(listing.dtypes)["ts"])
    return readers.settled_files(listing, now, modified="ts").select("event_id")


# ---- filters and expressions


@query
def usable_reads(spark, sf):
    return rd.usable_reads(view(spark, sf, "fx_reads")).groupBy("sample_name", "flag", "mapq").agg(
        F.count("*").alias("reads"), F.sum("pos").alias("pos_sum")
    )


@query
def usable_reads_single_end(spark, sf):
    all_reads = view(spark, sf, "fx_reads").groupBy("sample_name").agg(F.count("*").alias("all_reads"))
    kept = usable(spark, sf).groupBy("sample_name").agg(
        F.count("*").alias("kept_reads"), F.count_if(F.col("flag").bitwiseAND(64) == 64).alias("first_mates")
    )
    return all_reads.join(kept, "sample_name", "left")


@query
def overlap_counts(spark, sf):
    return counted(spark, sf)


@query
def overlap_counts_sweep(spark, sf):
    reads = rd.read_intervals(rd.min_mapq(usable(spark, sf)))
    return iv.count_overlaps_sweep(view(spark, sf, "fx_targets"), reads, view(spark, sf, "fx_reads"))


@query
def samples_passed(spark, sf):
    passed, _ = cov.split_by_coverage(counted(spark, sf), MIN_MEAN)
    return r6(cov.sample_coverage(passed), "mean_rc")


@query
def samples_failed(spark, sf):
    _, failed = cov.split_by_coverage(counted(spark, sf), MIN_MEAN)
    return r6(failed, "mean_rc")


@query
def region_qc(spark, sf):
    return cov.region_qc(counted(spark, sf), view(spark, sf, "fx_targets"), coverage=COVERAGE)


@query
def profiles(spark, sf):
    return r6(cov.scale_profiles(cut(counted(spark, sf))), "v")


@query
def profiles_zscored(spark, sf):
    return r6(zscores(spark, sf), "z")


@query
def library_size_factor(spark, sf):
    return r6(cov.library_size_factor(counted(spark, sf)), "size_factor")


@query
def calls_autosomal(spark, sf):
    calls = view(spark, sf, "fx_poisson_calls").withColumn(
        "chr", F.concat(F.lit("chr"), (F.col("st_bp") % 26).cast("string"))
    )
    return cov.autosomes(calls, "chr").select("sample_name", "chr", "st_bp", "ed_bp")


@query
def deletions(spark, sf):
    p, r = g.deletions(view(spark, sf, "fx_poisson_calls"), view(spark, sf, "fx_ratio_calls"))
    kept = ["sample_name", "contig", "start_bp", "end_bp"]
    return (
        g.poisson_intervals(p)
        .select(*kept, F.lit("poisson").alias("caller"))
        .unionByName(g.ratio_intervals(r).select(*kept, F.lit("ratio").alias("caller")))
    )


@query
def curated_exons(spark, sf):
    return g.curated_exons(exons(spark, sf))


@query
def active_samples(spark, sf):
    return g.active_samples(view(spark, sf, "fx_manifest"))


@query
def first_regions(spark, sf):
    return cov.first_regions(counted(spark, sf))


@query
def strip_chr(spark, sf):
    calls = view(spark, sf, "fx_poisson_calls")
    return calls.select(
        "sample_name",
        "st_bp",
        c.strip_chr(F.col("chr")).alias("contig"),
        c.strip_chr(F.concat(F.lit("alt_"), "chr", F.lit("_"), "chr")).alias("first_only"),
    )


@query
def call_fields(spark, sf):
    return ratio(spark, sf).select(
        "sample_name",
        c.region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp")).alias("call_id"),
        c.length_kb(F.col("start_bp"), F.col("end_bp")).alias("length_kb"),
        c.short_type(F.col("type")).alias("short_type"),
    )


@query
def call_labels(spark, sf):
    kept = ["sample_name", "contig", "start_bp", "end_bp", "label"]
    return an.pack_poisson(poisson(spark, sf)).select(*kept).unionByName(an.pack_ratio(ratio(spark, sf)).select(*kept))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return iv.union_intervals(an.pack_poisson(poisson(spark, sf)), an.pack_ratio(ratio(spark, sf)))


@query
def call_labels_unpacked(spark, sf):
    rows = an.unpack(segments(spark, sf), "label_a", an.POISSON_COLUMNS)
    return an.unpack(rows, "label_b", an.RATIO_COLUMNS).drop("label_a", "label_b")


@query
def contig_prefixed(spark, sf):
    prefix = c.contig_prefix("hg38")
    return view(spark, sf, "fx_targets").select(
        "region_id", F.concat(F.lit(prefix), "contig").alias("contig"), F.lit(c.genome_build("hg38")).alias("build")
    )


@query
def gc_percent(spark, sf):
    gc, acgt = c.sequence_gc(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", gc.alias("gc_count"), acgt.alias("acgt_count"))
    return r6(rows.withColumn("gc", F.col("gc_count") * 100 / F.nullif("acgt_count", F.lit(0))), "gc")


@query
def gc_percent_regions(spark, sf):
    """Texts as sequences in chunks of 1000 letters; targets of 700 letters, the last one shorter, tile every text."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("contig"), "doc_id", "text")
    size = F.length("text")
    chunks = texts.select("contig", "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 1000))).alias("i")).select(
        "contig",
        (F.col("i") * 1000 + 1).alias("start_bp"),
        F.col("text").substr((F.col("i") * 1000 + 1).cast("int"), F.lit(1000)).alias("seq"),
    )
    targets = texts.where(size > 0).select(
        "doc_id", "contig", size.alias("size"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 700))).alias("i")
    )
    targets = targets.select(
        (F.col("doc_id") * 1000 + F.col("i")).alias("region_id"),
        "contig",
        (F.col("i") * 700 + 1).alias("start_bp"),
        F.least(F.col("i") * 700 + 700, F.col("size")).alias("end_bp"),
    )
    return r6(iv.region_gc(targets, chunks), "gc")


@query
def mappability(spark, sf):
    track = view(spark, sf, "fx_common_cnvs").select(
        "contig", "start_bp", "end_bp", ((F.col("end_bp") - F.col("start_bp")) % 100 / 100).alias("score")
    )
    targets = view(spark, sf, "fx_targets").select("region_id", "contig", "start_bp", "end_bp")
    return r6(iv.weighted_mean_over(targets, track, "score", "mean_mapp"), "mean_mapp")


# ---- joins


@query
def exon_hits_poisson(spark, sf):
    dels, _ = g.deletions(view(spark, sf, "fx_poisson_calls"), view(spark, sf, "fx_ratio_calls"))
    hits = g.exon_hits(g.curated_exons(exons(spark, sf)), g.poisson_intervals(dels))
    return hits.select("sample_name", "call_id", "gene_id", "transcript_id", "exon_number", "lratio", "copy_no")


@query
def exon_hits_ratio(spark, sf):
    _, dels = g.deletions(view(spark, sf, "fx_poisson_calls"), view(spark, sf, "fx_ratio_calls"))
    hits = g.exon_hits(g.curated_exons(exons(spark, sf)), g.ratio_intervals(dels))
    return hits.select("sample_name", "call_id", "gene_id", "transcript_id", "exon_number", "bf", "reads_ratio")


@query
def calls_with_genes(spark, sf):
    return an.annotate_calls_with_genes(poisson(spark, sf), exons(spark, sf))


def keyed(calls: DataFrame) -> DataFrame:
    label = c.region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp"))
    return calls.select(F.concat_ws("/", "sample_name", label).alias("call_key"), "contig", "start_bp", "end_bp")


@query
def calls_common_variants(spark, sf):
    return iv.annotate_overlaps(keyed(ratio(spark, sf)), view(spark, sf, "fx_common_cnvs"), 0.5, "common_cnv")


@query
def calls_exon_names(spark, sf):
    named = exons(spark, sf).select(
        F.concat_ws("_", "gene_name", F.col("exon_number").cast("string")).alias("name"), "contig", "start_bp", "end_bp"
    )
    return iv.annotate_overlaps(keyed(ratio(spark, sf)), named, 0.0001, "exon_names")


@query
def targets_annotated(spark, sf):
    targets = view(spark, sf, "fx_targets")
    track = view(spark, sf, "fx_common_cnvs").select("contig", "start_bp", "end_bp", F.lit(0.5).alias("score"))
    bare = targets.select("region_id", "contig", "start_bp", "end_bp")
    mapp = iv.weighted_mean_over(bare, track, "score", "mapp")
    return cov.annotate_targets(bare, targets, mapp)


@query
def gene_calls_merged(spark, sf):
    return g.merge_callers(g.calls_by_key(*gene_level(spark, sf)), view(spark, sf, "fx_genes"))


@query
def gene_counts_scored(spark, sf):
    return g.add_gene_scores(sample_counts(spark, sf), view(spark, sf, "fx_pli"), hi(spark, sf))


@query
def gene_panel_flag(spark, sf):
    genes = view(spark, sf, "fx_genes").select("gene_id", "gene_name")
    return g.flag_in_panel(genes, view(spark, sf, "fx_panel"))


@query
def gene_deletion_table(spark, sf):
    return gene_table.gene_deletion_table(
        view(spark, sf, "fx_poisson_calls"),
        view(spark, sf, "fx_ratio_calls"),
        view(spark, sf, "fx_manifest"),
        exons(spark, sf),
        view(spark, sf, "fx_genes"),
        view(spark, sf, "fx_pli"),
        hi(spark, sf),
        view(spark, sf, "fx_panel"),
    )


@query
def gene_deletions_protein_coding(spark, sf):
    return g.protein_coding(gene_deletion_table(spark, sf))


@query
def calls_for_active_samples(spark, sf):
    return g.calls_for_samples(view(spark, sf, "fx_ratio_calls"), g.active_samples(view(spark, sf, "fx_manifest")))


@query
def unprocessed_samples(spark, sf):
    samples = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_name"))
    done = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sample_name"))
    return g.unprocessed(samples, done)


@query
def reference_counts(spark, sf):
    return rc.leave_one_out(labelled(spark, sf))


@query
def noise_distances(spark, sf):
    return r6(co.noise_distances(*points(spark, sf)), "distance")


@query
def calls_full_split(spark, sf):
    calls = keyed(poisson(spark, sf)).withColumnRenamed("call_key", "segment_id")
    return an.annotate_genes_full_split(calls, view(spark, sf, "fx_genes"))


# ---- aggregates, windows, sets


@query
def read_length(spark, sf):
    return rd.read_length(usable(spark, sf))


@query
def sample_coverage(spark, sf):
    return r6(cov.sample_coverage(counted(spark, sf)), "mean_rc")


@query
def gene_calls_poisson(spark, sf):
    return gene_level(spark, sf)[0]


@query
def gene_calls_ratio(spark, sf):
    return gene_level(spark, sf)[1]


@query
def gene_sample_counts(spark, sf):
    return sample_counts(spark, sf)


@query
def label_counts(spark, sf):
    return co.label_counts(points(spark, sf)[1])


@query
def noise_assigned(spark, sf):
    positions, labels = points(spark, sf)
    return r6(co.assign_noise(co.noise_distances(positions, labels), labels), "distance")


@query
def cluster_members(spark, sf):
    return writers.cluster_members(points(spark, sf)[1])


@query
def sample_correlation(spark, sf):
    found = rc.sample_correlation(cut(labelled(spark, sf)))
    return found.select(
        "label", "sample_name", F.concat_ws(",", "partners").alias("partners"), micros(F.col("corrs")).alias("corrs")
    )


@query
def union_intervals(spark, sf):
    return segments(spark, sf)


@query
def call_keys(spark, sf):
    return g.call_keys(*gene_level(spark, sf))


@query
def best_k(spark, sf):
    return r6(pc.best_k(pc.null_model_bic(k0(spark, sf))), "bic")


@query
def null_model_bic(spark, sf):
    return r6(pc.null_model_bic(k0(spark, sf)), "bic")


# ---- new samples into a cohort


def grown(spark: SparkSession, sf: str) -> cs.Cohort:
    """A cohort of all samples: two of them, one of each kit, join after the others."""
    counts = cut(labelled(spark, sf))
    late = F.col("sample_name").isin("S05", "S17")
    cohort = cs.create_cohort(spark, handover_path(spark, "cohort"), 8)
    cs.add_samples(cohort, counts.where(~late))
    cs.add_samples(cohort, counts.where(late))
    return cohort


@query
def grown_reference_counts(spark, sf):
    return cs.leave_one_out(grown(spark, sf))


@query
def grown_correlation(spark, sf):
    return r6(cs.sample_correlation(grown(spark, sf)), "r")


# ---- cohort modelling


@query
def profile_gram(spark, sf):
    found = co.profile_gram(cut(zscores(spark, sf)))
    return found.select("sample_name", F.concat_ws(",", "partners").alias("partners"), micros(F.col("dots")).alias("dots"))


@query
def profile_components(spark, sf):
    return r6(co.profile_components(cut(zscores(spark, sf))), "score")


@query
def sample_neighbours(spark, sf):
    return r6(co.sample_neighbours(cut(zscores(spark, sf)), NEIGHBOURS), "distance")


@query
def batch_samples(spark, sf):
    return co.batch_samples(co.sample_neighbours(cut(zscores(spark, sf)), NEIGHBOURS), MIN_CLUSTER)


def component_points(spark: SparkSession, sf: str) -> DataFrame:
    """Samples on the components of their profiles, as points."""
    scores = co.profile_components(cut(zscores(spark, sf)))
    return cut(scores.select("sample_name", F.col("component").alias("dim"), F.col("score").alias("v")))


@query
def density_tree(spark, sf):
    """The spanning tree of the samples' mutual reachability, in the order of its merges, with the sizes that it joins."""
    vectors = cut(de.sample_vectors(component_points(spark, sf)))
    cores = cut(de.core_distances(vectors, MIN_CLUSTER))
    edges = cut(de.spanning_tree(cores))
    merged = de.merges(edges, cores).select("rank", F.least("size_a", "size_b").alias("smaller"), F.greatest("size_a", "size_b").alias("larger"))
    return r6(de.ranked(edges).join(merged, "rank"), "weight")


@query
def density_groups(spark, sf):
    return de.density_groups(component_points(spark, sf), MIN_CLUSTER)


@query
def clusters_to_process(spark, sf):
    positions, labels = points(spark, sf)
    likely = co.assign_noise(co.noise_distances(positions, labels), labels)
    done = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sample_name"))
    return co.clusters_to_process(likely, done)


@query
def reference_rank(spark, sf):
    ranked = rc.reference_rank(rc.sample_correlation(cut(labelled(spark, sf))))
    return ranked.withColumn("refs", F.concat_ws(",", "refs"))


@query
def reference_prefix_sums(spark, sf):
    counts = cut(labelled(spark, sf))
    sums = rc.reference_prefix_sums(counts, rc.reference_rank(rc.sample_correlation(counts)))
    return r6(
        rc.scored_prefixes(sums)
        .withColumn("e", F.explode(F.arrays_zip("scores", "ref", "x2t")))
        .select("label", "sample_name", "e.scores.m", "e.scores.score", F.col("e.ref").cast("long").alias("ref_n"), "e.x2t"),
        "score",
        "x2t",
    )


@query
def select_references(spark, sf):
    chosen = rc.select_references(labelled(spark, sf))
    return r6(chosen.withColumn("refs", F.concat_ws(",", "refs")), "score")


@query
def state_likelihoods(spark, sf):
    found = rc.state_likelihoods(rc.leave_one_out(labelled(spark, sf)))
    return r6(found.drop("p"), "expected", *[f"ll_{s}" for s in rc.STATES])


@query
def state_likelihoods_overdispersed(spark, sf):
    """Beta-binomial log-likelihoods under given strengths, which differ from case to case."""
    with_refs = cut(rc.leave_one_out(labelled(spark, sf)))
    strength = (20 + 15 * F.substring("sample_name", 2, 2).cast("int")).cast("double").alias("strength")
    given = with_refs.select("label", "sample_name").distinct().select("label", "sample_name", strength)
    found = rc.state_likelihoods(with_refs, given)
    return r6(found.drop("p", "strength"), "expected", *[f"ll_{s}" for s in rc.STATES])


@query
def case_strengths(spark, sf):
    """How far the counts of each case are from a binomial, fitted on all regions."""
    return r6(ds.case_strengths(rc.leave_one_out(labelled(spark, sf))), "strength")


@query
def state_segments(spark, sf):
    found = rc.positioned(
        rc.state_likelihoods(rc.leave_one_out(labelled(spark, sf))), view(spark, sf, "fx_targets")
    ).withColumn("state", rc.most_likely_state())
    return r6(rc.state_segments(found, rc.SEGMENT_KEYS, ["expected", "observed"]), "expected")


@query
def call_read_ratio(spark, sf):
    counts = cut(labelled(spark, sf))
    with_refs = cut(rc.reference_totals(counts, rc.select_references(counts)))
    calls = rc.call_read_ratio(with_refs, view(spark, sf, "fx_targets"))
    return r6(calls, "bf", "reads_expected", "reads_ratio")


@query
def call_read_ratio_one_case(spark, sf):
    calls = pipeline.one_case(view(spark, sf, "fx_targets"), cut(labelled(spark, sf)), "S05")
    return r6(calls, "bf", "reads_expected", "reads_ratio")


@query
def expected_counts_k0(spark, sf):
    return r6(
        k0(spark, sf).select("label", "sample_name", "region_id", "region_effect", "gc_effect", "expected"),
        "region_effect",
        "gc_effect",
        "expected",
    )


@query
def expected_counts(spark, sf):
    return r6(pc.expected_counts(k0(spark, sf)).select("label", "sample_name", "region_id", "n", "k", "expected"), "expected")


@query
def poisson_factor_bic(spark, sf):
    """BIC of each number of latent factors, fitted to counts, per group and contig."""
    return r6(pc.latent_bic(pf.poisson_models(k0(spark, sf))), "bic")


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return pc.scan_windows(pc.chains(cut(k0(spark, sf))))


@query
def scan_windows(spark, sf):
    return r6(scanned(spark, sf).drop("reach_ord"), "norm_cov", "lratio")


@query
def best_scan_window(spark, sf):
    return r6(pc.best_scan_window(scanned(spark, sf)), "norm_cov", "lratio")


@query
def call_poisson_scan(spark, sf):
    calls = pc.call_poisson_scan(pc.chains(cut(pc.expected_counts(k0(spark, sf)))))
    return r6(calls, "norm_cov", "lratio", "mbic")


@query
def copy_number(spark, sf):
    return k0(spark, sf).select(
        "label", "sample_name", "region_id", pc.copy_number(F.col("n"), F.col("expected")).alias("copy_no")
    )


# ---- end to end


@query
def annotated_sample_calls(spark, sf):
    return an.annotate_sample_calls(poisson(spark, sf), ratio(spark, sf), view(spark, sf, "fx_genes"))


def chain(spark: SparkSession, sf: str, include_likely: bool) -> pipeline.CohortCalls:
    return pipeline.cohort_calls(
        view(spark, sf, "fx_targets"),
        view(spark, sf, "fx_reads"),
        min_mean_rc=4,
        min_cluster_size=MIN_CLUSTER,
        neighbours=NEIGHBOURS,
        coverage=COVERAGE,
        include_likely=include_likely,
    )


@query
def cohort_calls(spark, sf):
    """Noise samples are called along with the cluster nearest to them."""
    found = chain(spark, sf, include_likely=True)
    return pipeline.both_callers(found.ratio, found.poisson)


@query
def cohort_calls_clusters_only(spark, sf):
    found = chain(spark, sf, include_likely=False)
    return pipeline.both_callers(found.ratio, found.poisson)


@query
def reads_to_gene_table(spark, sf):
    """The whole way: reads, calls of both callers, deletions per gene over the cohort."""
    found = chain(spark, sf, include_likely=True)
    return gene_table.gene_deletion_table(
        found.poisson,
        found.ratio,
        view(spark, sf, "fx_manifest"),
        exons(spark, sf),
        view(spark, sf, "fx_genes"),
        view(spark, sf, "fx_pli"),
        hi(spark, sf),
        view(spark, sf, "fx_panel"),
    )
