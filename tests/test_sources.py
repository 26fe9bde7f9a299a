"""Readers and sinks on small files in the reference formats."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from copyloom.operators import annotate, coverage, genes, reads
from copyloom.sources import count_files, readers, writers


@pytest.fixture
def targets(spark):
    rows = [(0, "1", 10, 50), (1, "1", 100, 150), (2, "X", 5, 9)]
    return spark.createDataFrame(rows, "region_id long, contig string, start_bp long, end_bp long")


def write(path, text):
    opened = gzip.open if str(path).endswith(".gz") else open
    with opened(path, "wt") as f:
        f.write(text)


def test_targets_from_bed(spark, tmp_path):
    write(tmp_path / "t.bed", "#comment\nX\t5\t9\nchr10\t1\t2\nchr2\t30\t40\textra\nchr2\t7\t90\n")
    found = [(r.region_id, r.contig, r.start_bp) for r in readers.read_targets(spark, str(tmp_path / "t.bed")).orderBy("region_id").collect()]
    assert found == [(0, "chr2", 7), (1, "chr2", 30), (2, "chr10", 1), (3, "X", 5)]
    shifted = readers.read_targets(spark, str(tmp_path / "t.bed"), bed_zero_based=True)
    assert shifted.agg(F.min("start_bp")).first()[0] == 2


def test_count_files_and_what_is_wrong_with_them(spark, tmp_path, targets):
    write(tmp_path / "a+b 1_exome_RC.csv.gz", '"",a+b 1\n1:10-50,3\n1:100-150,0\nX:5-9,7\n')
    write(tmp_path / "S10_exome_RC.csv.gz", '"",S10\n1:10-50,1\n')
    write(tmp_path / "empty_exome_RC.csv.gz", '"",empty\n')
    (tmp_path / "torn_exome_RC.csv.gz").write_bytes(b"this is no gzip file at all")
    counts = readers.read_counts(spark, str(tmp_path), targets)
    assert {tuple(r) for r in counts.collect()} == {("a+b 1", 0, 3), ("a+b 1", 1, 0), ("a+b 1", 2, 7), ("S10", 0, 1)}
    assert {r[0] for r in readers.failed_count_files(spark, str(tmp_path), counts).collect()} == {"empty", "torn"}


def test_samples_are_found_and_settled(spark, tmp_path):
    for name in ("WES_S1_dup.bam", "WES_S2_dup.bam", "WES_S3.bai"):
        write(tmp_path / name, "x")
    os.utime(tmp_path / "WES_S2_dup.bam", (1_000_000, 1_000_000))
    found = readers.discover_samples(spark, str(tmp_path), "WES_", "_dup.bam")
    assert {r.sample_name for r in found.collect()} == {"S1", "S2"}
    assert [r.sample_name for r in readers.settled_files(found, F.current_timestamp()).collect()] == ["S2"]


def test_manifest_names_and_exclusion(spark, tmp_path):
    write(tmp_path / "m.csv", "Sample Name,Sample Project Name,PairedReads Exclude,x\nS1,p,FALSE,1\nS1,p,FALSE,2\nS2,p,TRUE,1\n")
    assert [tuple(r) for r in genes.active_samples(readers.read_manifest(spark, str(tmp_path / "m.csv"))).collect()] == [("S1", "p")]


def test_gtf_scores_and_panel(spark, tmp_path):
    write(
        tmp_path / "g.gtf",
        '#!build\n1\thavana\tgene\t1\t90\t.\t+\t.\tgene_id "G1"; gene_name "A1"; gene_biotype "protein_coding";\n'
        '1\thavana\texon\t1\t20\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; exon_number "2"; gene_name "A1"; ccds_id "C9";\n',
    )
    exon = readers.read_gtf(spark, str(tmp_path / "g.gtf"), "exon").first()
    assert (exon.gene_id, exon.exon_number, exon.ccds_id, exon.gene_biotype) == ("G1", 2, "C9", None)
    canonical = spark.createDataFrame([("T1",), ("T1",)], "transcript_id string")
    assert readers.read_gtf(spark, str(tmp_path / "g.gtf"), "exon", canonical).first().is_canonical == "YES"
    write(tmp_path / "pli.txt", "gene\tpLI\tlof_z\tmis_z\tpRec\tpNull\nA1\t0.9\t1\t2\t0.1\tNA\n")
    pli = readers.read_gene_scores(spark, str(tmp_path / "pli.txt"))
    write(tmp_path / "hi.bed", "track name=x\n1\t1\t2\tA1|0.25|10%\n1\t3\t4\tB2|0.75|1%\n")
    hi = readers.read_hi_scores(spark, str(tmp_path / "hi.bed"))
    assert [r.gene_name for r in hi.collect()] == ["B2", "A1"]
    write(tmp_path / "panel.txt", "A1\n\nZ9\n")
    counts = spark.createDataFrame([("G1", "A1", 3), ("G2", "B2", 1)], "gene_id string, gene_name string, sample_cnt long")
    scored = genes.flag_in_panel(genes.add_gene_scores(counts, pli, hi), readers.read_gene_panel(spark, str(tmp_path / "panel.txt")))
    rows = {r.gene_id: r for r in scored.collect()}
    assert rows["G1"].pLI == 0.9 and rows["G1"].pNull is None and rows["G1"].oe_lof_upper is None and rows["G1"].in_gene_panel
    assert rows["G2"].hi_score == 0.75 and rows["G2"].pLI is None and not rows["G2"].in_gene_panel


def test_duplicate_symbols_fan_out_unless_told_otherwise(spark):
    counts = spark.createDataFrame([("G1", "A1", 3)], "gene_id string, gene_name string, sample_cnt long")
    pli = spark.createDataFrame([("A1", 0.5)], "gene string, pLI double")
    hi = spark.createDataFrame([("A1", 0.2), ("A1", 0.4)], "gene_name string, hi_score double")
    assert genes.add_gene_scores(counts, pli, hi).count() == 2
    assert genes.add_gene_scores(counts, pli, hi, "max").first().hi_score == 0.4


def test_external_counts_by_position(spark, tmp_path):
    write(tmp_path / "e.tsv", "g\tx\ty\nA1\t2\t5\n")
    row = readers.read_external_counts(spark, str(tmp_path / "e.tsv"), "gnomad_").first()
    assert row.asDict() == {"gene_name": "A1", "gnomad_sample_hom_cnt": 2, "gnomad_sample_het_cnt": 5}


def test_call_files(spark, tmp_path):
    header = "sample_name\tchr\tcnv\tst_bp\ted_bp\tlength_kb\tst_exon\ted_exon\traw_cov\tnorm_cov\tcopy_no\tlratio\tmBIC\n"
    line = "S1\tchr1\tdel\t10\t90\t0.08\t1\t2\t5\t11.5\t1\t8.5\t3\n"
    write(tmp_path / "cls0_CODEX2_chr1.tsv", header + line + line.replace("S1", "S10"))
    write(tmp_path / "cls-1_CODEX2_chr2.tsv", header + line)
    calls = readers.read_poisson_calls(spark, str(tmp_path / "cls*_CODEX2_chr*.tsv"))
    labels = spark.createDataFrame([(0, "S1")], "label int, sample_name string")
    kept = annotate.calls_by_sample(calls, labels).collect()
    assert [(r.label, r.sample_name) for r in kept] == [(0, "S1")]
    write(tmp_path / "S1_CODEX2.tsv", header + line)
    write(tmp_path / "S2_CODEX2.tsv", header)
    ratio = "start.p\tend.p\ttype\tnexons\tstart\tend\tchromosome\tid\tBF\treads.expected\treads.observed\treads.ratio\tConrad.hg19\texons.hg19\n"
    write(tmp_path / "S1_ExomeDepth.tsv", ratio + "1\t2\tdeletion\t2\t10\t90\t1\tchr1:10-90\t8.1\t100\t52\t0.52\tNA\tE1\n")
    assert readers.read_calls(spark, str(tmp_path), "poisson").where("sample_name = 'S1'").first().mbic == 3
    row = readers.read_calls(spark, str(tmp_path), "ratio").first()
    assert (row.sample_name, row.type, row.bf, row.common_cnv, row.exon_names) == ("S1", "deletion", 8.1, None, "E1")
    assert readers.read_calls(spark, str(tmp_path), "poisson").where("sample_name = 'S2'").count() == 0


def test_sinks(spark, tmp_path, targets):
    counts = spark.createDataFrame([("007", 0, 3), ("007", 1, 0), ("S2", 2, 9)], "sample_name string, region_id long, n long")
    writers.write_counts(counts, targets, str(tmp_path / "counts"))
    assert sorted(map(tuple, readers.read_count_table(spark, str(tmp_path / "counts"), targets).collect())) == sorted(map(tuple, counts.collect()))
    qc = spark.range(3)
    writers.write_region_qc(qc, str(tmp_path / "qc"))
    writers.write_region_qc(spark.range(9), str(tmp_path / "qc"))
    assert spark.read.parquet(str(tmp_path / "qc")).count() == 3
    labels = spark.createDataFrame([(0, "b"), (0, "a"), (-1, "c")], "label int, sample_name string")
    writers.write_clusters(labels, str(tmp_path / "clusters"))
    assert sorted(map(tuple, readers.read_clusters(spark, str(tmp_path / "clusters")).collect())) == [(-1, "c"), (0, "a"), (0, "b")]
    table = spark.createDataFrame([("x", None, 1.5)], "call_id string, hi_score double, pLI double")
    writers.write_gene_table(table, str(tmp_path / "table"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "table")).collect()}
    assert lines == {"call_id\thi_score\tpLI", "x\t\t1.5"}
    calls = spark.createDataFrame([("S1", "1", 9, 10), ("S1", "1", 2, 3)], "sample_name string, contig string, start_bp long, end_bp long")
    writers.write_annotated(calls, str(tmp_path / "annotated"))
    assert [r.value for r in spark.read.text(str(tmp_path / "annotated/sample_name=S1")).collect()] == ["contig\tstart_bp\tend_bp", "1\t2\t3", "1\t9\t10"]


def test_sample_stats_keep_failed_and_callless_samples(spark):
    samples = spark.createDataFrame([("a", "a.bam"), ("b", "b.bam"), ("c", "c.bam")], "sample_name string, bam_file string")
    cov = spark.createDataFrame([("a", 30.0), ("b", 2.0), ("c", 9.0)], "sample_name string, mean_rc double")
    labels = spark.createDataFrame([("a", 0, 0), ("c", -1, 0)], "sample_name string, label int, likely int")
    calls = spark.createDataFrame([("a",), ("a",)], "sample_name string")
    rows = {r.sample_name: tuple(r)[2:] for r in annotate.sample_stats(samples, cov, labels, calls).collect()}
    assert rows == {"a": (30.0, 0, 0, 2), "b": (2.0, None, None, None), "c": (9.0, -1, 0, 0)}


def test_coverage_split_is_strict_and_reports_empty_samples(spark):
    counts = spark.createDataFrame([("a", 0, 20), ("b", 0, 21), ("c", 0, None)], "sample_name string, region_id long, n long")
    passed, failed = coverage.split_by_coverage(counts, 20)
    assert [r.sample_name for r in passed.collect()] == ["b"] and {r.sample_name for r in failed.collect()} == {"a", "c"}
    assert coverage.first_regions(spark.range(10).withColumnRenamed("id", "region_id"), 4).count() == 4


def test_single_end_samples_and_supplementary_reads(spark):
    rows = [("p", 65), ("p", 129), ("p", 65 + 1024), ("p", 65 + 2048), ("s", 0), ("s", 4), ("u", 64 + 4), ("u", 0)]
    df = spark.createDataFrame(rows, "sample_name string, flag int")
    assert sorted(map(tuple, reads.usable_reads(df).collect())) == [("p", 65), ("p", 65 + 2048), ("s", 0), ("u", 0)]
    assert reads.usable_reads(df, primary_only=True).where("sample_name = 'p'").count() == 1


def test_merged_callers_equal_a_full_join(spark):
    p = spark.createDataFrame(
        [("s", "g", "c1", 1.0, 0), ("s", "g", "c1", 1.0, 0), ("s", "g", "c1", 2.0, 1), ("s", "g", "c2", 3.0, 1)],
        "sample_name string, gene_id string, call_id string, codex_lratio double, codex_copy_number int",
    )
    r = spark.createDataFrame(
        [("s", "g", "c1", 5.0, 0.5), ("t", "g", "c3", 6.0, 0.4)],
        "sample_name string, gene_id string, call_id string, exomedepth_bf double, exomedepth_ratio double",
    )
    info = spark.createDataFrame([("g", "N", "b")], "gene_id string, gene_name string, gene_biotype string")
    found = genes.merge_callers(genes.calls_by_key(p, r), info)
    expected = p.distinct().join(r, genes.CALL_KEY, "full").join(info, "gene_id").select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.count() == 4
    assert genes.gene_sample_counts(genes.calls_by_key(p, r), info).first().sample_cnt == 2


def test_torn_count_files_are_reported(spark, tmp_path):
    targets = spark.createDataFrame([(i, "1", 10 * i + 1, 10 * i + 9) for i in range(20_000)], "region_id long, contig string, start_bp long, end_bp long")
    lines = "region,x\n" + "".join(f"1:{10 * i + 1}-{10 * i + 9},{i}\n" for i in range(20_000))
    packed = gzip.compress(lines.encode())
    (tmp_path / "whole_exome_RC.csv.gz").write_bytes(packed)
    (tmp_path / "torn_exome_RC.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "other_exome_RC.csv.gz").write_bytes(gzip.compress(lines.replace("1:1-9", "2:1-9").encode()))
    (tmp_path / "empty_exome_RC.csv.gz").write_bytes(gzip.compress(b"region,x\n"))
    report = {r.sample_name: r for r in readers.count_file_report(spark, str(tmp_path), targets).collect()}
    assert {s: r.complete for s, r in report.items()} == {"whole": True, "torn": False, "other": False, "empty": False}
    assert 0 < report["torn"].rows < 20_000 and report["other"].matched == 19_999 and report["empty"].rows == 0


def test_sample_files_hold_one_sample_each_in_order(spark, tmp_path):
    rows = [(f"S{s}", "1", i * 7 % 100, None if i % 9 == 0 else i) for s in range(5) for i in range(100)]
    frame = spark.createDataFrame(rows, "sample_name string, contig string, start_bp long, n long").repartition(7)
    done = writers.write_sample_files(frame, str(tmp_path / "out"), ".tsv", ["contig", "start_bp", "n"], ["start_bp"])
    assert {(r.sample_name, r["rows"]) for r in done.collect()} == {(f"S{s}", 100) for s in range(5)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"S{s}.tsv" for s in range(5)]
    lines = (tmp_path / "out" / "S3.tsv").read_text().splitlines()
    assert lines[0] == "contig\tstart_bp\tn" and [int(x.split("\t")[1]) for x in lines[1:]] == list(range(100))
    assert sum(x.endswith("NA") for x in lines) == 12


def test_rows_without_a_sample_are_refused(spark, tmp_path):
    frame = spark.createDataFrame([("S1", 1), (None, 2)], "sample_name string, n long")
    with pytest.raises(Exception, match="belong to no file"):
        writers.write_sample_files(frame, str(tmp_path / "refused"), ".tsv", ["n"], ["n"]).collect()


def test_a_torn_file_gives_no_rows_and_is_listed_from_one_scan(spark, tmp_path, targets):
    text = "region,x\n1:10-50,3\n1:100-150,0\nX:5-9,7\n"
    packed = gzip.compress(text.encode())
    for name, data in {
        "whole": packed,
        "parts": gzip.compress(text[:30].encode()) + gzip.compress(text[30:].encode()) + b"\0" * 8,
        "torn": packed[:-6],
        "tail": packed + b"more",
        "nothing": b"",
        "void": gzip.compress(b""),
        "words": gzip.compress(text.replace(",7", ",seven").encode()),
        "missing": gzip.compress(text.replace(",7", ",").encode()),
        "three": gzip.compress(text.replace(",7", ",7,7").encode()),
        "twice": gzip.compress(text.replace("X:5-9", "1:10-50").encode()),
        "quoted": gzip.compress(text.replace("X:5-9", '"X:5-9"').rstrip("\n").encode()),
    }.items():
        (tmp_path / f"{name}_exome_RC.csv.gz").write_bytes(data)
    found = count_files.load_count_files(spark, str(tmp_path), targets)
    assert {r.sample_name for r in found.counts.collect()} == {"whole", "parts", "twice", "quoted"}
    report = {r.sample_name: r for r in found.report.collect()}
    assert len(report) == 11 and {s for s, r in report.items() if r.complete} == {"whole", "parts", "quoted"}
    assert {s for s, r in report.items() if r.fault is None} == {"whole", "parts", "twice", "quoted"}
    assert report["torn"].fault == "breaks off before its end mark" and report["nothing"].fault == "is empty"
    assert report["twice"].rows == report["twice"].matched == 3 and report["void"].fault == "holds no header"


def test_count_files_are_unpacked_in_pieces():
    text = b"region,x\n" + b"".join(b"1:%d-%d,%d\n" % (i, i + 5, i) for i in range(1000))
    packed = gzip.compress(text)
    for piece in (1, 7, 100, 1 << 20):
        assert b"".join(count_files.unpacked(packed, piece)) == text
    tables = list(count_files.file_tables(packed, 100))
    assert len(tables) > 50 and [n for t in tables for n in t["n"].to_pylist()] == list(range(1000))


def test_a_large_sample_is_sorted_in_ranges(spark, tmp_path, monkeypatch):
    """A file of several pieces is whole and in order, under one header; no task sorts all of it."""
    monkeypatch.setattr(writers, "PIECE_ROWS", 100)
    frame = spark.range(1000).selectExpr("if(id % 10 = 0, 'a', 'b') sample_name", "cast(999 - id as int) start_bp", "if(id = 7, null, id) n")
    for suffix, sep in ((".tsv", "\t"), (".csv.gz", ",")):
        done = writers.write_sample_files(frame, str(tmp_path / f"out{suffix}"), suffix, ["start_bp", "n"], ["start_bp"], sep)
        assert {r["sample_name"]: r["rows"] for r in done.collect()} == {"a": 100, "b": 900}
        lines = [r.value for r in spark.read.text(str(tmp_path / f"out{suffix}" / f"b{suffix}")).collect()]
        assert lines[0] == f"start_bp{sep}n" and f"992{sep}NA" in lines
        starts = [int(line.split(sep)[0]) for line in lines[1:]]
        assert starts == sorted(starts) and starts == [i for i in range(1000) if (999 - i) % 10]
        assert sorted(p.name for p in (tmp_path / f"out{suffix}").iterdir() if not p.name.startswith(".")) == [f"a{suffix}", f"b{suffix}"]


def test_gene_table_repeats_take_little_room(spark, tmp_path):
    """Rows that differ in one score only take a few bytes each."""
    rows = spark.range(20000).selectExpr("concat('1:1000-2000/', id div 500) call_id", "'a gene that a call touches' gene_name", "(id % 500) / 1000 hi_score")
    writers.write_gene_table(rows.coalesce(1), str(tmp_path / "table"))
    assert sum(p.stat().st_size for p in (tmp_path / "table").glob("part-*")) < 20000 * 10
    assert spark.read.csv(str(tmp_path / "table"), sep="\t", header=True, schema=rows.schema).exceptAll(rows).isEmpty()
