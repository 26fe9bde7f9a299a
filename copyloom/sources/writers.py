"""Sinks. Every write is distributed; per-sample files come from one shuffle on the sample."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom import schemas
from copyloom.functions.columns import region_label
from copyloom.session import cut, handover_path

# Parts a sample's counts are written in.
SAMPLE_PARTS = 4

# Rows of a piece of a sample's file, and most tasks that string pieces together.
PIECE_ROWS = 200_000
MOST_FILE_TASKS = 200


def labelled_counts(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts under the region label contig:start-end."""
    label = region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp")).alias("region")
    return counts.join(targets.select("region_id", label), "region_id").select("sample_name", "region", "n")


def write_counts(counts: DataFrame, targets: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Count table partitioned by sample, a few files each."""
    rows = labelled_counts(counts, targets)
    part = F.pmod(F.hash("region"), F.lit(SAMPLE_PARTS))
    writer = rows.repartition("sample_name", part).sortWithinPartitions("sample_name").write.partitionBy("sample_name")
    if fmt == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        writer.parquet(path)


def write_sample_files(rows: DataFrame, folder: str, suffix: str, columns: list[str], order: list[str], sep: str = "\t") -> DataFrame:
    """One text file per sample, `<sample><suffix>`, with a header and NA for NULL; packed if the name ends so.

    However large a sample is, no task sorts it whole: ranges of about `PIECE_ROWS` rows in order of sample and place are written
    as pieces, which are then strung together byte by byte. A task holds one range, or one piece of a megabyte. Files are
    written under another name and then moved, so that a repeated attempt replaces a file rather than adding to it. A row
    without a sample name has no file to go to and is an error. Returns sample_name and rows.
    """
    spark = rows.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    scratch = handover_path(spark, "pieces")
    store, pieces_root = fs.FileSystem.from_uri(scratch)
    store.create_dir(pieces_root, recursive=True)
    packed = suffix.endswith(".gz")

    def encoded(part: pd.DataFrame, header: bool) -> bytes:
        text = io.StringIO()
        part.to_csv(text, sep=sep, index=False, header=header, na_rep="NA")
        data = text.getvalue().encode()
        return gzip.compress(data) if packed else data

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, root = fs.FileSystem.from_uri(scratch)
        context = TaskContext.get()
        sample, out, piece, count, done = None, None, "", 0, 0

        def close() -> pd.DataFrame:
            out.close()
            return pd.DataFrame({"sample_name": [sample], "place": [context.partitionId()], "piece": [piece], "rows": [count]})

        for batch in batches:
            if batch["sample_name"].isna().any():
                raise ValueError("rows without a sample name belong to no file")
            for name, part in batch.groupby("sample_name", sort=False):
                if name != sample:
                    if out is not None:
                        yield close()
                    sample, count, done = name, 0, done + 1
                    piece = f"{context.taskAttemptId()}-{done}"
                    out = target.open_output_stream(f"{root}/{piece}", compression=None)
                out.write(encoded(part[columns], False))
                count += len(part)
        if out is not None:
            yield close()

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, pieces = fs.FileSystem.from_uri(scratch)
        target, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        sample, out, count = None, None, 0

        def close() -> pd.DataFrame:
            out.close()
            target.move(f"{root}/_{attempt}_{sample}{suffix}", f"{root}/{sample}{suffix}")
            return pd.DataFrame({"sample_name": [sample], "rows": [count]})

        for batch in batches:
            for row in batch.itertuples():
                if row.sample_name != sample:
                    if out is not None:
                        yield close()
                    sample, count = row.sample_name, 0
                    out = target.open_output_stream(f"{root}/_{attempt}_{sample}{suffix}", compression=None)
                    out.write(encoded(pd.DataFrame(columns=columns), True))
                with source.open_input_stream(f"{pieces}/{row.piece}", compression=None) as data:
                    while chunk := data.read(1 << 20):
                        out.write(chunk)
                count += row.rows
        if out is not None:
            yield close()

    # Numbers as text, so that NULL does not turn whole numbers into fractions.
    text = [F.col(c).cast("string").alias(c) for c in columns if c != "sample_name"]
    place = F.struct(*order, F.xxhash64(*columns)).alias("_place")
    kept = cut(rows.select("sample_name", place, *text))
    ranges = max(1, -(-kept.count() // PIECE_ROWS))
    spread = kept.repartitionByRange(ranges, "sample_name", "_place").sortWithinPartitions("sample_name", "_place").drop("_place")
    written = cut(spread.mapInPandas(write, "sample_name string, place int, piece string, rows long"))
    # A row per piece says nothing of its bytes: tasks by number of pieces.
    tasks = max(1, min(written.count(), MOST_FILE_TASKS))
    joined = cut(written.repartition(tasks, "sample_name").sortWithinPartitions("sample_name", "place").mapInPandas(join, "sample_name string, rows long"))
    store.delete_dir(pieces_root)
    return joined


def write_count_files(counts: DataFrame, targets: DataFrame, folder: str) -> DataFrame:
    """Count files per sample as `read_counts` takes them."""
    places = targets.select("region_id", "contig", "start_bp")
    rows = labelled_counts(counts, targets).join(
        targets.select(region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp")).alias("region"), "region_id"), "region"
    )
    rows = rows.join(places, "region_id")
    return write_sample_files(rows, folder, schemas.COUNT_SUFFIX, ["region", "n"], ["contig", "start_bp"], ",")


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def write_poisson_calls(calls: DataFrame, folder: str) -> DataFrame:
    """Caller B's table per sample as `read_calls` takes it."""
    return write_sample_files(calls, folder, schemas.POISSON_SUFFIX, names(schemas.POISSON_CALLS), ["chr", "st_bp", "ed_bp"])


def write_ratio_calls(calls: DataFrame, folder: str) -> DataFrame:
    """Caller A's table per sample as `read_calls` takes it."""
    columns = names(schemas.RATIO_CALLS)
    whole = calls.withColumns({c: F.lit(None).cast("string") for c in columns if c not in calls.columns})
    return write_sample_files(whole, folder, schemas.RATIO_SUFFIX, columns, ["chromosome", "start_bp", "end_bp"])


def write_region_qc(qc: DataFrame, path: str) -> None:
    """Written once; an existing table is left alone."""
    qc.write.mode("ignore").parquet(path)


def write_gene_table(table: DataFrame, path: str) -> None:
    """Cohort table as packed TSV with a header; NULL as an empty field.

    Rows of a call and gene differ in one score only and lie together, so that they take a few bytes each once packed.
    """
    table.write.option("compression", "gzip").option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_annotated(calls: DataFrame, path: str) -> None:
    """Annotated calls, one folder per sample, sorted by contig, start, end; a large sample gets several files."""
    (
        calls.repartition("sample_name", "contig")
        .sortWithinPartitions("sample_name", "contig", "start_bp", "end_bp")
        .write.partitionBy("sample_name")
        .option("sep", "\t")
        .option("header", True)
        .option("nullValue", "NA")
        .csv(path)
    )


def cluster_members(labels: DataFrame) -> DataFrame:
    """One row per label with its members, sorted and joined by commas."""
    return labels.groupBy("label").agg(
        F.concat_ws(",", F.sort_array(F.collect_list("sample_name"))).alias("members")
    )


def write_clusters(labels: DataFrame, path: str) -> None:
    cluster_members(labels).select(F.col("label").cast("string"), "members").write.option("sep", "\t").csv(path)


def write_sample_stats(stats: DataFrame, path: str) -> None:
    stats.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
