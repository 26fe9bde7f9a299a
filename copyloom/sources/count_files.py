"""Count files read whole: packed text with a header and one line per region, one file per sample.

A file counts only if it is whole: the packed stream ends with its end mark, and every line is a label and a whole number.
Its rows are known to be good only when its last byte has been read, so one scan writes the rows of all files with a closing row for
each, and everything else follows from that table. Files come through Spark's binary reader, so any file system will do;
a task unpacks a file piece by piece and holds the packed file and one piece.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom import schemas
from copyloom.functions.columns import name_from_path, region_label
from copyloom.session import cut

# Unpacked bytes taken at a time.
PIECE = 1 << 20

ROW = pa.schema([("path", pa.string()), ("region", pa.string()), ("n", pa.int64()), ("closing", pa.bool_()), ("fault", pa.string())])


class CountFiles(NamedTuple):
    """Counts of the whole files, and one row per file that says what it holds and what is wrong with it."""

    counts: DataFrame
    report: DataFrame


class Fault(Exception):
    """What is wrong with a file."""


def unpacked(packed: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """The text of a packed file in pieces; packed parts may follow each other. Raises if it breaks off."""
    rest = packed
    while True:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            try:
                out = stream.decompress(rest, piece)
            except zlib.error as error:
                raise Fault("not a packed file, or damaged") from error
            rest = stream.unconsumed_tail
            if out:
                yield out
            elif not stream.eof:
                raise Fault("breaks off before its end mark")
        rest = stream.unused_data.lstrip(b"\0")
        if not rest:
            return


def parsed(lines: bytes) -> pa.Table:
    """Labels and counts of whole lines."""
    names = ["region", "n"]
    try:
        table = csv.read_csv(
            io.BytesIO(lines),
            read_options=csv.ReadOptions(column_names=names, use_threads=False),
            convert_options=csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
        )
        return table.set_column(1, "n", table["n"].cast(pa.int64()))
    except pa.ArrowInvalid as error:
        raise Fault("holds lines that are not a label and a whole number") from error


def file_tables(packed: bytes, piece: int = PIECE) -> Iterator[pa.Table]:
    """The lines behind the header, piece by piece. Whole lines that come before a fault are given before it is raised."""
    kept, header = b"", True
    for text in unpacked(packed, piece):
        kept += text
        at = kept.rfind(b"\n") + 1
        lines, kept = kept[:at], kept[at:]
        if header and lines:
            lines, header = lines[lines.index(b"\n") + 1 :], False
        if lines.strip():
            yield parsed(lines)
    if header and not kept.strip():
        raise Fault("holds no header")
    if not header and kept.strip():
        yield parsed(kept)


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of each file, then its closing row."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            name, fault = path.as_py(), None
            try:
                for table in file_tables(content.as_py()):
                    rows = {
                        "path": pa.array([name] * table.num_rows, pa.string()),
                        "region": table["region"].combine_chunks(),
                        "n": table["n"].combine_chunks(),
                        "closing": pa.array([False] * table.num_rows),
                        "fault": pa.nulls(table.num_rows, pa.string()),
                    }
                    yield pa.RecordBatch.from_arrays(list(rows.values()), schema=ROW)
            except Fault as error:
                fault = str(error)
            yield pa.RecordBatch.from_pylist([{"path": name, "closing": True, "fault": fault}], schema=ROW)


def listed_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The sample of every count file of a folder, also of files without a byte, which Spark's scans leave out."""
    paths = spark.read.format("binaryFile").load(f"{folder}/*{schemas.COUNT_SUFFIX}").inputFiles()
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    return listing.select(name_from_path(F.col("path"), schemas.COUNT_SUFFIX).alias("sample_name"))


def load_count_files(spark: SparkSession, folder: str, targets: DataFrame) -> CountFiles:
    """Counts and report of all count files of a folder, in one scan of the files.

    The sample is named by the file. Counts come from whole files only and are joined with the targets by label; lines whose label is no
    target are counted in the report and go. The report has, per file: its lines, those whose label is among the targets, the number of
    targets, whether it is whole and covers every target exactly once, and its fault. For a file with a fault, lines are those read before it.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/*{schemas.COUNT_SUFFIX}").select("path", "content")
    named = files.mapInArrow(read_files, "path string, region string, n bigint, closing boolean, fault string")
    scanned = cut(named.select(name_from_path(F.col("path"), schemas.COUNT_SUFFIX).alias("sample_name"), "region", "n", "closing", "fault"))
    read = scanned.where("closing").select("sample_name", "fault")
    unread = listed_samples(spark, folder).join(read, "sample_name", "left_anti")
    ends = read.unionByName(unread.withColumn("fault", F.lit("is empty")))
    rows = scanned.where("NOT closing").select("sample_name", "region", "n")

    label = region_label(F.col("contig"), F.col("start_bp"), F.col("end_bp")).alias("region")
    labels = targets.select(label, "region_id")
    whole = read.where("fault IS NULL").select("sample_name")
    counts = rows.join(whole, "sample_name", "left_semi").join(labels, "region").select("sample_name", "region_id", "n")

    distinct = labels.select("region").distinct()
    wanted = distinct.agg(F.count("*").alias("targets"))
    found = (
        rows.groupBy("sample_name", "region")
        .agg(F.count("*").alias("rows"))
        .join(distinct.withColumn("known", F.lit(True)), "region", "left")
        .groupBy("sample_name")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(F.when(F.col("known"), F.col("rows")).otherwise(0)).alias("matched"),
            F.count("known").alias("covered"),
        )
    )
    report = ends.join(found, "sample_name", "left").crossJoin(F.broadcast(wanted))  # one row
    report = report.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rows", "matched", "covered")})
    once = (F.col("rows") == F.col("targets")) & (F.col("covered") == F.col("targets"))
    complete = F.col("fault").isNull() & once
    return CountFiles(counts, report.select("sample_name", "rows", "matched", "targets", complete.alias("complete"), "fault"))
