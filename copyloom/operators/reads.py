"""Choice of usable reads and their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.functions.columns import (
    FLAG_FIRST_MATE,
    FLAG_SECONDARY,
    FLAG_SUPPLEMENTARY,
    FLAG_UNUSABLE,
)
from copyloom.session import small_table


def passes(primary_only: bool) -> Column:
    unwanted = FLAG_UNUSABLE + (FLAG_SECONDARY + FLAG_SUPPLEMENTARY if primary_only else 0)
    return F.col("flag").bitwiseAND(unwanted) == 0


def first_mate() -> Column:
    return F.col("flag").bitwiseAND(FLAG_FIRST_MATE) == FLAG_FIRST_MATE


def read_samples(reads: DataFrame, primary_only: bool = False) -> DataFrame:
    """Every sample, and whether it has a usable first mate; one pass over two columns."""
    return reads.groupBy("sample_name").agg(F.max(passes(primary_only) & first_mate()).alias("paired"))


def usable_reads(reads: DataFrame, primary_only: bool = False, samples: DataFrame | None = None) -> DataFrame:
    """Reads that are mapped, passed QC, are no duplicates, and are first mates.

    A sample without any first mate is single-end and keeps all its reads. The samples (`read_samples`) are a
    small table that goes to the reads; the reads themselves are not shuffled.
    """
    samples = small_table(read_samples(reads, primary_only)) if samples is None else samples
    return (
        reads.where(passes(primary_only))
        .join(samples.select("sample_name", "paired"), "sample_name")
        .where(~F.col("paired") | first_mate())
        .select(*reads.columns)
    )


def min_mapq(reads: DataFrame, threshold: int = 20) -> DataFrame:
    return reads.where(F.col("mapq") >= threshold)


def read_intervals(reads: DataFrame) -> DataFrame:
    """Closed interval of a read from its start and query width; clips and gaps are not considered."""
    return reads.withColumns({"start_bp": F.col("pos"), "end_bp": F.col("pos") + F.col("qwidth") - 1})


def read_length(reads: DataFrame) -> DataFrame:
    """Mean query width per sample over the usable reads, before the mapping quality filter; ties to even."""
    return reads.groupBy("sample_name").agg(F.bround(F.avg("qwidth")).alias("read_length"))
