"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alignment flag bits.
FLAG_UNMAPPED = 4
FLAG_FIRST_MATE = 64
FLAG_SECONDARY = 256
FLAG_QC_FAIL = 512
FLAG_DUPLICATE = 1024
FLAG_SUPPLEMENTARY = 2048
FLAG_UNUSABLE = FLAG_DUPLICATE + FLAG_QC_FAIL + FLAG_UNMAPPED

# Chromosomes the callers report on.
AUTOSOMES = [str(number) for number in range(1, 23)]

# Contig prefix and build name per assembly.
ASSEMBLIES = {"b37": ("", "GRCh37"), "hg38": ("chr", "GRCh38")}


def round6(value: Column) -> Column:
    """Six decimals, halves up; the same arithmetic in every SQL engine."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def region_label(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def strip_chr(contig: Column) -> Column:
    """Remove the first "chr" only."""
    return F.regexp_replace(contig, "^(.*?)chr", "$1")


def length_kb(start: Column, end: Column) -> Column:
    return (end - start) / 1000


def short_type(name: Column) -> Column:
    return F.substring(name, 1, 3)


def contig_prefix(assembly: str) -> str:
    return ASSEMBLIES[assembly][0]


def genome_build(assembly: str) -> str:
    return ASSEMBLIES[assembly][1]


def is_autosome(contig: Column) -> Column:
    return strip_chr(contig).isin(AUTOSOMES)


def sequence_gc(text: Column) -> tuple[Column, Column]:
    """Number of g/c and of a/c/g/t letters, in either case."""
    lowered = F.lower(text)
    gc = F.length(F.regexp_replace(lowered, "[^gc]", ""))
    acgt = F.length(F.regexp_replace(lowered, "[^acgt]", ""))
    return gc.cast("long"), acgt.cast("long")


def sorted_distinct(values: Column) -> Column:
    """Distinct values of a group, sorted, joined by commas; NULL for a group without values."""
    found = F.sort_array(F.collect_set(values))
    return F.when(F.size(found) > 0, F.concat_ws(",", found))


def name_from_path(path: Column, suffix: str, prefix: str = "") -> Column:
    """File name without folder, prefix and suffix."""
    pattern = f"([^/]*){re.escape(suffix)}$"
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(plain, pattern, 1)
    return F.regexp_replace(name, f"^{re.escape(prefix)}", "") if prefix else name
