"""A cohort kept as tables that grow by batches of samples, so that new samples need no new run over the old ones.

Counts and region totals are bucketed by (label, region): joins and sums by region read them where they lie. What is kept of
a batch adds up: totals per region, sums per sample, and the products of its samples with all samples so far. A batch becomes visible
with its row in the table of batches, which is written last; what a broken run left behind is never read.

Every sample must have a row for every region of its label, zeros included, as counting gives it; a batch that does not is refused, as
are samples that are in already, repeated rows, a sample with two labels, and NULLs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.operators.numbering import dense_numbers
from copyloom.session import broadcast_if_small, cut, has_at_most

SCHEMAS = {
    "counts": "batch STRING, label INT, region_id BIGINT, sample_id BIGINT, n BIGINT",
    "totals": "batch STRING, label INT, region_id BIGINT, samples BIGINT, total BIGINT",
    "samples": "batch STRING, label INT, sample_name STRING, sum_n BIGINT, sum_squares BIGINT, regions BIGINT, sample_id BIGINT",
    "products": "batch STRING, label INT, a BIGINT, b BIGINT, dot DOUBLE, mirrored BOOLEAN",
    "batches": "batch STRING",
}
BUCKETED = ("counts", "totals")
KEY = ["label", "region_id"]

# Samples per side of a block of products, regions multiplied at a time, and blocks a task holds before it passes them on.
ROW_SAMPLES = 512
NEW_SAMPLES = 128
REGIONS_AT_ONCE = 512
OPEN_BLOCKS = 128


class Cohort(NamedTuple):
    spark: SparkSession
    path: str
    buckets: int

    def name(self, kind: str) -> str:
        return f"cohort_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{kind}"


def open_cohort(spark: SparkSession, path: str) -> Cohort:
    """The cohort in a folder that all executors share; any session may open it."""
    cohort = Cohort(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])
    located = path.replace("\\", "\\\\").replace("'", "\\'")
    for kind, schema in SCHEMAS.items():
        clustered = f"CLUSTERED BY ({', '.join(KEY)}) INTO {cohort.buckets} BUCKETS" if kind in BUCKETED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {cohort.name(kind)} ({schema}) USING parquet {clustered} LOCATION '{located}/{kind}'")
        spark.catalog.refreshTable(cohort.name(kind))
    return cohort


def create_cohort(spark: SparkSession, path: str, buckets: int | None = None) -> Cohort:
    """An empty cohort. The number of buckets is fixed for good; by default that of the session's shuffles."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
    return open_cohort(spark, path)


def rows_of(cohort: Cohort, kind: str, also: str | None = None) -> DataFrame:
    """Rows of all batches that are complete, and of one more if asked for. The batches' names go to the rows."""
    batches = cohort.spark.table(cohort.name("batches"))
    if also is not None:
        batches = batches.union(cohort.spark.range(1).select(F.lit(also)))
    return cohort.spark.table(cohort.name(kind)).join(broadcast_if_small(batches.distinct()), "batch", "left_semi")


def append(cohort: Cohort, kind: str, batch: str, rows: DataFrame) -> None:
    """Add the batch's rows; of a bucketed table each bucket is written by one task."""
    columns = [field.split()[0] for field in SCHEMAS[kind].split(", ")]
    rows = rows.withColumn("batch", F.lit(batch)).select(*columns)
    if kind in BUCKETED:
        rows = rows.repartition(cohort.buckets, *KEY)
    rows.write.insertInto(cohort.name(kind))


def check_batch(cohort: Cohort, counts: DataFrame, names: DataFrame, totals: DataFrame) -> None:
    """Raise if the batch breaks what the tables rely on."""
    gaps = F.greatest(*[F.col(c).isNull() for c in counts.columns])
    if not has_at_most(counts.where(gaps), 0):
        raise ValueError("counts need a label, a sample, a region and a number in every row")
    if not has_at_most(counts.groupBy("sample_name", "region_id").count().where("count > 1"), 0):
        raise ValueError("a sample has two rows for a region")
    if not has_at_most(names.groupBy("sample_name").count().where("count > 1"), 0):
        raise ValueError("a sample has two labels")
    if not has_at_most(names.join(rows_of(cohort, "samples"), "sample_name", "left_semi"), 0):
        raise ValueError("a sample is in the cohort already")
    known = rows_of(cohort, "totals").select(*KEY).union(totals.select(*KEY)).distinct()
    wanted = known.groupBy("label").agg(F.count("*").alias("wanted"))
    everyone = names.select("label", "regions").unionByName(rows_of(cohort, "samples").select("label", "regions"))
    short = everyone.join(wanted.join(totals.select("label").distinct(), "label", "left_semi"), "label")
    if not has_at_most(short.where("regions <> wanted"), 0):
        raise ValueError("every sample of a label needs a row for each of its regions")


def add_samples(cohort: Cohort, counts: DataFrame) -> str:
    """Add a batch of samples (label, sample_name, region_id, n); returns the batch's name.

    Counts of earlier batches are read bucket by bucket, to multiply them with the new ones, and never shuffled.
    """
    batch = uuid.uuid4().hex
    counts = cut(counts.select(F.col("label").cast("int"), "sample_name", F.col("region_id").cast("long"), F.col("n").cast("long")))
    names = cut(
        counts.groupBy("label", "sample_name").agg(
            F.sum("n").alias("sum_n"), F.sum(F.col("n") * F.col("n")).alias("sum_squares"), F.count("*").alias("regions")
        )
    )
    totals = cut(counts.groupBy(*KEY).agg(F.count("*").alias("samples"), F.sum("n").alias("total")))
    check_batch(cohort, counts, names, totals)
    first = cohort.spark.table(cohort.name("samples")).agg(F.coalesce(F.max("sample_id") + 1, F.lit(0))).first()[0]
    names = cut(dense_numbers(names, ["sample_name"], "sample_id").withColumn("sample_id", F.col("sample_id") + first))
    append(cohort, "samples", batch, names)
    append(cohort, "totals", batch, totals)
    append(cohort, "counts", batch, counts.join(broadcast_if_small(names.select("sample_name", "sample_id")), "sample_name"))
    append(cohort, "products", batch, new_products(cohort, batch).withColumn("mirrored", F.col("a") < first))
    append(cohort, "batches", batch, cohort.spark.range(1))
    return batch


def sample_blocks(counts: DataFrame, size: int, side: str) -> DataFrame:
    """One row per region and block of samples, with the samples and their counts as arrays; no exchange on bucketed counts."""
    block = F.floor(F.col("sample_id") / size).alias(f"{side}_block")
    entries = F.collect_list(F.struct("sample_id", F.col("n").cast("double").alias("n"))).alias("e")
    return (
        counts.groupBy(*KEY, block)
        .agg(entries)
        .select(*KEY, f"{side}_block", F.col("e.sample_id").alias(f"{side}_ids"), F.col("e.n").alias(f"{side}_n"))
    )


def new_products(cohort: Cohort, batch: str) -> DataFrame:
    """Sum over the regions of the counts of every sample times those of each new sample of its label: label, a, b, dot.

    Exact as long as a sum stays below 2**53. A task multiplies blocks of samples over the regions of its bucket.
    """
    everyone = sample_blocks(rows_of(cohort, "counts", batch), ROW_SAMPLES, "row")
    new = sample_blocks(cohort.spark.table(cohort.name("counts")).where(F.col("batch") == batch), NEW_SAMPLES, "new")
    schema = "label int, a long, b long, dot double"
    return everyone.join(new, KEY).drop("region_id").mapInPandas(multiply, schema).groupBy("label", "a", "b").agg(F.sum("dot").alias("dot"))


def dense(part: pd.DataFrame, side: str, block: int, size: int) -> np.ndarray:
    """Regions x samples of a block."""
    matrix = np.zeros((len(part), size))
    ids = part[f"{side}_ids"].tolist()
    at = np.repeat(np.arange(len(part)), [len(i) for i in ids])
    matrix[at, np.concatenate(ids) - block * size] = np.concatenate(part[f"{side}_n"].tolist())
    return matrix


def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Products of blocks, summed over the rows of a task; at most OPEN_BLOCKS are held before they are passed on."""
    held: dict[tuple[int, int, int], list] = {}

    def passed_on() -> Iterator[pd.DataFrame]:
        for (label, _, _), (rows, news, product, row_first, new_first) in held.items():
            a, b = np.flatnonzero(rows), np.flatnonzero(news)
            yield pd.DataFrame(
                {
                    "label": np.full(len(a) * len(b), label),
                    "a": np.repeat(a + row_first, len(b)),
                    "b": np.tile(b + new_first, len(a)),
                    "dot": product[np.ix_(a, b)].ravel(),
                }
            )
        held.clear()

    for frame in frames:
        for key, rows in frame.groupby(["label", "row_block", "new_block"]):
            if key not in held and len(held) >= OPEN_BLOCKS:
                yield from passed_on()
            for at in range(0, len(rows), REGIONS_AT_ONCE):
                part = rows.iloc[at : at + REGIONS_AT_ONCE]
                left, right = dense(part, "row", key[1], ROW_SAMPLES), dense(part, "new", key[2], NEW_SAMPLES)
                if key not in held:
                    empty = [np.zeros(s, dtype=bool) for s in (ROW_SAMPLES, NEW_SAMPLES)]
                    held[key] = [*empty, np.zeros((ROW_SAMPLES, NEW_SAMPLES)), key[1] * ROW_SAMPLES, key[2] * NEW_SAMPLES]
                held[key][0][np.concatenate(part["row_ids"].tolist()) - held[key][3]] = True
                held[key][1][np.concatenate(part["new_ids"].tolist()) - held[key][4]] = True
                held[key][2] += left.T @ right
    yield from passed_on()


def cohort_counts(cohort: Cohort) -> DataFrame:
    """All counts: label, sample_name, region_id, n."""
    names = broadcast_if_small(rows_of(cohort, "samples").select("sample_id", "sample_name"))
    return rows_of(cohort, "counts").join(names, "sample_id").select("label", "sample_name", "region_id", "n")


def leave_one_out(cohort: Cohort, batch: str | None = None) -> DataFrame:
    """Reference count of a sample = all other samples of its label, for all samples or those of one batch.

    Totals of the batches are added and meet the counts in their buckets; neither is shuffled.
    """
    totals = rows_of(cohort, "totals").groupBy(*KEY).agg(F.sum("total").alias("total"))
    names = rows_of(cohort, "samples").select("sample_id", "sample_name")
    counts = rows_of(cohort, "counts")
    if batch is not None:
        counts = counts.where(F.col("batch") == batch)
    rest = (F.col("total") - F.col("n")).alias("ref_n")
    return (
        counts.join(totals, KEY)
        .join(broadcast_if_small(names), "sample_id")
        .select("label", "sample_name", "region_id", "n", rest)
    )


def sample_correlation(cohort: Cohort, batch: str | None = None) -> DataFrame:
    """Correlation of samples with all samples of their label, themselves included: label, sample_name, partner, r.

    For all samples, or those of one batch only. It follows from the kept products and sums; no counts are read. NULL where a sample is
    constant.
    """
    products = rows_of(cohort, "products")
    pairs = products.select("label", "a", "b", "dot").union(products.where("mirrored").select("label", "b", "a", "dot"))
    sums = rows_of(cohort, "samples").withColumns({c: F.col(c).cast("double") for c in ("sum_n", "sum_squares", "regions")})

    def side(key: str, name: str) -> DataFrame:
        spread = F.col("regions") * F.col("sum_squares") - F.col("sum_n") * F.col("sum_n")
        return sums.select(F.col("sample_id").alias(key), F.col("sample_name").alias(name), F.col("sum_n").alias(f"s_{key}"), spread.alias(f"v_{key}"), "regions", "batch")

    own = side("a", "sample_name")
    if batch is not None:
        own = own.where(F.col("batch") == batch)
    shared = F.col("regions") * F.col("dot") - F.col("s_a") * F.col("s_b")
    return (
        pairs.join(broadcast_if_small(own.drop("batch")), "a")
        .join(broadcast_if_small(side("b", "partner").drop("batch", "regions")), "b")
        .select("label", "sample_name", "partner", F.try_divide(shared, F.sqrt(F.col("v_a") * F.col("v_b"))).alias("r"))
    )
