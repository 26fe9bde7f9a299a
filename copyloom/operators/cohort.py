"""Groups of samples with similar coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.operators import blocks
from copyloom.operators.intervals import running_totals
from copyloom.sources.writers import cluster_members
from copyloom.session import cut

# Defaults of the grouping.
COMPONENTS = 50
MIN_CLUSTER_SIZE = 12
NEIGHBOURS = 8
NOISE = -1


def one_group(values: DataFrame) -> DataFrame:
    return values.withColumn("_all", F.lit(0))


def profile_gram(profiles: DataFrame) -> DataFrame:
    return blocks.gram(one_group(profiles), "_all", "sample_name", "region_id", "z").drop("_all")


def profile_components(profiles: DataFrame, k: int = COMPONENTS, dense: int = blocks.DENSE_SAMPLES) -> DataFrame:
    """Scores of the samples on the k leading components; k is capped at samples - 1."""
    samples = profiles.select("sample_name").distinct().count()
    found = blocks.components(
        one_group(profiles), "_all", "sample_name", "region_id", "z", min(k, max(1, samples - 1)), dense
    )
    return found.select("sample_name", "component", (F.col("u") * F.sqrt("eigenvalue")).alias("score"))


def sample_neighbours(profiles: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    return blocks.nearest(one_group(profiles), "_all", "sample_name", "region_id", "z", k).drop("_all")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable name per node.

    Each round takes the least name among the neighbours and then jumps to that name's own name, so the
    number of rounds grows with the logarithm of the longest path. Rounds are cut from their lineage.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = cut(nodes.select("sample_name", F.col("sample_name").alias("root")))
    while True:
        offered = both.join(names, F.col("b") == F.col("sample_name")).groupBy("a").agg(F.min("root").alias("offer"))
        lowered = names.join(offered, F.col("sample_name") == F.col("a"), "left").select(
            "sample_name", F.col("root").alias("old"), F.least("root", "offer").alias("root")
        )
        jump = lowered.select(F.col("sample_name").alias("at"), F.col("root").alias("next"))
        jumped = cut(
            lowered.join(jump, F.col("root") == F.col("at")).select("sample_name", "old", F.col("next").alias("root"))
        )
        names = jumped.select("sample_name", "root")
        if jumped.where("old <> root").isEmpty():
            return names


def batch_samples(
    neighbours: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, samples: DataFrame | None = None
) -> DataFrame:
    """Connected components of mutual neighbours, numbered by size; groups below the minimum become noise (-1).

    `samples` lists all samples; without it those that have a neighbour, which is all of them unless there is one.
    """
    neighbours = cut(neighbours.select("sample_name", "neighbour"))
    nodes = (neighbours if samples is None else samples).select("sample_name").distinct()
    edges = (
        neighbours.select(F.least("sample_name", "neighbour").alias("a"), F.greatest("sample_name", "neighbour").alias("b"))
        .groupBy("a", "b")
        .count()
        .where("count = 2")
    )
    roots = connected_components(nodes, edges)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= min_cluster_size)
    # One row per group, at most samples / min_cluster_size of them.
    numbered = sizes.select(
        "root", (F.row_number().over(Window.orderBy(F.desc("size"), "root")) - 1).cast("int").alias("label")
    )
    return roots.join(numbered, "root", "left").select("sample_name", F.coalesce("label", F.lit(NOISE)).alias("label"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("sample_cnt"))


def noise_distances(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean Manhattan distance of every noise sample to the members of every cluster.

    `points` is long (sample_name, dim, v). The sum of |x - m| over the members m of a cluster follows from the
    number and sum of the members below x and in all; one sorted sweep per cluster and dimension gives it
    for all noise samples, without a row per noise sample and member.
    """
    labelled = points.join(labels.select("sample_name", "label"), "sample_name")
    members = labelled.where(F.col("label") != NOISE)
    noise = labelled.where(F.col("label") == NOISE).select("sample_name", "dim", "v")
    totals = members.groupBy("label", "dim").agg(F.count("*").alias("members"), F.sum("v").alias("all_sum"))
    # 2**16 steps over the middle 98 percent of the values, more of the same width outside, so that an outlier does not
    # put all others in one step. Steps only say which rows are swept together.
    middle = F.percentile_approx("v", F.array(F.lit(0.01), F.lit(0.99)), F.lit(1000)).alias("middle")
    spread = labelled.groupBy("dim").agg(middle, F.min("v").alias("least"), F.max("v").alias("most"))
    narrow, wide = F.col("middle")[1] - F.col("middle")[0], F.col("most") - F.col("least")
    width = F.when(narrow > 0, narrow).otherwise(wide) / 65536
    scale = spread.select("dim", F.col("middle")[0].alias("low"), width.alias("w"))
    asked = noise.join(totals, "dim")
    here = (
        members.groupBy("label", "dim", "v")
        .agg(F.count("*").alias("below"), F.sum("v").alias("below_sum"))
        .withColumns({"sample_name": F.lit(None).cast("string")})
    )
    there = asked.select(
        "label", "dim", "v", F.lit(0).cast("long").alias("below"), F.lit(0.0).alias("below_sum"), "sample_name"
    )
    step = F.when(F.col("w") > 0, F.floor((F.col("v") - F.col("low")) / F.col("w"))).otherwise(0).cast("long")
    events = here.unionByName(there).join(scale, "dim").withColumn("step", step).drop("low", "w")
    swept = running_totals(events, ["label", "dim"], "v", ["below", "below_sum"], F.shiftright("step", 8)).where(
        F.col("sample_name").isNotNull()
    )
    x, below, below_sum = F.col("v"), F.col("total_below"), F.col("total_below_sum")
    above = F.col("members") - below
    apart = x * below - below_sum + (F.col("all_sum") - below_sum) - x * above
    return (
        swept.join(totals, ["label", "dim"])
        .groupBy("sample_name", "label")
        .agg((F.sum(apart) / F.max("members")).alias("distance"))
    )


def assign_noise(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """`likely`: the own label, or the nearest cluster of a noise sample; ties go to the smaller label."""
    nearest = distances.groupBy("sample_name").agg(
        F.min_by("label", F.struct("distance", "label")).alias("_nearest"), F.min("distance").alias("distance")
    )
    own = F.when(F.col("label") != NOISE, F.col("label"))
    return labels.join(nearest, "sample_name", "left").select(
        "sample_name", "label", F.coalesce(own, F.col("_nearest"), F.col("label")).alias("likely"), "distance"
    )


def clusters_to_process(labels: DataFrame, done: DataFrame, include_likely: bool = False) -> DataFrame:
    """Clusters that hold, or are nearest to, a sample without a result; members by label.

    With `include_likely` the noise samples count as members of their nearest cluster.
    """
    new = labels.join(done.select("sample_name"), "sample_name", "left_anti")
    wanted = new.select("label").unionByName(new.select(F.col("likely").alias("label"))).where(F.col("label") != NOISE)
    column = "likely" if include_likely else "label"
    members = labels.select("sample_name", F.col(column).alias("label"))
    return cluster_members(members.join(wanted.distinct(), "label", "left_semi"))
