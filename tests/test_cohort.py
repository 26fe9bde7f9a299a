"""Block products, grouping and noise assignment against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES, zscores
from copyloom.operators import blocks, cohort, coverage
from copyloom.session import cut


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(13, 40)) + rng.normal(size=(13, 1)) * np.sin(np.arange(40))
    rows = [("g", f"s{i:02d}", j, float(data[i, j])) for i in range(13) for j in range(40)]
    return data, cut(spark.createDataFrame(rows, "g string, s string, d long, v double"))


@pytest.mark.parametrize(("row_block", "column_block"), [(512, 4096), (4, 16), (1, 1000)])
def test_gram_in_blocks(matrix, row_block, column_block):
    data, df = matrix
    found = blocks.gram(df, "g", "s", "d", "v", row_block=row_block, column_block=column_block).orderBy("sample_name").collect()
    assert [r.partners for r in found] == [[f"s{i:02d}" for i in range(13)]] * 13
    assert np.allclose(np.array([r.dots for r in found]), data @ data.T)


def test_correlations_and_neighbours_in_blocks(matrix):
    data, df = matrix
    found = blocks.correlations(df, "g", "s", "d", "v", row_block=4, column_block=16).orderBy("sample_name").collect()
    assert np.allclose(np.array([r.corrs for r in found]), np.corrcoef(data))
    near = blocks.nearest(df, "g", "s", "d", "v", 3, row_block=4, column_block=16).toPandas()
    distance = np.sqrt(((data[:, None] - data[None]) ** 2).sum(axis=2))
    for i in range(13):
        mine = near[near.sample_name == f"s{i:02d}"].sort_values("rank")
        best = [f"s{j:02d}" for j in np.argsort(distance[i]) if j != i][:3]
        assert list(mine.neighbour) == best


def test_both_ways_to_components_agree(matrix):
    data, df = matrix
    values, vectors = np.linalg.eigh(data @ data.T)
    for dense in (2000, 5):
        found = blocks.components(df, "g", "s", "d", "v", 3, dense=dense).toPandas()
        for k in (1, 2, 3):
            mine = found[found.component == k].sort_values("sample_name")
            assert np.allclose(np.abs(mine.u), np.abs(vectors[:, -k]), atol=1e-5)
            assert np.allclose(mine.eigenvalue, values[-k])


def test_component_scores_reproduce_the_gram_matrix(spark, middle):
    z = cut(zscores(spark, middle))
    scores = cohort.profile_components(z).toPandas().pivot(index="sample_name", columns="component", values="score")
    wide = z.toPandas().pivot(index="sample_name", columns="region_id", values="z")
    assert scores.shape == (24, 23)
    assert np.allclose(scores.to_numpy() @ scores.to_numpy().T, wide.to_numpy() @ wide.to_numpy().T, atol=1e-6)


def test_profiles_add_up_and_are_standardised(spark, middle):
    from checks.queries import counted

    counts = cut(counted(spark, middle))
    scaled = coverage.scale_profiles(counts)
    assert np.allclose(scaled.groupBy("sample_name").agg(F.sum("v").alias("t")).toPandas().t, 1000)
    z = coverage.zscore_by_region(scaled).groupBy("region_id").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).toPandas()
    assert np.allclose(z.m, 0) and set(np.round(z.s, 9)) <= {0.0, 1.0}


def test_connected_components_of_random_graphs(spark):
    r = random.Random(5)
    nodes = [f"n{i:03d}" for i in range(150)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(90)] + list(zip(nodes[:60], nodes[1:61]))
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = cohort.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "sample_name string"), spark.createDataFrame(edges, "a string, b string")
    ).collect()
    assert {x.sample_name: x.root for x in found} == {n: find(n) for n in nodes}


def test_groups_never_mix_the_kits(spark, middle):
    labels = QUERIES["batch_samples"](spark, middle).toPandas()
    labels["kit"] = labels.sample_name < "S12"
    assert (labels[labels.label >= 0].groupby("label").kit.nunique() == 1).all()
    assert sorted(labels.label.value_counts()) == [1, 11, 12]


def test_noise_distance_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    # A third of all members sit on one and the same point.
    points = np.vstack([rng.normal(size=(20, 2)), np.zeros((10, 2)), rng.normal(3, 1, size=(5, 2))])
    labels = [0] * 10 + [1] * 20 + [-1] * 5
    names = [f"p{i:02d}" for i in range(35)]
    long = [(names[i], d, float(points[i, d])) for i in range(35) for d in range(2)]
    p = spark.createDataFrame(long, "sample_name string, dim int, v double")
    labelled = spark.createDataFrame(list(zip(names, labels)), "sample_name string, label int")
    found = cohort.noise_distances(p, labelled).toPandas()
    assert len(found) == 10
    for row in found.itertuples():
        members = points[np.array(labels) == row.label]
        assert np.isclose(row.distance, np.abs(members - points[names.index(row.sample_name)]).sum(axis=1).mean())
    assigned = cohort.assign_noise(cohort.noise_distances(p, labelled), labelled).toPandas()
    best = found.sort_values(["distance", "label"]).groupby("sample_name").label.first()
    noise = assigned[assigned.label == -1].set_index("sample_name").likely
    assert noise.to_dict() == best.to_dict()
    assert (assigned[assigned.label >= 0].likely == assigned[assigned.label >= 0].label).all()


def test_no_noise_and_one_sample(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 0)], "sample_name string, label int")
    p = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "sample_name string, dim int, v double")
    assert cohort.assign_noise(cohort.noise_distances(p, labels), labels).where("likely = label").count() == 2
    alone = cohort.batch_samples(spark.createDataFrame([], "sample_name string, neighbour string"), 1, labels.limit(1))
    assert alone.collect()[0].label == 0


def test_clusters_to_process(spark):
    likely = spark.createDataFrame(
        [("a", 0, 0), ("b", 0, 0), ("c", 1, 1), ("d", -1, 1), ("e", 2, 2)], "sample_name string, label int, likely int"
    )
    done = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_name string")
    assert {(r.label, r.members) for r in cohort.clusters_to_process(likely, done).collect()} == {(1, "c"), (2, "e")}
    with_likely = cohort.clusters_to_process(likely, done, include_likely=True).collect()
    assert {(r.label, r.members) for r in with_likely} == {(1, "c,d"), (2, "e")}


def test_noise_distances_do_not_mind_outliers(spark):
    values = [1e12, -3e9, *range(200), 5, 5, 5]
    rows = [(f"m{i}", 0, float(v), i % 2) for i, v in enumerate(values)] + [(f"n{i}", 0, float(v), -1) for i, v in enumerate((0, 7.5, 2e9))]
    points = spark.createDataFrame([r[:3] for r in rows], "sample_name string, dim int, v double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "sample_name string, label int")
    found = {(r.sample_name, r.label): r.distance for r in cohort.noise_distances(points, labels).collect()}
    for name, _, x, label in rows:
        if label == -1:
            for cluster in (0, 1):
                members = [r[2] for r in rows if r[3] == cluster]
                assert np.isclose(found[name, cluster], sum(abs(x - m) for m in members) / len(members))
