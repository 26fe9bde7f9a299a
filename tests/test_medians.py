"""Medians by counting in ranges against sorted values."""

import random
import statistics

from pyspark.sql import functions as F

from copyloom.operators.medians import medians


def test_one_key_in_many_tasks_and_others(spark):
    rng = random.Random(8)
    values = {
        "hot": [rng.lognormvariate(0, 3) for _ in range(6001)],
        "even": [rng.gauss(0, 1) for _ in range(500)],
        "gap": [0.0] * 200 + [1e9] * 200,
        "ties": [rng.choice([1.0, 2.0, 3.0]) for _ in range(301)],
        "same": [7.5] * 300,
        "outlier": [*range(99), 1e18],
        "one": [4.0],
        "two": [4.0, -5.0],
        "far": [-1e6, 1e6],
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("even", None), ("none", None), (None, 1.0)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "key string, v double").repartition(13)
    for few, buckets in ((4096, 1024), (8, 16)):
        found = {r.key: r.middle for r in medians(table, ["key"], F.col("v"), "middle", few, buckets).collect()}
        assert found.keys() == values.keys()
        for key, vs in values.items():
            assert abs(found[key] - statistics.median(vs)) <= 1e-12 * max(1, abs(found[key])), key


def test_empty(spark):
    assert medians(spark.createDataFrame([], "key string, v double"), ["key"], F.col("v"), "middle").count() == 0
