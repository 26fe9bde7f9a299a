"""Dense numbers by ranges, against sorting in Python."""

import random

from copyloom.operators.numbering import dense_numbers
from copyloom.sources.readers import number_targets


def test_numbers_of_a_key_that_spans_ranges(spark):
    random.seed(3)
    # One key holds most rows, one is NULL; order values repeat and are NULL at times.
    rows = [(random.choice(["a"] * 8 + ["b", None]), random.choice([None, *range(400)]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v long, id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = dense_numbers(frame, ["v", "id"], "place", ("k",)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expected |= {r[2]: i for i, r in enumerate(ordered)}
    assert {r.id: r.place for r in found} == expected


def test_numbers_without_a_key_ties_and_empty(spark):
    frame = spark.createDataFrame([(5,), (5,), (5,), (None,), (1,)], "v long")
    found = sorted((r.place, r.v) for r in dense_numbers(frame, ["v"], "place").collect())
    assert found == [(0, None), (1, 1), (2, 5), (3, 5), (4, 5)]
    assert dense_numbers(frame.limit(0), ["v"], "place").collect() == []


def test_no_window_over_a_whole_contig(spark):
    targets = spark.createDataFrame([("1", i % 50, i) for i in range(200)] + [(None, 1, 2)], "contig string, start_bp long, end_bp long")
    numbered = number_targets(targets)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line]
    assert windows and all("_range" in line for line in windows)
    places = sorted((r.region_id, r.start_bp, r.end_bp) for r in numbered.collect())
    assert [p[1:] for p in places] == sorted((i % 50, i) for i in range(200)) and places[-1][0] == 199
