"""A cohort that grows by batches, against one run over all samples."""

import numpy as np
import pytest

from copyloom.operators import cohort_store as cs
from copyloom.operators import ratio_caller as rc

COUNTS = "label int, sample_name string, region_id long, n long"


def batch(spark, samples, regions, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(s % 2, f"S{s}", r, int(rng.poisson(30))) for s in samples for r in range(regions)], COUNTS)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    cohort = cs.create_cohort(spark, str(tmp_path_factory.mktemp("cohort")), 4)
    parts = [batch(spark, range(9), 40, 1), batch(spark, (20, 21), 40, 2), batch(spark, (30,), 40, 3)]
    names = [cs.add_samples(cohort, p) for p in parts]
    whole = parts[0].union(parts[1]).union(parts[2])
    return cohort, names, whole


def test_grown_equals_one_run(spark, grown):
    cohort, names, whole = grown
    assert rows(cs.cohort_counts(cohort)) == rows(whole)
    expected = rows(rc.leave_one_out(whole))
    assert rows(cs.leave_one_out(cohort)) == expected
    assert rows(cs.leave_one_out(cohort, names[1])) == [r for r in expected if r[1] in ("S20", "S21")]
    single = rc.sample_correlation(whole).collect()
    pairs = {(r.sample_name, p): c for r in single for p, c in zip(r.partners, r.corrs)}
    found = {(r.sample_name, r.partner): r.r for r in cs.sample_correlation(cohort).collect()}
    assert found.keys() == pairs.keys() and all(abs(found[k] - pairs[k]) < 1e-9 for k in pairs)
    late = {(r.sample_name, r.partner) for r in cs.sample_correlation(cohort, names[2]).collect()}
    assert late == {k for k in pairs if k[0] == "S30"}


def scan_exchanges(plan):
    """Depth-first lines of the counts' scan with the exchanges above it."""
    above, found = [], []
    for line in plan.splitlines():
        text = line.lstrip(" :+-*()0123456789")
        depth = len(line) - len(text)
        above = [(d, t) for d, t in above if d < depth]
        if "FileScan" in text and "cohort_" in text and ("_counts[" in text or "_totals[" in text):
            found.append([t for _, t in above if t.startswith("Exchange") or "Exchange hash" in t])
        above.append((depth, text))
    return found


def test_no_exchange_on_counts_and_totals(spark, grown):
    cohort, names, _ = grown
    # As for tables too large for Spark's own broadcasts.
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_exchanges(cohort, names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def check_exchanges(cohort, names):
    for frame in (cs.leave_one_out(cohort), cs.leave_one_out(cohort, names[1])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        found = scan_exchanges(plan)
        assert "SortMergeJoin" in plan and len(found) == 2 and not any(found), plan
    products = cs.new_products(cohort, names[2])
    found = scan_exchanges(products._jdf.queryExecution().executedPlan().toString())
    # The one exchange adds up the products of the buckets.
    assert len(found) == 2 and all(len(above) <= 1 for above in found)


def test_blocks_are_passed_on_early(spark, grown, monkeypatch):
    cohort, names, whole = grown
    frame = cs.sample_blocks(cs.rows_of(cohort, "counts"), 512, "row").join(cs.sample_blocks(cs.rows_of(cohort, "counts"), 128, "new"), cs.KEY)
    pdf = frame.drop("region_id").toPandas()
    whole_sums = list(cs.multiply(iter([pdf])))
    monkeypatch.setattr(cs, "OPEN_BLOCKS", 1)
    monkeypatch.setattr(cs, "REGIONS_AT_ONCE", 3)
    parts = list(cs.multiply(iter([pdf.iloc[i : i + 7] for i in range(0, len(pdf), 7)])))
    assert len(parts) > len(whole_sums)

    def total(frames):
        out = {}
        for f in frames:
            for r in f.itertuples():
                out[r.label, r.a, r.b] = out.get((r.label, r.a, r.b), 0) + r.dot
        return out

    assert total(parts) == total(whole_sums)


def test_another_session_opens_it_and_broken_batches_stay_unseen(spark, grown):
    cohort, _, whole = grown
    again = cs.open_cohort(spark.newSession(), cohort.path)
    assert again.buckets == 4 and cs.cohort_counts(again).count() == whole.count()
    cs.append(cohort, "totals", "broken", spark.createDataFrame([(0, 1, 1, 99)], "label int, region_id long, samples long, total long"))
    assert rows(cs.leave_one_out(cohort)) == rows(rc.leave_one_out(whole))


@pytest.mark.parametrize(
    "bad, message",
    [
        ([(0, None, 0, 1)], "every row"),
        ([(0, "N", r, None) for r in range(40)], "every row"),
        ([(0, "N", r % 39, 1) for r in range(40)], "two rows"),
        ([(r % 2, "N", r, 1) for r in range(40)], "two labels"),
        ([(0, "S4", r, 1) for r in range(40)], "already"),
        ([(0, "N", r, 1) for r in range(39)], "each of its regions"),
        ([(0, "N", r, 1) for r in range(41)], "each of its regions"),
    ],
)
def test_refused_batches(spark, grown, bad, message):
    cohort = grown[0]
    with pytest.raises(ValueError, match=message):
        cs.add_samples(cohort, spark.createDataFrame(bad, COUNTS))


def test_an_empty_batch_and_an_empty_cohort(spark, tmp_path):
    cohort = cs.create_cohort(spark, str(tmp_path / "it's"), 2)
    assert rows(cs.leave_one_out(cohort)) == [] and rows(cs.sample_correlation(cohort)) == []
    cs.add_samples(cohort, spark.createDataFrame([], COUNTS))
    cs.add_samples(cohort, spark.createDataFrame([(0, "A", 0, 5)], COUNTS))
    assert rows(cs.leave_one_out(cohort)) == [(0, "A", 0, 5, 0)]
    assert rows(cs.sample_correlation(cohort)) == [(0, "A", "A", None)]
