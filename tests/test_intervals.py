"""Range joins and interval algebra against brute force on random intervals."""

import math
import random

import pytest

from copyloom.operators import intervals as iv


def random_intervals(seed, rows, span, longest, extra):
    r = random.Random(seed)
    out = []
    for i in range(rows):
        start = r.randrange(1, span)
        out.append((r.choice("AB"), start, start + r.randrange(0, longest), *extra(i, r)))
    return out


@pytest.fixture(scope="module")
def two_tracks(spark):
    many = random_intervals(1, 400, 3_000_000, 300_000, lambda i, r: (f"m{i}",))
    # Wide ones that only the whole-contig bin holds, neighbours at one base, and one base intervals.
    many += [("A", 268_435_000, 268_436_000, "w0"), ("A", 100, 199, "t0"), ("A", 200, 200, "t1"), ("B", 1, 3_100_000, "t2")]
    track = random_intervals(2, 300, 3_000_000, 5_000, lambda i, r: (f"t{i}",))
    track += [("A", 199, 199, "x0"), ("A", 200, 300, "x1"), ("A", 268_435_455, 268_435_456, "x2")]
    pairs = {(m[3], t[3]) for m in many for t in track if m[0] == t[0] and m[1] <= t[2] and t[1] <= m[2]}
    left = spark.createDataFrame(many, "contig string, start_bp long, end_bp long, m string")
    right = spark.createDataFrame(track, "contig string, start_bp long, end_bp long, t string")
    return left, right, pairs


@pytest.mark.parametrize(("small", "hot_rows"), [(True, 10**6), (False, 10**6), (False, 3)])
def test_overlap_join_gives_each_pair_once(two_tracks, small, hot_rows):
    left, right, pairs = two_tracks
    found = [(r.m, r.t) for r in iv.overlap_join(left, right, small=small, hot_rows=hot_rows).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs


def test_overlap_join_is_symmetric(two_tracks):
    left, right, pairs = two_tracks
    assert {(r.m, r.t) for r in iv.overlap_join(right, left).collect()} == pairs


@pytest.mark.parametrize(("small", "hot_rows"), [(True, 10**6), (False, 3)])
def test_left_overlap_join_keeps_rows_without_partner(two_tracks, small, hot_rows):
    left, right, pairs = two_tracks
    rows = iv.overlap_join(left, right, how="left", small=small, hot_rows=hot_rows).collect()
    assert len(rows) == len(pairs) + left.count() - len({m for m, _ in pairs})


def test_one_bin_with_a_third_of_all_rows(spark):
    left = spark.range(6000).selectExpr(
        "'A' AS contig", "IF(id % 3 = 0, 5000L, id * 10000) AS start_bp", "IF(id % 3 = 0, 5099L, id * 10000 + 50) AS end_bp", "id"
    )
    right = spark.createDataFrame([("A", 5050, 5060, "t")], "contig string, start_bp long, end_bp long, t string")
    binned, listed = iv.split_hot(left.withColumnRenamed("id", "bin"), right.withColumnRenamed("t", "bin"), ["contig"], 500)
    assert binned.select("_part").distinct().count() == 12 and listed.count() == 12
    assert iv.overlap_join(left, right, small=False, hot_rows=100).count() == 2000


def test_wide_tracks_are_not_broadcast(spark, monkeypatch):
    few = spark.createDataFrame([("A", 1, 200_000_000), ("A", 5, 90)], "contig string, start_bp long, end_bp long")
    assert iv.track_fits(few)
    monkeypatch.setattr(iv, "BROADCAST_BIN_ROWS", 50_000)
    assert not iv.track_fits(few) and iv.track_fits(few.where("end_bp = 90")) and iv.track_fits(few.where("end_bp < 0"))


def test_counting_forms_agree_with_brute_force(spark):
    targets = [(i, "A" if i % 2 else "B", 1 + 500 * i, 1 + 500 * i + 37 * i % 400) for i in range(40)]
    reads = random_intervals(5, 3000, 22_000, 160, lambda i, r: (r.choice(["S1", "S2"]),))
    reads += [("A", 65_530, 65_600, "S1"), ("A", 65_536, 65_536, "S1")]
    targets += [(40, "A", 65_500, 65_536), (41, "A", 65_537, 65_590), (42, "C", 5, 9)]
    expected = {
        (s, t[0]): sum(r[3] == s and r[0] == t[1] and r[1] <= t[3] and t[2] <= r[2] for r in reads)
        for s in ("S1", "S2", "S3")
        for t in targets
    }
    t = spark.createDataFrame(targets, "region_id long, contig string, start_bp long, end_bp long")
    r = spark.createDataFrame(reads, "contig string, start_bp long, end_bp long, sample_name string")
    samples = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "sample_name string")
    for form in (iv.count_overlaps, iv.count_overlaps_sweep):
        found = {(x.sample_name, x.region_id): x.n for x in form(t, r, samples).collect()}
        assert found == expected


def test_running_totals_over_bucket_bounds(spark):
    rows = [("k", i, i * i % 7) for i in (0, 3, 3, 9, 10, 11, 40, 41, 41, 99)]
    df = spark.createDataFrame(rows, "k string, at long, x long")
    found = iv.running_totals(df, ["k"], "at", ["x"], (df["at"] / 10).cast("long")).collect()
    for row in found:
        assert row.total_x == sum(x for _, at, x in rows if at <= row["at"])


@pytest.mark.parametrize("shift", [3, 20])
def test_union_against_single_bases(spark, shift):
    r = random.Random(8)

    def track(seed):
        rows = []
        for sample in ("S1", "S2"):
            at = 0
            for i in range(40):
                start = at + r.randrange(0, 6)
                at = start + r.randrange(1, 30)
                rows.append((sample, "A", start, at, f"{seed}{sample}{i}"))
        return rows

    a, b = track("a"), track("b")
    b += [("S3", "A", 5, 50, "only")]
    schema = "sample_name string, contig string, start_bp long, end_bp long, label string"
    pieces = iv.union_intervals(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), shift).collect()

    def bases(rows):
        return {(s, p): label for s, _, start, end, label in rows for p in range(start, end)}

    in_a, in_b = bases(a), bases(b)
    seen = {}
    for piece in pieces:
        for p in range(piece.start_bp, piece.end_bp):
            assert (piece.sample_name, p) not in seen
            seen[piece.sample_name, p] = (piece.label_a, piece.label_b)
    assert seen == {k: (in_a.get(k), in_b.get(k)) for k in in_a.keys() | in_b.keys()}
    cuts = {(x[0], x[i]) for x in a + b for i in (2, 3)}
    assert all((x.sample_name, x.start_bp) in cuts and (x.sample_name, x.end_bp) in cuts for x in pieces)


def test_min_overlap_is_a_share_of_the_call(spark):
    calls = spark.createDataFrame([("c1", "A", 1, 100), ("c2", "A", 1000, 1099)], "call_key string, contig string, start_bp long, end_bp long")
    reference = spark.createDataFrame(
        [("half", "A", 51, 400), ("less", "A", 52, 400), ("half", "A", 1, 60)], "name string, contig string, start_bp long, end_bp long"
    )
    found = {x.call_key: x.names for x in iv.annotate_overlaps(calls, reference, 0.5, "names").collect()}
    assert found == {"c1": "half", "c2": None}


def test_region_gc_over_chunk_bounds(spark):
    text = "".join(random.Random(3).choice("ACGTNacgt") for _ in range(500))
    chunks = spark.createDataFrame([("A", 1 + i, text[i : i + 70]) for i in range(0, 500, 70)], "contig string, start_bp long, seq string")
    targets = spark.createDataFrame([(0, "A", 10, 300), (1, "A", 71, 71)], "region_id long, contig string, start_bp long, end_bp long")
    found = {x.region_id: x for x in iv.region_gc(targets, chunks).collect()}
    part = text[9:300].upper()
    gc, bases = sum(part.count(c) for c in "GC"), sum(part.count(c) for c in "ACGT")
    assert found[0].bases == bases and abs(found[0].gc - 100 * gc / bases) < 1e-9


def test_full_and_split_rows(spark):
    from copyloom.operators.annotate import annotate_genes_full_split

    segments = spark.createDataFrame([("s1", "A", 1, 100), ("s2", "A", 500, 600)], "segment_id string, contig string, start_bp long, end_bp long")
    genes = spark.createDataFrame(
        [("g1", "X", "A", 50, 70), ("g2", "Y", "A", 100, 200)], "gene_id string, gene_name string, contig string, start_bp long, end_bp long"
    )
    rows = annotate_genes_full_split(segments, genes).toPandas()
    full = rows[rows.annotation_mode == "full"].set_index("segment_id")
    assert full.gene_name["s1"] == "X,Y" and full.gene_count["s2"] == 0 and full.overlap_bp["s1"] == 22
    assert sorted(rows[rows.annotation_mode == "split"].gene_name) == ["X", "Y"]


def test_weighted_mean_by_running_sums_over_bucket_bounds(spark):
    rng = random.Random(7)
    top = 5 << iv.SWEEP_SHIFT
    near = [b << iv.SWEEP_SHIFT for b in range(1, 5)]

    def interval(longest):
        start = rng.choice(near) + rng.randint(-3, 3) if rng.random() < 0.4 else rng.randint(1, top)
        return start, start + rng.choice([0, 1, 50, longest])

    pieces = [(rng.choice("12"), *interval(3 << iv.SWEEP_SHIFT), rng.random()) for _ in range(60)]
    pieces += [("1", 10, 5, 1.0), ("1", 1, top, None), ("1", 1, top, float("nan")), ("2", 1, top, float("inf")), (None, 1, top, 1.0)]
    regions = [(i, rng.choice("12"), *interval(2 << iv.SWEEP_SHIFT)) for i in range(200)] + [(200, "3", 1, 9), (201, None, 1, 9)]
    targets = spark.createDataFrame(regions, "region_id long, contig string, start_bp long, end_bp long")
    track = spark.createDataFrame(pieces, "contig string, start_bp long, end_bp long, v double")
    found = {r.region_id: r.m for r in iv.weighted_mean_over(targets, track, "v", "m").collect()}
    assert len(found) == 202
    for region, contig, start, end in regions:
        shared = [
            (v, min(end, e) - max(start, s) + 1)
            for c, s, e, v in pieces
            if contig and c == contig and s <= e and v is not None and math.isfinite(v) and s <= end and start <= e
        ]
        if not shared:
            assert found[region] is None
        else:
            assert abs(found[region] - sum(v * w for v, w in shared) / sum(w for _, w in shared)) < 1e-9


def test_weighted_mean_lists_no_track_under_bins(spark):
    targets = spark.createDataFrame([(0, "1", 1, 9)], "region_id long, contig string, start_bp long, end_bp long")
    track = spark.createDataFrame([("1", 1, 1 << 40, 0.5)], "contig string, start_bp long, end_bp long, v double")
    assert iv.weighted_mean_over(targets, track, "v", "m").first().m == 0.5


def test_the_sweep_adds_up_reads_by_position_once(spark):
    reads = spark.createDataFrame([("s1", "1", i * 37 % 900, i * 37 % 900 + 40) for i in range(300)], "sample_name string, contig string, start_bp long, end_bp long")
    targets = spark.range(20).selectExpr("id region_id", "'1' contig", "id * 50 start_bp", "id * 50 + 30 end_bp")
    plan = iv.count_overlaps_sweep(targets, reads)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [sample_name" in line and ", at#" in line.split("]")[0] for line in plan.splitlines()) == 1
