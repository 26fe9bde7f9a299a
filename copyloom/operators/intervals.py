"""Range joins and interval algebra on (contig, start_bp, end_bp), closed at both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.functions.columns import sequence_gc, sorted_distinct
from copyloom.session import BROADCAST_ROWS, has_at_most

# Bin widths 4 kb, 64 kb, 1 Mb, 16 Mb and 268 Mb; the last level is one bin for the whole contig.
BIN_SHIFTS = (12, 16, 20, 24, 28)
WHOLE_CONTIG = 62

# A track listed under its bins is broadcast only up to this many rows.
BROADCAST_BIN_ROWS = 4_000_000

# A bin with more rows than this is split over several tasks in the shuffled join.
HOT_BIN_ROWS = 1_000_000

# Width of the position buckets of the sweeps: 2**16 positions.
SWEEP_SHIFT = 16


def home_bin(start: str, end: str) -> Column:
    """The narrowest bin that holds the whole interval: one bin per row.

    Never NULL, so that the planner has no reason to evaluate it a second time in a filter on the scan.
    """
    levels = [
        f"WHEN shiftright({start}, {s}) = shiftright({end}, {s}) "
        f"THEN named_struct('level', {s}, 'bin', coalesce(shiftright({start}, {s}), -1L))"
        for s in BIN_SHIFTS
    ]
    return F.expr(f"CASE {' '.join(levels)} ELSE named_struct('level', {WHOLE_CONTIG}, 'bin', 0L) END")


def touched_bins(start: str, end: str) -> Column:
    """Every bin of every level that the interval touches."""
    levels = [
        f"transform(sequence(shiftright({start}, {s}), shiftright({end}, {s})), "
        f"b -> named_struct('level', {s}, 'bin', b))"
        for s in BIN_SHIFTS
    ]
    return F.expr(f"concat({', '.join(levels)}, array(named_struct('level', {WHOLE_CONTIG}, 'bin', 0L)))")


def track_fits(track: DataFrame) -> bool:
    """Whether a track may be broadcast: few rows, and few rows still when listed under the bins they touch.

    Both numbers come from one aggregate over two columns.
    """
    per_level = [f"shiftright(end_bp, {s}) - shiftright(start_bp, {s}) + 1" for s in BIN_SHIFTS]
    found = track.agg(F.count("*").alias("rows"), F.expr(f"sum({' + '.join(per_level)} + 1)").alias("listed")).first()
    return found["rows"] <= BROADCAST_ROWS and (found["listed"] or 0) <= BROADCAST_BIN_ROWS


def overlap_join(
    many: DataFrame,
    track: DataFrame,
    *,
    on: tuple[str, ...] = (),
    how: str = "inner",
    small: bool | None = None,
    hot_rows: int = HOT_BIN_ROWS,
) -> DataFrame:
    """Pairs of rows whose closed intervals overlap, each pair once.

    Both sides carry contig, start_bp and end_bp; the track's come back as track_start and track_end. `many`
    keeps one row per interval, in its home bin, so the large side is never multiplied. The `track`, whose
    intervals should be the short ones, is listed under every bin it touches. A pair can therefore meet in
    the home bin of its `many` row only. A track counted to be small is broadcast (`small` passes on a count
    already made); beyond that the join shuffles on the bins, and bins with more than `hot_rows` rows are
    split over several tasks.
    """
    keys = [*on, "contig", "level", "bin"]
    binned = many.select("*", home_bin("start_bp", "end_bp").alias("_home")).select(
        *many.columns, "_home.level", "_home.bin"
    )
    renamed = track.withColumnsRenamed({"start_bp": "track_start", "end_bp": "track_end"})
    listed = renamed.select("*", F.explode(touched_bins("track_start", "track_end")).alias("_bin")).select(
        *renamed.columns, "_bin.level", "_bin.bin"
    )
    if track_fits(track) if small is None else small:
        listed = F.broadcast(listed)
    else:
        binned, listed = split_hot(binned, listed, keys, hot_rows)
        keys = [*keys, "_part"]
    left, right = binned.alias("m"), listed.alias("t")
    same_bin = reduce(lambda a, b: a & b, [F.col(f"m.{k}") == F.col(f"t.{k}") for k in keys])
    overlaps = (F.col("m.start_bp") <= F.col("t.track_end")) & (F.col("t.track_start") <= F.col("m.end_bp"))
    kept = [F.col(f"m.{c}") for c in many.columns]
    kept += [F.col(f"t.{c}") for c in renamed.columns if c not in many.columns]
    return left.join(right, same_bin & overlaps, how).select(*kept)


def split_hot(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Spread the left rows of every key with more than `hot_rows` rows over parts; repeat the right rows per part.

    The table of hot keys has at most (left rows / hot_rows) entries. A row's part follows from its content,
    so a task that is run again after a loss sends every row to the same place.
    """
    hot = (
        left.groupBy(*keys)
        .count()
        .where(F.col("count") > hot_rows)
        .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    spread = left.join(hot, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")
    )
    repeated = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop("_parts"), repeated.drop("_parts")


def grid(targets: DataFrame, samples: DataFrame, small: bool | None = None, blocks: int = 64, parts: int = 16) -> DataFrame:
    """One row per sample and region with n = 0: equi-join on region blocks and parts of the samples.

    The (sample, block) rows are few but each becomes many, so they are spread over all tasks by number. Where the
    regions are broadcast (`small` passes on a count already made) one part will do; otherwise a task gets a block of
    the regions and a part of the samples.
    """
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    regions = targets.select("region_id", F.pmod(F.hash("region_id"), F.lit(blocks)).alias("_block"))
    if has_at_most(regions, BROADCAST_ROWS) if small is None else small:
        regions, parts = F.broadcast(regions.withColumn("_part", F.lit(0))), 1
    else:
        regions = regions.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wanted = samples.select("sample_name").distinct().withColumns(
        {"_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "_part": F.pmod(F.hash("sample_name"), F.lit(parts))}
    )
    wanted = wanted.repartition(tasks, "sample_name", "_block")
    return regions.join(wanted, ["_block", "_part"]).select("sample_name", "region_id", F.lit(0).cast("long").alias("n"))


def count_overlaps(targets: DataFrame, reads: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Reads per region and sample, zero regions kept; a read counts in every region it touches.

    `reads` carries sample_name, contig, start_bp and end_bp. With a small target list this is one pass over
    the reads, a hash lookup per read and a partial count per task; only (sample, region) sums are shuffled.
    A target list beyond the broadcast bound is counted by the sweep instead.
    """
    samples = reads if samples is None else samples
    if not track_fits(targets):
        return count_overlaps_sweep(targets, reads, samples)
    hits = overlap_join(
        reads.select("sample_name", "contig", "start_bp", "end_bp"),
        targets.select("region_id", "contig", "start_bp", "end_bp"),
        small=True,
    ).select("sample_name", "region_id", F.lit(1).cast("long").alias("n"))
    zeros = grid(targets, samples, small=True)
    return hits.unionByName(zeros).groupBy("sample_name", "region_id").agg(F.sum("n").alias("n"))


def running_totals(
    events: DataFrame, keys: list[str], order: str, sums: list[str], bucket: Column, loose: DataFrame | None = None
) -> DataFrame:
    """Running sum of each column over the rows of a key up to and including the row's order value.

    Sums run inside buckets, which must grow with the order; the totals of earlier buckets are added. No task
    has to sort a whole key. Where the events are sums themselves, `loose` holds the rows they were added up from: totals of
    buckets are taken from these, so that the events are made once.
    """
    buckets = events.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        (buckets if loose is None else loose.withColumn("_bucket", bucket)).groupBy(*keys, "_bucket")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(*keys, "_bucket", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums])
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        buckets.withColumns({f"_in_{s}": F.sum(s).over(inside) for s in sums})
        .join(offsets, [*keys, "_bucket"])
        .select(*events.columns, *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"total_{s}") for s in sums])
    )


def count_overlaps_sweep(targets: DataFrame, reads: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """The same counts as starts up to the region's end minus ends before its start.

    For target lists too large to broadcast. Reads are summed per position before the shuffle, so a bucket
    never holds more rows than positions and region bounds.
    """
    samples = reads if samples is None else samples
    zero = F.lit(0).cast("long")
    ends = reads.select(
        "sample_name",
        "contig",
        F.explode(
            F.array(
                F.struct(F.col("start_bp").alias("at"), F.lit(1).alias("opened"), F.lit(0).alias("closed")),
                F.struct(F.col("end_bp").alias("at"), F.lit(0).alias("opened"), F.lit(1).alias("closed")),
            )
        ).alias("e"),
    ).select("sample_name", "contig", "e.*")
    bounds = (
        ends.groupBy("sample_name", "contig", "at")
        .agg(F.sum("opened").cast("long").alias("opened"), F.sum("closed").cast("long").alias("closed"))
        .withColumns({"region_id": F.lit(None).cast("long"), "upper": F.lit(None).cast("boolean")})
    )
    asked = (
        grid(targets, samples)
        .join(targets.select("region_id", "contig", "start_bp", "end_bp"), "region_id")
        .select(
            "sample_name",
            "contig",
            "region_id",
            F.explode(
                F.array(
                    F.struct(F.col("end_bp").alias("at"), F.lit(True).alias("upper")),
                    F.struct((F.col("start_bp") - 1).alias("at"), F.lit(False).alias("upper")),
                )
            ).alias("e"),
        )
        .select("sample_name", "contig", "region_id", "e.at", "e.upper", zero.alias("opened"), zero.alias("closed"))
    )
    events = bounds.unionByName(asked)
    bucket = F.shiftright("at", SWEEP_SHIFT)
    loose = ends.unionByName(asked.select(*ends.columns))
    swept = running_totals(events, ["sample_name", "contig"], "at", ["opened", "closed"], bucket, loose)
    signed = F.when(F.col("upper"), F.col("total_opened")).otherwise(-F.col("total_closed"))
    return (
        swept.where(F.col("region_id").isNotNull())
        .groupBy("sample_name", "region_id")
        .agg(F.sum(signed).alias("n"))
    )


def union_intervals(track_a: DataFrame, track_b: DataFrame, shift: int = 20) -> DataFrame:
    """Cut two call tracks at every breakpoint; each piece carries the label of either track or NULL.

    Tracks hold sample_name, contig, start_bp, end_bp and label, do not overlap within themselves, and are read
    as half-open here. One sweep over the breakpoints per (sample, contig, bucket); what reaches over from
    earlier buckets comes from a table with one row per bucket.
    """
    keys = ["sample_name", "contig"]

    def marks(track: DataFrame, side: str) -> DataFrame:
        other = "b" if side == "a" else "a"
        here = F.array(
            F.struct(F.col("start_bp").alias("at"), F.col("label").alias("label"), F.lit(1).alias("opens")),
            F.struct(F.col("end_bp").alias("at"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("opens")),
        )
        state = F.struct(F.col("e.opens").alias("opens"), F.col("e.label").alias("label"))
        return track.select(*keys, F.explode(here).alias("e")).select(
            *keys, "e.at", state.alias(side), F.lit(None).cast("struct<opens:int,label:string>").alias(other)
        )

    # Where one call ends and the next one starts, the start wins: max of the struct.
    points = (
        marks(track_a, "a")
        .unionByName(marks(track_b, "b"))
        .withColumn("_bucket", F.shiftright("at", shift))
        .groupBy(*keys, "_bucket", "at")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select(
        *keys,
        "_bucket",
        "at",
        F.lead("at").over(inside).alias("next_at"),
        F.last("a", ignorenulls=True).over(so_far).alias("a"),
        F.last("b", ignorenulls=True).over(so_far).alias("b"),
    )
    per_bucket = points.groupBy(*keys, "_bucket").agg(
        F.min("at").alias("first_at"),
        F.max_by("a", F.when(F.col("a").isNotNull(), F.col("at"))).alias("a"),
        F.max_by("b", F.when(F.col("b").isNotNull(), F.col("at"))).alias("b"),
    )
    buckets = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys,
        "_bucket",
        F.lead("first_at").over(buckets).alias("_after"),
        F.last("a", ignorenulls=True).over(earlier).alias("_a"),
        F.last("b", ignorenulls=True).over(earlier).alias("_b"),
    )
    return (
        swept.join(carried, [*keys, "_bucket"])
        .select(
            *keys,
            F.col("at").alias("start_bp"),
            F.coalesce("next_at", "_after").alias("end_bp"),
            F.coalesce("a", "_a")["label"].alias("label_a"),
            F.coalesce("b", "_b")["label"].alias("label_b"),
        )
        .where("end_bp IS NOT NULL AND (label_a IS NOT NULL OR label_b IS NOT NULL)")
    )


def annotate_overlaps(calls: DataFrame, reference: DataFrame, min_overlap: float, column: str) -> DataFrame:
    """Names of the reference intervals that cover at least a share of the call; NULL where none does.

    `calls` carries call_key, contig, start_bp, end_bp; `reference` carries name, contig, start_bp, end_bp.
    """
    shared = F.least("end_bp", "track_end") - F.greatest("start_bp", "track_start") + 1
    names = (
        overlap_join(calls.select("call_key", "contig", "start_bp", "end_bp"), reference)
        .where(shared >= min_overlap * (F.col("end_bp") - F.col("start_bp") + 1))
        .groupBy("call_key")
        .agg(sorted_distinct(F.col("name")).alias(column))
    )
    return calls.join(names, "call_key", "left")


def track_events(track: DataFrame, value: Column) -> DataFrame:
    """Both ends of every piece of a track, one row per position.

    The sum of a track from the first position of its bucket up to x is slope * x + rise, x counted within the bucket: a
    piece turns the slope up by its value where it starts and down again where it ends. `covers` and `covered` are the
    same for the number of pieces.
    """
    low, high = bucket_place(F.col("start_bp")), bucket_place(F.col("end_bp"))
    opens = F.struct(
        F.col("start_bp").alias("at"), value.alias("slope"), (value * (1 - low)).alias("rise"), F.lit(1).alias("covers"), (1 - low).alias("covered")
    )
    closes = F.struct(
        F.col("end_bp").alias("at"), (-value).alias("slope"), (value * high).alias("rise"), F.lit(-1).alias("covers"), high.alias("covered")
    )
    return (
        track.select("contig", F.explode(F.array(opens, closes)).alias("e"))
        .groupBy("contig", F.col("e.at").alias("at"))
        .agg(*[F.sum(f"e.{c}").alias(c) for c in ("slope", "rise", "covers", "covered")])
    )


def bucket_place(at: Column) -> Column:
    """Place of a position within its bucket of the sweeps, from 0."""
    return at.bitwiseAND(F.lit((1 << SWEEP_SHIFT) - 1)).cast("long")


def weighted_mean_over(targets: DataFrame, track: DataFrame, value: str, name: str) -> DataFrame:
    """Mean of a track's value over each target, weighted by overlap length; NULL where the track has none.

    Running sums over the track, looked up at both ends of a target, which is cut where it crosses buckets of 2**16
    positions. A piece of the track is one row at each end however long it is and however many targets lie on it: what reaches into a
    bucket comes from a table with one row per bucket. Sums start anew in every bucket, so they lose no digits to the length of the
    contig. Pieces may overlap and count each; pieces whose value is NULL or not finite say nothing.
    """
    number = F.col(value).cast("double")
    usable = (F.col("start_bp") <= F.col("end_bp")) & F.col("contig").isNotNull()
    sums = ["slope", "rise", "covers", "covered"]
    pieces = track.where(usable & number.isNotNull() & (F.abs(number) < F.lit(float("inf"))))
    ends = track_events(pieces, number).withColumns({"region_id": F.lit(None).cast("long"), "sign": F.lit(0)})
    width = 1 << SWEEP_SHIFT
    first = F.shiftleft("_b", SWEEP_SHIFT)
    asked = (
        targets.where(usable)
        .select("region_id", "contig", "start_bp", "end_bp")
        .withColumn("_b", F.explode(F.sequence(F.shiftright("start_bp", SWEEP_SHIFT), F.shiftright("end_bp", SWEEP_SHIFT))))
        .select(
            "contig",
            "region_id",
            F.explode(
                F.array(
                    F.struct(F.least("end_bp", first + (width - 1)).alias("at"), F.lit(1).alias("sign")),
                    F.struct((F.greatest("start_bp", first) - 1).alias("at"), F.lit(-1).alias("sign")),
                )
            ).alias("e"),
            first.alias("_first"),
        )
        .where(F.col("e.at") >= F.col("_first"))  # nothing lies before a bucket's first position
        .select("contig", "e.at", *[F.lit(0).alias(s) for s in sums], "region_id", "e.sign")
    )
    events = ends.unionByName(asked).withColumn("_bucket", F.shiftright("at", SWEEP_SHIFT))
    earlier = Window.partitionBy("contig").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy("contig", "_bucket")
        .agg(F.sum("slope").alias("slope"), F.sum("covers").alias("covers"))
        .select(
            "contig",
            "_bucket",
            F.coalesce(F.sum("slope").over(earlier), F.lit(0.0)).alias("_slope"),
            F.coalesce(F.sum("covers").over(earlier), F.lit(0)).alias("_covers"),
        )
    )
    inside = Window.partitionBy("contig", "_bucket").orderBy("at")
    swept = events.select("contig", "_bucket", "at", "region_id", "sign", *[F.sum(s).over(inside).alias(s) for s in sums])
    place = bucket_place(F.col("at"))
    total = (F.col("slope") + F.col("_slope")) * place + F.col("rise") + F.col("_slope")
    covered = (F.col("covers") + F.col("_covers")) * place + F.col("covered") + F.col("_covers")
    means = (
        swept.where("sign <> 0")
        .join(carried, ["contig", "_bucket"])
        .groupBy("region_id")
        .agg(F.sum(F.col("sign") * total).alias("_total"), F.sum(F.col("sign") * covered).alias("_covered"))
        .select("region_id", F.when(F.col("_covered") > 0, F.col("_total") / F.col("_covered")).alias(name))
    )
    return targets.join(means, "region_id", "left")


def region_gc(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """GC percentage of each target from sequence chunks (contig, start_bp, seq), cut at the target's bounds."""
    pieces = chunks.withColumn("end_bp", F.col("start_bp") + F.length("seq") - 1)
    joined = overlap_join(pieces, targets.select("region_id", "contig", "start_bp", "end_bp"))
    first = F.greatest("start_bp", "track_start")
    last = F.least("end_bp", "track_end")
    cut = F.col("seq").substr((first - F.col("start_bp") + 1).cast("int"), (last - first + 1).cast("int"))
    gc, acgt = sequence_gc(cut)
    share = F.sum("gc_count") * 100 / F.nullif(F.sum("acgt_count"), F.lit(0))
    return (
        joined.select("region_id", gc.alias("gc_count"), acgt.alias("acgt_count"))
        .groupBy("region_id")
        .agg(F.sum("acgt_count").alias("bases"), share.alias("gc"))
    )
