"""Removal of repeated byte strings, found with suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else in the corpus, its own text included.

1. Every window of `LENGTH` bytes belongs to an anchor, the place in it whose next `GRAM` bytes have the smallest hash, the
   leftmost of equals. That depends on the window alone, so equal windows have anchors with equal grams, at the same place.
   Grams that occur once are done with: no window that belongs to them repeats.
2. The windows of an anchor whose gram repeats lie in a region around it. Regions go to tasks by their gram, equal ones once;
   a gram that has but one region needs no task.
3. A task writes its regions as symbols of `SYMBOL` bytes, aligned to the anchors, and builds one suffix array over all of
   them by linear grouping. Equal windows share a run of `RUN` aligned symbols, so they are neighbours in the array; windows
   whose runs stand together and whose bytes before and after it agree are repeats.
4. Regions that occur more than once repeat as a whole. Runs of repeated windows become spans of texts; spans that touch or
   overlap are one.

Grams that more than `HOT_REGIONS` different regions have do not go to one task: their windows are counted one by one, by
their hashes, with sums ahead of the shuffle. Windows, regions and texts count as equal if their 64-bit hashes are.

Nulls and edge cases: a null text is empty; texts shorter than `LENGTH` stay whole; equal texts, whole copies, are worked
through once and go entirely, if they are long enough; repeated rows and null ids are rows of their own; an empty table gives
an empty result; further columns are ignored. A text must fit in a task's memory about a hundred times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm import wordhash
from copyloom.llm.bittable import Among
from copyloom.llm.suffixes import suffix_array
from copyloom.llm.wordhash import mixed
from copyloom.session import broadcast_if_small, cut

LENGTH = 200
GRAM = 64
SYMBOL = 16
RUN = (LENGTH - SYMBOL + 1) // SYMBOL
HOT_REGIONS = 50_000
GRAM_BITS = 26
TEXT_BITS = 23
CHUNK_BYTES = 512 << 10
ARRAY_BYTES = 4 << 20
PLACE_BITS = 30

_RANDOM = np.random.default_rng(23)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


class Rolling:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE, dtype=np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            self.total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * power[:-1], out=self.total[1:])
            self.unshift = np.full(n + 1, _INVERSE, dtype=np.uint64)
            self.unshift[0] = 1
            np.cumprod(self.unshift, out=self.unshift)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[end] - self.total[start]) * self.unshift[start] + (end - start).astype(np.uint64))

    def all_of(self, length: int) -> np.ndarray:
        """The hash of every substring of this length."""
        with np.errstate(over="ignore"):
            return mixed((self.total[length:] - self.total[:-length]) * self.unshift[: len(self.total) - length] + np.uint64(length))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """For some texts, bytes and borders from 0: rolling hashes; the anchors; the first and last window of each."""
    none = np.zeros(0, dtype=np.int64)
    rolling = Rolling(data)
    if len(data) < LENGTH:
        return rolling, none, none, none
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (rolling.all_of(GRAM) & ~low) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    reach, have, least = LENGTH - GRAM + 1, 1, key
    while 2 * have <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < reach:
        least = np.minimum(least[: len(least) - (reach - have)], least[reach - have :])
    ends = np.repeat(at[1:], np.diff(at))
    window = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[: len(least)])
    place = (least[window] & low).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else none
    last = np.append(fresh[1:], len(window)) - 1 if len(place) else none
    return rolling, place[fresh], window[fresh], window[last]


def _gram_keys(rolling: Rolling, anchor: np.ndarray) -> np.ndarray:
    """A hash for the gram at each anchor, mixed anew: anchors have the smallest of the hashes they are chosen by."""
    return mixed(rolling.hashes(anchor, anchor + GRAM) ^ _BASE)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = wordhash.buffers(batch.column("text"))
        for low, high in wordhash.chunks(at, CHUNK_BYTES):
            rolling, anchor, _, _ = anchors(data[at[low] : at[high]], at[low : high + 1] - at[low])
            yield pa.RecordBatch.from_pydict({"gram": pa.array(_gram_keys(rolling, anchor).view(np.int64))})


PLACE = "gram long, region long, text_key long, start long, size long"
BODY = "gram long, region long, anchor int, bytes binary"
WINDOW = "region long, low long, hash long"


def _cut_out(batch: pa.RecordBatch, wanted: Among) -> Iterator[tuple[np.ndarray, ...]]:
    """For the texts of a batch, part by part: the bytes, then for each region whose gram may be among the wanted ones its
    gram, the hash that tells it apart, its anchor, where it begins and ends, its text, and where in the text it begins."""
    data, at = wordhash.buffers(batch.column("text"))
    for low, high in wordhash.chunks(at, CHUNK_BYTES):
        part, borders = data[at[low] : at[high]], at[low : high + 1] - at[low]
        rolling, anchor, first, last = anchors(part, borders)
        gram = _gram_keys(rolling, anchor)
        some = np.flatnonzero(wanted.maybe(gram)) if len(gram) else anchor
        gram, anchor, first, end = gram[some], anchor[some], first[some], last[some] + LENGTH
        with np.errstate(over="ignore"):
            region = mixed(rolling.hashes(first, end) + (anchor - first).astype(np.uint64) * _BASE).view(np.int64)
        text = np.searchsorted(borders, first, "right") - 1
        yield part, gram.view(np.int64), region, anchor, first, end, low + text, first - borders[text]


def _places(wanted: Among) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_numpy()
            for _, gram, region, _, first, end, text, start in _cut_out(batch, wanted):
                columns = [gram, region, keys[text], start, end - first]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in PLACE.split(", ")])

    return place


def _bodies(wanted: Among) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of each region, once from a task."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, gram, region, anchor, first, end, _, _ in _cut_out(batch, wanted):
                fresh = [i for i, r in enumerate(region.tolist()) if not (r in seen or seen.add(r))]
                cuts = [part[x:y].tobytes() for x, y in zip(first[fresh].tolist(), end[fresh].tolist(), strict=True)]
                columns = [pa.array(gram[fresh]), pa.array(region[fresh]), pa.array((anchor - first)[fresh].astype(np.int32)), pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BODY.split(", ")])

    return body


def repeated_windows(regions: list[bytes], anchor: np.ndarray) -> list[np.ndarray]:
    """For each of some different regions which of its windows occur in another region, or elsewhere in it."""
    size = np.array([len(r) for r in regions], dtype=np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(regions), dtype=np.uint8)
    rolling = Rolling(data)
    # Symbols: aligned to the anchor, whole ones only, a mark of its own behind each region's last one.
    shift = anchor % SYMBOL
    count = (size - shift) // SYMBOL
    owner = np.repeat(np.arange(len(regions)), count + 1)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count + 1) - count - 1, count + 1)
    place = base[owner] + shift[owner] + number * SYMBOL
    is_mark = number == count[owner]
    place[is_mark] = 0
    hashes = rolling.hashes(place, place + SYMBOL) if len(data) >= SYMBOL else np.zeros(len(place), dtype=np.uint64)
    _, rank = np.unique(hashes, return_inverse=True)
    symbols = np.where(is_mark, owner, rank + len(regions))
    order = suffix_array(symbols)
    # Runs of symbols that begin alike stand together in the array.
    order = order[(count[owner[order]] - number[order]) >= RUN]
    run = rolling.hashes(place[order], place[order] + RUN * SYMBOL)
    fresh = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, dtype=bool)
    block = np.cumsum(fresh)
    often = np.bincount(block)[block] > 1 if len(block) else fresh
    order, block = order[often], block[often]
    windows = np.maximum(size - LENGTH + 1, 0)
    first = np.cumsum(windows) - windows
    found = np.zeros(int(windows.sum()), dtype=bool)
    own = owner[order]
    for before in range(SYMBOL):
        start = place[order] - base[own] - before
        ok = np.flatnonzero((start >= 0) & (start < windows[own]))
        at = base[own[ok]] + start[ok]
        whole = rolling.hashes(at, at + LENGTH)
        by = np.lexsort((whole, block[ok]))
        same = (block[ok][by][1:] == block[ok][by][:-1]) & (whole[by][1:] == whole[by][:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(by) else np.zeros(0, dtype=bool)
        found[(first[own[ok]] + start[ok])[by[twice]]] = True
    return np.split(found, first[1:])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


REPEATS = "region long, low long, high long"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of regions that come in order of their grams; a suffix array takes the regions of whole
    grams, until they have `ARRAY_BYTES`."""
    grams: list[int] = []
    ids: list[int] = []
    anchor: list[int] = []
    cuts: list[bytes] = []

    def result(n: int) -> pa.RecordBatch:
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []
        for region, flags in zip(ids[:n], repeated_windows(cuts[:n], np.array(anchor[:n], dtype=np.int64)), strict=True):
            if flags.any():
                rows.append((region, *_runs(flags)))
        for x in (grams, ids, anchor, cuts):
            del x[:n]
        low = np.concatenate([a for _, a, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
        high = np.concatenate([b for _, _, b in rows]) if rows else low
        region = np.repeat(np.array([r for r, _, _ in rows], dtype=np.int64), [len(a) for _, a, _ in rows])
        return pa.RecordBatch.from_pydict({"region": pa.array(region), "low": pa.array(low), "high": pa.array(high)})

    held = 0
    for batch in batches:
        for gram, region, place, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "region", "anchor", "bytes")), strict=True):
            if ids and region == ids[-1]:
                continue  # from another task
            if held >= ARRAY_BYTES and gram != grams[-1]:
                yield result(len(grams))
                held = 0
            grams.append(gram)
            ids.append(region)
            anchor.append(place)
            cuts.append(data)
            held += len(data)
    if grams:
        yield result(len(grams))


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """region, low, hash for every window of some regions."""
    for batch in batches:
        for region, data in zip(batch.column("region").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            hashes = Rolling(np.frombuffer(data, dtype=np.uint8)).all_of(LENGTH).view(np.int64)
            columns = [pa.array(np.full(len(hashes), region)), pa.array(np.arange(len(hashes))), pa.array(hashes)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in WINDOW.split(", ")])


def repeats(docs: DataFrame, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """text_key, start, stop: spans of bytes of the texts that lie in repeated windows, from rows (text_key, text); spans may
    overlap. Rows with the same key are one text.

    The texts are read three times, so that of what they hold only short rows and the bytes of regions that have to be
    compared are written or shuffled.
    """
    grams = docs.select("text").mapInArrow(_grams, "gram long").groupBy("gram").count().where("count > 1").select("gram")
    places = cut(docs.mapInArrow(_places(Among(grams, GRAM_BITS)), PLACE).distinct())
    by_gram = cut(places.select("gram", "region").distinct().groupBy("gram").agg(F.count("*").alias("regions")).where("regions > 1"))
    usual = Among(by_gram.where(F.col("regions") <= hot_regions).select("gram"), GRAM_BITS)
    bodies = docs.select("text").mapInArrow(_bodies(usual), BODY)
    hot = by_gram.where(F.col("regions") > hot_regions).select("gram")
    any_hot = hot.limit(1).count() > 0
    if any_hot:  # a hot gram may share its bucket with a usual one
        bodies = bodies.join(broadcast_if_small(hot), "gram", "left_anti")
    bodies = bodies.repartition("gram").sortWithinPartitions("gram", "region")
    found = bodies.mapInArrow(_searched, REPEATS)
    if any_hot:
        windows = docs.select("text").mapInArrow(_bodies(Among(hot, GRAM_BITS)), BODY).select("region", "bytes")
        windows = cut(windows.mapInArrow(_each_window, WINDOW).distinct())
        twice = windows.groupBy("hash").count().where("count > 1").select("hash")
        found = found.unionByName(windows.join(twice, "hash", "left_semi").select("region", "low", (F.col("low") + 1).alias("high")))
    often = places.groupBy("region").count().where("count > 1").select("region")
    whole = often.select("region", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    parts = places.select("region", "text_key", "start", "size").join(found.unionByName(whole), "region")
    stop = F.when(F.col("high").isNull(), F.col("size")).otherwise(F.col("high") - 1 + LENGTH)
    return parts.select("text_key", (F.col("start") + F.col("low")).alias("from"), (F.col("start") + stop).alias("stop")).withColumnRenamed("from", "start")


# --- removal


def merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "spans")), strict=True):
            data, at, kept, runs = text.encode(), 0, [], merged([s["start"] for s in spans], [s["stop"] for s in spans])
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
        names = ["text_key", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _picked(wanted: Among) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.maybe(batch.column("text_key").to_numpy())))

    return pick


def trimmed_texts(docs: DataFrame, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """text_key, n_removed, n_spans, kept_sha256, kept (bytes) for every different text of which something goes, whole
    copies aside. Texts that cannot be among them are never shuffled."""
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").where(F.octet_length("text") >= LENGTH)
    spans = cut(repeats(texts, hot_regions).groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    wanted = Among(spans.select("text_key"), TEXT_BITS)
    some = texts.mapInArrow(_picked(wanted), "text_key long, text string").dropDuplicates(["text_key"])
    schema = "text_key long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return some.join(spans, "text_key").select("text_key", "text", "spans").mapInArrow(_kept, schema)


def deduplicated(docs: DataFrame, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    thin = texts.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
    )
    thin = cut(thin)
    copies = thin.where(F.col("n_bytes") >= LENGTH).groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1")
    changed = trimmed_texts(texts, hot_regions).drop("kept")
    rows = thin.join(copies, "text_key", "left").join(changed, "text_key", "left")
    copy, nothing = F.col("n").isNotNull(), F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", nothing)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", nothing)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
