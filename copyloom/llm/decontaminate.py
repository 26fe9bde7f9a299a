"""Benchmark decontamination with suffix arrays over the training texts.

The training texts are cut into shards, runs of whole documents of bounded size. Each shard gets a suffix array over its
words, and every suffix of every benchmark item is found in it by binary search: the neighbours of its place give the
longest verbatim match, the range of suffixes that begin with a match gives its locations. Suffixes that cannot match are
left out of the array beforehand: only words from a place on where the first `ANCHOR` words of some test suffix occur,
and at most as many as the longest item has, are sorted. No text is shuffled.

The benchmark is split into blocks of bounded size; each block's words go to the tasks, one block after the other.

Nulls and edge cases: a null text has no words; a document without words is not contaminated; items without words are
left out; a null item id is the empty id; repeated items and items with the same words count by their ids; repeated
documents are judged one by one; empty tables give empty results or no hits; further columns are ignored. A document must
fit in a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm import wordhash
from copyloom.llm.batches import giving_back
from copyloom.llm.wordhash import ALNUM, Words
from copyloom.session import cut

WINDOW = 13
ANCHOR = 4
HIT_SHARE = 20  # contaminated from one word in so many on
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20
FILTER_MASK = np.uint64((1 << FILTER_BITS) - 1)
SHARD_BYTES = 2 << 20
STEP_PAIRS = 1 << 20


@dataclass(frozen=True)
class Benchmark:
    """A block of items: the words of all items in a row, and what is needed to find places where suffixes may match."""

    ids: list[str]
    words: Words
    anchors: dict[int, np.ndarray]  # by number of words: sorted hashes of how test suffixes begin
    window: int

    @cached_property
    def tables(self) -> dict[int, np.ndarray]:
        """For each kind of anchors a bit table that sorts out most other hashes; made once in a task."""
        out = {}
        for size, among in self.anchors.items():
            out[size] = np.zeros(1 << FILTER_BITS, dtype=bool)
            out[size][(among & FILTER_MASK).astype(np.int64)] = True
        return out

    @property
    def longest(self) -> int:
        return int(np.diff(self.words.first).max(initial=0))

    def window_of(self, item: np.ndarray) -> np.ndarray:
        return np.minimum(np.diff(self.words.first)[item], self.window)


def benchmark_block(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Benchmark:
    words = wordhash.of_texts([t for _, t in rows], ALNUM)
    sizes = np.diff(words.first)
    some = np.flatnonzero(sizes)
    first = np.concatenate([[0], np.cumsum(sizes[some])])
    anchors: dict[int, list[np.ndarray]] = {}
    for low, n in zip(first[:-1], sizes[some], strict=True):
        short = min(int(n), ANCHOR)
        anchors.setdefault(short, []).append(wordhash.sequences(words.hashes[low : low + n], short))
    return Benchmark([rows[i][0] or "" for i in some], Words(words.hashes, first), {k: np.unique(np.concatenate(v)) for k, v in anchors.items()}, window)


def _member(values: np.ndarray, among: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones, whose bit table is given."""
    found = table[(values & FILTER_MASK).astype(np.int64)]
    maybe = np.flatnonzero(found)
    place = np.minimum(np.searchsorted(among, values[maybe]), len(among) - 1)
    found[maybe] = among[place] == values[maybe]
    return found


class Shard:
    """Suffix array over the words of some documents that may match."""

    def __init__(self, words: Words, test: Benchmark) -> None:
        self.words, self.test = words, test
        n = len(words.hashes)
        ends = np.repeat(words.first[1:], np.diff(words.first))  # for each word its document's end
        wanted = np.zeros(n + 1, dtype=np.int64)
        for size, among in test.anchors.items():
            begins = np.flatnonzero(_member(wordhash.sequences(words.hashes, size), among, test.tables[size]))
            begins = begins[begins + size <= ends[begins]]
            np.add.at(wanted, begins, 1)
            np.add.at(wanted, np.minimum(begins + test.longest, ends[begins]), -1)
        self.place = np.flatnonzero(np.cumsum(wanted)[:n] > 0)  # of each sorted word in the shard
        self.stop = np.zeros(0, dtype=np.int64)
        self.order = self.stop
        if len(self.place):
            self._sort(ends)

    def _sort(self, ends: np.ndarray) -> None:
        place, m = self.place, len(self.place)
        last = np.ones(m, dtype=bool)  # a run ends where the next word is not beside it or in another document
        last[:-1] = (np.diff(place) != 1) | (ends[place[1:]] != ends[place[:-1]])
        stops = np.flatnonzero(last) + 1
        self.stop = stops[np.searchsorted(stops, np.arange(m), "right")]
        self.alphabet, rank = np.unique(self.words.hashes[place], return_inverse=True)
        self.word, rank = 2 * rank, rank + 1  # a rank of 0 stands for the end of a run
        # Test words as numbers of the same kind; words the shard lacks are odd, between their neighbours.
        near = np.searchsorted(self.alphabet, self.test.words.hashes)
        known = self.alphabet[np.minimum(near, len(self.alphabet) - 1)] == self.test.words.hashes
        self.test_word = np.where(known, 2 * near, 2 * near - 1)
        step = 1
        while True:
            ahead = np.zeros(m, dtype=np.int64)
            inside = np.flatnonzero(np.arange(m) + step < self.stop)
            ahead[inside] = rank[inside + step]
            keys = rank * (m + 1) + ahead
            self.order = np.argsort(keys, kind="stable")
            sorted_keys = keys[self.order]
            fresh = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
            rank = np.empty(m, dtype=np.int64)
            rank[self.order] = np.cumsum(fresh)
            step *= 2
            if step >= self.test.longest or fresh.all():
                return

    def _compare(self, suffix: np.ndarray, start: np.ndarray, length: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words suffixes and patterns share, and whether the suffix is smaller than the pattern."""
        same, smaller = np.zeros(len(suffix), dtype=np.int64), np.zeros(len(suffix), dtype=bool)
        left = np.minimum(self.stop[suffix] - suffix, length)
        going = np.arange(len(suffix))
        while len(going):
            at_end = same[going] >= left[going]
            over = going[at_end]
            smaller[over] = same[over] < length[over]  # the run ends inside the pattern
            going = going[~at_end]
            a, b = self.word[suffix[going] + same[going]], test[start[going] + same[going]]
            smaller[going[a < b]] = True
            going = going[a == b]
            same[going] += 1
        return same, smaller

    def _bound(self, start: np.ndarray, length: np.ndarray, test: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search for each pattern: the first suffix that is not smaller, or the first beyond all it begins."""
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(self.order), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            same, before = self._compare(self.order[mid], start[open_], length[open_], test)
            if upper:
                before |= same >= length[open_]
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        return low

    def search(self, shortest: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """For the test suffixes whose longest match has as many words as `shortest` says for their item: suffix, item,
        length of the longest match."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.place):
            return none, none, none
        test, ends = self.test_word, np.repeat(self.test.words.first[1:], np.diff(self.test.words.first))
        start = np.flatnonzero(test % 2 == 0)  # its first word is in the shard
        length = ends[start] - start
        low = self._bound(start, length, test, upper=False)
        best = np.zeros(len(start), dtype=np.int64)
        for neighbour in (low - 1, low):
            there = np.flatnonzero((neighbour >= 0) & (neighbour < len(self.order)))
            same, _ = self._compare(self.order[neighbour[there]], start[there], length[there], test)
            best[there] = np.maximum(best[there], same)
        item = np.searchsorted(self.test.words.first, start, "right") - 1
        keep = best >= shortest(item)
        return start[keep], item[keep], best[keep]

    def ranges(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range (low, high) of the array whose suffixes begin with it."""
        return self._bound(start, length, self.test_word, upper=False), self._bound(start, length, self.test_word, upper=True)

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place in the shard in some ranges of the array: the range's number, the word."""
        which = np.repeat(np.arange(len(low)), high - low)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return which, self.place[self.order[low[which] + offset]]


def _covered(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words lie in an occurrence of a window, and the pairs (document, item) of such occurrences.

    A window is located once, however many items have it and however often; windows of one length have ranges apart from
    each other, so there are at most as many places as words for each length. Its documents then meet its items.
    """
    test, words = shard.test, shard.words
    none = np.zeros(0, dtype=np.int64)
    start, item, _ = shard.search(test.window_of)
    if not len(start):
        return np.zeros(len(words.hashes), dtype=bool), none, none
    window = test.window_of(item)
    low, high = shard.ranges(start, window)
    keys, first, of = np.unique(low * (test.window + 1) + window, return_index=True, return_inverse=True)
    which, place = shard.places(low[first], high[first])
    edges = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + window[first][which], -1)
    doc = np.searchsorted(words.first, place, "right") - 1
    n_docs, n_items = len(words.first), max(1, len(test.ids))
    docs, items = np.unique(which * n_docs + doc), np.unique(of.ravel() * n_items + item)
    doc_first, item_first = (np.searchsorted(x // n, np.arange(len(keys) + 1)) for x, n in ((docs, n_docs), (items, n_items)))
    docs, items = docs % n_docs, items % n_items
    sizes = np.diff(doc_first) * np.diff(item_first)
    total = np.concatenate([[0], np.cumsum(sizes)])
    pairs = none
    for at in range(0, int(total[-1]), STEP_PAIRS):
        # The pairs of a step by their number: the window, and the document and item of it.
        number = np.arange(at, min(at + STEP_PAIRS, int(total[-1])))
        k = np.searchsorted(total, number, "right") - 1
        inside, wide = number - total[k], np.diff(item_first)[k]
        pairs = np.union1d(pairs, docs[doc_first[k] + inside // wide] * n_items + items[item_first[k] + inside % wide])
    return np.cumsum(edges)[:-1] > 0, pairs // n_items, pairs % n_items


def _shards(column: pa.Array, test: Benchmark) -> Iterator[tuple[int, Shard]]:
    """Shards of a batch, each with the number of its first document."""
    data, at = wordhash.buffers(column)
    for low, high in wordhash.chunks(at, SHARD_BYTES):
        words = wordhash.words(data[at[low] : at[high]], at[low : high + 1] - at[low], ALNUM)
        yield low, Shard(words, test)


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


STATE = {"n_words": pa.int64(), "hit_start": pa.list_(pa.int64()), "hit_end": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
STATE_SQL = "n_words long, hit_start array<long>, hit_end array<long>, items array<string>"


def _judge(test: Benchmark) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros(n, dtype=np.int64)
            hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[list[str]] = [[] for _ in range(n)]
            for low, shard in _shards(wordhash.texts(batch), test):
                first = shard.words.first
                counts[low : low + len(first) - 1] = np.diff(first)
                covered, docs, found = _covered(shard)
                for d, i in zip(docs, found, strict=True):
                    items[low + d].append(test.ids[i])
                for d in np.unique(docs):
                    hits[low + d] = _runs(covered[first[d] : first[d + 1]])
            if "n_words" in batch.schema.names:  # what earlier blocks found
                for d in range(n):
                    before = zip(batch.column("hit_start")[d].as_py(), batch.column("hit_end")[d].as_py(), strict=True)
                    hits[d] = _joined([*before, *hits[d]])
                    items[d] += batch.column("items")[d].as_py()
            state = [counts, [[a for a, _ in h] for h in hits], [[b for _, b in h] for h in hits], [sorted(set(x)) for x in items]]
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in STATE]
            names = [c for c in batch.schema.names if c not in STATE]
            arrays = [pa.array(x, t) for x, t in zip(state, STATE.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*names, *STATE])

    return judge


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int, window: int) -> Iterator[Benchmark]:
    """The items in blocks of about `block_bytes`; an item is never split, but dealt out by its hash."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        yield benchmark_block([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], window)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs`, which need a column text or whole rows in a column row, with n_words, hit_start, hit_end (runs of hit words) and items (sorted ids).

    Columns of these names are replaced. One pass over the texts for each block of the benchmark.
    """
    kept = [c for c in docs.columns if c not in STATE]
    out, done = docs.select(*kept), False
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for test in _blocks(benchmark, block_bytes, window):
        out = (cut(out) if done else out).mapInArrow(giving_back(_judge(test)), f"{plain}, {STATE_SQL}")
        done = True
    return out if done else out.mapInArrow(_judge(benchmark_block([], window)), f"{plain}, {STATE_SQL}")


def with_verdict(rows: DataFrame, hit_share: int = HIT_SHARE) -> DataFrame:
    """Adds n_hit, and contaminated: hits, and at least one word in `hit_share` is hit."""
    n_hit = F.aggregate(F.zip_with("hit_end", "hit_start", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("n_hit", n_hit)
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_share: int = HIT_SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    rows = with_verdict(judged(docs.select("doc_id", "text"), benchmark, window), hit_share)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_share: int = HIT_SHARE) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    rows = with_verdict(judged(docs.select(F.struct(*docs.columns).alias("row")), benchmark, window), hit_share)
    return rows.where(~F.col("contaminated")).select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, word, n_words, item_id, item_word: where the longest match of every test suffix of at least `window` words
    (or the whole item) occurs. Matches that only continue a longer one a word further left are left out."""
    schema = "doc_id string, word long, n_words long, item_id string, item_word long"
    names = [f.split()[0] for f in schema.split(", ")]

    def find(test: Benchmark) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, shard in _shards(wordhash.texts(batch), test):
                    start, item, best = shard.search(test.window_of)
                    which, place = shard.places(*shard.ranges(start, best)) if len(start) else (start, start)
                    seen = set(zip(place.tolist(), start[which].tolist(), strict=True))
                    first = np.array([(p - 1, s - 1) not in seen for p, s in zip(place.tolist(), start[which].tolist(), strict=True)], dtype=bool)
                    which, place = which[first], place[first]
                    doc = np.searchsorted(shard.words.first, place, "right") - 1
                    ids = batch.column("doc_id").take(pa.array(doc + low))
                    items = pa.array([test.ids[i] for i in item[which]], pa.string())
                    word, item_word = place - shard.words.first[doc], start[which] - test.words.first[item[which]]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(word), pa.array(best[which]), items, pa.array(item_word)], names=names)

        return match

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    parts = [rows.mapInArrow(find(test), schema) for test in _blocks(benchmark, block_bytes, window)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def items_digest(items: list[str]) -> str:
    """The digest that `contamination` returns for some item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
