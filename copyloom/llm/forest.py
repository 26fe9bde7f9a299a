"""Near duplicates by an LSH forest: sorted orders of MinHash signatures, neighbours by longest common prefix.

1. A document's shingles are its distinct n-grams of words. Equal sets, told by 128-bit sums of their hashes, are one node.
   A node has `TREES` labels of `DEPTH` MinHash values each.
2. Each tree sorts the nodes by its labels. A region is a run of nodes with a common prefix: `LEAST_DEPTH` values where at
   most `REGION_ROWS` nodes share them, else one more, down to `DEPTH` where many nodes agree. The nodes of a region are each
   other's neighbours by longest common prefix and the only candidates.
3. First links: every node of a region with its hub, the node of it that has most company over all trees. Parity bitmaps,
   whose differing bits bound the number of shingles that only one of two sets has, rule out pairs that cannot be similar;
   the others are confirmed on the full sets. Families of near copies become one component here at one comparison a member
   and hub.
4. Last links: within a region, nodes of different components by now are held against each other, in blocks of at most
   `BLOCK_ROWS` by `BLOCK_ROWS`; pairs that the bitmaps leave are candidates. Rounds confirm them: one of each two components
   first, `MORE` times as many in each further round, all when no more are left than there are sets, and those whose components
   have met need no confirmation. Nothing is paired inside a component. A round joins components only, not all links anew.

Two documents with a similarity s of 0.85 share a region of a tree with a chance of s**3, where the region is crowded s**5.
With 24 trees a link is missed with a chance below 2e-10 and 8e-7; similar ones are found the more surely. A set so small
that no other set is similar enough has no labels; it equals its copies and that is all.

Texts are written once with a number for each row. To confirm pairs, the text of one side goes ahead of its partners', in
groups of at most `GROUP_ROWS`, and a task reads a group as a stream.

Nulls and edge cases: a null text, or one without words, has no shingles and no links; with fewer words than n the whole
sequence is one shingle; a component's id is the smallest document id in it, nulls aside; repeated rows and ids are rows of
their own; a document without id is never the one that stays (`kept` is null); an empty table gives an empty result; further
columns are ignored. A document must fit in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyloom.llm import wordhash
from copyloom.llm.components import components
from copyloom.llm.wordhash import PLAIN, mixed
from copyloom.session import broadcast_if_small, cut

WORDS = 3
PERCENT = 85
TREES = 24
LEAST_DEPTH, DEPTH = 3, 5
REGION_ROWS = 32
RUN_ROWS = 20_000
BLOCK_ROWS = 1_000
GROUP_ROWS = 256
STEP_PAIRS = 1 << 17
MORE = 16
MIN_BITS = 1024

HASHES = TREES * DEPTH
_RANDOM = np.random.default_rng(12)
_FACTOR = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADDEND = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_SIGNS = _RANDOM.integers(1, 1 << 63, 2, dtype=np.uint64)
_SHORT = np.uint64(0x2545F4914F6CDD1D)
_HALF = np.uint64(32)

SET = "number long, doc_id long, n long, high long, low long, labels binary, bits binary"
ROW = "key long, rest long, node long, n long"
MEMBER = "region long, node long, n long, rows long"


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; texts are given as bytes and borders."""
    words = wordhash.words(data, at, PLAIN)
    grams = wordhash.sequences(words.hashes, n)
    out = []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if first < last < first + n:
            out.append(mixed(wordhash.sequences(words.hashes[first:last], last - first) ^ _SHORT))
        else:
            out.append(np.unique(grams[first : max(first, last - n + 1)]))
    return out


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of texts (low, high) of bounded size together, with their sets."""
    data, at = wordhash.buffers(column)
    for low, high in wordhash.chunks(at):
        yield low, high, shingle_sets(data[at[low] : at[high]], at[low : high + 1] - at[low], n)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, a row of `HASHES` for each."""
    shingles = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(shingles * _FACTOR[j] + _ADDEND[j], starts) >> _HALF
    return out


def parity(shingles: np.ndarray) -> bytes:
    """A bitmap in which each shingle flips a bit, of a power of two of at least twice as many bits as shingles."""
    bits = max(MIN_BITS, 2 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Parity bitmaps of some sets, to be compared pair by pair. Of two lengths the longer one is folded."""

    def __init__(self, bitmaps: list[bytes]) -> None:
        self.lengths = np.array([len(b) for b in bitmaps], dtype=np.int64)
        self.rows = [np.frombuffer(b, dtype=np.uint64) for b in bitmaps]

    def _folded(self, at: np.ndarray, words: int) -> np.ndarray:
        return np.array([np.bitwise_xor.reduce(self.rows[i].reshape(-1, words), axis=0) for i in at.tolist()], dtype=np.uint64).reshape(-1, words)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the bitmaps i and j differ."""
        shorter = np.minimum(self.lengths[i], self.lengths[j])
        out = np.zeros(len(i), dtype=np.int64)
        for length in np.unique(shorter).tolist():
            some = np.flatnonzero(shorter == length)
            used, places = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
            matrix = self._folded(used, length // 8)
            step = max(1, (1 << 21) // length)
            for k in range(0, len(some), step):
                a, b = places[: len(some)][k : k + step], places[len(some) :][k : k + step]
                out[some[k : k + step]] = np.bitwise_count(matrix[a] ^ matrix[b]).sum(axis=1)
        return out


def may_link(n: np.ndarray, m: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m can be similar enough with so many shingles in one of them alone, at least."""
    return differing <= n + m - 2 * -(-percent * (n + m) // (100 + percent))


def least_linked(percent: int) -> int:
    """The size from which on a set can be similar enough to another one: one with a shingle more."""
    return -(-percent // (100 - percent))


def _described(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, sets in sets_of(batch.column("text"), n):
                size = [len(s) for s in sets]
                both = [[int(mixed(s ^ sign).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets] for sign in _SIGNS]
                labels: list[bytes | None] = [None] * len(sets)
                bits: list[bytes | None] = [None] * len(sets)
                large = [i for i, k in enumerate(size) if k >= least_linked(percent)]
                if large:
                    for i, row in zip(large, signatures([sets[i] for i in large]), strict=True):
                        labels[i], bits[i] = row.tobytes(), parity(sets[i])
                part = batch.slice(low, high - low)
                arrays = [part.column("number"), part.column("doc_id"), pa.array(size, pa.int64()), *(pa.array(x, pa.int64()) for x in both), pa.array(labels, pa.binary()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SET.split(", ")])

    return describe


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


# --- the forest


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: the first values of its label as one hash, the two others behind each other."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                wide = _matrix(part.column("labels")).reshape(-1, TREES, DEPTH).astype(np.uint64)
                key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), wide.shape[:2])
                for j in range(LEAST_DEPTH):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, j])
                rest = (wide[:, :, -2] << _HALF) | wide[:, :, -1]
                node, n = (np.repeat(part.column(c).to_numpy(), TREES) for c in ("node", "n"))
                columns = [key.ravel().view(np.int64), rest.ravel().view(np.int64), node, n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in ROW.split(", ")])


def _regions(region_rows: int, run_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows in order of key and rest those that share a region with others, and which. Runs of a key that are too long to
    hold are cut up at full depth as they come."""

    def runs(*columns: np.ndarray) -> np.ndarray:
        """For each row the length of the run of equal rows around it."""
        new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(new)))
        return np.repeat(lengths, lengths)

    def found(rows: dict[str, np.ndarray], dense: bool = False) -> pa.RecordBatch:
        key, rest = rows["key"].view(np.uint64), rows["rest"].view(np.uint64)
        upper = rest >> _HALF
        most, some, least = runs(key), runs(key, upper), runs(key, rest)
        shallow, medium = (most <= region_rows) & (not dense), (some <= region_rows) & (not dense)
        with np.errstate(over="ignore"):
            region = np.where(shallow, mixed(key), np.where(medium, mixed(mixed(key + np.uint64(1)) + upper), mixed(mixed(key + np.uint64(2)) + rest)))
        size = np.where(shallow, most, np.where(medium, some, least))
        keep = size > (0 if dense else 1)
        out = {"region": region.view(np.int64)} | {c: rows[c] for c in ("node", "n")} | {"rows": size}
        return pa.RecordBatch.from_pydict({c: pa.array(x[keep]) for c, x in out.items()})

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        long_key = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if long_key is not None:
                end = int(np.searchsorted(rows["key"], long_key, "right"))
                if end:
                    yield found({c: v[:end] for c, v in rows.items()}, dense=True)
                rows = {c: v[end:] for c, v in rows.items()}
            if not len(rows["key"]):
                continue
            long_key = None
            if carry is not None:
                rows = {c: np.concatenate([carry[c], v]) for c, v in rows.items()}
            last = int(np.searchsorted(rows["key"], rows["key"][-1], "left"))
            if last:
                yield found({c: v[:last] for c, v in rows.items()})
            carry = {c: v[last:] for c, v in rows.items()}
            if len(carry["key"]) > run_rows:
                long_key = carry["key"][0]
                yield found(carry, dense=True)
                carry = None
        if carry is not None:
            yield found(carry)

    return cut_up


def forest(nodes: DataFrame, region_rows: int = REGION_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """region, node, n, rows: the members of all regions of all trees, from nodes (node, n, labels); written once. `rows` is
    the size of the region, in long runs of the part of it that came in one batch."""
    rows = nodes.select("node", "n", "labels").mapInArrow(_planted, ROW)
    rows = rows.repartition("key").sortWithinPartitions("key", "rest")
    members = rows.mapInArrow(_regions(region_rows, run_rows), MEMBER)
    return cut(members)


# --- candidates


def similar_sizes(n: str, m: str, percent: int) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def first_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: the hub of a region and another of its nodes, if their bitmaps leave it possible that they are similar."""
    company = members.groupBy("node").agg(F.sum(F.log2("rows")).alias("company"))
    members = members.join(company, "node")
    hubs = members.groupBy("region").agg(F.max(F.struct("company", "node", "n")).alias("hub"), F.count("*").alias("rows")).where("rows > 1")
    pairs = members.select("region", "node", "n").join(hubs, "region").where("node != hub.node").where(similar_sizes("n", "hub.n", percent))
    pairs = pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4000):
                part = batch.slice(low, 4000)
                k = np.arange(part.num_rows)
                apart = Bitmaps(part.column("bits_a").to_pylist() + part.column("bits_b").to_pylist()).differing(k, k + len(k))
                ok = may_link(part.column("n_a").to_numpy(), part.column("n_b").to_numpy(), apart, percent)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(possible, "a long, b long")


def _crossed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of different components in each block (region, i, j), from rows in order of block: part i with part j."""

    def of_block(rows: dict[str, np.ndarray], bitmaps: list[bytes]) -> Iterator[pa.RecordBatch]:
        compared = Bitmaps(bitmaps)
        same = rows["i"][0] == rows["j"][0]
        left = np.flatnonzero(rows["part"] == rows["i"])
        right = left if same else np.flatnonzero(rows["part"] == rows["j"])
        step = max(1, STEP_PAIRS // max(1, len(right)))
        for k in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[k : k + step], right, indexing="ij"))
            small, large = np.minimum(rows["n"][i], rows["n"][j]), np.maximum(rows["n"][i], rows["n"][j])
            ok = (rows["component"][i] != rows["component"][j]) & (100 * small >= percent * large)
            ok &= (i < j) if same else (i != j)
            i, j = i[ok], j[ok]
            if len(i):
                near = may_link(rows["n"][i], rows["n"][j], compared.differing(i, j), percent)
                a, b = rows["node"][i[near]], rows["node"][j[near]]
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region", "i", "j", "part", "node", "n", "component"]
        carry: tuple[dict[str, np.ndarray], list[bytes]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, bitmaps = {c: batch.column(c).to_numpy() for c in names}, batch.column("bits").to_pylist()
            if carry is not None:
                rows, bitmaps = {c: np.concatenate([carry[0][c], v]) for c, v in rows.items()}, carry[1] + bitmaps
            new = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("region", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield from of_block({c: v[low:high] for c, v in rows.items()}, bitmaps[low:high])
            low = int(starts[-1])
            carry = {c: v[low:].copy() for c, v in rows.items()}, bitmaps[low:]
        if carry is not None:
            yield from of_block(*carry)

    return cross


def last_pairs(members: DataFrame, nodes: DataFrame, together: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: nodes of a region that are in different components so far and that their bitmaps leave possible."""
    rows = members.select("region", "node", "n").join(together, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = cut(rows)
    several = rows.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows"))
    several = several.where("x != y").select("region", F.ceil(F.col("rows") / block_rows).cast("int").alias("parts"))
    rows = rows.join(several, "region").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A block for each two parts: a row goes to those of its part.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("region", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "component")
    rows = rows.join(nodes.select("node", "bits"), "node").repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")
    return rows.mapInArrow(_crossed(percent), "a long, b long").distinct()


# --- confirmation


def _confirming(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (a, part, b, text) in order of a, part, b the pairs whose sets are similar. The row without b has the text of a."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            for low, high, sets in sets_of(batch.column("text"), n):
                keep = np.zeros(high - low, dtype=bool)
                for k, other in enumerate(sets):
                    if b[low + k] is None:
                        head, own = (a[low + k], part[low + k]), other
                    elif head == (a[low + k], part[low + k]):
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        keep[k] = 100 * common >= percent * (len(own) + len(other) - common)
                    else:
                        raise ValueError("a pair came without the text of its first side")
                yield batch.slice(low, high - low).select(["a", "b"]).filter(pa.array(keep))

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The pairs (a, b) of nodes that are similar on their full sets; `texts` has number, text. Written once."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts"))
    rows = cut(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")))
    heads = rows.select("a", "part").distinct().select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("number"))
    asked = heads.unionByName(rows.select("a", "part", "b", F.col("b").alias("number")))
    wanted = broadcast_if_small(cut(asked.select("number").distinct()))
    some = texts.join(wanted, "number", "left_semi")
    streams = asked.join(some, "number").repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return cut(streams.select("a", "part", "b", "text").mapInArrow(_confirming(n, percent), "a long, b long"))


def settled(candidates: DataFrame, together: DataFrame, texts: DataFrame, n: int, percent: int, plenty: int) -> DataFrame:
    """node, component from components `together` and those of the candidates that prove to be links.

    A round confirms some candidates between each two components, one at first and `MORE` times as many each further time; once
    no more than `plenty` are left, all of them. Candidates whose components have met are left out, as they change nothing.
    """
    limit = 1
    while True:
        rows = candidates
        for side in ("a", "b"):
            rows = rows.join(together.select(F.col("node").alias(side), F.col("component").alias(f"component_{side}")), side, "left")
            rows = rows.withColumn(f"component_{side}", F.coalesce(f"component_{side}", side))
        ends = (F.least("component_a", "component_b").alias("x"), F.greatest("component_a", "component_b").alias("y"))
        rows = rows.where("component_a != component_b").select("a", "b", *ends)
        rank = F.row_number().over(W.partitionBy("x", "y").orderBy(F.xxhash64("a", "b"), "a", "b"))
        rows = cut(rows.withColumn("rank", rank))
        left = rows.count()
        some = rows if left <= plenty else rows.where(F.col("rank") <= limit)
        found = confirmed(some.select("a", "b"), texts, n, percent) if left else None
        if found is not None and not found.isEmpty():
            met = cut(components(some.join(found, ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))))
            together = cut(joined(together, met))
        if left <= plenty:
            return together
        candidates, limit = rows.where(F.col("rank") > limit).select("a", "b"), limit * MORE


def joined(together: DataFrame, met: DataFrame) -> DataFrame:
    """node, component after the components of `together` have met as `met` says: its nodes are components, or nodes that
    were alone."""
    met = met.select(F.col("node").alias("whole"), F.col("component").alias("new"))
    rows = together.join(broadcast_if_small(met), F.col("component") == F.col("whole"), "left")
    rows = rows.select("node", F.coalesce("new", "component").alias("component"))
    known = together.select("component").distinct()
    alone = met.join(known, F.col("whole") == F.col("component"), "left_anti")
    return rows.unionByName(alone.select(F.col("whole").alias("node"), F.col("new").alias("component")))


# --- the operator


def linked(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, region_rows: int = REGION_ROWS, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (number, doc_id, n, high, low), their distinct sets (high, low, least id, node) and node, component for
    the sets that are linked."""
    texts = cut(docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = cut(texts.mapInArrow(_described(n, percent), SET))
    sets = rows.where("n > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("least"), F.min("number").alias("node"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("bits").alias("bits")
    )
    sets = cut(sets)
    nodes = sets.where("labels is not null").select("node", "n", "labels", "bits")
    members = forest(nodes, region_rows, run_rows)
    first = confirmed(cut(first_pairs(members, nodes, percent)), texts.select("number", "text"), n, percent)
    together = cut(components(first))
    last = cut(last_pairs(members, nodes, together, percent, block_rows))
    # As many candidates as there are sets cost no more than the first links did.
    together = settled(last, together, texts.select("number", "text"), n, percent, sets.count())
    return rows.drop("labels", "bits"), sets.drop("labels", "bits", "n"), together


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    rows, sets, together = linked(docs, n, percent, **options)
    sets = sets.join(together, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    sets = sets.join(least, "component").select("high", "low", "component_id")
    some = rows.where("n > 0").join(sets, ["high", "low"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id") == F.col("component_id"))
