"""Jaccard join of documents on word n-grams, by prefixes of groups.

A document's shingles are its distinct n-grams of words, as 64-bit hashes. In one order of all shingles, two sets that are
alike enough share a shingle among the first few of each, their prefixes. The order puts shingles that many documents have
last; it comes from a table of counts of fixed size over the whole corpus, so that prefixes hold what is rare.

1. Documents with equal shingle sets are one node, and nodes with the same prefix and size are one group.
2. First links: nodes that share one of their `MINS` smallest hashes are compared with the node among them that has most
   shingles in common with the corpus. Large families of near copies fall into one component here, at one comparison a node.
3. Group join: groups that share a shingle of their prefixes, whose sizes and places in the prefix leave room for enough
   common shingles, and that are not in one component yet, are candidates. They are expanded to their nodes.
4. Candidates are filtered by parity bitmaps, whose differing bits bound the number of shingles that only one of two sets
   has, and then verified on the whole sets. Links and first links together give the components.

Step 3 covers all pairs that can be alike but for those that a component already holds, so no component is missed. No
pairs are formed inside a component, neither of groups nor of the nodes of a group. A shingle whose groups all have one
component is passed over; one that `RUN_ROWS` groups or more share is dealt out to many tasks, in blocks of at most
`BLOCK_ROWS` by `BLOCK_ROWS` groups that leave out those inside a component. Arrays hold `STEP_PAIRS` pairs at a time.

Nulls and edge cases: a null text, or one without words, has no shingles and no links; with fewer words than n the whole
sequence is one shingle; a component's id is the smallest document id in it, nulls last; repeated rows and ids are rows of
their own; an empty table gives an empty result; further columns are ignored. A document must fit in a task's memory. Sets
are taken as equal if their 64-bit signatures and sizes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm import wordhash
from copyloom.llm.batches import give_back, giving_back, text_batches
from copyloom.llm.bittable import Among, slices, summed
from copyloom.llm.components import components
from copyloom.llm.wordhash import PLAIN, mixed
from copyloom.session import broadcast_if_small, cut

WORDS = 5
PERCENT = 75
MINS = 6
TABLE_BITS = 22
FILTER_BITS = 23
RUN_ROWS = 20_000
BLOCK_ROWS = 2_000
STEP_PAIRS = 2_000_000
MIN_BITS = 1024
YIELD_SHINGLES = 1 << 18

_SIGN, _SHORT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shingle_sets(column: pa.Array, n: int = WORDS, unique: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its shingles, each once; as they come if not `unique`."""
    data, at = wordhash.buffers(column)
    for low, high in wordhash.chunks(at):
        words = wordhash.words(data[at[low] : at[high]], at[low : high + 1] - at[low], PLAIN)
        grams = wordhash.sequences(words.hashes, n)
        for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if first == last:
                yield grams[:0]
            elif last - first < n:
                yield mixed(wordhash.sequences(words.hashes[first:last], last - first) ^ _SHORT)
            else:
                own = grams[first : last - n + 1]
                yield np.unique(own) if unique else own


def least_common(size: int | np.ndarray, other: int | np.ndarray, percent: int) -> int | np.ndarray:
    """How many shingles two sets of these sizes must share: 100 * common >= percent * (size + other - common)."""
    return -(-percent * (size + other) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _parity(shingles: np.ndarray) -> bytes:
    """A bitmap in which each shingle flips a bit, of a power of two of at least as many bits as shingles."""
    bits = max(MIN_BITS, 1 << (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ; the longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def shingle_ranks(docs: DataFrame, n: int = WORDS, bits: int = TABLE_BITS) -> np.ndarray:
    """For each bucket of shingle hashes how common its shingles are: 0 for the usual, else the logarithm of the excess.

    The usual is what chance puts into a bucket, up to four standard deviations. A task counts to 255 in a bucket, which is
    far beyond the usual.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for shingles in shingle_sets(batch.column(0), n, unique=False):
                np.add.at(counts, (shingles >> np.uint64(64 - bits)).astype(np.int64), 1)
        yield slices(np.minimum(counts, 255).astype(np.uint8))

    counts = summed(docs.select("text").mapInArrow(giving_back(count), "no int, data binary"), 1 << bits, np.uint8, np.add, np.uint32)
    mean = counts.mean()
    usual = max(4.0, 4 * mean**0.5)
    excess = np.maximum(counts - mean, 0) / usual
    ranks = np.where(excess >= 1, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)
    del counts, excess
    give_back()
    return ranks


# --- nodes and groups

NODE = "node long, group long, n long, central double, mins array<long>, prefix array<long>, bits binary"


def _signature(shingles: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mixed(np.array([np.sum(mixed(shingles ^ _SIGN), dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64))[0]


def _describe(ranks: np.ndarray, n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shift = np.uint64(64 - (len(ranks) - 1).bit_length())

    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), longs, longs, pa.binary()]
    names = [f.split()[0] for f in NODE.split(", ")]

    def described_row(shingles: np.ndarray) -> list:
        if not len(shingles):
            return [None, None, 0, None, None, None, None]
        rank = ranks[(shingles >> shift).astype(np.int64)]
        first = shingles[np.argsort(rank, kind="stable")[: prefix_length(len(shingles), percent)]]
        node, group = (_signature(x).view(np.int64) for x in (shingles, np.append(first, np.uint64(len(shingles)))))
        return [node, group, len(shingles), float(rank.mean()), shingles[:MINS].view(np.int64), first.view(np.int64), _parity(shingles)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            start, rows, held = 0, [], 0
            for k, shingles in enumerate(shingle_sets(batch.column("text"), n), 1):
                rows.append(described_row(shingles))
                held += len(shingles)
                if held >= YIELD_SHINGLES or k == batch.num_rows:
                    arrays = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    part = batch.slice(start, k - start)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], names=[*kept, *names])
                    start, rows, held = k, [], 0

    return describe


def described(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs`, which need a column text, with the columns of `NODE` in place of the text; written once."""
    ranks = shingle_ranks(docs, n)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return cut(docs.mapInArrow(giving_back(_describe(ranks, n, percent)), ", ".join([*kept, NODE])))


def first_links(nodes: DataFrame) -> DataFrame:
    """a, b: for each of a node's smallest hashes the node and the most central one that has that hash, too."""
    rows = nodes.select("node", "central", F.explode("mins").alias("hash"))
    hubs = rows.groupBy("hash").agg(F.max(F.struct("central", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = rows.join(hubs, "hash").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    return pairs.where("a != b").distinct()


# --- group join

TOKEN = ["token", "group", "n", "place", "component"]
PAIRS = "token long, a long, b long"


def _alike(n: np.ndarray, place: np.ndarray, component: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows that share a token can be alike, were it the first token they share, and are not together yet."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    room = 1 + np.minimum(n[i] - place[i], n[j] - place[j]) - 1
    return (component[i] != component[j]) & (100 * small >= percent * large) & (room >= least_common(small, large, percent))


def _joined(percent: int, run_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of groups from rows in order of token. A run that is too long comes out as its token alone."""

    def apart(component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in a run whose components differ, some at a time: each place with those of later components."""
        order = np.argsort(component, kind="stable")
        ends = np.searchsorted(component[order], component[order], "right")
        counts = len(order) - ends
        total = np.cumsum(counts)
        low = 0
        while low < len(order) and total[-1] > (done := total[low] - counts[low]):
            high = max(low + 1, int(np.searchsorted(total, done + STEP_PAIRS, "right")))
            some = counts[low:high]
            i = np.repeat(np.arange(low, high), some)
            j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + ends[i]
            yield order[i], order[j]
            low = high

    def index_pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        token, component = rows["token"], rows["component"]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.append(starts, len(token)))
        several = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        starts, lengths = starts[several], lengths[several]
        for length in np.unique(lengths).tolist():
            at = starts[lengths == length]
            if length * (length - 1) // 2 > STEP_PAIRS:
                for start in at.tolist():
                    for i, j in apart(component[start : start + length]):
                        yield start + i, start + j
                continue
            first, second = np.triu_indices(length, 1)
            step = max(1, STEP_PAIRS // len(first))
            for k in range(0, len(at), step):
                yield tuple((at[k : k + step, None] + x).ravel() for x in (first, second))

    def pairs_of(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j in index_pairs(rows):
            ok = _alike(rows["n"], rows["place"], rows["component"], i, j, percent)
            i, j = i[ok], j[ok]
            if len(i):
                a, b = rows["group"][i], rows["group"][j]
                yield rows["token"][i], np.minimum(a, b), np.maximum(a, b)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        long_token: int | None = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in TOKEN}
            if long_token is not None:
                keep = int(np.searchsorted(rows["token"], long_token, "right"))
                rows = {c: v[keep:] for c, v in rows.items()}
            if not len(rows["token"]):
                continue
            long_token = None
            if carry is not None:
                rows = {c: np.concatenate([carry[c], v]) for c, v in rows.items()}
            last = int(np.searchsorted(rows["token"], rows["token"][-1], "left"))
            carry = {c: v[last:] for c, v in rows.items()}
            yield from found(pairs_of({c: v[:last] for c, v in rows.items()}) if last else ())
            if len(carry["token"]) >= run_rows:
                long_token, carry = int(carry["token"][0]), None
                yield pa.RecordBatch.from_pydict({"token": pa.array([long_token]), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
        if carry is not None:
            yield from found(pairs_of(carry))

    def found(parts) -> Iterator[pa.RecordBatch]:
        for token, a, b in parts:
            yield pa.RecordBatch.from_pydict({"token": pa.array(token), "a": pa.array(a), "b": pa.array(b)})

    return join


def _crossed(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Candidate pairs of one block of a long run: rows of the left part with rows of the right part."""

    def cross(rows: pd.DataFrame) -> pd.DataFrame:
        n, place, component, group = (rows[c].to_numpy() for c in ("n", "place", "component", "group"))
        left, right = np.flatnonzero(rows.is_left.to_numpy()), np.flatnonzero(rows.is_right.to_numpy())
        a, b = [], []
        for i in left.tolist():
            ok = right[_alike(n, place, component, np.full(len(right), i), right, percent)]
            ok = ok[group[ok] != group[i]]
            a.append(np.minimum(group[i], group[ok]))
            b.append(np.maximum(group[i], group[ok]))
        token = rows.token.iloc[0]
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
        return pd.DataFrame({"token": token, "a": a, "b": b})

    return cross


def group_pairs(tokens: DataFrame, percent: int = PERCENT, run_rows: int = RUN_ROWS) -> DataFrame:
    """a, b: distinct pairs of groups that may be alike, from rows (token, group, n, place, component)."""
    spread = tokens.repartition("token").sortWithinPartitions("token").select(*TOKEN)
    found = cut(spread.mapInArrow(giving_back(_joined(percent, run_rows)), PAIRS).distinct())
    pairs, long_tokens = found.where("a is not null").select("a", "b"), found.where("a is null").select("token").distinct()
    if long_tokens.limit(1).count():
        crossed = _blocks(tokens.join(F.broadcast(long_tokens), "token"), min(run_rows, BLOCK_ROWS))
        pairs = pairs.unionByName(crossed.groupBy("token", "low", "high").applyInPandas(_crossed(percent), PAIRS).select("a", "b"))
    return pairs.distinct()


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of long runs in blocks (token, low, high), `is_left` and `is_right`, so that rows of different components meet.

    A component with `block_rows` rows of a token or more has parts of its own, which are not paired with each other; the
    others share parts. Tokens with one component go.
    """
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("rows"))
    several = sizes.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    sizes = sizes.join(several, "token").withColumn("owner", F.when(F.col("rows") >= block_rows, F.col("component")))
    parts = sizes.groupBy("token", "owner").agg((F.sum("rows") / block_rows + 1).cast("int").alias("parts"))
    sizes = cut(sizes.alias("s").join(parts.alias("p"), F.expr("s.token = p.token AND s.owner <=> p.owner")).select("s.token", "component", "s.owner", "parts"))
    name = F.concat_ws(":", F.col("owner").cast("string"), F.col("number").cast("string")).alias("part")
    each = sizes.select("token", "owner", "parts").distinct()
    each = each.select("token", "owner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("number")).select("token", "owner", name)
    pairs = each.alias("l").join(each.alias("r"), F.expr("l.token = r.token AND l.part <= r.part"))
    pairs = pairs.where("l.owner IS NULL OR r.owner IS NULL OR l.owner != r.owner")
    pairs = pairs.select("l.token", F.col("l.part").alias("low"), F.col("r.part").alias("high"))
    pairs = pairs.withColumn("part", F.explode(F.array_distinct(F.array("low", "high"))))
    rows = rows.join(broadcast_if_small(sizes), ["token", "component"]).withColumn("number", F.pmod(F.xxhash64("group"), F.col("parts")))
    rows = rows.select(*TOKEN, name).join(pairs, ["token", "part"])
    return rows.withColumns({"is_left": F.col("part") == F.col("low"), "is_right": F.col("part") == F.col("high")})


# --- verification


def _near(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b"))
            mask = [_differing(x, y) <= n + m - 2 * least_common(n, m, percent) for x, y, n, m in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return keep


def _verified(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(shingle_sets(batch.column("text_a"), n), shingle_sets(batch.column("text_b"), n), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                mask.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return keep


def _texts(docs: DataFrame, wanted: Among, n: int) -> DataFrame:
    """node, text of the documents whose node may be among the wanted ones, a text for each node."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array([_signature(s) if len(s) else 0 for s in shingle_sets(batch.column("text"), n)], dtype=np.uint64).view(np.int64)
            rows = pa.RecordBatch.from_arrays([pa.array(nodes), batch.column("text")], names=["node", "text"])
            yield rows.filter(pa.array(wanted.maybe(nodes)))

    return docs.select("text").where("text is not null").mapInArrow(giving_back(pick), "node long, text string").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike."""
    both = pairs
    for side in ("a", "b"):
        own = nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        both = both.join(own, side)
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    near = cut(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(giving_back(_near(percent)), "a long, b long"))
    wanted = Among(near.select(F.explode(F.array("a", "b"))), FILTER_BITS)
    texts = cut(_texts(docs, wanted, n))
    rows = near
    for side in ("a", "b"):
        rows = rows.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return cut(rows.select("a", "b", "text_a", "text_b").mapInArrow(giving_back(_verified(n, percent)), "a long, b long"))


# --- the join


def linked(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, run_rows: int = RUN_ROWS) -> tuple[DataFrame, DataFrame]:
    """The documents (`docs` without text, with node and n) and node, component for the nodes that are linked."""
    with text_batches(docs.sparkSession):
        return _linked(docs, n, percent, run_rows)


def _linked(docs: DataFrame, n: int, percent: int, run_rows: int) -> tuple[DataFrame, DataFrame]:
    rows = described(docs, n, percent)
    nodes = rows.where("n > 0").dropDuplicates(["node"])
    thin = cut(nodes.select("node", "group", "n", "central", "mins", "bits"))
    first = verified(first_links(thin), thin, docs, n, percent)
    together = cut(components(first))

    members = thin.select("node", "group", "n").join(together, "node", "left")
    members = cut(members.withColumn("component", F.coalesce("component", "node")))
    labels = members.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    labels = labels.select("group", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("group")).alias("component"))
    groups = rows.where("n > 0").select("group", "n", "prefix").dropDuplicates(["group"]).join(labels, "group")
    tokens = groups.select("group", "n", "component", F.posexplode("prefix").alias("place", "token"))
    pairs = group_pairs(tokens, percent, run_rows)

    side = lambda s: members.select(F.col("node").alias(f"node_{s}"), F.col("group").alias(s), F.col("component").alias(f"component_{s}"))
    expanded = pairs.join(side("a"), "a").join(side("b"), "b")
    expanded = expanded.where("component_a != component_b and node_a != node_b")
    expanded = expanded.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    several = labels.where("component = group").select("group")
    inside = members.join(several, "group")
    inside = inside.select(F.col("group").alias("token"), F.col("node").alias("group"), "n", F.lit(0).alias("place"), "component")
    expanded = expanded.unionByName(group_pairs(inside, percent, run_rows)).distinct()
    links = verified(cut(expanded), thin, docs, n, percent)
    all_links = first.unionByName(links)
    return rows.drop("group", "central", "mins", "prefix", "bits"), cut(components(all_links))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows, together = linked(texts, n, percent, run_rows)
    some = rows.where("n > 0").join(together, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    some = some.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def first_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id, and all documents without words; columns as in `docs`."""
    base = cut(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
    texts = base.select("number", F.col("row.doc_id").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    rows, together = linked(texts, n, percent)
    some = rows.where("n > 0").join(together, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keep = some.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number")).alias("kept"))
    others = cut(some.select("component", "number").join(keep, "component").where("number != kept.number").select("number"))
    return base.join(broadcast_if_small(others), "number", "left_anti").select("row.*")
