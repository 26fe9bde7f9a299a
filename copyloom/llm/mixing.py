"""Mixing sources to target weights.

Every source's words form one stream that is packed into blocks of a fixed number of words. A source's target says how
many of its blocks the mix takes. Output shards draw how many of their slots each source fills from a multinomial; the
running number of a source's slots is mapped to a block through a pseudorandom permutation of the source's blocks, a new
one for each pass over the source. Slots and blocks meet in an equi-join on (source, block).

Nulls and edge cases: a null text has size 0; a null source is a source of its own and comes last; documents of size 0
take part with `taken` 0; repeated rows are separate documents; an empty table gives an empty result; further columns
are ignored. Document ids may be null or repeated: rows are told apart by their place in the stream.

What reaches the driver: one row for each source (its name, size and number of documents), since every source has a
weight in the mix. Everything else is a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 256
SHARD_SLOTS = 1024
TASK_SHARDS = 32
MAX_REPEATS = 3
SEED = 20


@dataclass(frozen=True)
class SourcePlan:
    """What the mix takes from one source: `slots` blocks, the last of them cut to `last_words` words."""

    source_id: int
    source: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int


def target_sizes(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; none above `most` times its size, the excess goes to the others by weight."""
    targets, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while open_:
        scale = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * scale > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] * scale
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, seed: int, source_id: int, epoch: int, inverse: bool = False) -> np.ndarray:
    """Place of each index under a pseudorandom permutation of 0..n-1: a Feistel network on the next power of four,
    walked along its cycles until the value is below n."""
    if n == 1:
        return np.zeros(len(index), dtype=np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.SeedSequence([seed, source_id, epoch]).generate_state(4, np.uint64)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def plan_source(source_id: int, source: str | None, size: int, target: float, block_words: int, seed: int) -> SourcePlan:
    """Slots whose words add up to the rounded target. The short last block of a source counts with its own words."""
    blocks = -(-size // block_words)
    want = min(round(target), MAX_REPEATS * size)
    if not blocks or not want:
        return SourcePlan(source_id, source, size, target, blocks, 0, 0)
    epochs, rest = divmod(want, size)
    if not rest:
        return SourcePlan(source_id, source, size, target, blocks, epochs * blocks, block_words)
    short = blocks * block_words - size
    place = int(permuted(np.array([blocks - 1]), blocks, seed, source_id, epochs, inverse=True)[0])
    full = rest // block_words  # slots before the one that is cut, were all blocks full
    if place < full or (place == full and rest - full * block_words > block_words - short):
        full = max((rest + short) // block_words, place + 1)
        return SourcePlan(source_id, source, size, target, blocks, epochs * blocks + full + 1, rest + short - full * block_words)
    return SourcePlan(source_id, source, size, target, blocks, epochs * blocks + full + 1, rest - full * block_words)


def plan_sources(sized: DataFrame, weights: dict | None, block_words: int, seed: int) -> list[SourcePlan]:
    """One plan per source, by code point, null last. Without weights they are 1, 2, 3, repeating."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode()))
    given = [weights.get(r.source, 0.0) if weights else float(1 + i % 3) for i, r in enumerate(rows)]
    targets = target_sizes([r.size for r in rows], given)
    return [plan_source(i, r.source, r.size, t, block_words, seed) for i, (r, t) in enumerate(zip(rows, targets, strict=True))]


def draw_slots(spark: SparkSession, plans: list[SourcePlan], seed: int, shard_slots: int, block_words: int) -> DataFrame:
    """(shard, source_id, pass_no, block, words): the blocks that the mix takes, and how many words of each.

    A shard draws its counts from a multinomial with the sources' shares. Slots beyond what a source has to give are
    left out, what the draws leave over comes in shards behind them, so that every source gives its target exactly.
    """
    schema = "shard long, source_id int, pass_no int, block long, words int"
    wanted = np.array([p.slots for p in plans], dtype=np.int64)
    total = int(wanted.sum())
    if not total:
        return spark.createDataFrame([], schema)
    share, shards = wanted / total, -(-total // shard_slots)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.minimum(shard_slots, total - batch.id.to_numpy() * shard_slots)
            drawn = [np.random.default_rng([seed, i]).multinomial(n, share) for i, n in zip(batch.id.tolist(), sizes.tolist(), strict=True)]
            if drawn:
                row, source = np.nonzero(np.array(drawn))
                yield pd.DataFrame({"shard": batch.id.to_numpy()[row], "source_id": source.astype(np.int32), "n": np.array(drawn)[row, source]})

    drawn = spark.range(shards).mapInPandas(counts, "shard long, source_id int, n long")
    before = W.partitionBy("source_id").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    give = spark.createDataFrame([(p.source_id, p.slots) for p in plans], "source_id int, slots long")
    ends = drawn.groupBy("source_id").agg(F.sum("n").alias("drawn"))
    rest = give.join(ends, "source_id", "left").select("source_id", F.coalesce("drawn", F.lit(0).cast("long")).alias("first"), "slots")
    rest = rest.where("first < slots").withColumn(
        "at", F.explode(F.sequence(F.col("first"), F.col("slots") - 1, F.lit(shard_slots).cast("long")))
    )
    rest = rest.select(
        (F.lit(shards).cast("long") + (F.col("at") - F.col("first")) / shard_slots).cast("long").alias("shard"),
        "source_id",
        F.least(F.lit(shard_slots).cast("long"), F.col("slots") - F.col("at")).alias("n"),
        F.col("at").alias("first"),
    )

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source_id, rows in batch.groupby("source_id"):
                plan = plans[source_id]
                n = (np.minimum(rows["first"] + rows["n"], plan.slots) - rows["first"]).clip(lower=0).to_numpy()
                slot = np.repeat(rows["first"].to_numpy(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if not len(slot):
                    continue
                passes, block = slot // plan.blocks, np.empty(len(slot), dtype=np.int64)
                for k in np.unique(passes):
                    here = passes == k
                    block[here] = permuted(slot[here] % plan.blocks, plan.blocks, seed, int(source_id), int(k))
                words = np.where(slot == plan.slots - 1, plan.last_words, block_words)
                shard = np.repeat(rows["shard"].to_numpy(), n)
                yield pd.DataFrame({"shard": shard, "source_id": source_id, "pass_no": passes, "block": block, "words": words})

    # A task for every few shards, as a row here stands for many slots.
    spread = drawn.unionByName(rest).repartition(max(1, shards // TASK_SHARDS), "shard")
    return spread.mapInPandas(blocks, schema)


def numbered(sized: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """Adds source_id and `start`, the first word's place in the source's stream.

    Documents are put in buckets by a hash of their id, as many as the root of their number, so that neither a bucket
    nor a source's list of buckets is long. A source's stream is its buckets in order.
    """
    spark = sized.sparkSession
    ids = spark.createDataFrame([(p.source_id, p.source) for p in plans], "source_id int, name string")
    counts = sized.groupBy("source").agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("buckets"))
    ids = ids.join(counts, ids.name.eqNullSafe(counts.source)).select("source_id", "name", "buckets")
    rows = sized.join(F.broadcast(ids), sized.source.eqNullSafe(ids.name)).drop("name")  # a row for each source
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.col("buckets")))
    ends = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("source_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(
        "source_id", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0).cast("long")).alias("bucket_start")
    )
    inside = W.partitionBy("source_id", "bucket").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    return rows.join(ends, ["source_id", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("inside"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every document, written once, since three steps read it."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size")))


def mix(
    docs: DataFrame, weights: dict | None = None, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """The mix as (documents, pieces).

    documents: doc_id, source, size, source_id, start, target, source_size for every row of `docs`.
    pieces: shard, source_id, pass_no, block, doc_id, start, size, from_word, n_words: what each slot takes from each
    document.
    """
    spark = docs.sparkSession
    sized = sizes(docs)
    plans = plan_sources(sized, weights, block_words, seed)
    targets = spark.createDataFrame(
        [(p.source_id, p.size, float(p.target)) for p in plans], "source_id int, source_size long, target double"
    )
    documents = numbered(sized, plans).select("doc_id", "source", "size", "source_id", "start")
    documents = cut(documents.join(F.broadcast(targets), "source_id"))  # a row for each source
    slots = draw_slots(spark, plans, seed, shard_slots, block_words)
    parts = documents.where("size > 0").select(
        "source_id",
        "doc_id",
        "start",
        "size",
        F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    pieces = parts.join(slots, ["source_id", "block"])
    pieces = pieces.withColumns({"from_word": low - F.col("start"), "n_words": F.greatest(high - low, F.lit(0))})
    return documents, pieces.drop("words")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of every document the mix takes, repeats counted."""
    documents, pieces = mix(docs, **options)
    taken = pieces.groupBy("source_id", "start").agg(F.sum("n_words").alias("taken"))
    some, none = documents.where("size > 0"), documents.where("size = 0")
    some = some.join(taken, ["source_id", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    out = some.unionByName(none.withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", "taken")
