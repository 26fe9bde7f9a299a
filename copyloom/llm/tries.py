"""Prefix trie of rebuilt conversations, by z-fast tries over ranges of conversations.

1. Turns become digests of role and text, with the bytes of the text, before anything is shuffled. A family of
   conversations, one whose id 5 divides and the ones that borrow its first turns, streams through a task in order and is
   rebuilt: a path of turn digests for each conversation.
2. Conversations with equal paths are one sequence, with their number and smallest id.
3. Sequences are dealt by ranges of their paths. A task inserts them batch by batch into a compacted trie. Its nodes lie in
   a hash table under their handles, the digest of the prefix whose length is the two-fattest number on the node's edge. A
   fat binary search over these lengths finds the node at which a sequence leaves the trie, with some log2(turns) lookups;
   all sequences of a batch are located first, then inserted from where they were found. A trie is closed when it holds
   `TRIE_TURNS` turns, or with its range.
4. Edges are expanded: a row for each prefix, numbered so that a subtree is a range. Tries share prefixes at the borders of
   ranges; a window over the digest of a prefix gives the members, the smallest member and one owning trie for each.
5. Each trie sums over its subtrees what it owns, and a last aggregate adds up tries and attaches the members that end at a
   node, whose ids are joined in chunks and hashed in order.

Digests have 128 bits. A conversation must fit in a task, at some 200 bytes a turn; a trie holds `TRIE_TURNS` turns or one
longer sequence.

Nulls and edge cases: turns come by turn, nulls first, then in an order of their content, so ties have an order and repeated
rows all count; null roles and texts are empty; rows without conv_id belong to no conversation; c % 5 has the sign of c; a
conversation without turns left is a member of the root alone; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyloom.session import cut

FAMILY, HEADS = 5, 9
WIDTH = 16
ROOT = bytes(WIDTH)
TRIE_TURNS = 1 << 17
YIELD_BYTES = 2 << 20
RANGE_BYTES = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()

REBUILT = "conv_id long, seq binary, path binary, sizes binary"
NODE = "part long, pre long, last long, parent long, digest binary, depth long, conv_id long, n_convs long, own long, bytes long"
PARTIAL = "digest binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def batch_of(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


# --- rebuilt conversations


def turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, turn, digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    written = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(written, 256), 1, 2 * WIDTH))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(conv.isNotNull())
    return rows.select((conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def borrowed(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _prefixes(path: bytes) -> list[bytes]:
    """The digest of every prefix of a path, the empty one first."""
    out = [ROOT]
    for k in range(0, len(path), WIDTH):
        out.append(hashlib.blake2b(out[-1] + path[k : k + WIDTH], digest_size=WIDTH).digest())
    return out


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of base, whether it is another conversation, conv_id, turn."""
    family, head, done, waiting = None, [], [[], [], [], []], 0
    for (base, conv), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
        own = [(digest, size) for _, _, digest, size in rows]
        if base != family:
            family, head = base, []
        if conv == base:
            head = own[: HEADS - 1]
        h = borrowed(conv)
        whole = head[:h] + own[h:]
        path = b"".join(d for d, _ in whole)
        row = (conv, _prefixes(path)[-1], path, np.array([s for _, s in whole], dtype=np.int64).tobytes())
        for column, value in zip(done, row, strict=True):
            column.append(value)
        waiting += 100 + 24 * len(whole)
        if waiting >= YIELD_BYTES:
            yield batch_of(REBUILT, done)
            done, waiting = [[], [], [], []], 0
    if done[0]:
        yield batch_of(REBUILT, done)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (digest of the whole path), path, sizes for every conversation."""
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "digest"]
    rows = turns(conversations).repartition("base").sortWithinPartitions(*order)
    return rows.select("base", "conv_id", "digest", "bytes").mapInArrow(_rebuild, REBUILT)


# --- the trie


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie over sequences given by the digests of their prefixes. Node 0 is the root."""

    def __init__(self) -> None:
        self.sequences: list[list[bytes]] = []
        self.extent = [0]
        self.parent = [-1]
        self.label = [-1]  # a sequence that runs through the node
        self.children: list[dict[bytes, int]] = [{}]
        self.ends: list[int] = [-1]  # the sequence that ends at the node
        self.handles: dict[bytes, int] = {}

    def ancestor(self, digests: list[bytes], node: int = 0) -> int:
        """The deepest node below `node`, itself on the sequence, whose extent is a prefix of it, by fat binary search."""
        low, high = self.extent[node], len(digests) - 1
        while low < high:
            middle = two_fattest(low, high)
            found = self.handles.get(digests[middle])
            if found is None:
                high = middle - 1
                continue
            end = self.extent[found]
            if end >= len(digests) or self.sequences[self.label[found]][end] != digests[end]:
                return self.parent[found]  # it leaves on the edge to the node found
            node, low = found, end
        return node

    def _node(self, extent: int, parent: int, label: int) -> int:
        self.extent.append(extent)
        self.parent.append(parent)
        self.label.append(label)
        self.children.append({})
        self.ends.append(-1)
        return len(self.extent) - 1

    def _hang(self, node: int) -> None:
        """Enters a node under its handle and with its parent."""
        digests, above = self.sequences[self.label[node]], self.extent[self.parent[node]]
        self.handles[digests[two_fattest(above, self.extent[node])]] = node
        self.children[self.parent[node]][digests[above + 1]] = node

    def _insert(self, digests: list[bytes], node: int) -> int:
        """The node at which the sequence ends, made if there is none; the search begins at `node`."""
        self.sequences.append(digests)
        label, length = len(self.sequences) - 1, len(digests) - 1
        node = self.ancestor(digests, node)
        above = self.extent[node]
        if above == length:
            return node
        child = self.children[node].get(digests[above + 1])
        if child is not None:
            other = self.sequences[self.label[child]]
            low, high = above + 1, min(self.extent[child], length)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if other[middle] == digests[middle] else (low, middle - 1)
            old = other[two_fattest(above, self.extent[child])]
            node = self._node(low, node, self.label[child])
            self.parent[child] = node
            del self.handles[old]
            self._hang(node)
            self._hang(child)
            if low == length:
                return node
        leaf = self._node(length, node, label)
        self._hang(leaf)
        return leaf

    def insert(self, batch: list[list[bytes]]) -> list[int]:
        """Locates all sequences of a batch, then inserts them; the node at which each ends."""
        located = [self.ancestor(digests) for digests in batch]
        return [self._insert(digests, node) for digests, node in zip(batch, located, strict=True)]

    def preorder(self) -> list[int]:
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            out.append(node)
            stack.extend(self.children[node].values())
        return out


def expanded(trie: ZFastTrie, convs: np.ndarray, counts: np.ndarray, own: np.ndarray, sizes: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    """A row of `NODE` for every prefix in the trie. `convs`, `counts` and `own` are by node: the smallest member that ends
    there, and how many do; `sizes` has the bytes of the turns of the sequences that label nodes."""
    order = trie.preorder()
    length = {node: trie.extent[node] - (trie.extent[trie.parent[node]] if node else -1) for node in order}
    first, at = {}, 0
    for node in order:
        first[node] = at
        at += length[node]
    last = {node: first[node] + length[node] - 1 for node in order}
    for node in reversed(order[1:]):
        above = trie.parent[node]
        last[above] = max(last[above], last[node])
        counts[above] += counts[node]
        convs[above] = min(convs[above], convs[node])
    rows, waiting = [[] for _ in NODE.split(", ")], 0
    for node in order:
        end, n = trie.extent[node], length[node]
        start = end - n + 1
        above = first[trie.parent[node]] + length[trie.parent[node]] - 1 if node else -1
        digests = trie.sequences[trie.label[node]][start : end + 1] if node else [ROOT]
        pre = range(first[node], first[node] + n)
        weights = sizes[trie.label[node]][start - 1 : end].tolist() if node else [0]
        columns = [
            [part] * n, pre, [last[node]] * n, [above, *pre[:-1]], digests, range(start, end + 1),
            [int(convs[node])] * n, [int(counts[node])] * n, [0] * (n - 1) + [int(own[node])], weights,
        ]
        for row, column in zip(rows, columns, strict=True):
            row.extend(column)
        waiting += n
        if waiting >= 1 << 14:
            yield batch_of(NODE, rows)
            rows, waiting = [[] for _ in NODE.split(", ")], 0
    if waiting:
        yield batch_of(NODE, rows)


def _grow(trie_turns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        trie, ends, held = ZFastTrie(), [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nodes = len(trie.extent)
            convs, counts, own = np.full(nodes, np.iinfo(np.int64).max), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
            for node, conv, n, _ in ends:
                convs[node], counts[node], own[node] = min(convs[node], conv), counts[node] + n, own[node] + n
            sizes = {k: size for k, (_, _, _, size) in enumerate(ends)}
            yield from expanded(trie, convs, counts, own, sizes, number)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.select(["path", "sizes", "conv_id", "n_convs"]).columns]
            low = 0
            while low < len(columns[0]):
                high, some = low, 0
                while high < len(columns[0]) and (high == low or held + some < trie_turns):
                    some += len(columns[0][high]) // WIDTH + 1
                    high += 1
                found = trie.insert([_prefixes(p) for p in columns[0][low:high]])
                for node, size, conv, n in zip(found, *(c[low:high] for c in columns[1:]), strict=True):
                    ends.append((node, conv, n, np.frombuffer(size, dtype=np.int64)))
                held += some
                low = high
                if held >= trie_turns:
                    yield from closed()
                    trie, ends, held, number = ZFastTrie(), [], 0, number + 1
        if ends:
            yield from closed()

    return grow


def _subtrees(rows: pd.DataFrame) -> pd.DataFrame:
    """What a trie adds to each of its prefixes: children, leaves and saved bytes below, of those that it owns."""
    rows = rows.sort_values("pre", ignore_index=True)
    owned = (rows.owner == rows.part).to_numpy()
    parent, last = rows.parent.to_numpy(), rows["last"].to_numpy()

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.where(owned, values, 0))])
        return total[last + 1] - total[:-1]

    n = rows.all_convs.to_numpy()
    inner = parent >= 0
    above = rows.least.to_numpy()[np.maximum(parent, 0)]
    return pd.DataFrame(
        {
            "digest": rows.digest,
            "depth": rows.depth,
            "conv_id": rows.least,
            "parent_conv_id": pd.arrays.IntegerArray(above.astype(np.int64), ~inner),
            "n_convs": n,
            "n_children": np.bincount(parent[inner & owned], minlength=len(rows)),
            "n_leaves": below((rows.all_own.to_numpy() == n).astype(np.int64)),
            "saved_tokens": below((n - 1) * rows.bytes.to_numpy()),
        }
    )


# --- ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined ids of each run of equal sequences, in chunks, with the first id of each."""
    done, waiting = [[], [], []], 0
    for seq, rows in groupby(_rows(batches), key=lambda r: r[0]):
        first, ids, length = None, [], 0
        for _, conv in rows:
            first = conv if not ids else first
            ids.append(str(conv))
            length += len(ids[-1]) + 1
            if length >= YIELD_BYTES // 4:
                for column, value in zip(done, (seq, first, ",".join(ids)), strict=True):
                    column.append(value)
                ids, waiting, length = [], waiting + length, 0
                if waiting >= YIELD_BYTES:
                    yield batch_of("seq binary, first long, ids string", done)
                    done, waiting = [[], [], []], 0
        if ids:
            for column, value in zip(done, (seq, first, ",".join(ids)), strict=True):
                column.append(value)
            waiting += 100 + length
        if waiting >= YIELD_BYTES:
            yield batch_of("seq binary, first long, ids string", done)
            done, waiting = [[], [], []], 0
    if done[0]:
        yield batch_of("seq binary, first long, ids string", done)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[list] = [[], []]
    for seq, rows in groupby(_rows(batches), key=lambda r: r[0]):
        digest = hashlib.sha256()
        for k, (_, ids) in enumerate(rows):
            digest.update(("," * bool(k) + ids).encode())
        done[0].append(seq)
        done[1].append(digest.hexdigest())
        if len(done[0]) >= 10_000:
            yield batch_of("seq binary, ends_sha256 string", done)
            done = [[], []]
    if done[0]:
        yield batch_of("seq binary, ends_sha256 string", done)


def ends(conversations: DataFrame) -> DataFrame:
    """seq, ends_sha256: the hash of the ids, in order and joined, of the conversations with each sequence."""
    rows = conversations.select("seq", "conv_id")
    rows = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    chunks = rows.mapInArrow(_chunks, "seq binary, first long, ids string")
    chunks = chunks.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "ids")
    return chunks.mapInArrow(_hashed, "seq binary, ends_sha256 string")


# --- the operator


def prefix_trie(conversations: DataFrame, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """A row for each distinct prefix of rebuilt conversations; see the top of the module for its columns' sense."""
    paths = cut(rebuilt(conversations))
    sequences = paths.groupBy("seq").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("path").alias("path"), F.first("sizes").alias("sizes")
    )
    ranges = sequences.repartitionByRange(F.substring("path", 1, RANGE_BYTES), "seq").sortWithinPartitions(F.substring("path", 1, RANGE_BYTES), "seq")
    nodes = cut(ranges.select("path", "sizes", "conv_id", "n_convs").mapInArrow(_grow(trie_turns), NODE))
    everywhere = W.partitionBy("digest")
    shared = nodes.withColumns(
        {
            "owner": F.min("part").over(everywhere),
            "least": F.min("conv_id").over(everywhere),
            "all_convs": F.sum("n_convs").over(everywhere),
            "all_own": F.sum("own").over(everywhere),
        }
    ).drop("conv_id", "n_convs", "own")
    partial = shared.groupBy("part").applyInPandas(_subtrees, PARTIAL).withColumn("ends_sha256", F.lit(None).cast("string"))
    ended = ends(paths).select(F.col("seq").alias("digest"), "ends_sha256")
    both = partial.unionByName(ended, allowMissingColumns=True)
    least = [F.min(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    out = both.groupBy("digest").agg(*least, *sums, F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256"))
    return out.drop("digest")
