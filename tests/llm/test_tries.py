import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from copyloom.llm.queries import op13_tries
from copyloom.llm.tries import ZFastTrie, prefix_trie, two_fattest

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows (conv_id, turn, role, text) to the sorted rows of the result, by listing all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - abs(c) % 5 * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        weight = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += weight
            leaves[p[:d]] += children[p] == 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -(10**9), len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def result(df):
    return sorted(
        (r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


def test_two_fattest_numbers():
    for low in range(40):
        for high in range(low + 1, 41):
            best = max(range(low + 1, high + 1), key=lambda x: (x & -x, -x))
            assert two_fattest(low, high) == best


def test_trie_finds_where_sequences_leave():
    rng = random.Random(3)
    words = [bytes(rng.choices(range(3), k=rng.randrange(20))) for _ in range(400)]
    words += [b"\0" * k for k in (1, 2, 30, 64, 65)]
    digests = lambda w: [hashlib.blake2b(w[:k] + bytes([k]), digest_size=16).digest() for k in range(len(w) + 1)]
    words = list(dict.fromkeys(words))
    trie = ZFastTrie()
    ends = []
    for k in range(0, len(words), 37):
        ends += trie.insert([digests(w) for w in words[k : k + 37]])
    # Nodes are the branching prefixes, the ends and the root; each lies under its handle.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    after = defaultdict(set)
    for p in prefixes:
        if p:
            after[p[:-1]].add(p)
    nodes = {p for p in prefixes if len(after[p]) > 1} | set(words) | {b""}
    assert len(trie.extent) == len(nodes) and len(set(ends)) == len(words)
    assert len(trie.handles) == len(nodes) - 1
    for w, node in zip(words, ends, strict=True):
        assert trie.extent[node] == len(w) and trie.ancestor(digests(w)) == node
        longer = digests(w + b"\7")
        assert trie.ancestor(longer) == node


@pytest.mark.parametrize("trie_turns", [1, 40, 1 << 17])
def test_against_brute_force(spark, small, trie_turns):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert result(prefix_trie(table, trie_turns)) == brute(rows)


def test_query_on_whole_table(spark, middle):
    rows = spark.read.parquet(f"{middle}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert result(op13_tries(spark, middle)) == brute([tuple(r) for r in rows])


def test_nulls_ties_repeats_and_hot_prefixes(spark):
    rng = random.Random(4)
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, None, "", ""), (3, 1, "user", "a"), (3, 1, "assistant", "a"), (3, 1, "user", "a")]
    rows += [(c, k, "user", "same" if k < 3 else rng.choice("xy")) for c in range(-12, 200) for k in range(rng.randrange(1, 12))]
    rows += [(1000, k, "user", "ä" * (k % 4)) for k in range(200)] + [(1001, k, "user", "ä" * (k % 4)) for k in range(199)]
    rows += [(2001, 0, "user", "no first of the family"), (2002, 5, "user", "z\x00z")]
    table = spark.createDataFrame(rows, COLUMNS).withColumn("n_convs", F.lit("clash")).withColumn("part", F.lit(1))
    for trie_turns in (64, 1 << 17):
        assert result(prefix_trie(table.repartition(5), trie_turns)) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0
