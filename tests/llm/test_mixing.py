import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from copyloom.llm.mixing import mix, mixed, permuted, plan_source, target_sizes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_permutation_is_one_and_has_an_inverse():
    for n in (1, 2, 3, 17, 64, 1000):
        there = permuted(np.arange(n), n, 5, 2, 1)
        assert sorted(there) == list(range(n))
        assert (permuted(there, n, 5, 2, 1, inverse=True) == np.arange(n)).all()


def test_targets_share_and_stop():
    assert target_sizes([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert target_sizes([100, 1, 100], [1, 2, 3]) == pytest.approx([49.5, 3, 148.5])
    assert target_sizes([0, 0], [1, 2]) == [0, 0]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 50, 64])
def test_planned_slots_add_up_to_the_target(size):
    for want in range(0, 3 * size + 1):
        plan = plan_source(1, "a", size, want, 8, 3)
        total, blocks = 0, plan.blocks
        for slot in range(plan.slots):
            block = int(permuted(np.array([slot % blocks]), blocks, 3, 1, slot // blocks)[0])
            words = min(8, size - block * 8)
            total += min(words, plan.last_words) if slot == plan.slots - 1 else words
        assert total == want


def check(docs, result):
    rows = result.toPandas()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, target_sizes([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    assert len(rows) == docs.count()
    assert (rows.taken <= 3 * rows["size"]).all()
    by_target = rows.groupby("target").taken.sum()
    for target in set(targets.values()):
        near = sum(round(t) for t in targets.values() if t == target)
        assert by_target[target] == near
    return rows


def test_whole_table(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    rows = check(docs, mixed(docs))
    again = mixed(docs.repartition(7)).toPandas()
    key = ["doc_id"]
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, "a b c", "x", "s", 1), (1, "a b c", "x", "s", 1), (None, "d", None, None, None), (2, None, None, "s", 0)]
    rows += [(3, "", "x", "t", 0), (4, " \t\n", "x", "t", 0), (5, "w " * 3000, "x", "u", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("taken", F.lit("clash")).withColumn("block", F.lit(1))
    out = check(docs, mixed(docs, block_words=4, shard_slots=16))
    assert set(out[out["size"] == 0].taken) == {0}


def test_empty_table(spark):
    assert mixed(spark.createDataFrame([], COLUMNS)).count() == 0


def test_pieces_lie_inside_documents(spark, small):
    documents, pieces = mix(spark.read.parquet(f"{small}/documents.parquet"), block_words=32)
    assert pieces.where("from_word < 0 or from_word + n_words > size").count() == 0
    per_slot = pieces.groupBy("source_id", "pass_no", "block").agg(F.sum("n_words").alias("n"))
    assert per_slot.where("n > 32").count() == 0
    assert documents.count() == 200


def taken_by_hand(docs, block_words, seed):
    """Per (source, start) the words taken: every source's stream is laid out word by word, and every slot walks it."""
    documents, _ = mix(docs, block_words=block_words, shard_slots=16, seed=seed)
    rows = sorted((r for r in documents.collect() if r["size"]), key=lambda r: (r.source_id, r.start))
    out, streams = {}, {}
    for r in rows:
        stream = streams.setdefault(r.source_id, [])
        assert r.start == len(stream)  # documents lie end to end
        stream += [(r.source_id, r.start)] * r["size"]
        out[r.source_id, r.start] = (r.doc_id, r["size"], 0)
    sources = {r.source_id: (r.source, r.source_size, r.target) for r in documents.collect()}
    for source_id, stream in streams.items():
        source, size, target = sources[source_id]
        assert size == len(stream)
        plan = plan_source(source_id, source, size, target, block_words, seed)
        for slot in range(plan.slots):
            round_, place = divmod(slot, plan.blocks)
            block = int(permuted(np.array([place]), plan.blocks, seed, source_id, round_)[0])
            words = plan.last_words if slot == plan.slots - 1 else block_words
            for owner in stream[block * block_words : min((block + 1) * block_words, block * block_words + words)]:
                doc_id, n, taken = out[owner]
                out[owner] = (doc_id, n, taken + 1)
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("block_words, seed", [(1, 3), (7, 3), (32, 8)])
def test_taken_of_every_document_against_walking_the_stream(spark, block_words, seed):
    rng = np.random.default_rng(seed)
    sources = ["s"] * 12 + ["t"] * 3 + ["u", None]
    rows = [(i, "w " * int(rng.integers(0, 60)), "x", sources[int(rng.integers(len(sources)))], 0) for i in range(120)]
    rows += [(500, "long " * 900, "x", "t", 0), (501, None, "x", "s", 0), (502, "w", "x", "lone", 0), (502, "w", "x", "lone", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    found = mixed(docs, block_words=block_words, shard_slots=16, seed=seed).where("size > 0").collect()
    by_hand = taken_by_hand(docs, block_words, seed)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in found), key=repr) == by_hand
    assert sum(t for _, _, t in by_hand) > 0
