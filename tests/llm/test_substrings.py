import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copyloom.llm import substrings
from copyloom.llm.substrings import HOT_REGIONS, deduplicated
from copyloom.llm.suffixes import suffix_array

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, dtype=np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("period", [[0], [1, 0], [0, 1], [2, 1, 0], [0, 0, 1]])
def test_suffix_array_of_periods(period):
    symbols = period * 300
    assert suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(docs):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    out = []
    for d, b in data:
        covered = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                covered[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~covered])
        out.append((d, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in docs], COLUMNS)


def test_whole_table(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] > 0 for r in expected) > 10
    assert result(deduplicated(docs)) == expected


@pytest.mark.parametrize("hot", [HOT_REGIONS, 3])
def test_planted_repeats(spark, hot):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    parts = [text(n) for n in (190, 199, 200, 201, 215, 260, 500)]
    docs = [(i, text(rng.randrange(400)) + rng.choice(parts) + text(rng.randrange(50)) + rng.choice(parts)[rng.randrange(40) :]) for i in range(60)]
    base = text(1500)
    for i in range(40):
        at = rng.randrange(1500)
        docs.append((100 + i, base[:at] + text(rng.randrange(3)) + base[at + 1 :]))
    docs += [(200, "ab" * 300), (201, "x" * 199), (202, "y" * 200), (203, "z" * 201), (204, text(3) * 120)]
    assert result(deduplicated(frame(spark, docs), hot)) == brute(docs)


def test_nulls_copies_and_long_texts(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcd ") for _ in range(40_000))
    docs = [(1, None), (1, None), (2, ""), (None, "short"), (None, "short"), (3, long), (3, long), (4, long[100:500]), (5, "q" * 5000), (6, long[:199])]
    df = frame(spark, docs).withColumn("text_key", F.lit("clash")).withColumn("n", F.lit(1))
    assert result(deduplicated(df)) == brute(docs)


def test_empty_table(spark):
    assert deduplicated(frame(spark, [])).count() == 0


def test_hot_grams_reach_no_suffix_array(spark, monkeypatch):
    """With so few buckets that usual grams set them all."""
    rng, hot, searched = random.Random(7), 5, substrings._searched
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, parts = text(120), [text(230) for _ in range(300)]
    docs = [(i, text(150) + line + text(150)) for i in range(30)] + [(100 + i, text(9) + parts[i % 300] + text(9)) for i in range(600)]

    def guarded(batches):
        held = list(batches)
        regions = Counter(g for g, _ in {p for b in held for p in zip(b["gram"].to_pylist(), b["region"].to_pylist(), strict=True)})
        assert max(regions.values(), default=0) <= hot
        yield from searched(iter(held))

    monkeypatch.setattr(substrings, "GRAM_BITS", 7)
    monkeypatch.setattr(substrings, "_searched", guarded)
    assert result(deduplicated(frame(spark, docs), hot)) == brute(docs)
