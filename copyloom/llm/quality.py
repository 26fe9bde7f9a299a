"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Shallow boosted trees over the statistics of labelled documents propose rules: each path from the root to a node is a
conjunction of thresholds. A logistic regression with an L1 penalty weighs the rules and leaves most of them out. What is
left is compiled into a Spark column over the statistics. The statistics themselves come from whole Arrow batches.

Fitting takes at most `SAMPLE` labelled rows, the first by a hash of the document id, to the driver; scoring covers every
document and whole texts. Rows whose crc32(doc_id as text) mod `FOLDS` is 0 are held out and never fitted on. Scores depend
on the text alone.

Nulls and edge cases: a null or empty text has all statistics 0 and is scored like any other; a null document id counts as
the empty text when folds are dealt, so it is held out; labels that are null are left out, repeated ones averaged; with no
labels the score is 0.5, with labels of one class that class's share, smoothed; an empty table gives an empty result; further
columns are ignored. A document must fit in a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm import wordhash

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES = 40
DEPTH = 3
RATE = 0.3
BINS = 32
LEAF_ROWS = 10
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
SEED = 3

# Kinds of bytes that are counted, with the bytes of each. Fixed values.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+_<>/{}[]",
    "quote": b"\"'()-`",
    "line": b"\n\r",
    "space": b" \t\x0b\x0c",
}
STATISTICS = [
    "chars", "words", "word_chars", "long_words", "short_words", "distinct_words", "repeated_words", "repeated_pairs",
    *(f"{k}_share" for k in KINDS), "beyond_ascii_share", "words_a_line", "stops_a_word",
]


def _codes() -> np.ndarray:
    codes = np.zeros(256, dtype=np.int64)  # 0: control bytes
    for i, kind in enumerate(KINDS.values(), 1):
        codes[list(kind)] = i
    codes[0x80:0xC0], codes[0xC0:] = len(KINDS) + 1, len(KINDS) + 2  # inside a character, its first byte
    return codes


_CODES = _codes()


def _per_text(words: wordhash.Words, flags: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[words.first]).astype(float)


def statistics_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of `STATISTICS` for each text."""
    n, size = len(at) - 1, len(KINDS) + 3
    text = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(text * size + _CODES[data], minlength=n * size).reshape(n, size).astype(float)
    chars = counts.sum(axis=1) - counts[:, len(KINDS) + 1]
    start, end = wordhash.spans(data, at, wordhash.PLAIN)
    words = wordhash.words(data, at, wordhash.PLAIN)
    length, of = end - start, words.text_of()
    number = np.diff(words.first).astype(float)
    same = np.zeros(len(of), dtype=bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])
    pairs = np.zeros(len(of), dtype=bool)
    pairs[2:] = (words.hashes[2:] == words.hashes[:-2]) & (of[2:] == of[:-2])
    order = np.lexsort((words.hashes, of))
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    some, c = np.maximum(number, 1), np.maximum(chars, 1)
    kinds = counts[:, 1 : len(KINDS) + 1]
    columns = [
        np.log1p(chars), np.log1p(number), _per_text(words, length) / some, _per_text(words, length > 15) / some,
        _per_text(words, length < 4) / some, _per_text(words, fresh) / some, _per_text(words, same) / some, _per_text(words, pairs) / some,
        *(kinds[:, i] / c for i in range(len(KINDS))), counts[:, -1] / c,
        number / (kinds[:, list(KINDS).index("line")] + 1), kinds[:, list(KINDS).index("stop")] / some,
    ]
    return np.column_stack(columns).astype(np.float64) if n else np.zeros((0, len(STATISTICS)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs`, which need a column text or whole rows in a column row, with `stats`, an array of the statistics, in place of
    the column text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = wordhash.buffers(wordhash.texts(batch))
            parts = [statistics_of(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in wordhash.chunks(at)]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            offsets = np.arange(0, values.size + 1, len(STATISTICS), dtype=np.int32)
            stats = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), stats], names=[*names, "stats"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(measure, ", ".join([*rest, "stats array<double>"]))


# --- rules


@dataclass(frozen=True)
class Rule:
    """Statistics that lie above (or not above) thresholds, all of them: (statistic, above, threshold)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, stats: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, ((stats[:, i] > t) == above for i, above, t in self.parts))

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, ((stats[i] > t) if above else (stats[i] <= t) for i, above, t in self.parts))

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[i]} {'>' if above else '<='} {t:.4g}" for i, above, t in self.parts)


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))"""

    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def scores(self, stats: np.ndarray) -> np.ndarray:
        total = np.full(len(stats), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * rule.holds(stats)
        return 1 / (1 + np.exp(-total))

    def column(self, stats: Column) -> Column:
        terms = [F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(
    binned: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, slope: np.ndarray, bend: np.ndarray, path: tuple, out: list, step: np.ndarray
) -> None:
    """Splits `rows` on the best threshold, notes the path of every node, and sets the leaves' steps."""
    total, curve = slope[rows].sum(), bend[rows].sum()
    step[rows] = RATE * total / (curve + 1.0)
    if len(path) == DEPTH or len(rows) < 2 * LEAF_ROWS:
        return
    best = (1e-6, -1, -1)
    for i in range(binned.shape[1]):
        size = len(edges[i]) + 1
        if size == 1:
            continue
        s = np.cumsum(np.bincount(binned[rows, i], slope[rows], size))[:-1]
        b = np.cumsum(np.bincount(binned[rows, i], bend[rows], size))[:-1]
        n = np.cumsum(np.bincount(binned[rows, i], minlength=size))[:-1]
        gain = s**2 / (b + 1) + (total - s) ** 2 / (curve - b + 1) - total**2 / (curve + 1)
        gain[(n < LEAF_ROWS) | (len(rows) - n < LEAF_ROWS)] = 0
        k = int(gain.argmax())
        best = max(best, (float(gain[k]), i, k))
    _, i, k = best
    if i < 0:
        return
    over = binned[rows, i] > k
    for above in (False, True):
        part = (*path, (i, above, float(edges[i][k])))
        out.append(Rule(part))
        _grow(binned, edges, rows[over == above], slope, bend, part, out, step)


def propose_rules(stats: np.ndarray, label: np.ndarray, seed: int = SEED) -> list[Rule]:
    """The paths of all nodes of boosted trees, each once."""
    edges = [np.unique(np.quantile(stats[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(stats.shape[1])]
    edges = [e[e < stats[:, i].max()] for i, e in enumerate(edges)]
    binned = np.column_stack([np.searchsorted(e, stats[:, i], "left") for i, e in enumerate(edges)])
    score, rng, rules = np.zeros(len(label)), np.random.default_rng(seed), []
    for _ in range(TREES):
        p = _sigmoid(score)
        rows, step = np.flatnonzero(rng.random(len(label)) < 0.7), np.zeros(len(label))
        found: list[Rule] = []
        if len(rows):
            _grow(binned, edges, rows, label - p, p * (1 - p), (), found, step)
        rules += found
        leaves = [r for r in found if len(r.parts) == DEPTH] or found
        for rule in leaves:
            holds = rule.holds(stats)
            inside = rows[holds[rows]]
            if len(inside):
                score[holds] += step[inside[0]]
    unique = {}
    for rule in rules:  # the same rows: the shorter rule stays
        unique.setdefault(rule.holds(stats).tobytes(), rule)
    return list(unique.values())


def _lasso(x: np.ndarray, label: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic weights, the last one free, with an L1 penalty on the others: accelerated proximal gradient steps."""
    lipschitz = 0.25 * float(np.linalg.norm(x, 2) ** 2) / len(x) if len(x) else 1.0
    weights, ahead, t = start, start, 1.0
    for _ in range(rounds):
        new = ahead - x.T @ (_sigmoid(x @ ahead) - label) / len(x) / lipschitz
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / lipschitz, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - weights)
        moved, weights, t = np.abs(new - weights).max(), new, t_new
        if moved < 1e-5:
            break
    return weights


def fit_rules(stats: np.ndarray, label: np.ndarray, seed: int = SEED) -> RuleModel:
    """Proposes rules and weighs them; the penalty is the one that does best on a fifth of the rows kept back."""
    if len(label) == 0:
        return RuleModel(0.0, (), ())
    share = (label.sum() + 0.5) / (len(label) + 1)
    rules = propose_rules(stats, label, seed) if 0 < label.sum() < len(label) else []
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    x = np.column_stack([*(r.holds(stats) for r in rules), np.ones(len(label))]).astype(np.float64)
    back = np.random.default_rng(seed).random(len(label)) < 0.2
    weights, best = np.zeros(x.shape[1]), (math.inf, PENALTIES[-1])
    if 10 <= back.sum() < len(label):
        for penalty in PENALTIES:
            weights = _lasso(x[~back], label[~back], penalty, weights)
            p = np.clip(_sigmoid(x[back] @ weights), 1e-6, 1 - 1e-6)
            loss = -float(np.mean(label[back] * np.log(p) + (1 - label[back]) * np.log(1 - p)))
            best = min(best, (loss, penalty))
    weights = _lasso(x, label, best[1], weights)
    kept = np.flatnonzero(weights[:-1])
    return RuleModel(float(weights[-1]), tuple(rules[i] for i in kept), tuple(float(weights[i]) for i in kept))


# --- Spark


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> RuleModel:
    """A model from at most `sample` labelled documents outside the held-out fold."""
    given = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    given = given.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    texts = texts.join(F.broadcast(given), "doc_id")  # at most `sample` rows of two numbers
    rows = with_statistics(texts).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(sample)
    rows = rows.select("doc_id", "quality", "stats").collect()
    rows.sort(key=lambda r: (r.doc_id, r.stats))
    stats = np.array([r.stats for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_rules(stats, np.array([float(r.quality >= 0.5) for r in rows]))


def scored(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = with_statistics(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    rows = rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), model.column(F.col("stats")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with the columns they had."""
    rows = with_statistics(docs.select(F.struct(*docs.columns).alias("row")))
    return rows.where(model.column(F.col("stats")) >= threshold).select("row.*")
