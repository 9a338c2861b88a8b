"""Problem 2: repetition inside a single document.

Statistics of each document are scored by gradient-boosted trees, trained here on a bounded
sample (about ``SAMPLE`` documents by a hash of their key, a quarter also with made repetitions, all
labelled by the exact measure) and flattened into node arrays that numpy walks for a whole batch at
once. Features that can only speak for repetition are constrained to raise the score. The trees
decide: a document is repetitive from the score ``DECIDES`` on. Only those documents are measured
exactly, which can take a row away but never add one.

No text is shuffled: repeated rows are dropped from the small results.

The exact measure: a word (a run of letters, case ignored) is repeated if it lies in a second or
later occurrence of a run of four or more words of its document; the share is repeated words over
words. Defined results: null, empty and blank texts and texts without letters have share 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table

SAMPLE = 3000
SHARE = 0.4
DECIDES = 0.5
MADE_FOR_ONE_IN = 4
RUN = 4

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

# name, and +1 where a higher value may only raise the score
FEATURES = (
    ("log_words", 0), ("repeated_words", 1), ("repeated_pairs", 1), ("repeated_triples", 1), ("repeated_fours", 1),
    ("repeated_eights", 1), ("repeated_lines", 1), ("repeated_sentences", 1), ("commonest_triple", 1), ("compressibility", 1),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def repeated_share(words: list[str], run: int = RUN) -> float:
    """The exact share; linear in the words."""
    if len(words) < run:
        return 0.0
    seen: set[tuple[str, ...]] = set()
    covered, end = 0, 0
    for i, gram in enumerate(zip(*(words[k:] for k in range(run)))):
        if gram in seen:
            covered += i + run - max(i, end)
            end = i + run
        else:
            seen.add(gram)
    return covered / len(words)


def _again(parts: list) -> float:
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def statistics(text: str | None) -> list[float]:
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    grams = {n: list(zip(*(words[k:] for k in range(n)))) for n in (2, 3, 4, 8)}
    lines = [x.strip().lower() for x in text.split("\n") if x.strip()]
    sentences = [x.strip().lower() for x in SENTENCE.split(text) if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    top = Counter(grams[3]).most_common(1)[0][1] / len(grams[3]) if grams[3] else 0.0
    return [
        float(np.log1p(len(words))), _again(words), _again(grams[2]), _again(grams[3]), _again(grams[4]),
        _again(grams[8]), _again(lines), _again(sentences), top, 1 - min(1.0, len(zlib.compress(raw, 1)) / len(raw)),
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself, so a fixed number of steps reaches it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def train_trees(
    x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 4, ridge: float = 1.0
) -> Trees:
    """Gradient boosting for the logistic loss with second-order leaves and monotonic constraints.

    A split on a constrained feature is refused if its children's values are in the wrong order,
    and the children are bounded by the middle, so no later split below can cross it.
    """
    n = len(y)
    mean = min(max((y.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.empty((0, x.shape[1]), int)
    margin = np.full(n, base)

    def leaf(v: float) -> int:
        at = len(feature)
        feature.append(0)
        threshold.append(0.0)
        left.append(at)
        right.append(at)
        value.append(v)
        return at

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                size = len(edge) + 1
                cg = np.cumsum(np.bincount(code[rows, f], g[rows], size))[:-1]
                ch = np.cumsum(np.bincount(code[rows, f], h[rows], size))[:-1]
                cn = np.cumsum(np.bincount(code[rows, f], minlength=size))[:-1]
                a, b = np.clip(-cg / (ch + ridge), low, high), np.clip(-(total_g - cg) / (total_h - ch + ridge), low, high)
                gain = -(cg * a + 0.5 * (ch + ridge) * a * a + (total_g - cg) * b + 0.5 * (total_h - ch + ridge) * b * b)
                gain += total_g * own + 0.5 * (total_h + ridge) * own * own
                allowed = (cn >= least) & (len(rows) - cn >= least)
                if signs[f]:
                    allowed &= a <= b
                gain = np.where(allowed, gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(a[k]), float(b[k]))
        _, f, k, a, b = best
        if f < 0:
            return leaf(rate * own)
        at = leaf(0.0)
        feature[at], threshold[at] = f, float(edges[f][k])
        goes = code[rows, f] <= k
        middle = (a + b) / 2
        bounds = ((low, middle), (middle, high)) if signs[f] else ((low, high), (low, high))
        left[at] = grow(rows[goes], g, h, level + 1, *bounds[0])
        right[at] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return at

    for _ in range(rounds if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -4.0, 4.0))
        one = Trees(*(np.array(v) for v in (feature, threshold, left, right, value)), np.array(roots[-1:]), depth, 0.0)
        s = one.score(x)
        margin += np.log(s / (1 - s))
    if not roots:
        roots.append(leaf(0.0))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def made_repetitions(text: str, seed: int) -> list[str]:
    """The text with a phrase of its own said over and over at some place, once a little and once often."""
    draw = np.random.default_rng(seed & 0x7FFFFFFF)
    words = text.split(" ")
    out = []
    for most in (0.3, 3.0):
        size = int(draw.integers(3, 40))
        start = int(draw.integers(0, max(1, len(words) - size)))
        times = max(1, int(draw.random() * most * len(words) / size))
        at = int(draw.integers(0, len(words) + 1))
        out.append(" ".join([*words[:at], *(words[start : start + size] * times), *words[at:]]))
    return out


def fit(frame: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Trees:
    """Trees from about ``sample`` rows; their statistics alone come to the driver, at most three rows for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = [t, *made_repetitions(t, h)] if t and t.strip() and h % MADE_FOR_ONE_IN == 0 else [t]
                rows += [[float(h), *statistics(x), repeated_share(words_of(x))] for x in every]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["row"])

    share = sample / max(frame.count(), 1)
    keyed = frame.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    chosen = keyed.filter(F.pmod("h", F.lit(1_000_000)) < F.lit(share * 1_000_000))
    rows = sorted({tuple(r["row"]) for r in chosen.mapInArrow(run, "row array<double>").collect()})
    table_ = np.array(rows, float).reshape(-1, len(FEATURES) + 2)[:, 1:]
    return train_trees(table_[:, :-1], (table_[:, -1] >= SHARE).astype(float), [s for _, s in FEATURES])


def measure(frame: DataFrame, key: str, text: str, trees: Trees, decides: float = DECIDES) -> DataFrame:
    """(key, n_words, score, share) of each row: the share exactly from the score ``decides`` on, else null."""
    source = frame.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = trees.score(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES)))
            words = [words_of(t) for t in texts]
            shares = [repeated_share(w) if s >= decides else None for w, s in zip(words, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())],
                names=["key", "n_words", "score", "share"],
            )

    return source.mapInArrow(run, f"key {kind}, n_words bigint, score double, share double")


def _replies(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "transcriptions").select("reply_id", "markdown_text")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Replies that the trees call repetitive and the exact measure confirms."""
    replies = _replies(spark, directory)
    return measure(replies, "reply_id", "markdown_text", fit(replies, "reply_id", "markdown_text")).filter(F.col("share") >= SHARE).select(F.col("key").alias("reply_id")).distinct()


def p2_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Every reply's number of words and exact share of repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([repeated_share(w) for w in words], pa.float64())], names=["reply_id", "n_words", "share"])

    return _replies(spark, directory).mapInArrow(run, "reply_id bigint, n_words bigint, share double").dropDuplicates(["reply_id"])


def p2_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Every reply's score by the trees."""
    replies = _replies(spark, directory)
    return measure(replies, "reply_id", "markdown_text", fit(replies, "reply_id", "markdown_text")).select(F.col("key").alias("reply_id"), "score").dropDuplicates(["reply_id"])
