"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is the mean weight of its hashed features (words, word shapes, repetitions); ordered
thresholds turn it into the chance of each grade: P(grade > k) = sigmoid(score - threshold k). Weights
are shared by all grades. The fit takes at most TRAINING labelled documents. Each document gets its
expected grade and tail probability P(grade >= the top one), by which documents are selected.

Defined results: null and empty texts have no features and score 0, the middle; without labels all
grades are 0 and everything is kept; repeated rows get equal results; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tracewright.session import ship

from .common import Rows, descend, labelled_texts, over_texts, sigmoid, table, words_of

TRAINING = 8_000
WIDTH = 1 << 16
#: Least tail probability of a document that is kept.
KEEP = 0.2
REMEMBERED = 300_000
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


class Features:
    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def columns(self, word: str) -> tuple[int, int]:
        """Columns of a word and of its shape (letters as a, digits as 0)."""
        at = self.known.get(word)
        if at is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            shape = DIGITS.sub("0", LETTERS.sub("a", word))[:12]
            at = self.known[word] = (xxhash.xxh64_intdigest("w" + word.lower()) % WIDTH, xxhash.xxh64_intdigest("s" + shape) % WIDTH)
        return at

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(columns, shares): mean over the words of their word, shape and repetition features."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        n = len(words)
        cols = np.array([self.columns(w) for w in words], dtype=np.int64)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        lines = [x for x in text.split("\n") if x.strip()]
        copied = len(lines) - len(set(lines))
        extra = {"r-next": again / n, "r-known": 1 - len(set(words)) / n, "r-line": copied / max(1, len(lines))}
        at = np.array([xxhash.xxh64_intdigest(k) % WIDTH for k in extra])
        idx, where = np.unique(np.concatenate([cols.ravel(), at]), return_inverse=True)
        val = np.bincount(where, np.concatenate([np.full(2 * n, 1 / n), np.array(list(extra.values()))]))
        return idx, val


class CumulativeLink:
    """Weights and rising thresholds for grades 0 .. K - 1 (values: the ratings themselves)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, values: np.ndarray):
        self.weights, self.thresholds, self.values = weights, thresholds, values

    @classmethod
    def fit(cls, rows: list, ratings: np.ndarray, steps: int = 300, penalty: float = 1e-5) -> CumulativeLink:
        values, grade = np.unique(ratings, return_inverse=True)
        k = len(values) - 1
        if k < 1:
            return cls(np.zeros(WIDTH), np.zeros(0), values if len(values) else np.zeros(1))
        x = Rows(rows, WIDTH)
        at = np.clip([np.mean(grade > i) for i in range(k)], 1e-3, 1 - 1e-3)
        first = -np.log(at / (1 - at))
        start = np.concatenate([np.zeros(WIDTH), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])

        def thresholds(tail):
            return tail[0] + np.concatenate([[0], np.cumsum(np.exp(tail[1:]))])

        def gradient(p):
            t, s = thresholds(p[WIDTH:]), x.times(p[:WIDTH])
            up = np.append(t, np.inf)[grade] - s
            low = np.concatenate([[-np.inf], t])[grade] - s
            a, b = sigmoid(up), sigmoid(low)
            chance = np.maximum(a - b, 1e-9)
            da, db = a * (1 - a) / chance, b * (1 - b) / chance
            n = len(grade)
            by_threshold = (np.bincount(grade, -da, k + 1)[:k] + np.bincount(grade, db, k + 1)[1:]) / n
            later = np.cumsum(by_threshold[::-1])[::-1]
            tail = np.concatenate([later[:1], later[1:] * np.exp(p[WIDTH + 1 :])])
            return np.concatenate([x.back((da - db) / n) + penalty * p[:WIDTH], tail])

        p = descend(gradient, start, steps, 0.5)
        return cls(p[:WIDTH], thresholds(p[WIDTH:]), values)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])

    def judge(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected rating, P(top grade))."""
        score = np.asarray(score, dtype=np.float64)
        if not len(self.thresholds):
            return np.full(len(score), float(self.values[0])), np.ones(len(score))
        tails = self.tails(score)
        return self.values[0] + tails @ np.diff(self.values), tails[:, -1]


def featured(sample: DataFrame) -> tuple[list, np.ndarray]:
    """(features, ratings) of a sample's texts, by key. Texts stay where they are; the driver gets at
    most WIDTH columns for each."""

    def work(batches):
        features = Features()
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("label"), pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["key", "label", "at", "share"])

    ship(sample.sparkSession)
    got = sample.mapInArrow(work, "key string, label long, at array<int>, share array<float>").toPandas().sort_values("key", kind="stable")
    return [(np.asarray(i, np.int64), np.asarray(v, np.float64)) for i, v in zip(got["at"], got["share"], strict=True)], got["label"].to_numpy(dtype=np.int64)


def quality(docs: DataFrame, labels: DataFrame, column: str = "quality", training: int = TRAINING, keep: float = KEEP) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, column -> doc_id, score, expected_grade, tail_probability, kept."""
    rows, ratings = featured(labelled_texts(docs, labels, column, training))
    model = CumulativeLink.fit(rows, ratings)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.values))

    def make():
        features, model = Features(), CumulativeLink(*shared.value)

        def work(batch):
            rows = [features(t) for t in batch]
            scores = np.array([(model.weights[i] * v).sum() for i, v in rows], dtype=np.float64)
            grade, tail = model.judge(scores)
            return {
                "score": pa.array(scores, pa.float64()), "expected_grade": pa.array(grade, pa.float64()), "tail_probability": pa.array(tail, pa.float64()), "kept": pa.array(tail >= keep, pa.bool_()),
            }

        return work

    return over_texts(docs.select("doc_id", "text"), make, "doc_id long, score double, expected_grade double, tail_probability double, kept boolean")


def query(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
