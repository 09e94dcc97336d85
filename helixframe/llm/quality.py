"""Quality scoring by Bradley-Terry pairwise ranking.

Each document is a few numbers that describe its form (repetition, case, symbols, word shape). From a
bounded sample of labelled rows, pairs of a better and a worse document are drawn, and a linear score is
learned by logistic loss on the differences of their features, which is the Bradley-Terry model: the
probability that a beats b is the sigmoid of the difference of their scores. The threshold is the
quantile of the sample's scores that separates the labels best; scores are mapped to 0..1 around it.

The features take the whole text in one pass, and scoring is a map over documents: nothing is shuffled.

Defined results: null and empty texts have features of their own (no words) and a score like any
other; without a labelled example of both kinds every score is 1; every input row gives one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, raw, ship, slices
from .learning import CUT, MAX_LABELLED, best_cut, crc_of, labelled_texts, newton, to_unit

#: Pairs that the ranking is learned from, drawn in equal parts over the worse documents.
PAIRS = 200_000
#: Classes of bytes of the UTF-8 text that are counted.
SYMBOLS, STOPS, BARS, DIGITS = b"%$&*#@+=<>^~\\_{}[]", b".", b"|", b"0123456789"
CALLS = b"!?"
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
NAMES = ("empty", "length", "symbols", "calls", "bars", "digits", "upper", "stops", "letters", "shouted", "adjacent", "distinct", "word_length", "spread", "long_words", "top", "repeated_lines", "line_length", "title")


def without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def describe(text: bytes) -> list[float]:
    """The features of one text; shares are of its bytes, words or lines."""
    w = text.split()
    n, size = len(w), len(text)
    if not n:
        return [1.0] + [0.0] * (len(NAMES) - 1)
    lengths = np.fromiter(map(len, w), dtype=np.int64, count=n)
    lines = text.split(b"\n")
    held = Counter(w)
    mean = lengths.mean()
    return [
        0.0,
        np.log1p(n),
        *(np.log1p(100 * without(text, c) / size) for c in (SYMBOLS, CALLS, BARS, DIGITS, UPPER, STOPS)),
        without(text, LETTERS) / size,
        sum(map(bytes.isupper, w)) / n,
        np.log1p(100 * sum(map(eq, w, w[1:])) / n),
        len(held) / n**0.8,
        mean,
        lengths.std() / mean,
        (lengths > 20).mean(),
        np.log1p(100 * (max(held.values()) - 1) / n),
        1 - len(set(lines)) / len(lines),
        np.log1p(size / len(lines)),
        sum(map(bytes.istitle, w)) / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    cut: float

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return to_unit(self.raw_score(x), self.cut, 1.0) if len(self.coef) else np.ones(len(x))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features with their squares: what is bad may lie at both ends."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, z**2])


def balanced(pred: np.ndarray, y: np.ndarray) -> float:
    return pred[y == 1].mean() + (~pred[y == 0]).mean()


def rank(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """x: features of labelled rows; y: 1 for the better ones."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(0), 0.0)
    model = Model(x.mean(0), x.std(0) + 1e-6, np.zeros(0), 0.0)
    z = expand((x - model.mean) / model.scale)
    rng = np.random.default_rng(seed)
    wins, loses = rng.choice(good, pairs), np.resize(rng.permutation(bad), pairs)
    # P(good beats bad) = sigmoid(score difference): logistic loss on feature differences, all of them wins
    model.coef = newton(z[wins] - z[loses], np.ones(pairs), 1e-4 * pairs)
    model.cut = best_cut(z @ model.coef, y, balanced)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, limit: int = MAX_LABELLED) -> Model:
    ship(docs.sparkSession)
    texts = labelled_texts(docs, labels, label, keep, limit)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            x = [describe(t) for texts in slices(b.column(0)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "label", "doc_id"])

    rows = texts.select("text", "label", "doc_id").mapInArrow(run, "x array<double>, label int, doc_id long").collect()  # of the bounded sample
    rows.sort(key=lambda r: r["doc_id"])  # pairs are drawn by place, which must not depend on partitions
    x = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES))
    return rank(x, np.array([r["label"] for r in rows], dtype=int))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (double) and predicted (int)."""
    held = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(texts: pa.Array) -> list:
        s = model.score(np.array([describe(t) for t in raw(texts)]).reshape(-1, len(NAMES)))
        return [pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())]

    return extend(docs.select(*held), F.col(text_col).cast("string"), run, "score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input columns with held_out, score and predicted; labels of held-out rows are never learned from."""
    model = fit(docs, labels, keep=crc_of(F.col("doc_id"), 5) != 0)
    return score(docs.drop("held_out"), model).withColumn("held_out", crc_of(F.col("doc_id"), 5) == 0)
