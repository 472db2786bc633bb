"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from two labels: 0 toxic, 1 not toxic but of low quality, 2 good. One vector of weights
over hashed text features and ordered thresholds give P(grade <= g) = sigmoid(threshold_g - w.x), so
the expected grade and the tail probabilities of one score are consistent.

Every distinct word of the whole text counts with itself (lower-cased, outer punctuation stripped)
and its beginnings of 5 to 8 bytes, the text with a few rates of its shape in steps, all hashed. The
model is fitted on at most ``most`` labelled rows with at most ``FEATURES`` features in all, taken by a
hash of the id; the fifth of labelled rows whose crc32 is divisible by 5 is never among them.

Defined results: null or empty text has no feature and gets the grades' base rates; without labelled
rows every grade is alike; labels that are null are not learned from; an empty table gives an empty
result; rows that repeat a doc_id are scored each; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, written

BITS = 18
GRADES = 3
PREFIXES = (5, 6, 7, 8)
#: Features that the fit handles at once, and that its sample may have in all.
PART = 500_000
FEATURES = 8_000_000
#: A text has hundreds of words but four rates, which count so many times for it.
SHAPE_TIMES = 12
_OUTER = b".,;:!?()[]{}\"'#*$%&|<>-_"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def word_features(raw: bytes) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings."""
    w = raw.strip(_OUTER).lower()
    return tuple(zlib.crc32(x) >> (32 - BITS) for x in (w, *(w[:k] + b"\0" for k in PREFIXES if k <= len(w))))


def shape_features(text: str, raw: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Feature numbers of a text's rates, in twentieths."""
    rates = {
        b"\0symbols": (len(raw) - len(raw.translate(None, _SYMBOLS))) / len(raw),
        b"\0capitals": (len(raw) - len(raw.translate(None, _CAPITALS))) / len(raw),
        b"\0repeats": 1 - distinct / len(words),
    }
    named = [name + str(int(rate * 20)).encode() for name, rate in rates.items()]
    return SHAPE_TIMES * [zlib.crc32(x) >> (32 - BITS) for x in (*named, b"\0length" + str(len(words).bit_length()).encode())]


def features(text: str | None) -> np.ndarray:
    """Feature numbers of a text: those of every distinct word, and of its shape."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return np.zeros(0, np.int64)
    distinct = set(words)
    return np.array([*(n for w in sorted(distinct) for n in word_features(w)), *shape_features(text, raw, words, len(distinct))], dtype=np.int64)


class Scorer(dict):
    """w.x of texts; the sums of words' weights are remembered up to a bound."""

    def __init__(self, w: np.ndarray, most: int = 300_000) -> None:
        super().__init__()
        self.w, self.most = w, most

    def __missing__(self, word: bytes) -> float:
        total = self[word] = sum(self.w[n] for n in word_features(word))
        return total

    def __call__(self, text: str | None) -> float:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        words = raw.split()
        if not words:
            return 0.0
        if len(self) > self.most:
            self.clear()
        distinct = set(words)
        return math.fsum(map(self.__getitem__, distinct)) + sum(self.w[n] for n in shape_features(text, raw, words, len(distinct)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Ordinal:
    """Shared weights and ordered thresholds (the first, then logs of the steps between)."""

    def __init__(self) -> None:
        self.w = np.zeros(1 << BITS)
        self.steps = np.array([-1.0, 0.0])

    def thresholds(self) -> np.ndarray:
        return self.steps[0] + np.concatenate([[0.0], np.cumsum(np.exp(self.steps[1:]))])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1..GRADES-1, by column."""
        return _sigmoid(scores[:, None] - self.thresholds()[None, :])

    def slopes(self, params: np.ndarray, parts: list, grades: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Mean negative log likelihood with its ridge, and the gradient of both.

        ``params``: weights, then steps; ``parts``: (first row, end, feature numbers, their rows).
        """
        k, n = len(self.w), len(grades)
        self.steps = params[k:]
        cuts = self.thresholds()
        s = np.concatenate([np.bincount(own, params[ids], b - a) for a, b, ids, own in parts])
        upper = np.concatenate([_sigmoid(cuts[None, :] - s[:, None]), np.ones((n, 1))], axis=1)
        lower = np.concatenate([np.zeros((n, 1)), upper[:, :-1]], axis=1)
        at = np.arange(n), grades
        p = np.maximum(upper[at] - lower[at], 1e-12)
        slope_u, slope_l = (upper * (1 - upper))[at] / p, (lower * (1 - lower))[at] / p
        ds = (slope_u - slope_l) / n
        g = np.zeros_like(params)
        g[:k] = ridge * params[:k]
        for a, b, ids, own in parts:
            g[:k] += np.bincount(ids, ds[a:b][own], k)
        dcut = np.zeros(len(cuts))
        np.add.at(dcut, np.minimum(grades, len(cuts) - 1), np.where(grades < len(cuts), -slope_u, 0) / n)
        np.add.at(dcut, np.maximum(grades - 1, 0), np.where(grades > 0, slope_l, 0) / n)
        g[k] = dcut.sum()
        for j in range(1, len(cuts)):
            g[k + j] = dcut[j:].sum() * np.exp(params[k + j])
        return float(-np.log(p).mean() + 0.5 * ridge * (params[:k] ** 2).sum()), g

    @staticmethod
    def parts(rows: list[np.ndarray]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Parts of whole rows, so that no temporary grows with the sample."""
        flat, n = np.concatenate(rows).astype(np.int32), len(rows)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        cuts_at = np.unique([0, n, *np.searchsorted(ends, np.arange(0, len(flat), PART)).clip(0, n).tolist()])
        return [(a, b, flat[ends[a] : ends[b]], np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends[a : b + 1]))) for a, b in zip(cuts_at, cuts_at[1:], strict=False)]

    def fit(self, rows: list[np.ndarray], grades: np.ndarray, rounds: int = 200, rate: float = 0.07, ridge: float = 1e-3) -> list[float]:
        """Adam on the mean negative log likelihood with a ridge on the weights."""
        k, parts = len(self.w), self.parts(rows)
        params = np.concatenate([np.zeros(k), self.steps])
        m, v, losses = np.zeros_like(params), np.zeros_like(params), []
        for t in range(1, rounds + 1):
            loss, g = self.slopes(params, parts, grades, ridge)
            losses.append(loss)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params = params - rate * (1 - 0.8 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.steps = params[k:].copy()
        self.w = params[:k].copy()
        return losses


def graded(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(
        F.col("doc_id").alias("l_doc_id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade")
    )


def training_sample(docs: DataFrame, labels: DataFrame, most: int, features_in_all: int) -> pd.DataFrame:
    """grade and feature numbers of the sample's rows, in order of a hash of the id.

    Rows are taken after the join with their texts, so that repeated ids and long texts stay within the
    bounds: at most ``most`` rows, and of them as many as have ``features_in_all`` features together.
    """
    rated = graded(labels).where(crc_mod(F.col("l_doc_id"), 5) != 0).withColumn("salt", F.xxhash64("l_doc_id", F.lit("fit")))
    # More labels than these can't be among the first ``most`` rows, unless they have no text.
    chosen = rated.join(docs.select(F.col("doc_id").alias("t_doc_id")), F.col("l_doc_id") == F.col("t_doc_id"), "left_semi").orderBy("salt", "l_doc_id", "grade").limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"salt": batch["salt"], "grade": batch["grade"], "text_hash": batch["text_hash"], "n": [len(x) for x in ids], "ids": ids})

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_doc_id"))
    made = joined.select("salt", "grade", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, "salt long, grade int, text_hash long, n long, ids array<int>")
    made = written(made.withColumn("row", F.monotonically_increasing_id()))
    order = ["salt", "grade", "text_hash", "row"]
    first = made.select(*order, "n").orderBy(*order).limit(most)
    # At most ``most`` rows of numbers; a text over the bound by itself is left out, the others stay.
    upto = first.where(F.col("n") <= features_in_all).withColumn("upto", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    kept = upto.where(F.col("upto") <= features_in_all).select(F.col("row").alias("k_row"))
    got = made.join(F.broadcast(kept), F.col("row") == F.col("k_row")).select(*order, "ids").toPandas()
    return got.sort_values(["salt", "grade", "text_hash"], kind="stable")


def train(docs: DataFrame, labels: DataFrame, most: int = 6000) -> Ordinal | None:
    """A model fitted on at most ``most`` labelled rows outside the held-out fifth."""
    got = training_sample(docs, labels, most, FEATURES)
    rows = [np.asarray(x, dtype=np.int32) for x in got.pop("ids")]
    if not any(len(r) for r in rows):
        return None
    model = Ordinal()
    model.fit(rows, got["grade"].to_numpy(int))
    return model


def grade(docs: DataFrame, model: Ordinal | None, tail: float) -> DataFrame:
    """doc_id, held_out, p_ge_1, p_ge_2, expected_grade and selected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((None, None) if model is None else (model.w.astype(np.float32), model.steps))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, steps = shared.value
        own, score = Ordinal(), Scorer(w.tolist()) if w is not None else None
        for batch in batches:
            if w is None:
                tails = np.tile([2 / 3, 1 / 3], (len(batch), 1))
            else:
                own.steps = steps
                tails = own.tails(np.array([score(t) for t in batch["text"]]))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "p_ge_1": tails[:, 0], "p_ge_2": tails[:, 1], "expected_grade": tails.sum(axis=1), "selected": tails[:, -1] >= tail}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    flagged = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return flagged.mapInPandas(run, f"doc_id {kind}, held_out boolean, p_ge_1 double, p_ge_2 double, expected_grade double, selected boolean")


def ordinal_quality(docs: DataFrame, labels: DataFrame, most: int = 6000, tail: float = 0.5) -> DataFrame:
    return grade(docs, train(docs, labels, most), tail)
