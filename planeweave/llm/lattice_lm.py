"""Language-model scores by subword lattices.

A text is a sequence of words and one end. The pieces of an existing byte-level vocabulary and their
unigram scores give a word the summed probability of all its segmentations, by a forward recursion in
log space over the word's lattice; words are led by the blank that the vocabulary's pieces carry.
The vocabulary files at hand store no unigram scores but the order in which their pieces were made, so
scores start from a piece's rank (weight 1 / (rank + 100)) and are re-estimated by expectation
maximisation over every distinct training word with its count.

Counting, estimation and scoring run over one table of distinct words that grows with the corpus and
stays distributed. Of it only ``HOT`` frequent, short words go to every task; all other words of a
document meet their row by a shuffle of (document, word, times) that the documents sum up first.

Defined results: null or empty text is the end alone; a null doc_id is trained on as the empty id;
rows that repeat a doc_id are texts of their own; an empty table gives an empty result; with no
training text every count is 0; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written

#: Most words that go to every task, and the longest of them in bytes.
HOT = 150_000
HOT_BYTES = 48
#: Words beyond so many bytes are swept alone.
LONG = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_BITS = 19


class Pieces:
    """The vocabulary as a hash table from a piece's rolling code to its number."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranked = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines)]
        # A word has a blank at its start only, so no other piece can be part of one.
        kept = [(r, p) for r, p in ranked if not p[1:].translate(None, b" \t\n\r\x0b\x0c") != p[1:]]
        self.pieces = [p for _, p in kept]
        self.longest = max(map(len, self.pieces))
        codes = np.array([self._code(p) for p in self.pieces], dtype=np.uint64)
        size = 1 << _BITS
        self.keys, self.ids = np.zeros(size + 64, np.uint64), np.full(size + 64, -1, np.int32)
        for n, (code, slot) in enumerate(zip(codes.tolist(), self.slots(codes).tolist(), strict=True)):
            while self.ids[slot] >= 0:
                slot += 1
            self.keys[slot], self.ids[slot] = code, n
        taken = self.ids >= 0
        run = longest = 0
        for x in taken.tolist():
            run = run + 1 if x else 0
            longest = max(longest, run)
        self.probes = longest
        rank = np.array([r for r, _ in kept], dtype=np.float64)
        weight = 1.0 / (rank + 100.0)
        #: Log scores of the vocabulary's own order, the end apart.
        self.order = np.log(weight / weight.sum())

    @staticmethod
    def _code(piece: bytes) -> int:
        code = 0
        for b in piece:
            code = (code * int(_STEP) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return code

    @staticmethod
    def slots(codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these codes, -1 for none."""
        slot = self.slots(codes)
        out = np.where(self.keys[slot] == codes, self.ids[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.ids[slot] >= 0))
        step = 1
        while len(open_) and step <= self.probes:
            at = slot[open_] + step
            hit = (self.keys[at] == codes[open_]) & (self.ids[at] >= 0)
            out[open_[hit]] = self.ids[at[hit]]
            open_ = open_[~hit & (self.ids[at] >= 0)]
            step += 1
        return out

    def lattice(self, block: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length (rows of bytes): per end position the (start, rows, piece numbers)."""
        n, m = block.shape
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(m + 1)]
        for i in range(m):
            code = np.zeros(n, np.uint64)
            for j in range(i + 1, min(m, i + self.longest) + 1):
                code = code * _STEP + (block[:, j - 1].astype(np.uint64) + np.uint64(1))
                ids = self.find(code)
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    ends[j].append((i, rows, ids[rows]))
        return ends


def _grouped(words: list[bytes], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes by row) of words of equal length, blank first."""
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        if len(w) <= LONG:
            by.setdefault(len(w), []).append(at)
    for length, places in by.items():
        # Longer words come in smaller blocks, so that a block's lattice stays small.
        step = max(1, min(most, (1 << 18) // (length + 1)))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            block = np.frombuffer(b"".join(b" " + words[p] for p in part), np.uint8).reshape(len(part), length + 1)
            yield np.array(part), block


def _gather(store: np.ndarray, j: int, start: np.ndarray, rows: np.ndarray, add: np.ndarray) -> None:
    """store[:, j] takes in log(exp(.) + exp(add)) at ``rows``; a row comes once a call."""
    store[rows, j] = np.logaddexp(store[rows, j], start + add)


def _single(word: bytes, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, piece numbers) of one long word's lattice, by end."""
    cells = np.frombuffer(b" " + word, np.uint8).astype(np.uint64) + np.uint64(1)
    code, found = np.zeros(len(cells), np.uint64), []
    for size in range(1, min(pieces.longest, len(cells)) + 1):
        code = code[: len(cells) - size + 1] * _STEP + cells[size - 1 :]
        ids = pieces.find(code)
        at = np.flatnonzero(ids >= 0)
        found.append((at, at + size, ids[at]))
    starts, ends, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(ends, kind="stable")
    return starts[order], ends[order], ids[order]


def _sweep(size: int, source: list[int], to: list[int], scores: list[float]) -> np.ndarray:
    """Log sums of all paths from the first source's place along arcs that come in order of ``to``."""
    total = [-math.inf] * size
    total[source[0]] = 0.0
    for a, b, s in zip(source, to, scores, strict=True):
        x, y = total[a] + s, total[b]
        if x > y:
            x, y = y, x
        total[b] = y if x == -math.inf else y + math.log1p(math.exp(x - y))
    return np.array(total)


def log_likelihoods(words: list[bytes], pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """Natural log of every word's probability, summed over all its segmentations."""
    out = np.zeros(len(words))
    for places, block in _grouped(words):
        n, m = block.shape
        alpha = np.full((n, m + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j, steps in enumerate(pieces.lattice(block)):
            for i, rows, ids in steps:
                _gather(alpha, j, alpha[rows, i], rows, scores[ids])
        out[places] = alpha[:, m]
    for at, word in enumerate(words):
        if len(word) > LONG:
            starts, ends, ids = _single(word, pieces)
            out[at] = _sweep(len(word) + 2, starts.tolist(), ends.tolist(), scores[ids].tolist())[-1]
    return out


def expected_counts(words: list[bytes], weights: np.ndarray, pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the words, by forward and backward sums."""
    total = np.zeros(len(scores))
    for places, block in _grouped(words):
        n, m = block.shape
        ends = pieces.lattice(block)
        alpha, beta = np.full((n, m + 1), -np.inf), np.full((n, m + 1), -np.inf)
        alpha[:, 0], beta[:, m] = 0.0, 0.0
        for j in range(m + 1):
            for i, rows, ids in ends[j]:
                _gather(alpha, j, alpha[rows, i], rows, scores[ids])
        for j in range(m, -1, -1):
            for i, rows, ids in ends[j]:
                _gather(beta, i, beta[rows, j], rows, scores[ids])
        whole, share = alpha[:, m], weights[places]
        for j in range(m + 1):
            for i, rows, ids in ends[j]:
                use = np.exp(alpha[rows, i] + scores[ids] + beta[rows, j] - whole[rows]) * share[rows]
                total += np.bincount(ids, use, len(scores))
    for at, word in enumerate(words):
        if len(word) > LONG:
            starts, ends, ids = _single(word, pieces)
            alpha = _sweep(len(word) + 2, starts.tolist(), ends.tolist(), scores[ids].tolist())
            back = np.argsort(-starts, kind="stable")
            beta = _sweep(len(word) + 2, ends[back].tolist(), starts[back].tolist(), scores[ids[back]].tolist())
            total += np.bincount(ids, np.exp(alpha[starts] + scores[ids] + beta[ends] - alpha[-1]) * weights[at], len(scores))
    return total


def word_counts(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """word (lower-cased bytes), n (uses in all texts) and c (uses in training texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": list(every), "n": list(every.values()), "c": [train[w] for w in every]})

        every, train = Counter(), Counter()
        for batch in batches:
            for text, held_out in zip(batch["text"], batch["held_out"], strict=True):
                if text:
                    words = text.encode("utf-8", "surrogatepass").lower().split()
                    every.update(words)
                    if not held_out:
                        train.update(words)
            if len(every) > 400_000:
                yield rows()
                every, train = Counter(), Counter()
        yield rows()

    flagged = docs.select("text", (crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"))
    return flagged.mapInPandas(run, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def estimated(words: DataFrame, path: str, ends: int, rounds: int) -> tuple[np.ndarray, float]:
    """Natural-log scores of pieces and of the end after ``rounds`` of expectation maximisation."""
    pieces = Pieces(path)
    scores, end = pieces.order + math.log(0.9), math.log(0.1)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(scores)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Pieces(path)
            total = np.zeros(len(shared.value))
            for batch in batches:
                total += expected_counts(batch["word"].tolist(), batch["c"].to_numpy(np.float64), own, shared.value)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": used, "uses": total[used]})

        # At most as many rows as the vocabulary has.
        sums = words.where("c > 0").select("word", "c").mapInPandas(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(len(scores), 0.01)
        uses[sums["piece"].to_numpy(int)] += sums["uses"].to_numpy(float)
        everything = uses.sum() + ends + 1
        scores, end = np.log(uses / everything), math.log((ends + 1) / everything)
    return scores, end


def lattice_lm(docs: DataFrame, path: str, rounds: int = 1, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``path``: the vocabulary, one line per piece; ``rounds``: of expectation maximisation.
    """
    spark = docs.sparkSession
    counts = written(word_counts(docs, modulus, held))
    of = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = docs.where(crc_mod(F.col("doc_id"), modulus) != held).count()
    n, v = of["n"] + ends, of["v"] + (ends > 0)
    scores, end = estimated(counts, path, ends, rounds)
    shared = spark.sparkContext.broadcast(scores)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(path)
        for batch in batches:
            words = batch["word"].tolist()
            yield pd.DataFrame({"word": words, "n": batch["n"], "c": batch["c"], "lp": log_likelihoods(words, pieces, shared.value) / math.log(10)})

    weighed = written(counts.mapInPandas(weigh, "word binary, n long, c long, lp double"))
    # The least use that at most HOT words reach, from a histogram of bounded size.
    short = weighed.where(F.length("word") <= HOT_BYTES)
    steps = short.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, room = None, HOT
    for step in steps:
        room -= step["words"]
        if room < 0:
            break
        least = step["n"]
    hot = short.where(F.col("n") >= least).select("word", "c", "lp").toPandas() if least is not None else pd.DataFrame({"word": [], "c": [], "lp": []})
    known = spark.sparkContext.broadcast(
        {w: (math.log10(c + 1), int(c > 0), lp) for w, c, lp in zip(map(bytes, hot["word"]), hot["c"].tolist(), hot["lp"].tolist(), strict=True)}
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = known.value
        for batch in batches:
            rows = []
            for row, doc_id, held_out, text in zip(batch["row"], batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                found = [x for w in words if (x := frequent.get(w)) is not None]
                rare = Counter(w for w in words if w not in frequent) if len(found) < len(words) else {}
                logs, seen, lps = zip(*found, strict=True) if found else ((), (), ())
                rows.append((row, doc_id, held_out, len(words), math.fsum(logs), sum(seen), math.fsum(lps), list(rare), list(rare.values())))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "held_out", "words", "log_c", "seen", "lp", "rare", "times"]).astype({"doc_id": batch["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"), "text")
    parts = written(numbered.mapInPandas(split, f"row long, doc_id {kind}, held_out boolean, words long, log_c double, seen long, lp double, rare array<binary>, times array<int>"))
    asked = parts.select("row", F.inline(F.arrays_zip("rare", "times")))
    met = asked.join(weighed.select(F.col("word").alias("rare"), "c", F.col("lp").alias("w_lp")), "rare")
    sums = met.groupBy(F.col("row").alias("m_row")).agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("m_log_c"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("m_seen"), F.sum(F.col("times") * F.col("w_lp")).alias("m_lp")
    )
    joined = parts.drop("rare", "times").join(sums, F.col("row") == F.col("m_row"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"),
        (F.col("seen") + zero("m_seen") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + zero("m_log_c") + math.log10(ends + 1) - (F.col("words") + 1) * math.log10(n + v + 1)).alias("base_score"),
        (F.col("lp") + zero("m_lp") + end / math.log(10)).alias("score"),
    )
