"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
rows: at most ``per_language`` segments of each language and ``MOST`` in all, found by a hash of the
document. At prediction every text is cut into segments of ``SEGMENT`` bytes, each byte position of every segment
gets a distribution over languages, and the document's probability is the mean over all positions.

Defined results: a text that is null or has no letter is ``und`` with score 1; with no labelled rows
everything is ``und``; null languages are not learned; an empty table gives an empty result; rows
that repeat a doc_id are predicted each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, written

SEGMENT = 128
HIDDEN = 8
#: Segments of the training sample in all, and so languages that can be learned.
MOST = 60_000
#: The symbol behind a text's end in its last segment.
PAD = 256


def segments(texts: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(segments by positions, document of each segment); the last segment of a text is padded.

    Reads of a network go along positions, so callers hand it the transposed cells.
    """
    counts = np.array([-(-len(t) // size) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    cells = np.full((int(counts.sum()), size), PAD, dtype=np.int16)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        if n:
            cells[at : at + n].reshape(-1)[: len(text)] = np.frombuffer(text, np.uint8)
            at += n
    return cells, owner


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function of candidates and, moved to 0..1, of gates."""
    x /= np.abs(x) + np.float32(1)
    return x


def _slope(s: np.ndarray) -> np.ndarray:
    """Derivative of the squashing function by its value."""
    return (1 - np.abs(s)) ** 2


class Network:
    """Weights and both passes; ``w`` maps a name to an array.

    Names: x and h for what the byte and the state give to the update gate z, the reset gate r and
    the candidate n, of direction f or b; o and c for the labels.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        k = len(languages)
        self.languages, self.hidden = languages, hidden
        self.w = {}
        for d in "fb":
            for gate in "zrn":
                self.w[f"x{gate}{d}"] = g.normal(0, 0.5, (PAD + 1, hidden)).astype(np.float32)
                self.w[f"h{gate}{d}"] = g.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
        self.w["o"] = g.normal(0, 0.5, (2 * hidden, k)).astype(np.float32)
        self.w["c"] = np.zeros(k, np.float32)

    def states(self, cells: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (position, segment, unit) of one direction; ``cells`` is (position, segment)."""
        t, n = cells.shape
        xz, xr, xn, hz, hr, hn = (self.w[a + b + d] for a in "xh" for b in "zrn")
        out, h = np.empty((t, n, self.hidden), xz.dtype), np.zeros((n, self.hidden), xz.dtype)
        half = xz.dtype.type(0.5)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            at = cells[i]
            z = h @ hz
            z += xz.take(at, axis=0)
            z = _soft(z)
            z *= half
            z += half
            r = h @ hr
            r += xr.take(at, axis=0)
            r = _soft(r)
            r *= half
            r += half
            rh = r * h
            c = rh @ hn
            c += xn.take(at, axis=0)
            c = _soft(c)
            if keep is not None:
                keep.append((i, h, z, r, rh, c))
            new = out[i]
            np.subtract(c, h, out=new)
            new *= z
            new += h
            h = new
        return out

    def positions(self, cells: np.ndarray) -> np.ndarray:
        """Probabilities (position, segment, language), 0 behind a text's end."""
        t, n = cells.shape
        both = self.states(cells, "f").reshape(t * n, -1) @ self.w["o"][: self.hidden]
        both += self.states(cells, "b").reshape(t * n, -1) @ self.w["o"][self.hidden :]
        both += self.w["c"]
        # States lie within -1..1, so that logits are small and need no shift.
        np.exp(both, out=both)
        total = (both @ np.ones(both.shape[1], both.dtype)).reshape(t, n)
        both *= ((cells != PAD) / total).astype(both.dtype).reshape(-1, 1)
        return both.reshape(t, n, -1)

    def gradients(self, cells: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions and its gradient, by backpropagation through time."""
        h_, (t, n) = self.hidden, cells.shape
        kept = {"f": [], "b": []}
        hs = {d: self.states(cells, d, kept[d]) for d in "fb"}
        logits = hs["f"] @ self.w["o"][:h_] + hs["b"] @ self.w["o"][h_:] + self.w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        weight = (cells != PAD).astype(p.dtype)
        weight /= weight.sum()
        loss = float(-(np.log(p[:, np.arange(n), labels] + 1e-9) * weight).sum())
        p[:, np.arange(n), labels] -= 1
        p *= weight[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        flat = p.reshape(t * n, -1)
        g["c"] = flat.sum(axis=0)
        g["o"] = np.concatenate([hs[d].reshape(t * n, h_).T @ flat for d in "fb"])
        for d, o in (("f", self.w["o"][:h_]), ("b", self.w["o"][h_:])):
            up, dh = p @ o.T, np.zeros((n, h_), p.dtype)
            seen = {b: np.empty((t, n, h_), p.dtype) for b in "zrn"}
            for i, h, z, r, rh, c in reversed(kept[d]):
                dh = dh + up[i]
                dn = dh * z * _slope(c)
                drh = dn @ self.w["hn" + d].T
                dz = dh * (c - h) * _slope(2 * z - 1) * 0.5
                dr = drh * h * _slope(2 * r - 1) * 0.5
                for b, x, source in (("z", dz, h), ("r", dr, h), ("n", dn, rh)):
                    g["h" + b + d] += source.T @ x
                    seen[b][i] = x
                dh = dh * (1 - z) + drh * r + dz @ self.w["hz" + d].T + dr @ self.w["hr" + d].T
            byte = cells.reshape(-1)
            for b in "zrn":
                every = seen[b].reshape(t * n, h_)
                for u in range(h_):
                    g["x" + b + d][:, u] = np.bincount(byte, every[:, u], PAD + 1)
        return loss, g

    def fit(self, cells: np.ndarray, labels: np.ndarray, steps: int = 250, batch: int = 256, rate: float = 0.03, seed: int = 11) -> list[float]:
        """Adam over shuffled segments."""
        draw, losses = np.random.default_rng(seed), []
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = draw.integers(0, cells.shape[1], min(batch, cells.shape[1]))
            loss, g = self.gradients(cells[:, pick], labels[pick])
            losses.append(loss)
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((x * x).sum() for x in g.values())))))
            lr = rate * (1 - 0.9 * step / steps)
            for k, x in g.items():
                x *= scale
                first[k] += 0.1 * (x - first[k])
                second[k] += 0.001 * (x * x - second[k])
                self.w[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return losses


def training_sample(docs: DataFrame, per_language: int) -> pd.DataFrame:
    """At most ``per_language`` segments of each language as (lang, text); one segment of a document.

    With many languages each has fewer, so that all have ``MOST`` together, but never none; beyond
    ``MOST`` languages only the most frequent are learned.

    Documents are taken by a hash of the id below a share that the language's count sets, then by
    its order, so a language that holds most rows is thinned before it is sorted.
    """
    train_rows = docs.where((crc_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
    known = train_rows.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "k_lang")
    known = written(known.orderBy(F.desc("n"), "k_lang").limit(MOST))
    languages = known.count()
    per_language = max(1, min(per_language, MOST // max(languages, 1)))
    known = F.broadcast(known)  # at most MOST rows
    salt = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - SEGMENT + 1, F.lit(1))) + 1
    cut = train_rows.where(F.col("text").rlike(r"\p{L}")).select("lang", salt.alias("salt"), F.substring("text", start.cast("int"), F.lit(SEGMENT)).alias("text"))
    thin = cut.join(known, F.col("lang") == F.col("k_lang")).where(F.col("salt") < F.least(F.lit(1.0), (3.0 * per_language + 30) / F.col("n")) * (1 << 30))
    ranked = thin.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("salt", "text")))
    return ranked.where(F.col("nth") <= per_language).select("lang", "text").orderBy("lang", "text").toPandas()


def train(docs: DataFrame, per_language: int = 1500, steps: int = 250) -> Network | None:
    """A network fitted on the training rows (crc32 of the id as text, modulo 3, is not 1)."""
    sample = training_sample(docs, per_language)
    languages = sorted(set(sample["lang"]))
    if not languages:
        return None
    cells, owner = segments([t.encode("utf-8", "surrogatepass")[:SEGMENT] for t in sample["text"]])
    labels = np.searchsorted(np.array(languages, dtype=object), sample["lang"].to_numpy(dtype=object))[owner]
    # Languages weigh alike whatever their share of rows.
    each = [np.flatnonzero(labels == k) for k in range(len(languages))]
    most = max(map(len, each))
    even = np.concatenate([np.resize(x, most) for x in each])
    net = Network(languages)
    net.fit(np.ascontiguousarray(cells[even].T), labels[even], steps=steps)
    return net


#: Bytes of texts whose segments are laid out at once (a longer text is alone), and numbers in one block of labels.
TEXTS, BLOCK = 4 << 20, 1 << 22


def predict_batch(net: Network | None, texts: list) -> tuple[list[str], np.ndarray]:
    """Language and probability of whole texts, in blocks that shrink as languages grow in number."""
    named, score = ["und"] * len(texts), np.ones(len(texts))
    held, size = [], 0
    for i, text in enumerate(texts):
        if net is not None and text and any(map(str.isalpha, text)):
            held.append((i, text.encode("utf-8", "surrogatepass")))
            size += len(held[-1][1])
        if held and (size >= TEXTS or i == len(texts) - 1):
            for k, best, x in _predicted(net, held):
                named[k], score[k] = net.languages[best], x
            held, size = [], 0
    return named, score


def _predicted(net: Network, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, float]]:
    cells, owner = segments([raw for _, raw in held])
    total = np.zeros((len(held), len(net.languages)))
    rows = max(1, min(1024, BLOCK // (SEGMENT * len(net.languages))))
    for at in range(0, len(cells), rows):
        p = net.positions(np.ascontiguousarray(cells[at : at + rows].T, dtype=np.intp))
        np.add.at(total, owner[at : at + rows], p.sum(axis=0))
    total /= total.sum(axis=1, keepdims=True)
    for (k, _), best, x in zip(held, total.argmax(axis=1).tolist(), total.max(axis=1).tolist(), strict=True):
        yield k, best, min(1.0, x)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named, score = predict_batch(net, batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": named, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = 1500, steps: int = 250) -> DataFrame:
    return identify(docs, train(docs, per_language, steps))
