"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint becomes the bit counts of its 32 two-bit segments. Flipping one bit moves one
count by one, so the Manhattan distance of two embeddings never exceeds their Hamming distance. Of
two halves of the embedding one has at most half the distance, and two grid points at distance r
meet at a point within ceil(r/2) and floor(r/2) of both. So every fingerprint is sent, for each half,
to the grid points within ceil(limit/4) of its own, and fingerprints that meet are verified exactly.

Equal fingerprints are one node. A grid point may gather many near copies: its nodes are compared in
tiles of bounded size, a point over ``tile`` nodes being dealt out as pairs of tiles, and each task
returns a spanning forest of the links that it has found, never all pairs.

Defined results: null or empty text has fingerprint zero, linked like any other; fewer words than a
shingle make one shingle; a null doc_id never is the smallest unless its component has no other; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import components

SEED = 42
#: Bit sums of hashes: byte value -> its 8 bits as the 8 bytes of an integer, so up to 255 rows add without carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, least first."""
    total = np.zeros(64, dtype=np.int64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(columns), 255 * 256):
        spread = _SPREAD[columns[at : at + 255 * 256]]
        sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
        total += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the text's word shingles, repeats included."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
    else:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    majority = bit_sums(hashes) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_hash and the fingerprint as a signed long, by whole texts in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(x, width) for x in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": prints})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, f"doc_id {kind}, text_hash long, fp long")


def grid_points(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, grid point): for each half of the embedding the points within ceil(limit / 4) of the row's own.

    A half has 16 counts of 0..2, packed as 16 two-bit fields; the half's number is the top bit.
    """
    radius = -(-(limit // 2) // 2)
    low = np.uint64(0x5555555555555555)
    counts = (prints & low) + ((prints >> np.uint64(1)) & low)
    rows, points = [], []
    for half in range(2):
        key = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        at, here = np.arange(len(prints)), key
        found = [(at, here)]
        for _ in range(radius):
            step_at, step_to = [], []
            for field in range(16):
                shift = np.uint64(2 * field)
                value = (here >> shift) & np.uint64(3)
                for ok, to in ((value < 2, here + (np.uint64(1) << shift)), (value > 0, here - (np.uint64(1) << shift))):
                    step_at.append(at[ok])
                    step_to.append(to[ok])
            at, here = np.concatenate(step_at), np.concatenate(step_to)
            found.append((at, here))
        rows.append(np.concatenate([x for x, _ in found]))
        points.append(np.concatenate([x for _, x in found]) | np.uint64(half << 32))
    return np.concatenate(rows), np.concatenate(points)


class _Forest:
    """Union-find over fingerprints seen by one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (n := up.get(r, r)) != r:
            r = n
        while (n := up.get(x, x)) != r:
            up[x], x = r, n
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> pd.DataFrame:
        pairs = [(x, self.root(x)) for x in self.up]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")


def _near(a: np.ndarray, b: np.ndarray, limit: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles: places whose exact distance is within the limit."""
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= limit)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def links(nodes: DataFrame, limit: int, tile: int) -> DataFrame:
    """Edges (a, b) between fingerprints at most ``limit`` bits apart, a spanning forest per task."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            for at in range(0, len(values), 4000):
                part = values[at : at + 4000]
                row, point = grid_points(part.view(np.uint64), limit)
                yield pd.DataFrame({"point": point.view(np.int64), "fp": part[row]})

    dealt = written(nodes.mapInPandas(deal, "point long, fp long"))
    # As many rows as the dealt table has divided by ``tile``, at most.
    crowded = dealt.groupBy("point").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    crowded = crowded.select(F.col("point").alias("c_point"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    tiled = dealt.join(crowded, F.col("point") == F.col("c_point"), "left").withColumn("tile", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).otherwise(0))
    against = F.when(F.col("tiles").isNotNull(), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))
    pairs = tiled.select("point", "fp", "tile", F.explode(against).alias("other"))
    pairs = pairs.select("point", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), "tile", "fp")
    together = pairs.repartition("point", "t0", "t1").sortWithinPartitions("point", "t0", "t1", "tile", "fp")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held = _Forest(), None

        def settle(group: np.ndarray) -> None:
            prints, tiles = group[:, 4].copy().view(np.uint64), group[:, 3]
            mixed = group[0, 1] != group[0, 2]
            sides = (prints[tiles == group[0, 1]], prints[tiles == group[0, 2]]) if mixed else (prints, prints)
            if min(len(x) for x in sides) == 0:
                return
            for x in range(0, len(sides[0]), 1024):
                for y in range(0 if mixed else x, len(sides[1]), 1024):
                    a, b = sides[0][x : x + 1024], sides[1][y : y + 1024]
                    i, j = _near(a, b, limit, not mixed and x == y)
                    for p, q in zip(a.view(np.int64)[i].tolist(), b.view(np.int64)[j].tolist(), strict=True):
                        forest.join(p, q)

        for batch in batches:
            rows = batch[["point", "t0", "t1", "tile", "fp"]].to_numpy(np.int64)
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            bounds = [0, *change.tolist(), len(rows)]
            sizes = np.diff(bounds)
            for k in np.flatnonzero(sizes[:-1] > 1).tolist():
                settle(rows[bounds[k] : bounds[k + 1]])
            held = rows[bounds[-2] :]
        if held is not None and len(held) > 1:
            settle(held)
        yield forest.edges()

    return together.mapInPandas(verify, "a long, b long")


def grouped(docs: DataFrame, width: int = 4, limit: int = 4, tile: int = 4096) -> DataFrame:
    """doc_id, text_hash, fp, group (its smallest fingerprint) and component_id of every row."""
    prints = written(fingerprints(docs, width))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    met = links(nodes.select("fp"), limit, tile)
    labels = components(met)
    discard(met)  # the grid points: all links are contracted
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "c_label")
    of = named.join(smallest, F.col("label") == F.col("c_label")).select(F.col("fp").alias("n_fp"), F.col("label").alias("group"), "component_id")
    return prints.join(of, prints["fp"] == of["n_fp"]).drop("n_fp")


def simhash_dedup(docs: DataFrame, width: int = 4, limit: int = 4, tile: int = 4096) -> DataFrame:
    """doc_id, fingerprint and component_id: the smallest doc_id linked to it, itself included."""
    out = grouped(docs, width, limit, tile)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash and rows: of each group the row of smallest doc_id (null last), then of smallest
    hash of its text, and how many rows are equal in both."""
    found = written(grouped(docs, **options))
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    per = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = per.groupBy("group").agg(F.min_by(F.struct("doc_id", "text_hash", "rows"), key).alias("first"))
    return first.select("first.*")
