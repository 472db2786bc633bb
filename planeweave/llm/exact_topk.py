"""Exact top-k search by integer inner product with block-at-a-time pruning.

Vectors are the documents, their components the terms. Documents are put in order of the nearest of a
bounded number of centres, then of id, and cut into blocks that hold a forward index (the block's rows),
the largest and smallest value of each term, and the block's centre and radius. For a query a block is
bounded by the lesser of two sums: of each term's best possible contribution, and of the centre's score
and the query's length times the radius; the second is tight for dense vectors.

A sample of blocks and queries tells whether bounds leave anything out; it chooses the plan, not the
result. If so there are three passes, so that no vector moves before a bound has been looked at: the blocks' summaries alone
give every query its best block; that block's forward index gives a first k-th score; then only blocks
whose bound reaches the k-th score of some query of a group are sent to that group, where each query
takes its blocks by falling bound and scores them whole until a bound is below its k-th best score. If
not, as in vectors without any structure, only this last pass is made, over all pairs.

Blocks are dealt in shards, queries in groups, and a pair of both is one bounded task; the best k of
each pair are merged at the end.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as filled up with zeros; a query's own row is no candidate of it, rows that repeat an id
are candidates and queries of their own, of each other too; too few candidates give fewer rows; an
empty table gives an empty result. Scores that do not fit 64 bits are held to their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 256
#: Rows of a shard of documents and of a group of queries; shards of wide vectors have fewer.
SHARD, GROUP = 8192, 2048
#: Components that a shard holds at most, but for a single block.
CELLS = 1 << 22
#: Shards whose summaries make one task of the first pass.
CHUNK = 64
#: Centres that order documents, rows sampled for each, and the share of open pairs from which nothing is sorted out beforehand.
PIVOTS, SAMPLED, OPEN = 1024, 8, 0.9
#: A block's columns that bound its scores.
SUMMARY = ["most", "least", "centre", "radius"]
_RANGE = (-(1 << 63), (1 << 63) - 1)
_FOUND = "query long, query_id long, vec_id long, row long, score long"


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles; exact up to 2^53."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where no sum can pass 2^53, else in Python's integers."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), dtype=np.int64)
    if float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1] < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    exact = queries.astype(object).copy()
    exact[:] = [[int(x) for x in row] for row in queries]
    other = np.array([[int(x) for x in row] for row in rows], dtype=object).reshape(rows.shape)
    return np.vectorize(lambda x: min(max(x, _RANGE[0]), _RANGE[1]), otypes=[np.int64])(exact @ other.T)


def upper_bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray, centre: np.ndarray | None = None, radius: np.ndarray | None = None) -> np.ndarray:
    """(query, block): the lesser of the summed best contributions of the terms and, around a block's
    centre, the query times it plus the query's length times the radius; rounded up beyond doubles' error."""
    size = np.abs(queries) @ np.maximum(np.abs(most), np.abs(least)).T
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T + size * 1e-12
    if centre is None:
        return bounds
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.linalg.norm(queries, axis=1)[:, None]
        ball = queries @ centre.T + length * radius + length * (np.linalg.norm(centre, axis=1) + radius) * 1e-12
    # Lengths beyond doubles bound nothing.
    return np.minimum(bounds, np.where(np.isnan(ball), np.inf, ball))


class Block:
    """A forward index: ids and rows of a range of documents, and their term bounds."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.numbers, self.rows = ids, numbers, rows

    @classmethod
    def packed(cls, ids: bytes, numbers: bytes, rows: bytes, width: int) -> Block:
        own = np.frombuffer(ids, np.int64)
        return cls(own, np.frombuffer(numbers, np.int64), np.frombuffer(rows, np.float64).reshape(len(own), width))

    def merge(self, held: list[tuple[int, int, int]], number: int, scores: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """The best k as (-score, id, row) of those held and of this block's rows but the query's own."""
        keep = np.flatnonzero(self.numbers != number)
        if len(held) == k:
            keep = keep[scores[keep] >= -held[-1][0]]
        elif len(keep) > 4 * k:
            # All ties at the k-th stay in.
            keep = keep[scores[keep] >= np.partition(scores[keep], -k)[-k]]
        # Python's integers, as the least score has no opposite in 64 bits.
        new = [(-s, i, n) for s, i, n in zip(scores[keep].tolist(), self.ids[keep].tolist(), self.numbers[keep].tolist(), strict=True)]
        return sorted([*held, *new])[:k] if new else held


def best(blocks: list[Block], bounds: np.ndarray, numbers: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[list[tuple[int, int, int]]]:
    """Every query's best k of the blocks as (-score, id, row), of those that may still count.

    ``floors``: scores that k rows are known to reach; ``bounds``: (query, block). Queries that want the
    same block next are scored together.
    """
    order = np.argsort(-bounds, axis=1, kind="stable")
    held: list[list[tuple[int, int, int]]] = [[] for _ in numbers]
    at = np.zeros(len(numbers), dtype=int)
    active = list(range(len(numbers)))
    while active:
        wanted: dict[int, list[int]] = {}
        for q in active:
            # Equal bounds may still hold an equal score with a smaller id.
            need = max(floors[q], -held[q][-1][0]) if len(held[q]) == k else floors[q]
            if at[q] < len(blocks) and bounds[q, order[q, at[q]]] >= need:
                wanted.setdefault(int(order[q, at[q]]), []).append(q)
        for block, qs in wanted.items():
            for q, row in zip(qs, products(queries[qs], blocks[block].rows), strict=True):
                held[q] = blocks[block].merge(held[q], int(numbers[q]), row, k)
                at[q] += 1
        active = [q for qs in wanted.values() for q in qs]
    yield from held


def pivots(fine: DataFrame, n: int, width: int) -> np.ndarray:
    """Centres that order the documents, at most ``PIVOTS``: means of nearest rows of a sample of bounded size."""
    many = max(1, min(PIVOTS, n // BLOCK, CELLS // (SAMPLED * max(width, 1))))
    sample = _matrix(fine.orderBy(F.xxhash64("vec_id"), "row").limit(many * SAMPLED).toPandas()["v"], width)
    if not len(sample):
        return np.zeros((1, width))
    with np.errstate(over="ignore", invalid="ignore"):
        # Each begins where the ones before are farthest.
        begun, away = [0], np.full(len(sample), np.inf)
        while len(begun) < min(many, len(sample)):
            away = np.fmin(away, ((sample - sample[begun[-1]]) ** 2).sum(axis=1))
            begun.append(int(away.argmax()))
        centres = sample[begun]
        for _ in range(4):
            of = (0.5 * (centres**2).sum(axis=1) - sample @ centres.T).argmin(axis=1)
            for k in np.unique(of):
                centres[k] = sample[of == k].mean(axis=0)
    return centres


def blocked(fine: DataFrame, shards: int, width: int, centres: np.ndarray) -> DataFrame:
    """shard, block, ids, numbers and rows (packed), most, least, centre and radius of every block of documents."""

    @F.pandas_udf("int")
    def nearest(rows: pd.Series) -> pd.Series:
        with np.errstate(over="ignore", invalid="ignore"):
            return pd.Series((0.5 * (centres**2).sum(axis=1) - _matrix(rows, width) @ centres.T).argmin(axis=1), dtype="int32")

    # Ranges of like documents, in order of id; the row's number parts rows that repeat one id.
    ranged = fine.withColumn("pivot", nearest("v")).repartitionByRange(shards, "pivot", "vec_id", "row").withColumn("shard", F.spark_partition_id())

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pivot", "vec_id", "row"], kind="stable")
        ids, numbers, made = rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), []
        ends = [0, *(np.flatnonzero(np.diff(rows["pivot"].to_numpy())) + 1).tolist(), len(rows)]
        cuts = sorted({*ends, *(a for lo, hi in zip(ends, ends[1:], strict=False) for a in range(lo, hi, BLOCK))})
        for nth, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = _matrix(rows["v"].iloc[a:b], width)
            with np.errstate(over="ignore", invalid="ignore"):
                centre = part.mean(axis=0)
                radius = np.linalg.norm(part - centre, axis=1).max() * (1 + 1e-12)
            one = ids[a:b].tobytes(), numbers[a:b].tobytes(), part.tobytes()
            made.append((key[0], (int(key[0]) << 32) + nth, *one, part.max(axis=0).tobytes(), part.min(axis=0).tobytes(), centre.tobytes(), radius))
        return pd.DataFrame(made, columns=["shard", "block", "ids", "numbers", "rows", *SUMMARY])

    shape = "shard int, block long, ids binary, numbers binary, rows binary, most binary, least binary, centre binary, radius double"
    return ranged.groupBy("shard").applyInPandas(run, shape)


def _bounds(queries: np.ndarray, blocks: pd.DataFrame, width: int) -> np.ndarray:
    return upper_bounds(queries, *(_stacked(blocks[c], width) for c in SUMMARY[:3]), blocks["radius"].to_numpy(np.float64))


def open_share(index: DataFrame, queries: DataFrame, width: int, k: int) -> float:
    """Share of (query, block) pairs of a sample of bounded size whose bound reaches the k-th score within the sample."""
    # Of wide vectors fewer blocks.
    blocks = index.orderBy(F.xxhash64("block")).limit(max(1, min(64, CELLS // (BLOCK * max(width, 1))))).toPandas()
    asked = queries.orderBy(F.xxhash64("query")).limit(64).toPandas()
    if not len(blocks) or not len(asked):
        return 1.0
    v, numbers = _stacked(asked["v"], width), asked["query"].to_numpy(np.int64)
    held: list[list] = [[] for _ in numbers]
    for row in blocks[["ids", "numbers", "rows"]].itertuples(index=False):
        own = Block.packed(*row, width)
        held = [own.merge(h, int(q), s, k) for h, q, s in zip(held, numbers, products(v, own.rows), strict=True)]
    floors = np.array([float(-h[-1][0]) if len(h) == k else -np.inf for h in held])
    return float((_bounds(v, blocks, width) >= floors[:, None]).mean())


def _stacked(cells: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), width)


def first_floors(asked: DataFrame, index: DataFrame, summaries: DataFrame, width: int, k: int) -> DataFrame:
    """query and the k-th score of its best block by bound (the least integer, where it has fewer rows)."""

    def nearest(key: tuple, blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(queries):
            return pd.DataFrame({"query": [], "block": [], "bound": []})
        blocks = blocks.sort_values("block")
        bounds = _bounds(_stacked(queries["v"], width), blocks, width)
        top = bounds.argmax(axis=1)
        return pd.DataFrame({"query": queries["query"], "block": blocks["block"].to_numpy()[top], "bound": bounds[np.arange(len(top)), top]})

    near = summaries.groupBy("group", "chunk").cogroup(asked.groupBy("group", "chunk")).applyInPandas(nearest, "query long, block long, bound double")
    chosen = near.groupBy("query").agg(F.max(F.struct("bound", "block")).alias("top")).select("query", F.col("top.block").alias("block"))
    # Queries of one block are dealt in parts of a group's size, so that a block that many want is no hot key.
    sizes = chosen.groupBy("block").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    parted = chosen.join(sizes, "block").select("query", "block", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"))
    vectors = asked.where("chunk = 0").select("query", "v")
    left = index.join(sizes, "block").select("block", "ids", "numbers", "rows", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def score(key: tuple, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"query": [], "least": []})
        own = Block.packed(*block[["ids", "numbers", "rows"]].iloc[0], width)
        numbers, floors = queries["query"].to_numpy(np.int64), []
        for number, row in zip(numbers.tolist(), products(_stacked(queries["v"], width), own.rows), strict=True):
            found = own.merge([], number, row, k)
            floors.append(-found[-1][0] if len(found) == k else _RANGE[0])
        return pd.DataFrame({"query": numbers, "least": floors})

    right = parted.join(vectors, "query")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(score, "query long, least long")


def surviving(asked: DataFrame, summaries: DataFrame, width: int) -> DataFrame:
    """group, shard and either a block that some query of the group needs or a query that needs some block of the shard."""

    def run(key: tuple, blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(queries):
            return pd.DataFrame({"group": [], "shard": [], "block": [], "query": []})
        bounds = _bounds(_stacked(queries["v"], width), blocks, width)
        open_ = bounds >= queries["least"].to_numpy(np.float64)[:, None]
        shards, at = np.unique(blocks["shard"].to_numpy(), return_inverse=True)
        numbers, out = queries["query"].to_numpy(np.int64), []
        needed = np.flatnonzero(open_.any(axis=0))
        out.append(pd.DataFrame({"shard": shards[at[needed]], "block": pd.array(blocks["block"].to_numpy()[needed], "Int64"), "query": pd.NA}))
        for nth, shard in enumerate(shards):
            out.append(pd.DataFrame({"shard": shard, "block": pd.NA, "query": pd.array(numbers[open_[:, at == nth].any(axis=1)], "Int64")}))
        made = pd.concat([x.astype({"block": "Int64", "query": "Int64"}) for x in out])
        made.insert(0, "group", key[0])
        return made

    return summaries.groupBy("group", "chunk").cogroup(asked.groupBy("group", "chunk")).applyInPandas(run, "group int, shard int, block long, query long")


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` of every row whose id is divisible by ``every``."""
    fine = written(usable(vectors).select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v"), F.monotonically_increasing_id().alias("row")))
    of = fine.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = of["width"] or 0
    rows = max(BLOCK, min(SHARD, CELLS // max(width, 1)))
    shards, groups = -(-of["n"] // rows) or 1, -(-of["q"] // GROUP) or 1
    chunks = -(-shards // CHUNK)
    index = written(blocked(fine, shards, width, pivots(fine, of["n"], width)))

    @F.pandas_udf("binary")
    def packed(rows_: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in _matrix(rows_, width)])

    queries = fine.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), packed("v").alias("v"))
    queries = written(queries.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    if open_share(index, queries, width, k) > OPEN:
        # Bounds sort nothing out here: every shard meets every group, without passes that look for what may be left out.
        blocks = index.select("*", each(groups, "group"))
        asked = queries.select("*", F.lit(float("-inf")).alias("least"), each(shards, "shard"))
    else:
        summaries = index.select("shard", "block", *SUMMARY, F.floor(F.col("shard") / CHUNK).cast("int").alias("chunk"), each(groups, "group"))
        floors = written(first_floors(queries.select("*", each(chunks, "chunk")), index, summaries, width, k)).withColumnRenamed("query", "f_query")
        # Where a best block has fewer than k rows, or scores beyond 64 bits, nothing is known yet.
        floors = floors.withColumn("least", F.when(F.col("least") > F.lit(_RANGE[0]), F.col("least").cast("double")).otherwise(F.lit(float("-inf"))))
        floored = queries.join(floors, F.col("query") == F.col("f_query")).drop("f_query")
        need = written(surviving(floored.select("*", each(chunks, "chunk")), summaries, width))
        blocks = need.where("block is not null").select("group", F.col("block").alias("n_block")).join(index, F.col("n_block") == F.col("block")).drop("n_block")
        asked = need.where("query is not null").select("shard", F.col("query").alias("n_query")).join(floored, F.col("n_query") == F.col("query")).drop("n_query")

    def search(key: tuple, blocks_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks_) and len(queries_):
            held = [Block.packed(*x, width) for x in blocks_[["ids", "numbers", "rows"]].itertuples(index=False)]
            v, numbers = _stacked(queries_["v"], width), queries_["query"].to_numpy(np.int64)
            bounds = _bounds(v, blocks_, width)
            ids = queries_["query_id"].tolist()
            for q, found in enumerate(best(held, bounds, numbers, v, queries_["least"].to_numpy(np.float64), k)):
                out += [(int(numbers[q]), ids[q], i, n, -s) for s, i, n in found]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "row", "score"], dtype="int64")

    near = blocks.groupBy("group", "shard").cogroup(asked.groupBy("group", "shard")).applyInPandas(search, _FOUND)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
