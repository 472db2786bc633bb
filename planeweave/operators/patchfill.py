"""Filling a masked area from patches of the rest of the image.

Coarse to fine over a pyramid: every patch that touches the hole looks for the patch of known pixels
that is nearest to it, and every hole pixel becomes the weighted mean of what the matched patches say
of it. Matches are searched in rounds. In each, all patches at once propose places: their own match,
their neighbours' matches moved along, and places drawn by a hash of position and round around their
own; the nearest wins, ties to the smaller place. No patch waits for another within a round, so a
level can be cut into tiles anywhere without changing a result, and pixels are whole numbers (2^-20),
so that sums don't depend on their order.

Levels of up to ``side`` x ``side`` pixels are one bounded group an image. Larger ones stay a table, packed
into tiles once a level: a round deals the hole's surroundings out to tiles that propose places, sends
every proposal with its patch to the tile that holds the place, and keeps each patch's best by an
aggregation. All else is done on the surroundings only, no round touches single pixels far from a hole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.lineage import cut
from planeweave.plans.registry import Call, number, operator

from .stencil import distance_to

#: Patches are 7 x 7; the mask counts as hole above a trace; the shortest edge of the
#: coarsest level; passes of the coarsest level, of the finest of many levels, and of the others.
RADIUS, TRACE, LEAST_EDGE, PASSES = 3, 0.02, 24, (8, 2, 4)
#: Side of a tile, pixels' unit and range (held from 0 up), neighbours asked for their matches, proposals of one task.
SIDE, UNIT, MOST, STRIDES, TASK = 512, 1 << 20, 100.0, (1, 4), 200_000
_OFF = np.arange(-RADIUS, RADIUS + 1)
COLOURS = ("q0", "q1", "q2", "q3")


def drawn(*parts) -> np.ndarray:
    """64 mixed bits of whole numbers: a multiply and shift for each."""
    out = np.zeros(np.broadcast(*parts).shape, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (out ^ np.asarray(part).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return out


def cells(lines: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Patches around (y, x) of planes (k, h, w), as rows of k * 49; the edge repeated."""
    yy = np.clip(y[:, None] + _OFF, 0, lines.shape[1] - 1)
    xx = np.clip(x[:, None] + _OFF, 0, lines.shape[2] - 1)
    return np.ascontiguousarray(np.moveaxis(lines[:, yy[:, :, None], xx[:, None, :]], 0, 1)).reshape(len(y), -1)


def grown(flags: np.ndarray, by: int) -> np.ndarray:
    """Pixels with a flag within ``by`` rows and columns."""
    for axis in (0, 1):
        wide = np.pad(flags, [(by, by) if a == axis else (0, 0) for a in (0, 1)])
        flags = np.any([np.take(wide, range(k, k + flags.shape[axis]), axis=axis) for k in range(2 * by + 1)], axis=0)
    return flags


def proposals(match: np.ndarray, own: np.ndarray, at: tuple[int, int], size: tuple[int, int], level: int, turn: int) -> tuple[np.ndarray, ...]:
    """(row, y, x) of places for the patches ``own`` (y, x; within the region that begins ``at``).

    ``match``: (2, h, w), the places matched so far, -1 for none.
    """
    (h, w), rows, ys, xs = size, [], [], []
    y, x = own
    every = np.arange(len(y))

    def put(which, py, px):
        rows.append(which)
        ys.append(py)
        xs.append(px)

    mine = match[:, y, x]
    put(every, *mine)
    for stride in STRIDES:
        for dy, dx in ((-stride, 0), (stride, 0), (0, -stride), (0, stride)):
            ny, nx = y + dy, x + dx
            seen = (ny >= 0) & (ny < match.shape[1]) & (nx >= 0) & (nx < match.shape[2])
            other = match[:, ny[seen], nx[seen]]
            known = other[0] >= 0
            put(every[seen][known], other[0][known] - dy, other[1][known] - dx)
    # Around the own match at halving distances; without one, anywhere.
    gy, gx = y + at[0], x + at[1]
    reach, k, none = max(h, w), 0, mine[0] < 0
    while reach >= 1:
        bits = drawn(gy, gx, level, turn, k)
        span = np.uint64(2 * reach + 1)
        low, high = bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)
        put(every, np.where(none, (low % np.uint64(h)).astype(np.int64), mine[0] + (low % span).astype(np.int64) - reach), np.where(none, (high % np.uint64(w)).astype(np.int64), mine[1] + (high % span).astype(np.int64) - reach))
        reach, k = reach // 2, k + 1
    rows, ys, xs = map(np.concatenate, (rows, ys, xs))
    # The whole patch must lie in the image, and elsewhere.
    good = (ys >= RADIUS) & (ys < h - RADIUS) & (xs >= RADIUS) & (xs < w - RADIUS) & ((ys != gy[rows]) | (xs != gx[rows]))
    placed = np.unique(np.stack([rows[good], ys[good], xs[good]]), axis=1)
    return placed[0], placed[1], placed[2]


def distances(patches: np.ndarray, row: np.ndarray, planes: np.ndarray, whole: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, distance) from ``patches`` of ``row`` to the places (y, x) that hold known pixels only; ``whole`` tells patches without a hole."""
    which = np.flatnonzero(whole[y, x])
    out = np.empty(len(which))
    for k in range(0, len(which), 4096):
        part = which[k : k + 4096]
        out[k : k + 4096] = ((patches[row[part]].astype(np.float64) - cells(planes, y[part], x[part])) ** 2).sum(axis=1) / UNIT**2
    return which, out


def ballots(planes: np.ndarray, ty: np.ndarray, tx: np.ndarray, sy: np.ndarray, sx: np.ndarray, cost: np.ndarray) -> pd.DataFrame:
    """What matched patches say of the pixels below them: y, x, weight and weighted colours, summed."""
    weight = np.round(4096 / (1 + 4 * cost)).astype(np.int64) + 1
    out = []
    for dy in _OFF:
        for dx in _OFF:
            out.append(pd.DataFrame({"y": ty + dy, "x": tx + dx, "w": weight} | {c: planes[k, sy + dy, sx + dx] * weight for k, c in enumerate(COLOURS)}))
    return pd.concat(out).groupby(["y", "x"], as_index=False).sum() if out else pd.DataFrame()


def halved(planes: np.ndarray, hole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the known of 2 x 2 pixels; a cell with any hole is one."""
    h, w = max(1, hole.shape[0] // 2), max(1, hole.shape[1] // 2)
    ys, xs = (np.minimum(2 * np.arange(n)[:, None] + [0, 1], full - 1) for n, full in ((h, hole.shape[0]), (w, hole.shape[1])))
    block = lambda p: p[..., ys[:, None, :, None], xs[None, :, None, :]]
    holes = block(hole)
    known = (~holes).sum(axis=(2, 3))
    sums = np.where(holes, 0, block(planes)).sum(axis=(3, 4))
    return np.where(known > 0, _mean(sums, np.maximum(known, 1)), 0), holes.any(axis=(2, 3))


def _mean(sums, count):
    """Rounded half up, in whole numbers."""
    return (2 * sums + count) // (2 * count)


def peeled(planes: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """The hole filled from its edge inwards, each ring with the mean of its known neighbours."""
    planes, known = planes.copy(), ~hole
    while known.any() and not known.all():
        counts = sum(np.pad(known, 1)[1 + j : 1 + j + hole.shape[0], 1 + i : 1 + i + hole.shape[1]].astype(np.int64) for j in (-1, 0, 1) for i in (-1, 0, 1))
        sums = sum(np.pad(np.where(known, planes, 0), ((0, 0), (1, 1), (1, 1)))[:, 1 + j : 1 + j + hole.shape[0], 1 + i : 1 + i + hole.shape[1]] for j in (-1, 0, 1) for i in (-1, 0, 1))
        ring = ~known & (counts > 0)
        planes[:, ring] = _mean(sums, np.maximum(counts, 1))[:, ring]
        known |= ring
    return planes


def sizes(h: int, w: int) -> list[tuple[int, int]]:
    """Heights and widths of the levels, finest first."""
    out = [(h, w)]
    while min(out[-1]) // 2 >= LEAST_EDGE:
        out.append((max(1, out[-1][0] // 2), max(1, out[-1][1] // 2)))
    return out


def passes(level: int, levels: int) -> int:
    return PASSES[0] if level == levels - 1 else PASSES[1] if level == 0 and levels > 3 else PASSES[2]


def filled(planes: np.ndarray, hole: np.ndarray, level: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """One image from ``level`` upwards in memory: its planes without the hole, and the matches."""
    h, w = hole.shape
    coarse, match = filled(*halved(planes, hole), level + 1, levels) if level + 1 < levels else (None, np.full((2, 1, 1), -1))
    if (match >= 0).any():
        cy, cx = np.minimum(np.arange(h) // 2, coarse.shape[1] - 1)[:, None], np.minimum(np.arange(w) // 2, coarse.shape[2] - 1)[None, :]
        planes = np.where(hole, coarse[:, cy, cx], planes)
        match = np.where(match[:, cy, cx] >= 0, 2 * match[:, cy, cx] + np.stack(np.broadcast_arrays(np.arange(h)[:, None] % 2, np.arange(w)[None, :] % 2)), -1)
    else:  # the coarsest level that has something to copy from, or none has
        planes, match = peeled(planes, hole), np.full((2, h, w), -1)
    whole, targets = ~grown(hole, RADIUS), np.nonzero(grown(hole, RADIUS))
    match[:, whole] = -1
    if not len(targets[0]):
        return planes, match
    for turn in range(2 * passes(level, levels)):
        row, y, x = proposals(match, targets, (0, 0), (h, w), level, turn)
        which, cost = distances(cells(planes, *targets).astype(np.int32), row, planes, whole, y, x)
        match[:, targets[0], targets[1]] = -1
        if len(which):
            best = pd.DataFrame({"t": row[which], "cost": cost, "y": y[which], "x": x[which]}).sort_values(["t", "cost", "y", "x"]).drop_duplicates("t")
            ty, tx = targets[0][best["t"]], targets[1][best["t"]]
            match[:, ty, tx] = best["y"], best["x"]
            if turn % 2:
                told = ballots(planes, ty, tx, best["y"].to_numpy(), best["x"].to_numpy(), best["cost"].to_numpy())
                told = told[(told["y"] >= 0) & (told["y"] < h) & (told["x"] >= 0) & (told["x"] < w)]
                told = told[hole[told["y"], told["x"]]]
                for k, c in enumerate(COLOURS):
                    planes[k, told["y"], told["x"]] = _mean(told[c].to_numpy(), told["w"].to_numpy())
    return planes, match


# --- levels too large for one task

_STATE = "img string, y int, x int, q0 long, q1 long, q2 long, q3 long, hole boolean, sy int, sx int"


def _tiles(df: DataFrame, size: tuple[int, int], side: int, reach: int) -> DataFrame:
    """Rows of every tile (down, right) and of what is within ``reach`` of it."""
    near = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - reach) / side), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + reach) / side), F.lit((n - 1) // side)).cast("int"))
    return df.withColumn("down", F.explode(near("y", size[0]))).withColumn("right", F.explode(near("x", size[1])))


def _bounds(size: tuple[int, int], side: int, reach: int, down: int, right: int) -> tuple[int, int, tuple[int, int]]:
    """First row and column of a tile with its surroundings, and their height and width."""
    top, left = max(0, down * side - reach), max(0, right * side - reach)
    return top, left, (min(size[0], (down + 1) * side + reach) - top, min(size[1], (right + 1) * side + reach) - left)


class _Region:
    """A tile's rows as arrays; (top, left) is its first pixel, its own part without the surroundings."""

    def __init__(self, rows: pd.DataFrame, size: tuple[int, int], side: int, reach: int, down: int, right: int) -> None:
        self.top, self.left, shape = _bounds(size, side, reach, down, right)
        self.y, self.x = rows["y"].to_numpy() - self.top, rows["x"].to_numpy() - self.left
        self.planes, self.hole, self.match = np.zeros((4, *shape), np.int64), np.zeros(shape, bool), np.full((2, *shape), -1)
        self.planes[:, self.y, self.x] = rows[list(COLOURS)].to_numpy(np.int64).T
        self.hole[self.y, self.x] = rows["hole"].to_numpy(bool)
        if "sy" in rows:
            self.match[:, self.y, self.x] = rows[["sy", "sx"]].to_numpy(np.int64).T
        self.own = (self.y + self.top) // side == down
        self.own &= (self.x + self.left) // side == right


#: What a packed tile holds around its own pixels; its flags: a hole, one of its own pixels, a patch without a hole.
AROUND, HOLE, OWN, WHOLE = 2 * RADIUS, 1, 2, 4


def _packed(level: DataFrame, size: tuple[int, int], side: int) -> DataFrame:
    """A row per tile: its pixels and flags as bytes, and whether it has pixels of patches that touch a hole (``near``)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = _Region(rows, size, side, AROUND, key[1], key[2])
        flags = part.hole * HOLE + ~grown(part.hole, RADIUS) * WHOLE
        flags[part.y[part.own], part.x[part.own]] += OWN
        near = bool((grown(part.hole, AROUND) & (flags & OWN > 0)).any())
        return pd.DataFrame({"img": [key[0]], "down": [key[1]], "right": [key[2]], "near": [near], "planes": [part.planes.astype("<i4").tobytes()], "flags": [flags.astype(np.uint8).tobytes()]})

    tiles = _tiles(level.select("img", "y", "x", *COLOURS, "hole"), size, side, AROUND)
    return tiles.groupBy("img", "down", "right").applyInPandas(run, "img string, down int, right int, near boolean, planes binary, flags binary")


class _Tile:
    """A packed tile's arrays; (top, left) is its first pixel."""

    def __init__(self, rows: pd.DataFrame, size: tuple[int, int], side: int, down: int, right: int) -> None:
        self.top, self.left, shape = _bounds(size, side, AROUND, down, right)
        self.planes = np.frombuffer(rows["planes"].iloc[0], "<i4").reshape(4, *shape)
        self.flags = np.frombuffer(rows["flags"].iloc[0], np.uint8).reshape(shape)


def _surroundings(tiles: DataFrame, size: tuple[int, int], side: int) -> DataFrame:
    """Pixels of patches that touch a hole, with ``target`` for those patches' centres."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = _Tile(rows, size, side, key[1], key[2])
        hole = part.flags & HOLE > 0
        y, x = np.nonzero(grown(hole, AROUND) & (part.flags & OWN > 0))
        out = pd.DataFrame({"img": key[0], "y": y + part.top, "x": x + part.left} | {c: part.planes[k, y, x] for k, c in enumerate(COLOURS)})
        return out.assign(hole=hole[y, x], target=part.flags[y, x] & WHOLE == 0)

    return tiles.where("near").groupBy("img", "down", "right").applyInPandas(run, "img string, y int, x int, q0 long, q1 long, q2 long, q3 long, hole boolean, target boolean")


def _proposed(state: DataFrame, size: tuple[int, int], side: int, level: int, turn: int) -> DataFrame:
    reach = max(RADIUS, *STRIDES)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = _Region(rows, size, side, reach, key[1], key[2])
        own = part.own & rows["target"].to_numpy(bool)
        y, x = part.y[own], part.x[own]
        row, sy, sx = proposals(part.match, (y, x), (part.top, part.left), size, level, turn)
        patches = cells(part.planes, y, x).astype("<i4")
        return pd.DataFrame({"img": key[0], "ty": (y + part.top)[row], "tx": (x + part.left)[row], "sy": sy, "sx": sx, "patch": [patches[k].tobytes() for k in row], "down": sy // side, "right": sx // side})

    return _tiles(state, size, side, reach).groupBy("img", "down", "right").applyInPandas(run, "img string, ty int, tx int, sy int, sx int, patch binary, down int, right int")


def _met(wanted: DataFrame, tiles: DataFrame, parts: int, run, shape: str) -> DataFrame:
    """run(key, rows of ``wanted``, its packed tile) for the places in each tile, over ``parts`` tasks a tile."""
    tiles = tiles.select("img", "down", "right", "planes", "flags", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("ty", "tx"), F.lit(parts)).cast("int"))
    key = ("img", "down", "right", "part")
    return wanted.groupBy(*key).cogroup(tiles.groupBy(*key)).applyInPandas(run, shape)


def _searched(state: DataFrame, tiles: DataFrame, size: tuple[int, int], side: int, number_: int, turn: int, parts: int) -> DataFrame:
    """``state`` with the matches of one more round and their ``cost``."""

    def run(key: tuple, wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame(columns=["img", "ty", "tx", "sy", "sx", "cost"])
        part = _Tile(rows, size, side, key[1], key[2])
        y, x = wanted["sy"].to_numpy() - part.top, wanted["sx"].to_numpy() - part.left
        patches = np.frombuffer(b"".join(wanted["patch"]), "<i4").reshape(len(wanted), -1)
        which, cost = distances(patches, np.arange(len(wanted)), part.planes, part.flags & WHOLE > 0, y, x)
        return wanted.iloc[which][["img", "ty", "tx", "sy", "sx"]].assign(cost=cost)

    scored = _met(_proposed(state, size, side, number_, turn), tiles, parts, run, "img string, ty int, tx int, sy int, sx int, cost double")
    best = scored.groupBy(F.col("img").alias("b_img"), "ty", "tx").agg(F.min(F.struct("cost", "sy", "sx")).alias("best"))
    joined = state.drop("sy", "sx", "cost").join(best, (F.col("img") == F.col("b_img")) & (F.col("y") == F.col("ty")) & (F.col("x") == F.col("tx")), "left")
    none = F.lit(-1)
    return joined.select("img", "y", "x", *COLOURS, "hole", F.coalesce("best.sy", none).alias("sy"), F.coalesce("best.sx", none).alias("sx"), "target", F.col("best.cost").alias("cost"))


def _voted(state: DataFrame, tiles: DataFrame, size: tuple[int, int], side: int, parts: int) -> DataFrame:
    def run(key: tuple, wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame(columns=["img", "y", "x", "w", *COLOURS])
        part = _Tile(rows, size, side, key[1], key[2])
        sy, sx = wanted["sy"].to_numpy() - part.top, wanted["sx"].to_numpy() - part.left
        return ballots(part.planes, wanted["ty"].to_numpy(), wanted["tx"].to_numpy(), sy, sx, wanted["cost"].to_numpy()).assign(img=key[0])[["img", "y", "x", "w", *COLOURS]]

    matched = state.where("sy >= 0").select("img", F.col("y").alias("ty"), F.col("x").alias("tx"), "sy", "sx", "cost", (F.col("sy") / side).cast("int").alias("down"), (F.col("sx") / side).cast("int").alias("right"))
    told = _met(matched, tiles, parts, run, "img string, y int, x int, w long, q0 long, q1 long, q2 long, q3 long")
    told = told.groupBy(F.col("img").alias("b_img"), F.col("y").alias("b_y"), F.col("x").alias("b_x")).agg(F.sum("w").alias("w"), *[F.sum(c).alias(f"b_{c}") for c in COLOURS])
    joined = state.join(told, F.col("hole") & (F.col("img") == F.col("b_img")) & (F.col("y") == F.col("b_y")) & (F.col("x") == F.col("b_x")), "left")
    mean = lambda c: F.expr(f"(2 * b_{c} + w) div (2 * w)")
    return joined.select("img", "y", "x", *[F.coalesce(mean(c), F.col(c)).alias(c) for c in COLOURS], "hole", "sy", "sx", "target", "cost")


def _peeled(level: DataFrame) -> DataFrame:
    """``level`` with its holes filled ring by ring, one round each."""
    state = cut(level.withColumn("known", ~F.col("hole")))
    while True:
        around = state.where("known").select("img", F.explode(F.array(*[F.struct((F.col("y") + j).alias("n_y"), (F.col("x") + i).alias("n_x")) for j in (-1, 0, 1) for i in (-1, 0, 1)])).alias("n"), *COLOURS)
        around = around.select("img", "n.*", *COLOURS)
        open_ = state.where("not known").select(F.col("img").alias("o_img"), F.col("y").alias("o_y"), F.col("x").alias("o_x"))
        on = (F.col("img") == F.col("o_img")) & (F.col("n_y") == F.col("o_y")) & (F.col("n_x") == F.col("o_x"))
        means = around.join(open_, on).groupBy("o_img", "o_y", "o_x").agg(F.count("*").alias("w"), *[F.sum(c).alias(f"b_{c}") for c in COLOURS])
        joined = state.join(means, (F.col("img") == F.col("o_img")) & (F.col("y") == F.col("o_y")) & (F.col("x") == F.col("o_x")), "left")
        ring = F.col("w").isNotNull()
        after = cut(joined.select("img", "y", "x", *[F.when(ring, F.expr(f"(2 * b_{c} + w) div (2 * w)")).otherwise(F.col(c)).alias(c) for c in COLOURS], "hole", (F.col("known") | ring).alias("known")))
        done = after.where("not known").count() in (0, state.where("not known").count())
        state = after
        if done:
            return state.drop("known")


def _halved(level: DataFrame, half: tuple[int, int]) -> DataFrame:
    """``halved`` of a table."""
    known = lambda c: F.when(~F.col("hole"), F.col(c))
    small = level.where((F.col("y") < 2 * half[0]) & (F.col("x") < 2 * half[1])).groupBy("img", (F.col("y") / 2).cast("int").alias("hy"), (F.col("x") / 2).cast("int").alias("hx"))
    small = small.agg(F.count(known("q0")).alias("w"), *[F.sum(known(c)).alias(f"b_{c}") for c in COLOURS], F.max("hole").alias("hole"))
    return small.select("img", F.col("hy").alias("y"), F.col("hx").alias("x"), *[F.coalesce(F.expr(f"CASE WHEN w > 0 THEN (2 * b_{c} + w) div (2 * w) END"), F.lit(0)).alias(c) for c in COLOURS], "hole")


def _lifted(near: DataFrame, small: DataFrame, size: tuple[int, int], half: tuple[int, int], side: int, number_: int, levels: int) -> DataFrame:
    """``near`` with what the next level made of its holes and the matches found there."""
    none = F.lit(-1)
    made = cut(mended(small, half, side, number_ + 1, levels)).drop("hole")
    matched = made.where("sy >= 0").select("img").distinct()
    rest = near.join(matched, "img", "left_anti")
    if size[0] % 2 or size[1] % 2:  # the outermost line has no cell of its own and takes its neighbour's, hole or not
        edge = small.where((F.col("y") == half[0] - 1) | (F.col("x") == half[1] - 1)).where("not hole")
        both = made.union(edge.select("img", "y", "x", *COLOURS, none, none))
        made = both.groupBy("img", "y", "x").agg(*[F.max(c).alias(c) for c in (*COLOURS, "sy", "sx")])
    coarse = made.join(matched, "img", "left_semi").select(*[F.col(c).alias(f"c_{c}") for c in ("img", "y", "x", *COLOURS, "sy", "sx")])
    at = lambda k, n: F.least((F.col(k) / 2).cast("int"), F.lit(n - 1))
    on = (F.col("img") == F.col("c_img")) & (at("y", half[0]) == F.col("c_y")) & (at("x", half[1]) == F.col("c_x"))
    match = lambda s, k: F.when(F.col(f"c_{s}") >= 0, 2 * F.col(f"c_{s}") + F.col(k) % 2).otherwise(none).alias(s)
    start = near.join(matched, "img", "left_semi").join(coarse, on, "left").select("img", "y", "x", *[F.when(F.col("hole"), F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in COLOURS], "hole", "target", match("sy", "y"), match("sx", "x"))
    if not rest.isEmpty():  # nothing to copy from yet
        start = start.union(_first(rest))
    return start


def _first(near: DataFrame) -> DataFrame:
    """``near`` with its holes filled smoothly, without matches."""
    made = _peeled(near.drop("target"))
    return made.join(near.select("img", "y", "x", "target"), ["img", "y", "x"]).select("img", "y", "x", *COLOURS, "hole", "target", F.lit(-1).alias("sy"), F.lit(-1).alias("sx"))


def mended(level: DataFrame, size: tuple[int, int], side: int = SIDE, number_: int = 0, levels: int | None = None) -> DataFrame:
    """The filled holes of ``level`` (img, y, x, q0 to q3, hole) and the centres of patches that touch them, with their matches (sy, sx)."""
    levels = levels or len(sizes(*size))
    if size[0] * size[1] <= side * side:

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            part = _Region(rows, size, max(size), 0, 0, 0)
            planes, match = filled(part.planes, part.hole, number_, levels)
            out = rows[["img", "y", "x", "hole"]].assign(**{c: planes[k, part.y, part.x] for k, c in enumerate(COLOURS)}, sy=match[0, part.y, part.x], sx=match[1, part.y, part.x])
            return out[out["hole"] | (out["sy"] >= 0)][["img", "y", "x", *COLOURS, "hole", "sy", "sx"]]

        return level.groupBy("img").applyInPandas(run, _STATE)
    none = F.lit(-1)
    tiles = cut(_packed(level, size, side))
    near = cut(_surroundings(tiles, size, side))
    if number_ + 1 < levels:
        half = max(1, size[0] // 2), max(1, size[1] // 2)
        start = _lifted(near, cut(_halved(level, half)), size, half, side, number_, levels)
    else:
        start = _first(near)
    state = cut(start.withColumns({k: F.when(F.col("target"), F.col(k)).otherwise(none) for k in ("sy", "sx")}).withColumn("cost", F.lit(None).cast("double")))
    targets = state.where("target").count()
    parts = max(1, -(-targets * 24 // TASK))
    for turn in range(2 * passes(number_, levels) if targets else 0):
        state = _searched(state, tiles, size, side, number_, turn, parts)
        if turn % 2:
            state = cut(_voted(state, tiles, size, side, parts))
    return state.where("target").select("img", "y", "x", *COLOURS, "hole", "sy", "sx")


def completed(level: DataFrame, size: tuple[int, int], side: int = SIDE) -> DataFrame:
    """``level`` (img, y, x, q0 to q3, hole) with the hole filled, and matches (sy, sx)."""
    none = F.lit(-1)
    made = mended(level, size, side).select(F.col("img").alias("s_img"), F.col("y").alias("s_y"), F.col("x").alias("s_x"), *[F.col(c).alias(f"s_{c}") for c in COLOURS], F.col("sy").alias("s_sy"), F.col("sx").alias("s_sx"))
    on = (F.col("img") == F.col("s_img")) & (F.col("y") == F.col("s_y")) & (F.col("x") == F.col("s_x"))
    return level.join(made, on, "left").select("img", "y", "x", *[F.coalesce(f"s_{c}", c).alias(c) for c in COLOURS], "hole", F.coalesce("s_sy", none).alias("sy"), F.coalesce("s_sx", none).alias("sx"))


@operator("filter.remove", "Image image, Mask plane", "Image image", number("Grow", 2, 0, 50), reach=lambda call: None)
def remove(call: Call):
    """What the mask covers, and ``Grow`` pixels around it, rebuilt from the rest of the image.

    Without a mask, with one that is a number, or with one that covers all, the image stays. Where nothing can be copied, because
    no 7 x 7 patch is known, the hole is filled smoothly from its edge.
    """
    image = call.image()
    mask = call._input("Mask")
    if image is None or mask is None or not hasattr(mask, "frame"):
        return image
    frame, grow = image.frame, int(call["Grow"] + 0.5)
    (shown,) = call.keep(F.nanvl(call.plane("Mask"), F.lit(0.0)))
    (flag,) = frame.add((shown > TRACE).cast("double"))
    if grow:
        (flag,) = frame.add((F.col(distance_to(frame, F.col(flag) > 0, most=grow)) <= grow).cast("double"))
    safe = [F.nanvl(c, F.lit(0.0)) for c in (*image.rgb, image.alpha)]
    values = [*(m.to_srgb(m.biggest(c, 0.0)) if call.linear else c for c in safe[:3]), safe[3]]
    whole = cut(frame.df.select("img", "y", "x", *[F.round((m.clamp(v, -MOST, MOST) + MOST) * UNIT).cast("long").alias(c) for v, c in zip(values, COLOURS, strict=True)], (F.col(flag) > 0).alias("hole")))
    # Images without a hole have nothing to search for, those that are one nothing to copy.
    holes = whole.groupBy("img").agg(F.bool_or("hole").alias("some"), F.bool_and("hole").alias("all")).where("some and not all").select("img")
    made = mended(whole.join(F.broadcast(holes), "img", "left_semi"), (frame.h, frame.w)).where("hole")
    key, own = [frame.name() for _ in range(3)], [frame.name() for _ in range(4)]
    made = made.select(*[F.col(k).alias(v) for k, v in zip(("img", "y", "x"), key, strict=True)], *[(F.col(c) / UNIT - MOST).alias(n) for c, n in zip(COLOURS, own, strict=True)])
    frame.df = frame.df.join(made, (F.col("img") == F.col(key[0])) & (F.col("y") == F.col(key[1])) & (F.col("x") == F.col(key[2])), "left").drop(*key)
    fills = [*(m.to_linear(F.col(n)) if call.linear else F.col(n) for n in own[:3]), F.col(own[3])]
    cover = F.lit(1.0) if grow else m.clamp01(shown * 2.0)
    return frame.image(*(F.when(F.col(own[0]).isNull(), s).otherwise(m.mix(F.nanvl(s, f), f, cover)) for s, f in zip((*image.rgb, image.alpha), fills, strict=True)))
