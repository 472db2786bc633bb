"""Values of a dataflow graph over one growing DataFrame per pixel grid.

A ``Frame`` is a DataFrame keyed (img, y, x) that only gains columns; images and planes are names of
its columns. Values of one frame are zipped without a join, and the optimiser drops what no output
reads. Only values of different frames are joined, on their keys or on nearest positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.functions.maths import clamp, luma

KEY = ("img", "y", "x")


class Frame:
    """A pixel grid. ``w`` and ``h`` hold for every ``img`` of it."""

    def __init__(self, df: DataFrame, w: int, h: int) -> None:
        self.df, self.w, self.h, self._next = df, int(w), int(h), 0

    def name(self) -> str:
        self._next += 1
        return f"c{self._next}"

    def add(self, *columns: Column) -> list[str]:
        names = [self.name() for _ in columns]
        self.df = self.df.withColumns(dict(zip(names, columns, strict=True)))
        return names

    def image(self, r, g, b, a) -> Image:
        return Image(self, *self.add(*(c if isinstance(c, Column) else F.lit(float(c)) for c in (r, g, b, a))))

    def plane(self, v: Column) -> Plane:
        return Plane(self, *self.add(v))

    def adopt(self, other: Frame, names: list[str]) -> list[str]:
        """Columns of another frame on this one's rows: by key, or nearest position if sizes differ."""
        if other is self:
            return names
        same = (self.w, self.h) == (other.w, other.h)
        key = {k: self.name() for k in KEY}
        own = {n: self.name() for n in names}
        right = other.df.select(*[F.col(k).alias(v) for k, v in key.items()], *[F.col(n).alias(v) for n, v in own.items()])
        at = lambda k, mine, theirs: F.col(k) if same else F.least(F.lit(theirs - 1), F.floor(F.col(k) * theirs / mine)).cast("int")
        on = (F.col("img") == F.col(key["img"])) & (at("y", self.h, other.h) == F.col(key["y"])) & (at("x", self.w, other.w) == F.col(key["x"]))
        self.df = self.df.join(right, on, "left").drop(*key.values())
        return list(own.values())


@dataclass(frozen=True)
class Image:
    frame: Frame
    r: str
    g: str
    b: str
    a: str

    @property
    def names(self) -> list[str]:
        return [self.r, self.g, self.b, self.a]

    @property
    def rgb(self) -> list[Column]:
        return [F.col(n) for n in self.names[:3]]

    @property
    def alpha(self) -> Column:
        return F.col(self.a)


@dataclass(frozen=True)
class Plane:
    frame: Frame
    v: str

    @property
    def names(self) -> list[str]:
        return [self.v]


@dataclass(frozen=True)
class Number:
    """A scalar, and a plane that is constant at any size."""

    v: float


def canvas(spark: SparkSession, w: int, h: int, images: DataFrame | None = None) -> Frame:
    """An empty grid for generators, for one image or each of ``images`` (img)."""
    grid = spark.range(w * h).select((F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    grid = grid.select(F.lit("0").alias("img"), "y", "x") if images is None else images.select("img").join(grid)
    return Frame(grid, w, h)


def as_image(value, frame: Frame | None) -> Image | None:
    """Any value as an image of ``frame`` (or its own); planes become grey, numbers flat grey."""
    if value is None:
        return None
    if isinstance(value, Number):
        return frame.image(value.v, value.v, value.v, 1.0)
    home = frame or value.frame
    names = home.adopt(value.frame, value.names)
    return Image(home, *names) if isinstance(value, Image) else home.image(*[F.col(names[0])] * 3, 1.0)


def as_column(value, frame: Frame) -> Column | None:
    """Any value as one column of ``frame``; images become luminance."""
    if value is None:
        return None
    if isinstance(value, Number):
        return F.lit(float(value.v))
    names = frame.adopt(value.frame, value.names)
    return luma(*map(F.col, names[:3])) if isinstance(value, Image) else F.col(names[0])


def driven(column: Column, lo: float, hi: float) -> Column:
    """A column in a parameter's place: NaN counts as 0, then the hard range holds."""
    return clamp(F.nanvl(column, F.lit(0.0)), lo, hi)
