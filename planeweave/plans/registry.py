"""Operators by type: pins, parameters with hard ranges, and the function that lowers them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Frame, Image, Number, Plane, as_column, as_image, driven

FREE = 1e6


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    default: Any
    lo: float = -math.inf
    hi: float = math.inf
    options: tuple[str, ...] = ()

    def clean(self, value):
        """A loaded value made valid: wrong types and NaN give the default, numbers are held to the range."""
        if self.kind in ("float", "int", "enum"):
            if isinstance(value, str) and value in self.options:
                return self.options.index(value)
            if isinstance(value, bool) or not isinstance(value, int | float) or math.isnan(value):
                return self.default
            if self.kind == "float":
                return float(min(max(value, self.lo), self.hi))
            top = len(self.options) - 1 if self.kind == "enum" else self.hi
            low = 0 if self.kind == "enum" else self.lo
            return int(min(max(math.floor(abs(value) + 0.5) * (1 if value >= 0 else -1), low), top))
        if self.kind == "bool":
            return value if isinstance(value, bool) else self.default
        if self.kind == "colour":
            good = isinstance(value, list | tuple) and len(value) >= 3 and all(isinstance(v, int | float) and not math.isnan(v) for v in value[:3])
            return [min(max(float(v), self.lo), self.hi) for v in value[:3]] if good else self.default
        if self.kind == "text":
            return value if isinstance(value, str) else self.default
        return value if isinstance(value, dict | list) else self.default


def number(name, default, lo, hi) -> Param:
    return Param(name, "float", float(default), float(lo), float(hi))


def free(name, default) -> Param:
    return number(name, default, -FREE, FREE)


def choice(name, options, default=0) -> Param:
    return Param(name, "enum", default, options=tuple(o.strip() for o in options.split("|")))


def flag(name, default) -> Param:
    return Param(name, "bool", default)


def colour(name, *default, hi=1.0) -> Param:
    return Param(name, "colour", list(map(float, default)), 0.0, hi)


def text(name, default="") -> Param:
    return Param(name, "text", default)


def shape(name, default) -> Param:
    """Curves, ramps and other structured parameters."""
    return Param(name, "json", default)


@dataclass(frozen=True)
class Pin:
    name: str
    kind: str
    param: str | None = None


@dataclass(frozen=True)
class Spec:
    type: str
    inputs: tuple[Pin, ...]
    outputs: tuple[Pin, ...]
    params: tuple[Param, ...]
    lower: Callable[..., Any]
    reach: Callable[..., int | None] = field(default=lambda call: 0)

    def param(self, name: str) -> Param:
        return next(p for p in self.params if p.name == name)


REGISTRY: dict[str, Spec] = {}


def _pins(told: str) -> tuple[Pin, ...]:
    """``Image Image, Amount plane = Amount``: name, kind and, behind =, the parameter a wire replaces."""
    pins = []
    for part in filter(None, map(str.strip, told.split(","))):
        left, _, param = part.partition("=")
        name, _, kind = left.strip().rpartition(" ")
        pins.append(Pin(name.strip(), kind, param.strip() or None))
    return tuple(pins)


def operator(type_: str, inputs: str, outputs: str, *params: Param, reach=None):
    """Registers the decorated lowering. ``reach``: pixels around a region that it reads, None for all."""

    def take(f):
        REGISTRY[type_] = Spec(type_, _pins(inputs), _pins(outputs), params, f, reach or (lambda call: 0))
        return f

    return take


class Call:
    """One node at lowering: its parameters and inputs in the frame that its output gets."""

    def __init__(self, spec: Spec, params: dict, inputs: list, context) -> None:
        self.spec, self.params, self.inputs, self.context = spec, params, inputs, context
        sized = next((v.frame for v in inputs if isinstance(v, Image | Plane)), None)
        self.sized = sized
        self._frame = sized

    @property
    def frame(self) -> Frame:
        """The first sized input's grid, else the context's canvas."""
        if self._frame is None:
            self._frame = self.context.canvas()
        return self._frame

    @property
    def linear(self) -> bool:
        return self.context.linear

    @property
    def longest(self) -> float:
        """The long edge that sizes are shares of: the session's, else the frame's."""
        return float(self.context.session.long_edge or max(self.frame.w, self.frame.h))

    def __getitem__(self, name: str):
        return self.params[name]

    def _input(self, name: str):
        at = next(i for i, p in enumerate(self.spec.inputs) if p.name == name)
        return self.inputs[at]

    def image(self, name: str = "Image") -> Image | None:
        return as_image(self._input(name), self.frame) if self._input(name) is not None else None

    def plane(self, name: str, default: float | None = None) -> Column | None:
        value = self._input(name)
        if value is None:
            return None if default is None else F.lit(float(default))
        return as_column(value, self.frame)

    def driven(self, name: str) -> Column:
        """A slider: its wire held to the parameter's range, or the parameter."""
        value, param = self._input(name), self.spec.param(next(p.param for p in self.spec.inputs if p.name == name))
        if value is None:
            return F.lit(float(self.params[param.name]))
        if isinstance(value, Number):
            return F.lit(float(param.clean(value.v)))
        return driven(as_column(value, self.frame), param.lo, param.hi)

    def keep(self, *columns: Column) -> list[Column]:
        """Columns of their own, so that what reads them more than once doesn't repeat their expressions."""
        return [F.col(n) for n in self.frame.add(*columns)]

    def constant(self) -> bool:
        """Whether no input has a size."""
        return self.sized is None
