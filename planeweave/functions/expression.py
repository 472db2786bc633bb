"""Text expressions over pixels, compiled to one Column.

Variables r g b a in1 in2 x y u v w h and pi, e. ``^`` binds tighter than a leading minus and groups
from the left; ``log`` is the natural logarithm. Comparisons and logic give 0 or 1; a comma gives its
right side; a function of one argument may do without parentheses. What isn't finite becomes 0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import clamp, fract, lit, mix, smoothstep

TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|==|!=|&&|\|\||[-+*/%^<>!(),]))")


class ExpressionError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(f"{message} at character {at + 1}")
        self.at = at


def _truth(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _inside(x: Column, lo: float, hi: float, f) -> Column:
    """f(x) on lo..hi, nothing elsewhere."""
    return F.when((x >= lo) & (x <= hi), f(clamp(x, lo, hi)))


def _factorial(n: Column) -> Column:
    table = F.array(*[F.lit(float(math.factorial(i))) for i in range(21)])
    return F.when((n >= 0) & (n < 21), F.element_at(table, F.floor(clamp(n, 0, 20)).cast("int") + 1))


FUNCTIONS = {
    "abs": (1, F.abs), "floor": (1, lambda v: F.floor(clamp(v, -1e15, 1e15)).cast("double")), "ceil": (1, lambda v: F.ceil(clamp(v, -1e15, 1e15)).cast("double")),
    "sqrt": (1, F.sqrt), "exp": (1, F.exp), "ln": (1, F.ln), "log": (1, F.ln), "log10": (1, F.log10),
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "sinh": (1, F.sinh), "cosh": (1, F.cosh), "tanh": (1, F.tanh),
    "asin": (1, lambda v: _inside(v, -1, 1, F.asin)), "acos": (1, lambda v: _inside(v, -1, 1, F.acos)), "atan": (1, F.atan),
    "atan2": (2, F.atan2), "pow": (2, F.pow), "min": (2, F.least), "max": (2, F.greatest), "step": (2, lambda edge, v: _truth(v >= edge)),
    "clamp": (3, lambda v, lo, hi: F.least(F.greatest(v, lo), hi)), "mix": (3, mix), "smoothstep": (3, smoothstep), "fract": (1, fract),
    "fac": (1, _factorial), "ncr": (2, lambda n, k: _factorial(n) / (_factorial(k) * _factorial(n - k))), "npr": (2, lambda n, k: _factorial(n) / _factorial(n - k)),
}

#: Binding powers, weakest first.
BINARY = {",": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "^": 9}
APPLY = {
    ",": lambda a, b: b, "||": lambda a, b: _truth((a != 0) | (b != 0)), "&&": lambda a, b: _truth((a != 0) & (b != 0)),
    "==": lambda a, b: _truth(a == b), "!=": lambda a, b: _truth(a != b), "<": lambda a, b: _truth(a < b), "<=": lambda a, b: _truth(a <= b),
    ">": lambda a, b: _truth(a > b), ">=": lambda a, b: _truth(a >= b), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": _divide, "%": lambda a, b: F.try_mod(a, b), "^": F.pow,
}
PREFIX = 8


class _Parser:
    def __init__(self, text: str, names: dict[str, Column]) -> None:
        self.names, self.at, self.tokens, end = names, 0, [], len(text.rstrip())
        place = 0
        while place < end:
            found = TOKEN.match(text, place)
            if not found:
                raise ExpressionError("unexpected character", place + len(text[place:]) - len(text[place:].lstrip()))
            self.tokens.append((found.lastgroup, found[found.lastgroup], found.start(found.lastgroup)))
            place = found.end()
        self.tokens.append(("end", "", end))

    @property
    def now(self):
        return self.tokens[self.at]

    def take(self, op: str | None = None):
        token = self.now
        if op is not None and token[1] != op:
            raise ExpressionError(f"expected {op}", token[2])
        self.at += 1
        return token

    def expression(self, least: int = 0) -> Column:
        left = self.prefix()
        while self.now[0] == "op" and BINARY.get(self.now[1], -1) > least:
            op = self.take()[1]
            left = APPLY[op](left, self.expression(BINARY[op]))
        return left

    def prefix(self) -> Column:
        kind, told, place = self.take()
        if kind == "number":
            return F.lit(float(told))
        if told in ("-", "+", "!"):
            value = self.expression(PREFIX)
            return -value if told == "-" else _truth(value == 0) if told == "!" else value
        if told == "(":
            value = self.expression()
            self.take(")")
            return value
        if kind == "name" and told in FUNCTIONS:
            return self.call(told, place)
        if kind == "name" and told in self.names:
            return self.names[told]
        raise ExpressionError("unknown name" if kind == "name" else "unexpected end" if kind == "end" else "unexpected operator", place)

    def call(self, name: str, place: int) -> Column:
        count, f = FUNCTIONS[name]
        if self.now[1] != "(":
            if count != 1:
                raise ExpressionError(f"{name} takes {count} arguments", place)
            return f(self.prefix())
        self.take("(")
        given = [self.expression(BINARY[","])]
        while self.now[1] == ",":
            self.take()
            given.append(self.expression(BINARY[","]))
        self.take(")")
        if len(given) != count:
            raise ExpressionError(f"{name} takes {count} arguments", place)
        return f(*given)


def finite(v: Column) -> Column:
    """0 in place of NULL, NaN and infinities."""
    return F.coalesce(F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v), F.lit(0.0))


def compile_text(text: str, names: dict[str, Column]) -> Column:
    parser = _Parser(text, {"pi": F.lit(math.pi), "e": F.lit(math.e)} | names)
    value = parser.expression()
    if parser.now[0] != "end":
        raise ExpressionError("unexpected text", parser.now[2])
    return finite(lit(value))
