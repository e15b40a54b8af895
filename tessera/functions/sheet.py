"""Spreadsheet cells (A29, M20-M22): formulas over a grid, standard arithmetic and precedence."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z]+\d+)|([A-Za-z]+)|(.))")


def place(name: str) -> tuple[int, int]:
    """(row, column), from 0, of a cell name such as B3."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)", name)
    if not m:
        raise ValueError(f"not a cell: {name}")
    return int(m[2]) - 1, reduce(lambda n, c: n * 26 + ord(c) - 64, m[1].upper(), 0) - 1


def cell(row: int, col: int) -> str:
    """The name of a cell, as ``place`` reads it."""
    letters, n = "", col + 1
    while n:
        n, k = divmod(n - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row + 1}"


_FUNCTIONS: dict[str, Callable] = {
    "sum": lambda *v: sum(v),
    "avg": lambda *v: sum(v) / len(v),
    "min": min,
    "max": max,
    "ceil": math.ceil,
    "floor": math.floor,
    "exp": math.exp,
    "log": math.log,
    "sqrt": math.sqrt,
    "pow": math.pow,
}


class Sheet:
    """A grid of cell texts; ``=`` begins a formula."""

    def __init__(self, cells: list[list[str]]) -> None:
        self.cells, self.known, self.busy = cells, {}, set()

    def value(self, row: int, col: int) -> float | str:
        """A cell's number or text; empty cells count as 0 in formulas, circles raise."""
        at = row, col
        if at in self.busy:
            raise ValueError(f"cell {at} depends on itself")
        if at not in self.known:
            raw = self.cells[row][col].strip() if 0 <= row < len(self.cells) and 0 <= col < len(self.cells[row]) else ""
            self.busy.add(at)
            try:
                self.known[at] = self.evaluate(raw[1:]) if raw.startswith("=") else _number(raw)
            finally:
                self.busy.discard(at)
        return self.known[at]

    def evaluate(self, text: str) -> float:
        tokens = [next((k, g) for k, g in enumerate(m.groups()) if g is not None) for m in _TOKEN.finditer(text) if m[0].strip()]
        at = 0

        def peek() -> str | None:
            return tokens[at][1] if at < len(tokens) else None

        def take(want: str | None = None) -> tuple[int, str]:
            nonlocal at
            if at >= len(tokens) or want is not None and tokens[at][1] != want:
                raise ValueError(f"can't read formula {text!r}")
            at += 1
            return tokens[at - 1]

        def arguments() -> list[float]:
            out = []
            while peek() != ")":
                if tokens[at][0] == 1 and at + 1 < len(tokens) and tokens[at + 1][1] == ":":
                    a, b = place(take()[1]), place((take(":"), take())[1][1])
                    out += [float(v) for r in range(a[0], b[0] + 1) for c in range(a[1], b[1] + 1) if not isinstance(v := self.value(r, c), str)]
                else:
                    out.append(total())
                if peek() == ",":
                    take()
            return out

        def unit() -> float:
            kind, word = take()
            if kind == 0:
                return float(word)
            if kind == 1:
                v = self.value(*place(word))
                if isinstance(v, str) and v:
                    raise ValueError(f"{word} is no number")
                return float(v or 0)
            if kind == 2:
                take("(")
                v = arguments()
                take(")")
                return float(_FUNCTIONS[word.lower()](*v))
            if word == "-":
                return -unit()
            if word == "(":
                v = total()
                take(")")
                return v
            raise ValueError(f"can't read formula {text!r}")

        def product() -> float:
            v = unit()
            while peek() in ("*", "/", "%"):
                op = take()[1]
                w = unit()
                v = v * w if op == "*" else v / w if op == "/" else math.fmod(v, w)
            return v

        def total() -> float:
            v = product()
            while peek() in ("+", "-"):
                v = v + product() if take()[1] == "+" else v - product()
            return v

        v = total()
        if at < len(tokens):
            raise ValueError(f"can't read formula {text!r}")
        return v


def _number(raw: str) -> float | str:
    try:
        return float(raw)
    except ValueError:
        return raw


def range_aggregate(cells: DataFrame, first: str, last: str) -> DataFrame:
    """Sum, avg, min, max over a range of cells(row, col, value)."""
    (r0, c0), (r1, c1) = place(first), place(last)
    inside = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return inside.agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
