"""Column expressions over planes: a plane is a row-major ARRAY<BIGINT> of known width and height.

All stay inside Catalyst. They gather by index, which suits blocks and small planes; `map_planes` in
operators/filters.py takes numpy kernels for large ones.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cdiv(a, b) -> Column:
    """Integer division that truncates towards zero; null where the divisor is 0."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def clip(v: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(v, F.lit(lo).cast("long")), F.lit(hi).cast("long"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once: inside f it is a variable, not an expression to repeat for each pixel."""
    return F.get(F.transform(F.array(value), f), 0)


def bound(f):
    """Binds the leading Column arguments of an operator, so that planes made by other operators are made once."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        n = next((i for i, a in enumerate(args) if not isinstance(a, Column)), len(args))

        def rest(k, done):
            return f(*done, *args[n:], **kwargs) if k == n else let(args[k], lambda v: rest(k + 1, [*done, v]))

        return rest(0, [])

    return run


def pixels(n: int, f: Callable[[Column], Column]) -> Column:
    """A new plane of n values f(i)."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), f)


def at(plane: Column, i: Column) -> Column:
    """plane[i], null outside."""
    return F.get(plane, i.cast("int"))


def neighbour(plane: Column, i: Column, w: int, h: int, dx: int, dy: int, edge: str = "replicate") -> Column:
    """The value dx right and dy below i. edge: replicate the border, or null beyond it."""
    col, row = i % w + dx, cdiv(i, w) + dy
    if edge == "replicate":
        return at(plane, clip(row, 0, h - 1) * w + clip(col, 0, w - 1))
    return F.when((col >= 0) & (col < w) & (row >= 0) & (row < h), at(plane, row * w + col))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def gathered(plane: Column, i: Column, w: int, h: int, offsets: list[tuple[int, int]], edge: str = "replicate") -> Column:
    """Array of neighbours; those beyond the border are left out when edge is not replicate."""
    found = F.array(*[neighbour(plane, i, w, h, dx, dy, edge) for dx, dy in offsets])
    return found if edge == "replicate" else F.array_compact(found)


def in_rectangle(i: Column, w: int, x: int, y: int, rw: int, rh: int) -> Column:
    col, row = i % w, cdiv(i, w)
    return (col >= x) & (col < x + rw) & (row >= y) & (row < y + rh)
