"""Positions and velocities in a periodic box, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def vec(prefix: str, names: Sequence[str] = "xyz") -> Vec:
    """The columns prefix + x, y, z."""
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def nearest(dx: Column | str, box: Column | str | float) -> Column:
    """The image of a separation nearest to 0, after one wrap; unchanged where the box is null (not periodic)."""
    dx, half = col(dx), col(box) / 2
    return F.when(dx > half, dx - col(box)).when(dx < -half, dx + col(box)).otherwise(dx)


def wrap(x: Column | str, box: Column | str | float) -> Column:
    """A coordinate brought into [0, box)."""
    share = col(x) / col(box)
    return (share - F.floor(share)) * col(box)


def minus(a: Vec, b: Vec, box: Column | str | float | None = None) -> Vec:
    d = tuple(p - q for p, q in zip(a, b))
    return d if box is None else tuple(nearest(x, box) for x in d)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm2(a: Vec) -> Column:
    """The squared norm."""
    return dot(a, a)


def distance2(a: Vec, b: Vec, box: Column | str | float | None = None) -> Column:
    return norm2(minus(a, b, box))


def distance(a: Vec, b: Vec, box: Column | str | float | None = None) -> Column:
    """Euclidean distance, periodic if a box is given."""
    return F.sqrt(distance2(a, b, box))


def relative_velocity(x: Vec, v: Vec, x0: Vec, v0: Vec, hz: Column | str, a: Column | str, box: Column | str | None) -> Vec:
    """Physical velocity against a moving origin, with the Hubble flow over the physical separation."""
    flow = col(hz) * col(a)
    return tuple(p - q + flow * d for p, q, d in zip(v, v0, minus(x, x0, box)))  # type: ignore[return-value]


def cell(x: Column | str, step: Column | str | float, cells: Column | int) -> Column:
    """The grid cell of a coordinate, within 0 .. cells - 1."""
    n = F.lit(cells) if isinstance(cells, int) else cells
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(col(x) / col(step)))).cast("int")


def neighbour_range(n: Column, density: Column) -> Column:
    """Radius of the sphere that holds n points at a density (points per volume)."""
    return F.pow(n / density * F.lit(0.75 / 3.141592653589793), F.lit(1 / 3))
