"""Regions of interest: half-open boxes over (t, z, y, x) that compile to column predicates."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = ("t", "z", "y", "x")


@dataclass(frozen=True)
class Roi:
    """``offset`` and ``shape`` by dimension; a shape of None is unbounded above."""

    offset: tuple
    shape: tuple

    @property
    def end(self) -> tuple:
        return tuple(None if s is None else o + s for o, s in zip(self.offset, self.shape))

    def contains(self, dims=DIMS, prefix: str = "") -> Column:
        out = F.lit(True)
        for d, low, high in zip(dims, self.offset, self.end):
            out = out & (F.col(prefix + d) >= low)
            if high is not None:
                out = out & (F.col(prefix + d) < high)
        return out

    def intersect(self, other: Roi) -> Roi:
        low = tuple(map(max, self.offset, other.offset))
        high = tuple(b if a is None else a if b is None else min(a, b) for a, b in zip(self.end, other.end))
        return Roi(low, tuple(None if h is None else max(0, h - o) for o, h in zip(low, high)))

    def union(self, other: Roi) -> Roi:
        low = tuple(map(min, self.offset, other.offset))
        return Roi(low, tuple(None if a is None or b is None else max(a, b) - o for o, a, b in zip(low, self.end, other.end)))

    def grow(self, below: tuple, above: tuple) -> Roi:
        return Roi(tuple(o - b for o, b in zip(self.offset, below)), tuple(None if s is None else s + b + a for s, b, a in zip(self.shape, below, above)))

    def snap(self, grid: tuple) -> Roi:
        """The least box on the grid that holds this one."""
        low = tuple(floor(o / g) * g for o, g in zip(self.offset, grid))
        return Roi(low, tuple(None if e is None else ceil(e / g) * g - o for o, e, g in zip(low, self.end, grid)))


def frame_value(frame: Column, values: dict[int, float]) -> Column:
    """Step lookup: the value of the least key above ``frame``; key -1 is the default; without one a miss is an error."""
    out = None
    for key in sorted(k for k in values if k != -1):
        out = F.when(frame < key, F.lit(float(values[key]))) if out is None else out.when(frame < key, F.lit(float(values[key])))
    rest = F.lit(float(values[-1])) if -1 in values else F.raise_error(F.lit("no value for this frame")).cast("double")
    return rest if out is None else out.otherwise(rest)


def radius_value(frame: Column, radius: Column, setting: bool | dict[int, float]) -> Column:
    """Point radius: the row's own (true), the only value of a map, or its step lookup."""
    if isinstance(setting, bool):
        return radius
    if len(setting) == 1:
        return F.lit(float(next(iter(setting.values()))))
    return frame_value(frame, setting)


def distance2(a: str = "a_", b: str = "b_", dims=("z", "y", "x")) -> Column:
    """Squared distance by products, the same in any engine."""
    parts = [(F.col(a + d) - F.col(b + d)) * (F.col(a + d) - F.col(b + d)) for d in dims]
    return sum(parts[1:], parts[0])


def close_to_border(roi: Roi, distance: float | dict) -> Column:
    """Within ``distance`` (of a map, its least value) of a spatial side of the box."""
    d = float(min(distance.values()) if isinstance(distance, dict) else distance)
    out = F.lit(False)
    for name, low, high in zip(DIMS[1:], roi.offset[1:], roi.end[1:]):
        out = out | (F.col(name) - d < low)
        if high is not None:
            out = out | (F.col(name) + d >= high)
    return out
