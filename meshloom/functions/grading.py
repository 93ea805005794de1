"""Point distributions on an edge of n cells, as fractions of its length."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, functions as F

from meshloom.functions.topology import MeshError


class Grading(Enum):
    UNIFORM = "uniform"
    GEOMETRIC = "geometric"
    TANH_START = "tanh_start"
    TANH_END = "tanh_end"
    TANH_BOTH = "tanh_both"

    @classmethod
    def parse(cls, name: str) -> Grading:
        try:
            return cls(name)
        except ValueError:
            raise MeshError(f"unknown grading {name!r}; known: {', '.join(g.value for g in cls)}") from None


def fraction(i: Column, n: Column, kind: Column, a: Column) -> Column:
    """Where point i of 0..n lies. The ends are exactly 0 and 1. ``kind`` is a Grading's value."""
    s = i.cast("double") / n
    # geometric: the last cell is a times the first, cells grow by one ratio
    ratio = F.pow(a, 1.0 / F.greatest(n - 1, F.lit(1)))
    geometric = F.when(F.abs(a - 1) < 1e-12, s).otherwise((1 - F.pow(ratio, i)) / (1 - F.pow(ratio, n)))
    inner = (
        F.when(kind == Grading.GEOMETRIC.value, geometric)
        .when(kind == Grading.TANH_START.value, 1 - F.tanh(a * (1 - s)) / F.tanh(a))
        .when(kind == Grading.TANH_END.value, F.tanh(a * s) / F.tanh(a))
        .when(kind == Grading.TANH_BOTH.value, 0.5 * (1 + F.tanh(a * (2 * s - 1)) / F.tanh(a)))
        .otherwise(s)
    )
    return F.when(i <= 0, F.lit(0.0)).when(i >= n, F.lit(1.0)).otherwise(inner)
