"""Transfinite interpolation of corner values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column


def edge(a, b, u: Column) -> Column:
    return (1.0 - u) * a + u * b


def quad(corners: Sequence, u: Column, v: Column) -> Column:
    """Corners at (0,0), (1,0), (1,1), (0,1)."""
    return corners[0] * ((1.0 - u) * (1.0 - v)) + corners[1] * (u * (1.0 - v)) + corners[2] * (u * v) + corners[3] * ((1.0 - u) * v)


def hexa(corners: Sequence, u: Column, v: Column, w: Column) -> Column:
    """Corners of the bottom, then of the top, each in the order of ``quad``; summed in order."""
    low, p, q = 1.0 - w, 1.0 - u, 1.0 - v
    weights = [p * q * low, u * q * low, u * v * low, p * v * low, p * q * w, u * q * w, u * v * w, p * v * w]
    out = corners[0] * weights[0]
    for c, k in zip(corners[1:], weights[1:], strict=True):
        out = out + c * k
    return out
