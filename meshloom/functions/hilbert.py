"""Hilbert curve keys in three dimensions, 21 bits an axis."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BITS = 21


def hilbert_key(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Key of integer coordinates in [0, 2**bits), by Skilling's transform as one fold.

    The fold keeps the expression small: written out step by step it would double in size with
    every bit. x has the highest bit of each triple.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def inverse(s: Column, b: Column) -> Column:
        """Undo the excess work of one bit level: exchange or invert the lower bits."""
        q = F.call_function("shiftleft", one, b)
        p = q - 1
        sx, sy, sz = s["x"], s["y"], s["z"]
        # axis 0 against itself, then 1 and 2 against axis 0
        x0 = F.when(sx.bitwiseAND(q) != 0, sx.bitwiseXOR(p)).otherwise(sx)
        t1 = x0.bitwiseXOR(sy).bitwiseAND(p)
        hit1 = sy.bitwiseAND(q) != 0
        x1 = F.when(hit1, x0.bitwiseXOR(p)).otherwise(x0.bitwiseXOR(t1))
        y1 = F.when(hit1, sy).otherwise(sy.bitwiseXOR(t1))
        t2 = x1.bitwiseXOR(sz).bitwiseAND(p)
        hit2 = sz.bitwiseAND(q) != 0
        x2 = F.when(hit2, x1.bitwiseXOR(p)).otherwise(x1.bitwiseXOR(t2))
        z2 = F.when(hit2, sz).otherwise(sz.bitwiseXOR(t2))
        return F.struct(x2.alias("x"), y1.alias("y"), z2.alias("z"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z"))
    levels = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1))

    def finish(s: Column) -> Column:
        """Gray encode, then interleave."""
        gx = s["x"]
        gy = s["y"].bitwiseXOR(gx)
        gz = s["z"].bitwiseXOR(gy)
        t = F.aggregate(levels, zero, lambda acc, b: F.when(gz.bitwiseAND(F.call_function("shiftleft", one, b)) != 0, acc.bitwiseXOR(F.call_function("shiftleft", one, b) - 1)).otherwise(acc))
        ux, uy, uz = (g.bitwiseXOR(t) for g in (gx, gy, gz))

        def spread(acc: Column, b: Column) -> Column:
            bit = lambda u: F.call_function("shiftright", u, b).bitwiseAND(one)
            return F.shiftleft(acc, 3).bitwiseOR(F.shiftleft(bit(ux), 2)).bitwiseOR(F.shiftleft(bit(uy), 1)).bitwiseOR(bit(uz))

        return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), zero, spread)

    return F.aggregate(levels, start, inverse, finish)
