"""Derived face geometry, and wall distance on the cell graph."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column, DataFrame, functions as F

from meshloom.functions.vectors import Vec, dot, norm, scale, sub, vec
from meshloom.operators.partition import hilbert_partition
from meshloom.operators.relax import shortest_ways
from meshloom.plans.lineage import large, settled

TINY = 1e-30
BLOCK = 1 << 17  # cells that one process relaxes at a time


class Geom(IntFlag):
    VECTOR = 1
    DISTANCE = 2
    INVERSE_DISTANCE = 4
    WEIGHT = 8
    NON_ORTHOGONAL = 16
    ALL = 31


def with_centroids(faces: DataFrame, metrics: DataFrame) -> DataFrame:
    """``faces`` (with metrics) and both cells' centroids: lx, ly, lz and rx, ry, rz (null on the boundary)."""
    left = metrics.select(F.col("cell_gid").alias("cell_a"), *[F.col(f"c{a}").alias(f"l{a}") for a in "xyz"])
    right = metrics.select(F.col("cell_gid").alias("cell_b"), *[F.col(f"c{a}").alias(f"r{a}") for a in "xyz"])
    return faces.join(large(left), "cell_a").join(large(right), "cell_b", "left")


def _vector() -> Vec:
    """From cell to cell; on the boundary twice the way from the cell to the face."""
    boundary = F.col("cell_b").isNull()
    inner, outer = sub(vec("r"), vec("l")), scale(sub(vec("f"), vec("l")), 2.0)
    return tuple(F.when(boundary, o).otherwise(i) for i, o in zip(inner, outer, strict=True))


def inverse(d: Column) -> Column:
    return 1.0 / F.greatest(d, F.lit(TINY))


def face_geometry(faces: DataFrame, metrics: DataFrame, which: Geom = Geom.ALL) -> DataFrame:
    """``faces`` with the columns asked for: dx, dy, dz; distance; inverse_distance; weight (of the
    left cell, 0.5 on the boundary); tx, ty, tz (the non-orthogonal part of the area vector)."""
    df = with_centroids(faces, metrics)
    df = df.select("*", *[c.alias(f"d{a}") for a, c in zip("xyz", _vector(), strict=True)])
    d, n = vec("d"), vec("n")
    out: list[Column] = []
    if which & Geom.VECTOR:
        out += list(d)
    if which & Geom.DISTANCE:
        out.append(norm(d).alias("distance"))
    if which & Geom.INVERSE_DISTANCE:
        out.append(inverse(norm(d)).alias("inverse_distance"))
    if which & Geom.WEIGHT:
        lf, rf = F.abs(dot(sub(vec("f"), vec("l")), n)), F.abs(dot(sub(vec("r"), vec("f")), n))
        total = lf + rf
        out.append(F.when(F.col("cell_b").isNull() | (total <= TINY), F.lit(0.5)).otherwise(rf / F.when(total <= TINY, 1.0).otherwise(total)).alias("weight"))
    if which & Geom.NON_ORTHOGONAL:
        s = scale(n, F.col("area"))
        k = dot(s, s) / F.greatest(dot(d, s), F.lit(TINY))
        out += [(s[x] - k * d[x]).alias(f"t{a}") for x, a in enumerate("xyz")]
    return df.select(*faces.columns, *out)


def edge_lengths(edges: DataFrame, metrics: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, w: the way between two cells' centroids. ``more`` names columns of metrics to take
    from both ends: src_<name>, dst_<name>."""
    m = lambda end, p: metrics.select(F.col("cell_gid").alias(end), *[F.col(f"c{a}").alias(f"{p}{a}") for a in "xyz"], *[F.col(c).alias(f"{end}_{c}") for c in more])
    return edges.join(large(m("src", "l")), "src").join(large(m("dst", "r")), "dst").select("src", "dst", norm(sub(vec("r"), vec("l"))).alias("w"), *[f"{end}_{c}" for c in more for end in ("src", "dst")])


def wall_seeds(faces: DataFrame, metrics: DataFrame, walls: list[int]) -> DataFrame:
    """cell_gid, d: from cells at a wall patch to the nearest of their wall faces."""
    f = faces.where(F.col("patch_id").isin(walls)).select(F.col("cell_a").alias("cell_gid"), "fx", "fy", "fz")
    c = metrics.select("cell_gid", "cx", "cy", "cz")
    return f.join(large(c), "cell_gid").groupBy("cell_gid").agg(F.min(norm(sub(vec("f"), vec("c")))).alias("d"))


def wall_distance(metrics: DataFrame, faces: DataFrame, edges: DataFrame, walls: list[int], max_sweeps: int | None = None, rel_tol: float = 0.0) -> DataFrame:
    """cell_gid, distance: the shortest way over ``edges`` (face or node neighbours) to a wall.

    Min-plus relaxation, to its end within pieces of the Hilbert order, in sweeps between them. It
    ends when no distance falls (relatively more than ``rel_tol``). Cells that no wall reaches stay
    null. Every sweep ends in a checkpoint.
    """
    c = settled(metrics.select("cell_gid", "cx", "cy", "cz"))  # read for their number, order, edges and seeds
    k = -(-c.count() // BLOCK)
    if k > 1:
        c = settled(c.join(large(hilbert_partition(c, k).withColumnRenamed("part", "block")), "cell_gid"))
    else:
        c = c.withColumn("block", F.lit(0))
    w = edge_lengths(edges, c, ("block",)).withColumnsRenamed({"src_block": "block", "dst_block": "to_block"})
    seeds = wall_seeds(faces, c, walls).join(large(c.select("cell_gid", "block")), "cell_gid")
    return shortest_ways(c.select("cell_gid", "block"), w, seeds, max_sweeps, rel_tol).withColumnRenamed("d", "distance")
