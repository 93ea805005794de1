"""Unique faces by key matching, and the dual graph of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshloom.functions.topology import LFACE_BITS, half_faces, sorted_key
from meshloom.plans.lineage import large

KEY = ["k0", "k1", "k2", "k3"]


def surface_keys(surface: DataFrame) -> DataFrame:
    """k0..k3 and patch_id of surface elements (nodes array of 3 or 4)."""
    n = [F.get("nodes", F.lit(k)) for k in range(4)]
    return surface.select(*sorted_key(*n), "patch_id")


def match(cells: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """One row a face key that a volume cell has: k0..k3, n, low, high, patch_id.

    Cells' half-faces and surface elements meet in one aggregation, so the keys are shuffled once.
    ``low`` and ``high`` are the smallest and largest packed half-face (cell_gid * 8 + lface), plain
    longs, which keeps the aggregation a hash aggregation. Keys of surface elements alone are
    dropped; where several elements share a key the largest patch wins.
    """
    half = half_faces(cells).select(*KEY, (F.col("cell_gid") * LFACE_BITS + F.col("lface")).alias("p"), F.lit(None).cast("int").alias("patch_id"))
    if surface is not None:
        half = half.unionByName(surface_keys(surface).select(*KEY, F.lit(None).cast("long").alias("p"), F.col("patch_id").cast("int").alias("patch_id")))
    g = half.groupBy(*KEY).agg(F.count("p").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"), F.max("patch_id").alias("patch_id"))
    return g.where(F.col("n") > 0)


def build_faces(cells: DataFrame, surface: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Faces: k0..k3, cell_a, lface_a, cell_b?, lface_b?, patch_id?; cell_a < cell_b.

    An inner face has two cells and no patch; a boundary face has one, and the patch of its surface
    element. With ``check`` a key of more than two half-faces (a non-manifold mesh) fails the job.
    """
    g = match(cells, surface)
    n = F.col("n")
    if check:
        n = F.when(n > 2, F.raise_error(F.concat(F.lit("non-manifold face "), F.concat_ws(",", *KEY)))).otherwise(n).cast("long")
    two = n == 2
    cell = lambda c: F.shiftright(c, 3)
    return g.select(
        *KEY,
        cell("low").alias("cell_a"), (F.col("low") % LFACE_BITS).cast("int").alias("lface_a"),
        F.when(two, cell("high")).alias("cell_b"), F.when(two, (F.col("high") % LFACE_BITS).cast("int")).alias("lface_b"),
        F.when(~two, F.col("patch_id")).alias("patch_id"),
    )


def nonmanifold(cells: DataFrame) -> DataFrame:
    """Keys that more than two cells share: k0..k3, n."""
    return match(cells).where(F.col("n") > 2).select(*KEY, "n")


def orphans(cells: DataFrame, surface: DataFrame) -> DataFrame:
    """Surface elements that no cell has as a face: eid."""
    keys = surface.select("eid", *sorted_key(*[F.get("nodes", F.lit(k)) for k in range(4)]))
    return keys.join(half_faces(cells).select(*KEY), KEY, "left_anti").select("eid")


def dual_edges(faces: DataFrame) -> DataFrame:
    """src, dst of every inner face, both ways; two cells with two common faces have two edges."""
    both = F.array(F.struct(F.col("cell_a").alias("src"), F.col("cell_b").alias("dst")), F.struct(F.col("cell_b").alias("src"), F.col("cell_a").alias("dst")))
    return faces.where(F.col("cell_b").isNotNull()).select(F.explode(both).alias("e")).select("e.*")


def adjacency(edges: DataFrame) -> DataFrame:
    """src and its sorted neighbours. A cell has at most six, so the lists are short."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dst"))


def face_stats(faces: DataFrame) -> DataFrame:
    """n_faces, n_boundary, n_inner, n_dual (directed edges)."""
    inner = F.col("cell_b").isNotNull().cast("long")
    return faces.agg(F.count("*").alias("n_faces"), F.sum(1 - inner).alias("n_boundary"), F.sum(inner).alias("n_inner"), F.sum(2 * inner).alias("n_dual"))


def face_nodes(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """``faces`` with n0..n3 in the outward order of cell_a."""
    h = half_faces(cells).select(F.col("cell_gid").alias("cell_a"), F.col("lface").alias("lface_a"), "n0", "n1", "n2", "n3")
    return faces.join(large(h), ["cell_a", "lface_a"])
