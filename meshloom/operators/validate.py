"""Contracts of a partitioned mesh as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meshloom.operators.reorder import patch_ranges
from meshloom.functions.topology import NODES_PER_TYPE, MeshError, by_type
from meshloom.functions.vectors import dot, norm, sub, vec
from meshloom.plans.lineage import large
from meshloom.sources.mesh import LocalMesh


def cell_violations(m: LocalMesh) -> DataFrame:
    """Node count of the type, volume, and that owned cells use owned nodes: part, local_id, kind."""
    c = m.part_cells
    kind = F.when(F.size("nodes") != by_type(F.col("ctype"), {t: n for t, n in NODES_PER_TYPE.items()}), "node_count").when(~(F.col("volume") > 1e-15), "volume")
    own = c.where("donor IS NULL").select("part", "local_id", F.explode("nodes").alias("node_gid")).distinct()
    lost = own.join(large(m.part_nodes.where("is_owned").select("part", "node_gid")), ["part", "node_gid"], "left_anti")
    return c.select("part", "local_id", kind.alias("kind")).where("kind IS NOT NULL").unionByName(lost.select("part", "local_id", F.lit("node_owner").alias("kind")).distinct())


def zone_violations(m: LocalMesh) -> DataFrame:
    """Faces in a zone that they don't belong to: part, local_id, kind."""
    own = m.part_cells.select("part", F.col("local_id").alias("neigh"), F.col("donor").isNotNull().alias("ghost"))
    f = m.part_faces.join(large(own), ["part", "neigh"], "left")
    kind = (
        F.when((F.col("zone") == 0) & (F.col("ghost").isNull() | F.col("ghost") | F.col("patch_id").isNotNull()), "inner")
        .when((F.col("zone") == 1) & (~F.coalesce("ghost", F.lit(False)) | F.col("patch_id").isNotNull()), "coupled")
        .when((F.col("zone") == 2) & F.col("neigh").isNotNull(), "boundary")
        .when((F.col("zone") == 2) & F.col("patch_id").isNull(), "no_patch")
    )
    return f.select("part", "local_id", kind.alias("kind")).where("kind IS NOT NULL")


def order_violations(part_faces: DataFrame) -> DataFrame:
    """Faces that don't follow their predecessor: strictly by (owner, neigh) in the inner zones, by
    (patch, owner) on the boundary. Columns part, local_id."""
    w = Window.partitionBy("part", "zone").orderBy("local_id")
    boundary = F.col("zone") == 2
    k1, k2 = F.when(boundary, F.coalesce("patch_id", F.lit(2147483647))).otherwise(F.col("owner")), F.when(boundary, F.col("owner")).otherwise(F.col("neigh"))
    f = part_faces.select("part", "zone", "local_id", k1.alias("k1"), k2.alias("k2")).withColumns({"p1": F.lag("k1").over(w), "p2": F.lag("k2").over(w)})
    less = (F.col("k1") < F.col("p1")) | ((F.col("k1") == F.col("p1")) & (F.col("k2") < F.col("p2")))
    same = (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2"))
    return f.where(less | (same & (F.col("zone") < 2))).select("part", "local_id")


def unpatched(part_faces: DataFrame) -> DataFrame:
    return part_faces.where("zone = 2 AND patch_id IS NULL").select("part", "local_id")


def normal_violations(part_faces: DataFrame, part_cells: DataFrame) -> DataFrame:
    """Normals that aren't unit vectors (1e-6) or don't point out of the owner: part, local_id, kind."""
    c = part_cells.select("part", F.col("local_id").alias("owner"), "cx", "cy", "cz")
    f = part_faces.join(large(c), ["part", "owner"])
    kind = F.when(F.abs(norm(vec("n")) - 1) > 1e-6, "length").when(dot(vec("n"), sub(vec("f"), vec("c"))) <= 0, "inward")
    return f.select("part", "local_id", kind.alias("kind")).where("kind IS NOT NULL")


def halo_violations(halo: DataFrame) -> DataFrame:
    """Cells that one side sends and the other doesn't receive, or the other way round, place by place."""
    send = halo.where("direction = 'send'").select("part", "nb_part", "seq", "cell_gid", F.lit(1).alias("s"))
    recv = halo.where("direction = 'recv'").select(F.col("nb_part").alias("part"), F.col("part").alias("nb_part"), "seq", "cell_gid", F.lit(1).alias("r"))
    both = send.join(recv, ["part", "nb_part", "seq", "cell_gid"], "full")
    return both.where("s IS NULL OR r IS NULL").select("part", "nb_part", "seq", "cell_gid")


def patch_violations(part_faces: DataFrame) -> DataFrame:
    """part, patch_id of patches whose faces aren't one gapless range of the zone-sorted faces."""
    return patch_ranges(part_faces).where("end - first <> n_faces").select("part", "patch_id")


def face_conservation(part_faces: DataFrame, n_faces: int) -> DataFrame:
    """One row: n_pure, n_cut (local sides), n_boundary, balanced."""
    counts = part_faces.agg(*[F.sum((F.col("zone") == k).cast("long")).alias(n) for k, n in enumerate(("n_pure", "n_cut", "n_boundary"))])
    total = F.col("n_pure") + F.floor(F.col("n_cut") / 2) + F.col("n_boundary")
    return counts.withColumn("balanced", (F.col("n_cut") % 2 == 0) & (total == n_faces))


def part_report(m: LocalMesh) -> DataFrame:
    """part, n_own, n_ghost, n_faces, n_cut, volume."""
    c = m.part_cells.groupBy("part").agg(F.sum(F.col("donor").isNull().cast("long")).alias("n_own"), F.sum(F.col("donor").isNotNull().cast("long")).alias("n_ghost"), F.sum(F.when(F.col("donor").isNull(), F.col("volume"))).alias("volume"))
    f = m.part_faces.groupBy("part").agg(F.count("*").alias("n_faces"), F.sum((F.col("zone") == 1).cast("long")).alias("n_cut"))
    return c.join(f, "part")


def patch_report(part_faces: DataFrame) -> DataFrame:
    return part_faces.where("zone = 2").groupBy("patch_id").agg(F.count("*").alias("n_faces"), F.sum("area").alias("area"))


def validate(m: LocalMesh, n_faces: int) -> None:
    """Raise MeshError with some of the offending rows if any contract is broken."""
    checks = {
        "cells": cell_violations(m), "zones": zone_violations(m), "order": order_violations(m.part_faces), "normals": normal_violations(m.part_faces, m.part_cells), "halo": halo_violations(m.halo),
        "patches": patch_violations(m.part_faces), "faces": face_conservation(m.part_faces, n_faces).where("NOT balanced"),
    }
    for name, bad in checks.items():
        if rows := bad.take(5):
            raise MeshError(f"{name}: {rows}")
