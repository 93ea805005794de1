"""Orders of a part's owned cells, and what follows from them: local ids, face zones."""

from __future__ import annotations

from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from meshloom.functions.topology import MeshError
from meshloom.operators.partition import box_key
from meshloom.sources.mesh import LocalMesh


class Method(Enum):
    NONE = "NONE"
    RCM = "RCM"
    HILBERT = "HILBERT"

    @classmethod
    def parse(cls, name: str) -> Method:
        found = {"NONE": cls.NONE, "RCM": cls.RCM, "SFC": cls.HILBERT, "HILBERT_SFC": cls.HILBERT, "HILBERT": cls.HILBERT}.get(name.upper())
        if found is None:
            raise MeshError(f"unknown order {name!r}; known: NONE, RCM, SFC, HILBERT_SFC")
        return found


def hilbert_order(own: DataFrame) -> DataFrame:
    """part, old, new of owned cells (part, local_id, cx, cy, cz): along the curve in the part's own box."""
    keyed = box_key(own.select("part", "local_id", "cx", "cy", "cz"), ["part"])
    w = Window.partitionBy("part").orderBy("hkey", "local_id")
    return keyed.select("part", F.col("local_id").alias("old"), (F.row_number().over(w) - 1).cast("int").alias("new"))


def owned_graph(part_faces: DataFrame) -> DataFrame:
    """part, src, dst (local ids, both ways) of faces between two owned cells."""
    f = part_faces.where("zone = 0")
    both = F.array(F.struct(F.col("owner").alias("src"), F.col("neigh").alias("dst")), F.struct(F.col("neigh").alias("src"), F.col("owner").alias("dst")))
    return f.select("part", F.explode(both).alias("e")).select("part", "e.*")


def level_sets(neighbours: list[list[int]], root: int) -> list[list[int]]:
    """The vertices at distance 0, 1, 2, ... of ``root``."""
    met, out = {root}, [[root]]
    while front := sorted({v for u in out[-1] for v in neighbours[u]} - met):
        met.update(front)
        out.append(front)
    return out


def pseudo_peripheral(neighbours: list[list[int]], root: int) -> int:
    """A vertex about as far away as any (George and Liu): on to the last level's vertex of least
    degree, lowest id, for as long as that has more levels."""
    levels = level_sets(neighbours, root)
    while True:
        root = min(levels[-1], key=lambda v: (len(neighbours[v]), v))
        deeper = level_sets(neighbours, root)
        if len(deeper) <= len(levels):
            return root
        levels = deeper


def bandwidth_order(n: int, neighbours: list[list[int]]) -> list[int]:
    """Old ids in new order: reverse Cuthill-McKee, component by component from the lowest id."""
    out: list[int] = []
    placed: set[int] = set()
    for lowest in range(n):
        if lowest in placed:
            continue
        numbered = [pseudo_peripheral(neighbours, lowest)]
        placed.update(numbered)
        for u in numbered:  # grows while it is read
            fresh = sorted(set(neighbours[u]) - placed, key=lambda v: (len(neighbours[v]), v))
            placed.update(fresh)
            numbered += fresh
        out += numbered
    return out[::-1]


def rcm_order(own: DataFrame, part_faces: DataFrame) -> DataFrame:
    """part, old, new by reverse Cuthill-McKee. Sequential within a part, which fits one process."""
    rows = own.select("part", F.col("local_id").alias("src"), F.lit(None).cast("int").alias("dst")).unionByName(owned_graph(part_faces))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["src"].max()) + 1
        neighbours: list[list[int]] = [[] for _ in range(n)]
        e = pdf[pdf["dst"].notna()].sort_values(["src", "dst"])
        for u, v in zip(e["src"].tolist(), e["dst"].astype(int).tolist(), strict=True):
            neighbours[u].append(v)
        old = bandwidth_order(n, neighbours)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "old": old, "new": range(n)})

    return rows.groupBy("part").applyInPandas(order, "part int, old int, new int")


def bandwidth(part_faces: DataFrame) -> DataFrame:
    """part, bandwidth: the largest distance of two neighbours' local ids."""
    return part_faces.where("zone = 0").groupBy("part").agg(F.max(F.abs(F.col("owner") - F.col("neigh"))).alias("bandwidth"))


def zone_sort(part_faces: DataFrame) -> DataFrame:
    """local_id anew: inner faces, then those to ghosts, each by (owner, neigh); then the boundary
    by (patch, owner). ``lface`` settles what is left open."""
    boundary = F.col("zone") == 2
    k1 = F.when(boundary, F.coalesce("patch_id", F.lit(2147483647))).otherwise(F.col("owner"))
    k2 = F.when(boundary, F.col("owner")).otherwise(F.col("neigh"))
    w = Window.partitionBy("part").orderBy("zone", k1, k2, "lface")
    return part_faces.withColumn("local_id", (F.row_number().over(w) - 1).cast("int"))


def zone_counts(part_faces: DataFrame) -> DataFrame:
    return part_faces.groupBy("part").agg(*[F.sum((F.col("zone") == k).cast("long")).alias(f"n_zone{k}") for k in range(3)])


def patch_ranges(part_faces: DataFrame) -> DataFrame:
    """part, patch_id, n_faces, first, end: where a patch's faces lie after the zone sort."""
    return part_faces.where("zone = 2 AND patch_id IS NOT NULL").groupBy("part", "patch_id").agg(F.count("*").alias("n_faces"), F.min("local_id").alias("first"), (F.max("local_id") + 1).alias("end"))


def permute(mesh: LocalMesh, order: DataFrame) -> LocalMesh:
    """Give owned cells new local ids; ghosts keep theirs. Faces and halo follow, faces are zone-sorted."""
    to = order.select("part", F.col("old").alias("local_id"), "new")
    renumber = lambda df, col: df.join(to.withColumnRenamed("local_id", col).withColumnRenamed("new", "_new"), ["part", col], "left").withColumn(col, F.coalesce("_new", col)).drop("_new")
    cells = renumber(mesh.part_cells, "local_id")
    faces = zone_sort(renumber(renumber(mesh.part_faces, "owner"), "neigh"))
    halo = renumber(mesh.halo, "local_id")
    return LocalMesh(cells.select(mesh.part_cells.columns), mesh.part_nodes, faces.select(mesh.part_faces.columns), halo.select(mesh.halo.columns))


def reorder(mesh: LocalMesh, method: Method | str = Method.NONE) -> LocalMesh:
    """NONE still sorts the faces by zone."""
    method = Method.parse(method) if isinstance(method, str) else method
    own = mesh.part_cells.where("donor IS NULL")
    if method is Method.NONE:
        return LocalMesh(mesh.part_cells, mesh.part_nodes, zone_sort(mesh.part_faces), mesh.halo)
    return permute(mesh, hilbert_order(own) if method is Method.HILBERT else rcm_order(own, mesh.part_faces))
