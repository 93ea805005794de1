"""Per-part meshes: owned and ghost cells, local numbers, halo tables.

A part is what one solver process holds, so it fits one process; windows by part are bounded by
that. Orders that a distributed arrival would leave open are fixed by global ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meshloom.operators.faces import face_nodes
from meshloom.plans.lineage import large
from meshloom.sources.mesh import LocalMesh, Mesh


def sides(faces: DataFrame, parts: DataFrame) -> DataFrame:
    """Each part's view of its faces: part, owner_gid, neigh_gid?, nb_part?, patch_id?, and the face.

    A face between parts has a row in both, each with its own cell as owner and no patch; any other
    face has one row, with cell_a as owner. ``flip`` tells whether the owner is cell_b.
    """
    a = parts.select(F.col("cell_gid").alias("cell_a"), F.col("part").alias("part_a"))
    b = parts.select(F.col("cell_gid").alias("cell_b"), F.col("part").alias("part_b"))
    f = faces.join(large(a), "cell_a").join(large(b), "cell_b", "left")
    view = lambda p, own, nb, lf, nbp, flip: F.struct(F.col(p).alias("part"), F.col(own).alias("owner_gid"), F.col(nb).alias("neigh_gid"), F.col(lf).alias("lface"), nbp.alias("nb_part"), F.lit(flip).alias("flip"))
    cut = F.col("part_b").isNotNull() & (F.col("part_a") != F.col("part_b"))
    none = F.lit(None).cast("int")
    one = F.array(view("part_a", "cell_a", "cell_b", "lface_a", none, False))
    two = F.array(view("part_a", "cell_a", "cell_b", "lface_a", F.col("part_b"), False), view("part_b", "cell_b", "cell_a", "lface_b", F.col("part_a"), True))
    keep = [c for c in faces.columns if c not in ("lface_a", "lface_b", "patch_id")]
    rows = f.select(*keep, F.when(cut, F.lit(None).cast("int")).otherwise(F.col("patch_id")).alias("patch_id"), F.explode(F.when(cut, two).otherwise(one)).alias("s"))
    return rows.select(*keep, "patch_id", "s.*")


def ghosts(side: DataFrame, parts: DataFrame, kind: str = "face", cells: DataFrame | None = None) -> DataFrame:
    """part, donor, cell_gid of the cells that a part sees but doesn't own.

    ``face``: across faces between parts. ``vertex``: every cell of another part that shares a node
    with an owned cell.
    """
    if kind == "face":
        return side.where("nb_part IS NOT NULL").select("part", F.col("nb_part").alias("donor"), F.col("neigh_gid").alias("cell_gid")).distinct()
    at = cells.select("cell_gid", F.explode("nodes").alias("node")).join(large(parts), "cell_gid")
    near = at.select("part", "node").distinct().join(large(at.select("node", "cell_gid", F.col("part").alias("donor"))), "node")
    return near.where("part <> donor").select("part", "donor", "cell_gid").distinct()


def local_cells(parts: DataFrame, ghost: DataFrame) -> DataFrame:
    """part, local_id, cell_gid, donor (null: owned): owned cells by id, then ghosts by donor and id."""
    rows = parts.select("part", "cell_gid", F.lit(None).cast("int").alias("donor")).unionByName(ghost.select("part", "cell_gid", "donor"))
    w = Window.partitionBy("part").orderBy(F.col("donor").asc_nulls_first(), "cell_gid")
    return rows.select("part", (F.row_number().over(w) - 1).cast("int").alias("local_id"), "cell_gid", "donor")


def owned_cells(parts: DataFrame, metrics: DataFrame) -> DataFrame:
    """part, local_id, cell_gid and metrics of owned cells: the ids of local_cells, where ghosts come
    after them, without the faces that tell the ghosts."""
    w = Window.partitionBy("part").orderBy("cell_gid")
    own = parts.select("part", (F.row_number().over(w) - 1).cast("int").alias("local_id"), "cell_gid")
    return own.join(large(metrics), "cell_gid")


def halo(ghost: DataFrame, local: DataFrame) -> DataFrame:
    """part, nb_part, direction, seq, local_id, cell_gid: what a part receives from and sends to
    each neighbour, both in the order of the receiver's ghosts (global id)."""
    own = local.where("donor IS NULL").select("part", "local_id", "cell_gid")
    seq = (F.row_number().over(Window.partitionBy("part", "donor").orderBy("cell_gid")) - 1).cast("int")
    g = ghost.select("part", "donor", "cell_gid", seq.alias("seq"))
    recv = g.join(large(local.where("donor IS NOT NULL").select("part", "cell_gid", "local_id")), ["part", "cell_gid"])
    recv = recv.select("part", F.col("donor").alias("nb_part"), F.lit("recv").alias("direction"), "seq", "local_id", "cell_gid")
    send = g.select(F.col("donor").alias("part"), F.col("part").alias("nb_part"), "seq", "cell_gid").join(large(own), ["part", "cell_gid"])
    return recv.unionByName(send.select("part", "nb_part", F.lit("send").alias("direction"), "seq", "local_id", "cell_gid"))


def local_nodes(local: DataFrame, cells: DataFrame) -> DataFrame:
    """part, local_id, node_gid, is_owned: nodes of owned cells by id, then nodes of ghosts alone by id."""
    used = local.select("part", "cell_gid", "donor").join(large(cells.select("cell_gid", "nodes")), "cell_gid")
    rows = used.select("part", F.col("donor").isNull().alias("own"), F.explode("nodes").alias("node_gid")).groupBy("part", "node_gid").agg(F.bool_or("own").alias("is_owned"))
    w = Window.partitionBy("part").orderBy(F.desc("is_owned"), "node_gid")
    return rows.select("part", (F.row_number().over(w) - 1).cast("int").alias("local_id"), "node_gid", "is_owned")


def number_faces(side: DataFrame, local: DataFrame) -> DataFrame:
    """``side`` with owner, neigh (local cell ids) and local_id: by owner, then neighbour, boundary first."""
    own = local.select("part", F.col("cell_gid").alias("owner_gid"), F.col("local_id").alias("owner"))
    nb = local.select("part", F.col("cell_gid").alias("neigh_gid"), F.col("local_id").alias("neigh"))
    f = side.join(large(own), ["part", "owner_gid"]).join(large(nb), ["part", "neigh_gid"], "left")
    w = Window.partitionBy("part").orderBy("owner", F.col("neigh").asc_nulls_first(), "lface")
    return f.withColumn("local_id", (F.row_number().over(w) - 1).cast("int"))


def zone():
    """0: between owned cells, 1: to a ghost, 2: on the boundary."""
    return F.when(F.col("neigh").isNull(), 2).when(F.col("nb_part").isNotNull(), 1).otherwise(0)


def zoned_faces(faces: DataFrame, parts: DataFrame) -> DataFrame:
    """The faces of all parts, numbered, without nodes or geometry: for what follows from topology alone."""
    side = sides(faces, parts)
    f = number_faces(side, local_cells(parts, ghosts(side, parts)))
    return f.select("part", "local_id", "owner", "neigh", "owner_gid", "neigh_gid", "nb_part", "patch_id", "lface", zone().alias("zone"))


def bounding_boxes(local: DataFrame, cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per part the box of its owned cells' nodes."""
    own = local.where("donor IS NULL").select("part", "cell_gid").join(cells.select("cell_gid", "nodes"), "cell_gid").select("part", F.explode("nodes").alias("node_gid")).distinct()
    return own.join(nodes, "node_gid").groupBy("part").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def global_counts(side: DataFrame) -> DataFrame:
    """n_faces: local faces less one of each cut pair; n_patched: boundary faces with a patch."""
    cut = F.col("nb_part").isNotNull().cast("long")
    return side.agg((F.count("*") - F.expr("sum(cast(nb_part is not null as bigint)) div 2")).alias("n_faces"), F.expr("sum(cast(nb_part is not null as bigint)) div 2").alias("n_cut"), F.sum(F.col("patch_id").isNotNull().cast("long") * (1 - cut)).alias("n_patched"))


def local_faces(side: DataFrame, cells: DataFrame) -> DataFrame:
    """The faces of all parts with metrics, numbered, normals out of the owner; with nodes in that
    order where ``side`` has n0..n3."""
    sign = F.when(F.col("flip"), -1.0).otherwise(1.0)
    order = F.filter(F.array(*[F.col(f"n{k}") for k in range(4)]), lambda x: x.isNotNull())
    nodes = [F.when(F.col("flip"), F.reverse(order)).otherwise(order).alias("nodes")] if "n0" in side.columns else []
    return number_faces(side, cells).select(
        "part", "local_id", "owner", "neigh", "owner_gid", "neigh_gid", "nb_part", "patch_id", "lface",
        zone().alias("zone"), *nodes, "area", *[(sign * F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"], "fx", "fy", "fz",
    )


def localize(mesh: Mesh, faces: DataFrame, metrics: DataFrame, parts: DataFrame, ghost_kind: str = "face") -> LocalMesh:
    """All tables of the partitioned mesh. ``faces`` carry metrics; a face's normal points out of
    its owner in every part."""
    named = face_nodes(faces, mesh.cells)
    side = sides(named, parts)
    g = ghosts(side, parts, ghost_kind, mesh.cells)
    cells = local_cells(parts, g)
    m = metrics.select("cell_gid", "ctype", "volume", "cx", "cy", "cz")
    part_nodes = local_nodes(cells, mesh.cells)
    f = local_faces(side, cells)
    return LocalMesh(cells.join(large(m), "cell_gid").join(large(mesh.cells.select("cell_gid", "nodes")), "cell_gid"), part_nodes.join(large(mesh.nodes), "node_gid"), f, halo(g, cells))
