"""Planar meshes to meshes of one layer of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshloom.functions.topology import CellType, by_type
from meshloom.sources.mesh import Mesh

AXES = ("x", "y", "z")


def plane_span(nodes: DataFrame) -> DataFrame:
    """One row: span_x, span_y, span_z, and u, v, the axes of the plane. X is dropped where its span
    is at most 1e-14 of the larger other one, else Y likewise, else Z."""
    s = nodes.agg(*[(F.max(a) - F.min(a)).alias(f"span_{a}") for a in AXES])
    x, y, z = (F.col(f"span_{a}") for a in AXES)
    flat_x, flat_y = x <= 1e-14 * F.greatest(y, z), y <= 1e-14 * F.greatest(x, z)
    return s.select("*", F.when(flat_x, "y").otherwise("x").alias("u"), F.when(flat_x | flat_y, "z").otherwise("y").alias("v"))


def thickness(span_u: float, span_v: float, dz: float | None = None) -> float:
    """``dz`` where it is positive, else a tenth of the larger span, or 0.1 of nothing."""
    if dz is not None and dz > 0:
        return dz
    return 0.1 * max(span_u, span_v) or 0.1


def extrude_nodes(nodes: DataFrame, u: str, v: str, dz: float, n: int) -> DataFrame:
    """Every node at z = 0, and again as node_gid + n at z = dz."""
    copies = F.array(F.struct(F.lit(0).cast("long").alias("up"), F.lit(0.0).alias("z")), F.struct(F.lit(n).cast("long").alias("up"), F.lit(float(dz)).alias("z")))
    return nodes.select("node_gid", F.col(u).alias("x"), F.col(v).alias("y"), F.explode(copies).alias("c")).select((F.col("node_gid") + F.col("c.up")).alias("node_gid"), "x", "y", F.col("c.z").alias("z"))


def oriented(cells: DataFrame, nodes: DataFrame, u: str, v: str) -> DataFrame:
    """cell_gid, ctype, nodes of planar cells, counter-clockwise: a negative area swaps two nodes."""
    at = cells.select("cell_gid", F.posexplode("nodes").alias("pos", "node_gid")).join(nodes.select("node_gid", F.col(u).alias("p"), F.col(v).alias("q")), "node_gid")
    wide = at.groupBy("cell_gid").agg(*[F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in ("p", "q")])
    p, q = [F.col(f"p{k}") for k in range(4)], [F.col(f"q{k}") for k in range(4)]
    tri = p[3].isNull()
    term = lambda a, b: p[a] * q[b] - p[b] * q[a]
    area = term(0, 1) + term(1, 2) + F.when(tri, term(2, 0)).otherwise(term(2, 3) + term(3, 0))
    n = [F.get("nodes", F.lit(k)) for k in range(4)]
    turned = F.when(F.size("nodes") == 3, F.array(n[0], n[2], n[1])).otherwise(F.array(n[0], n[3], n[2], n[1]))
    return cells.join(wide.select("cell_gid", (area < 0).alias("neg")), "cell_gid").select("cell_gid", "ctype", F.when(F.col("neg"), turned).otherwise(F.col("nodes")).alias("nodes"))


def extrude(planar: Mesh, dz: float | None = None) -> Mesh:
    """TRI to PRISM, QUAD to HEXA; border bars to quads; caps Z_MIN and Z_MAX as symmetry planes.

    ``planar.surface`` holds the bars (nodes a, b; patch_id by explicit boundary conditions, null
    elsewhere, with ``section``: where no condition names a bar, its section's own patch fills the
    gap). Explicit conditions win.
    """
    spark = planar.nodes.sparkSession
    s = plane_span(planar.nodes).first()
    u, v = s["u"], s["v"]
    h = thickness(s[f"span_{u}"], s[f"span_{v}"], dz)
    n, n_cells = planar.nodes.count(), planar.cells.count()
    flat = oriented(planar.cells, planar.nodes, u, v)
    up = F.transform("nodes", lambda x: x + n)
    cells = flat.select("cell_gid", by_type(F.col("ctype"), {CellType.TRI: int(CellType.PRISM), CellType.QUAD: int(CellType.HEXA)}).cast("byte").alias("ctype"), F.concat("nodes", up).alias("nodes"))
    bars, patches = fill_patches(planar.surface, planar.patches)
    a, b = F.get("nodes", F.lit(0)), F.get("nodes", F.lit(1))
    quads = bars.select("eid", F.lit(int(CellType.QUAD)).cast("byte").alias("ftype"), F.array(a, b, b + n, a + n).alias("nodes"), "patch_id")
    top = max(bars.agg(F.max("eid")).first()[0] or 0, n_cells)
    first = (patches.agg(F.max("patch_id")).first()[0] + 1) if not patches.isEmpty() else 0
    low = flat.select((F.lit(top + 1) + F.col("cell_gid")).alias("eid"), F.col("ctype").alias("ftype"), F.reverse("nodes").alias("nodes"), F.lit(first).alias("patch_id"))
    high = flat.select((F.lit(top + 1 + n_cells) + F.col("cell_gid")).alias("eid"), F.col("ctype").alias("ftype"), up.alias("nodes"), F.lit(first + 1).alias("patch_id"))
    caps = spark.createDataFrame([(first, "Z_MIN", "SymmetryPlane"), (first + 1, "Z_MAX", "SymmetryPlane")], "patch_id int, name string, cgns_type string")
    return Mesh(extrude_nodes(planar.nodes, u, v, h, n), cells, quads.unionByName(low).unionByName(high), patches.unionByName(caps))


def fill_patches(bars: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars without a patch get the patch named like their section, a new one where there is none."""
    if "section" not in bars.columns:
        return bars, patches
    names = [r[0] for r in bars.where("patch_id IS NULL").select("section").distinct().orderBy("section").collect()]  # sections of a file
    known = {r["name"]: r["patch_id"] for r in patches.collect()}
    at = max([-1, *known.values()]) + 1
    new = [(at + k, x, "UserDefined") for k, x in enumerate(x for x in names if x not in known)]
    if new:
        patches = patches.unionByName(patches.sparkSession.createDataFrame(new, "patch_id int, name string, cgns_type string"))
    by_name = F.broadcast(patches.select(F.col("name").alias("section"), F.col("patch_id").alias("own")))  # one row a patch
    return bars.join(by_name, "section", "left").withColumn("patch_id", F.coalesce("patch_id", "own").cast("int")).drop("own"), patches
