"""A hexahedral lattice numbered by the dense keys of a table: 25 x 20 x (rows / 500) cells.

Cell g is at i = g % 25, j = g / 25 % 20, k = g / 500; node (i, j, k) is i + 26 j + 546 k at
(i/4, j/8, k/16), exact in binary. Patches 0..5 are the sides x-, x+, y-, y+, z-, z+.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshloom.functions.topology import FACES, CellType
from meshloom.sources.mesh import Mesh

NX, NY = 25, 20
ROW, LAYER = NX + 1, (NX + 1) * (NY + 1)
CORNERS = [0, 1, ROW + 1, ROW, LAYER, LAYER + 1, LAYER + ROW + 1, LAYER + ROW]
SIDE_OF_PATCH = [4, 2, 1, 3, 0, 5]  # the local face that lies on each side


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("cell_gid"))


def placed(keys: DataFrame) -> DataFrame:
    """cell_gid, i, j, k, b (the cell's lowest node)."""
    at = keys.selectExpr("cell_gid", f"cell_gid % {NX} AS i", f"(cell_gid div {NX}) % {NY} AS j", f"cell_gid div {NX * NY} AS k")
    return at.withColumn("b", F.col("i") + ROW * F.col("j") + LAYER * F.col("k"))


def lattice_cells(keys: DataFrame) -> DataFrame:
    return placed(keys).select("cell_gid", F.lit(int(CellType.HEXA)).cast("byte").alias("ctype"), F.array(*[F.col("b") + c for c in CORNERS]).alias("nodes"))


def lattice_nodes(spark: SparkSession, n_cells: int) -> DataFrame:
    n = LAYER * (n_cells // (NX * NY) + 1)
    at = spark.range(n).selectExpr("id AS node_gid", f"(id % {ROW}) / 4.0D AS x", f"((id div {ROW}) % {NY + 1}) / 8.0D AS y", f"(id div {LAYER}) / 16.0D AS z")
    return at


def lattice_surface(keys: DataFrame, n_cells: int) -> DataFrame:
    """Boundary quads: eid = n_cells + 1 + 6 cell_gid + patch, ftype, nodes (outward), patch_id."""
    nz = n_cells // (NX * NY)
    on = ["i = 0", f"i = {NX - 1}", "j = 0", f"j = {NY - 1}", "k = 0", f"k = {nz - 1}"]
    faces = [FACES[CellType.HEXA][s] for s in SIDE_OF_PATCH]
    quads = F.array(*[F.when(F.expr(c), F.struct(F.lit(p).cast("int").alias("patch_id"), F.array(*[F.col("b") + CORNERS[x] for x in f]).alias("nodes"))) for p, (c, f) in enumerate(zip(on, faces, strict=True))])
    rows = placed(keys).select("cell_gid", F.explode(quads).alias("q")).where("q IS NOT NULL")
    return rows.select((F.lit(n_cells + 1) + 6 * F.col("cell_gid") + F.col("q.patch_id")).alias("eid"), F.lit(int(CellType.QUAD)).cast("byte").alias("ftype"), F.col("q.nodes").alias("nodes"), F.col("q.patch_id").alias("patch_id"))


def lattice(spark: SparkSession, sf_dir: str) -> Mesh:
    keys = orders(spark, sf_dir)
    n = keys.count()
    patches = spark.createDataFrame([(p, s, "BCWall" if p == 4 else "BCTypeUserDefined") for p, s in enumerate(("x_min", "x_max", "y_min", "y_max", "z_min", "z_max"))], "patch_id int, name string, cgns_type string")
    return Mesh(lattice_nodes(spark, n), lattice_cells(keys), lattice_surface(keys, n), patches)
