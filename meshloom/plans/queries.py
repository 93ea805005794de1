"""One query for each operator, on meshes that the driver's tables define."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshloom.functions import tfi
from meshloom.functions.grading import Grading, fraction
from meshloom.functions.topology import half_faces, type_name, vtk_type
from meshloom.operators import auxgeom, connectivity, distribution, extrude, faces as fc, geometry, localize, partition, reorder, validate
from meshloom.plans.lineage import settled
from meshloom.sources import exports, generator, lattice as lat, mesh as ms
from meshloom.sources.mesh import LocalMesh, Mesh

K = 8
WALL = 4
DIGITS = 9
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in cols})


def n_cells(spark: SparkSession, sf_dir: str) -> int:
    return lat.orders(spark, sf_dir).count()


def parts_of(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return partition.block_partition(lat.orders(spark, sf_dir), n_cells(spark, sf_dir), k)


def faces_of(spark: SparkSession, sf_dir: str) -> tuple[Mesh, DataFrame]:
    m = lat.lattice(spark, sf_dir)
    return m, fc.build_faces(m.cells, m.surface)


def sides_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localize.sides(faces_of(spark, sf_dir)[1], parts_of(spark, sf_dir))


def measured(spark: SparkSession, sf_dir: str) -> tuple[Mesh, DataFrame, DataFrame]:
    m, f = faces_of(spark, sf_dir)
    return m, *geometry.mesh_metrics(f, m.cells, m.nodes)


def localized(spark: SparkSession, sf_dir: str) -> LocalMesh:
    m, f, c = measured(spark, sf_dir)
    return localize.localize(m, f, c, parts_of(spark, sf_dir))


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localize.zoned_faces(faces_of(spark, sf_dir)[1], parts_of(spark, sf_dir))


# -- distribution

@query
def block_distribution(spark, sf_dir):
    n = n_cells(spark, sf_dir)
    r = F.col("id")
    start = lambda x: distribution.block_start(x, F.lit(n), F.lit(7))
    return spark.range(7).select(r.alias("block"), start(r).alias("first"), start(r + 1).alias("end"))


@query
def block_owner_lookup(spark, sf_dir):
    n = n_cells(spark, sf_dir)
    return lat.orders(spark, sf_dir).select("cell_gid", distribution.block_owner(F.col("cell_gid"), n, 7).alias("block"))


@query
def rank_exscan(spark, sf_dir):
    return distribution.exclusive_prefix(partition.part_sizes(parts_of(spark, sf_dir)), "part", "n_cells", "before")


@query
def csr_offsets(spark, sf_dir):
    degree = fc.dual_edges(faces_of(spark, sf_dir)[1]).groupBy(F.col("src").alias("cell_gid")).agg(F.count("*").alias("degree"))
    return distribution.inclusive_offsets(degree.join(parts_of(spark, sf_dir), "cell_gid"), "part", "cell_gid", "degree", "row_end")


@query
def global_cell_rank(spark, sf_dir):
    keys = lat.placed(lat.orders(spark, sf_dir)).select("cell_gid", (F.col("k") + F.col("i")).alias("key"))
    return distribution.global_rank(keys, ["key", "cell_gid"]).withColumn("rank", F.col("rank").cast("long"))


# -- generator

def _grading(kind: Grading, a: float) -> Query:
    def run(spark, sf_dir):
        return spark.range(65).select(F.col("id").alias("i"), F.round(fraction(F.col("id"), F.lit(64), F.lit(kind.value), F.lit(a)), DIGITS).alias("s"))

    return run


GRADINGS = {"uniform": 1.0, "geometric": 2.0, "tanh_start": 2.5, "tanh_end": 2.5, "tanh_both": 2.5}
for _name, _a in GRADINGS.items():
    QUERIES[f"grading_{_name}"] = _grading(Grading(_name), _a)

TFI_CORNERS = [(0, 0, 0), (2, 0, 0.5), (2.5, 1.5, 0), (0, 1, 0), (0, 0.25, 2), (2, 0, 2), (2, 1, 3), (-0.5, 1, 2)]


@query
def tfi_nodes(spark, sf_dir):
    nodes = lat.lattice_nodes(spark, n_cells(spark, sf_dir))
    u, v, w = F.col("x") / 6.25, F.col("y") / 2.5, F.col("z") / F.lit(n_cells(spark, sf_dir) / 500 / 16)
    out = nodes.select("node_gid", *[tfi.hexa([F.lit(float(c[a])) for c in TFI_CORNERS], u, v, w).alias(n) for a, n in enumerate("xyz")])
    return rounded(out, "x", "y", "z")


def _config(spark: SparkSession, sf_dir: str) -> generator.Config:
    """Two graded blocks side by side, as deep as the lattice has layers."""
    nz = n_cells(spark, sf_dir) // 500
    return generator.parse_config(f"""
        [mesh]
        scale = 0.5
        vertices = [[0,0,0],[2,0,0],[2,2,0],[0,2,0],[0,0,2],[2,0,2],[2,2,2],[0,2,2],[6,0,0],[6,2,0],[6,0,2],[6,2,2]]
        [[blocks]]
        vertices = [0,1,2,3,4,5,6,7]
        cells = [10,8,{nz}]
        grading_type = ["uniform","tanh_both","geometric"]
        grading = [1.0,2.0,3.0]
        [[blocks]]
        vertices = [1,8,9,2,5,10,11,6]
        cells = [12,8,{nz}]
        grading_type = ["geometric","tanh_both","geometric"]
        grading = [2.0,2.0,3.0]
        [[boundaries]]
        name = "inlet"
        faces = [[0,4,7,3]]
        [[boundaries]]
        name = "bottom"
        faces = [[0,3,2,1],[1,2,9,8]]
    """)


@query
def generator_report(spark, sf_dir):
    """Counts and measures of the generated grid, by closed form in the oracle."""
    mesh = generator.generate(spark, _config(spark, sf_dir))
    f, c = geometry.mesh_metrics(fc.build_faces(mesh.cells, mesh.surface), mesh.cells, mesh.nodes)
    area = lambda p: F.round(F.sum(F.when(F.col("patch_id") == p, F.col("area"))), DIGITS)
    one = [
        f.agg(F.count("*").cast("double").alias("n_faces"), F.count("patch_id").cast("double").alias("n_patched"), area(0).alias("inlet_area"), area(1).alias("bottom_area")),
        c.agg(F.count("*").cast("double").alias("n_cells"), F.round(F.sum("volume"), DIGITS).alias("volume")),
        mesh.nodes.agg(F.countDistinct("node_gid").cast("double").alias("n_nodes"), F.max("node_gid").cast("double").alias("last_node")),
    ]
    rows = [d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in d.columns])).alias("r")).select("r.*") for d in one]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def lattice_cells(spark, sf_dir):
    return lat.lattice_cells(lat.orders(spark, sf_dir)).select("cell_gid", F.posexplode("nodes").alias("pos", "node_gid"))


@query
def lattice_nodes(spark, sf_dir):
    return lat.lattice_nodes(spark, n_cells(spark, sf_dir))


@query
def boundary_quads(spark, sf_dir):
    return lat.lattice_surface(lat.orders(spark, sf_dir), n_cells(spark, sf_dir)).select("eid", "patch_id", *[F.get("nodes", F.lit(k)).alias(f"n{k}") for k in range(4)])


# -- extrusion: a 5 x 5 plane of the nations, in x and z

def _planar(spark: SparkSession, sf_dir: str) -> Mesh:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as bigint) AS g")
    b = F.expr("g % 5 + 6 * (g div 5)")
    turned = F.expr("g % 2 = 1")
    quad = F.when(turned, F.array(b, b + 6, b + 7, b + 1)).otherwise(F.array(b, b + 1, b + 7, b + 6))
    cells = nation.select(F.col("g").alias("cell_gid"), F.lit(5).cast("byte").alias("ctype"), quad.alias("nodes"))
    nodes = spark.range(36).selectExpr("id AS node_gid", "(id % 6) / 2.0D AS x", "3.0D AS y", "(id div 6) / 4.0D AS z")
    bars = spark.range(5).selectExpr("26 + id AS eid", "cast(4 as tinyint) AS ftype", "array(id, id + 1) AS nodes", "cast(if(id < 2, 0, null) as int) AS patch_id", "'south' AS section")
    patches = spark.createDataFrame([(0, "named", "BCWall")], "patch_id int, name string, cgns_type string")
    return Mesh(nodes, cells, bars, patches)


@query
def plane_span(spark, sf_dir):
    return extrude.plane_span(_planar(spark, sf_dir).nodes)


@query
def extrude_nodes(spark, sf_dir):
    return extrude.extrude(_planar(spark, sf_dir)).nodes


@query
def extrude_cells(spark, sf_dir):
    return extrude.extrude(_planar(spark, sf_dir)).cells.select("cell_gid", F.posexplode("nodes").alias("pos", "node_gid"))


@query
def extrude_caps(spark, sf_dir):
    m = extrude.extrude(_planar(spark, sf_dir))
    return m.surface.join(F.broadcast(m.patches), "patch_id").groupBy("patch_id", "name", "cgns_type").agg(F.count("*").alias("n"), F.min("eid").alias("first"), F.max("eid").alias("last"))


@query
def eid_patch_last_wins(spark, sf_dir):
    elements = lat.orders(spark, sf_dir).select((F.col("cell_gid") + 1).alias("eid"))
    ranges = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS patch_id", "cast(n_nationkey * 50 + 90 as bigint) AS eid_lo", "cast(n_nationkey * 50 as bigint) AS eid_hi")
    return ms.patch_of_eid(elements, ranges, width=64)


@query
def section_classes(spark, sf_dir):
    n = n_cells(spark, sf_dir)
    sections = spark.createDataFrame([("b", 3, n // 3 + 1, n), ("a", 3, 1, n // 3), ("side", 5, n + 1, n + 40)], "name string, ctype int, start long, end long")
    return ms.classify_sections(sections, n).select("name", "is_volume", "cell_offset")


# -- faces

@query
def half_face_keys(spark, sf_dir):
    return half_faces(lat.lattice_cells(lat.orders(spark, sf_dir)))


@query
def face_match(spark, sf_dir):
    return fc.build_faces(lat.lattice_cells(lat.orders(spark, sf_dir))).drop("patch_id")


@query
def face_stats(spark, sf_dir):
    return fc.face_stats(faces_of(spark, sf_dir)[1])


@query
def nonmanifold_check(spark, sf_dir):
    keys = lat.orders(spark, sf_dir)
    cells = lat.lattice_cells(keys)
    more = lat.placed(keys).where("i = 0").select("cell_gid").join(cells, "cell_gid").withColumn("cell_gid", F.col("cell_gid") + 1_000_000_000)
    return fc.nonmanifold(cells.unionByName(more))


@query
def boundary_patch_match(spark, sf_dir):
    return faces_of(spark, sf_dir)[1].where("cell_b IS NULL").select("cell_a", "lface_a", "patch_id")


@query
def orphan_surface_elements(spark, sf_dir):
    m = lat.lattice(spark, sf_dir)
    away = m.surface.withColumns({"eid": F.col("eid") + 10_000_000, "nodes": F.transform("nodes", lambda x: x + F.when(F.col("patch_id") == 2, 0).otherwise(F.lit(10_000_000)))})
    return fc.orphans(m.cells, m.surface.unionByName(away))


@query
def dual_edges(spark, sf_dir):
    return fc.dual_edges(faces_of(spark, sf_dir)[1])


@query
def dual_degree(spark, sf_dir):
    adj = fc.adjacency(fc.dual_edges(faces_of(spark, sf_dir)[1]))
    return adj.select(F.col("src").alias("cell_gid"), F.size("dst").cast("long").alias("degree"), F.get("dst", F.lit(0)).alias("first"))


# -- partitions

@query
def partition_block_stats(spark, sf_dir):
    return partition.part_sizes(parts_of(spark, sf_dir))


@query
def edge_cut(spark, sf_dir):
    return partition.edge_cut(faces_of(spark, sf_dir)[1], parts_of(spark, sf_dir, 4))


@query
def imbalance(spark, sf_dir):
    return rounded(partition.balance(parts_of(spark, sf_dir, 7)), "avg_cells", "imbalance")


@query
def hilbert_partition_sizes(spark, sf_dir):
    m = lat.lattice(spark, sf_dir)
    return partition.part_sizes(partition.hilbert_partition(geometry.cell_metrics(m.cells, m.nodes), K))


@query
def part_rank_map(spark, sf_dir):
    ranks = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_nationkey")).alias("node_id"), F.col("s_suppkey").alias("rank"))
    return partition.part_map(ranks)


# -- local meshes

@query
def face_sides(spark, sf_dir):
    return sides_of(spark, sf_dir).select("part", "owner_gid", "neigh_gid", "nb_part", "patch_id", "lface")


@query
def ghost_cells(spark, sf_dir):
    return localize.ghosts(sides_of(spark, sf_dir), parts_of(spark, sf_dir))


@query
def vertex_ghost_cells(spark, sf_dir):
    return localize.ghosts(sides_of(spark, sf_dir), parts_of(spark, sf_dir), "vertex", lat.lattice_cells(lat.orders(spark, sf_dir)))


def _halo(spark, sf_dir) -> DataFrame:
    p = parts_of(spark, sf_dir)
    g = localize.ghosts(sides_of(spark, sf_dir), p)
    return localize.halo(g, localize.local_cells(p, g))


@query
def halo_recv(spark, sf_dir):
    return _halo(spark, sf_dir).where("direction = 'recv'").drop("direction")


@query
def halo_send(spark, sf_dir):
    return _halo(spark, sf_dir).where("direction = 'send'").drop("direction")


@query
def halo_symmetry(spark, sf_dir):
    return validate.halo_violations(_halo(spark, sf_dir)).agg(F.count("*").alias("violations"))


@query
def local_cell_numbering(spark, sf_dir):
    p = parts_of(spark, sf_dir)
    return localize.local_cells(p, localize.ghosts(sides_of(spark, sf_dir), p))


@query
def local_node_numbering(spark, sf_dir):
    return localize.local_nodes(local_cell_numbering(spark, sf_dir), lat.lattice_cells(lat.orders(spark, sf_dir)))


@query
def local_face_order(spark, sf_dir):
    return localize.number_faces(sides_of(spark, sf_dir), local_cell_numbering(spark, sf_dir)).select("part", "local_id", "owner_gid", "neigh_gid", "lface")


@query
def bbox(spark, sf_dir):
    m = lat.lattice(spark, sf_dir)
    return localize.bounding_boxes(local_cell_numbering(spark, sf_dir), m.cells, m.nodes)


@query
def global_face_counts(spark, sf_dir):
    return localize.global_counts(sides_of(spark, sf_dir))


# -- geometry

@query
def cell_metrics(spark, sf_dir):
    m = lat.lattice(spark, sf_dir)
    return rounded(geometry.cell_metrics(m.cells, m.nodes).drop("ctype"), "volume", "cx", "cy", "cz")


@query
def face_metrics(spark, sf_dir):
    m, f = faces_of(spark, sf_dir)
    out = geometry.face_metrics(f, m.cells, m.nodes).select("cell_a", "lface_a", "area", "nx", "ny", "nz", "fx", "fy", "fz")
    return rounded(out, *out.columns[2:])


@query
def patch_area(spark, sf_dir):
    m, f = faces_of(spark, sf_dir)
    rim = geometry.face_metrics(f.where("patch_id IS NOT NULL"), m.cells, m.nodes)
    return rounded(rim.groupBy("patch_id").agg(F.count("*").alias("n_faces"), F.sum("area").alias("area")), "area")


@query
def domain_volume(spark, sf_dir):
    m = lat.lattice(spark, sf_dir)
    return rounded(geometry.cell_metrics(m.cells, m.nodes).agg(F.count("*").alias("n_cells"), F.sum("volume").alias("volume"), F.min("volume").alias("smallest"), F.max("volume").alias("largest")), "volume", "smallest", "largest")


@query
def geometry_contracts(spark, sf_dir):
    _, f, c = measured(spark, sf_dir)
    return geometry.geometry_violations(f, c).agg(F.count("*").alias("violations"))


@query
def closed_cells(spark, sf_dir):
    _, f, _ = measured(spark, sf_dir)
    s = geometry.unit_face_closure(f)
    return rounded(s.select("cell_gid", *[F.abs(c).alias(c) for c in ("sx", "sy", "sz")]), "sx", "sy", "sz")


# -- order

@query
def hilbert_order(spark, sf_dir):
    m = lat.lattice(spark, sf_dir)
    return reorder.hilbert_order(localize.owned_cells(parts_of(spark, sf_dir), geometry.cell_metrics(m.cells, m.nodes)))


@query
def rcm_order(spark, sf_dir):
    m = localized(spark, sf_dir)
    return reorder.rcm_order(m.part_cells.where("donor IS NULL"), m.part_faces)


@query
def face_zone_sort(spark, sf_dir):
    return reorder.zone_sort(zoned(spark, sf_dir)).select("part", "local_id", "zone", "owner_gid", "lface")


@query
def zone_counts(spark, sf_dir):
    return reorder.zone_counts(zoned(spark, sf_dir))


@query
def patch_face_ranges(spark, sf_dir):
    return reorder.patch_ranges(reorder.zone_sort(zoned(spark, sf_dir))).select("part", "patch_id", "n_faces", (F.col("end") - F.col("first")).cast("long").alias("width"))


# -- adjacency

@query
def cell_faces(spark, sf_dir):
    return connectivity.cell_faces(faces_of(spark, sf_dir)[1])


@query
def cell_cells_face(spark, sf_dir):
    m, f = faces_of(spark, sf_dir)
    return connectivity.Connectivity(m.cells, f)[connectivity.Conn.CELL_CELLS_FACE]


@query
def node_cells(spark, sf_dir):
    return connectivity.node_cells(lat.lattice_cells(lat.orders(spark, sf_dir)))


@query
def node_faces(spark, sf_dir):
    return connectivity.node_faces(faces_of(spark, sf_dir)[1])


@query
def cell_cells_node(spark, sf_dir):
    return connectivity.cell_cells_by_node(connectivity.node_cells(lat.lattice_cells(lat.orders(spark, sf_dir))))


@query
def part_supplier_incidence(spark, sf_dir):
    """The incidence of suppliers (as cells) and parts (as nodes): how many others each meets."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("node_gid"), F.col("l_suppkey").alias("cell_gid")).distinct()
    return connectivity.cell_cells_by_node(rows).groupBy("cell_gid").agg(F.count("*").alias("others"))


# -- derived geometry

def _aux(which: auxgeom.Geom, *cols: str) -> Query:
    def run(spark, sf_dir):
        _, f, c = measured(spark, sf_dir)
        return rounded(auxgeom.face_geometry(f, c, which).select("cell_a", "lface_a", *cols), *cols)

    return run


QUERIES |= {
    "face_vector": _aux(auxgeom.Geom.VECTOR, "dx", "dy", "dz"),
    "face_distance": _aux(auxgeom.Geom.DISTANCE, "distance"),
    "face_distance_inv": _aux(auxgeom.Geom.INVERSE_DISTANCE, "inverse_distance"),
    "interp_weight": _aux(auxgeom.Geom.WEIGHT, "weight"),
    "non_ortho": _aux(auxgeom.Geom.NON_ORTHOGONAL, "tx", "ty", "tz"),
}


@query
def wall_distance(spark, sf_dir):
    _, f, c = measured(spark, sf_dir)
    f = settled(f.select("cell_a", "cell_b", "patch_id", "fx", "fy", "fz"))  # read for seeds and edges
    return rounded(auxgeom.wall_distance(c, f, fc.dual_edges(f), [WALL]), "distance")


# -- validation, exports

@query
def face_conservation(spark, sf_dir):
    m = localized(spark, sf_dir)
    return validate.face_conservation(m.part_faces, faces_of(spark, sf_dir)[1].count())


@query
def order_violations(spark, sf_dir):
    return validate.order_violations(reorder.zone_sort(zoned(spark, sf_dir))).agg(F.count("*").alias("violations"))


@query
def normal_violations(spark, sf_dir):
    _, f, c = measured(spark, sf_dir)
    p = parts_of(spark, sf_dir)
    side = localize.sides(f, p)
    faces = localize.local_faces(side, localize.local_cells(p, localize.ghosts(side, p)))
    return validate.normal_violations(faces, localize.owned_cells(p, c)).agg(F.count("*").alias("violations"))


@query
def zone_violations(spark, sf_dir):
    return validate.zone_violations(localized(spark, sf_dir)).agg(F.count("*").alias("violations"))


@query
def cell_violations(spark, sf_dir):
    return validate.cell_violations(localized(spark, sf_dir)).agg(F.count("*").alias("violations"))


@query
def part_report(spark, sf_dir):
    return rounded(validate.part_report(localized(spark, sf_dir)), "volume")


@query
def patch_report(spark, sf_dir):
    return rounded(validate.patch_report(localized(spark, sf_dir).part_faces), "area")


@query
def bc_default_type(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("BC"), F.initcap("event_type")).alias("name"))
    known = spark.createDataFrame([(k,) for k in exports.DEFAULT_BC], "name string")
    return names.unionByName(known).groupBy("name").agg(F.count("*").alias("n")).select("name", "n", exports.default_bc(F.col("name")).alias("bc"), exports.bc_output_type(F.col("name")).alias("written"))


@query
def vtk_type_counts(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") % 6).alias("ctype"))
    return parts.groupBy("ctype").agg(F.count("*").alias("n")).select("n", type_name(F.col("ctype")).alias("name"), vtk_type(F.col("ctype")).alias("vtk"))


@query
def section_layout(spark, sf_dir):
    return exports.section_layout(lat.lattice(spark, sf_dir))
