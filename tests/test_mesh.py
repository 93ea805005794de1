"""Closed forms, unit cells, broken contracts, scalar models of the sequential parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions.hilbert import hilbert_key
from meshloom.functions.topology import FACES, MIRRORED, CellType, MeshError, half_faces, mirrored
from meshloom.operators import auxgeom, distribution, extrude, faces as fc, geometry, localize, partition, reorder, validate
from meshloom.plans import pipeline
from meshloom.plans.queries import QUERIES
from meshloom.sources import exports, generator
from meshloom.sources.mesh import Mesh, empty, patch_of_eid

UNIT = {
    CellType.TET: ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], 1 / 6),
    CellType.PYRA: ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 1)], 1 / 3),
    CellType.PRISM: ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)], 1 / 2),
    CellType.HEXA: ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], 1.0),
}

# A channel that bends upwards: an arm, the corner, an arm; two layers of cells. All counts below are by hand.
BEND = """
[mesh]
name = "bend"
vertices = [[0,0,0],[3,0,0],[4,0,0],[0,1,0],[3,1,0],[4,1,0],[3,4,0],[4,4,0],
            [0,0,0.5],[3,0,0.5],[4,0,0.5],[0,1,0.5],[3,1,0.5],[4,1,0.5],[3,4,0.5],[4,4,0.5]]

[[blocks]]
vertices = [0,1,4,3,8,9,12,11]
cells = [30,12,2]
grading_type = ["geometric", "tanh_both", "uniform"]
grading = [2.0,2.0,1.0]

[[blocks]]
vertices = [1,2,5,4,9,10,13,12]
cells = [10,12,2]
grading_type = ["uniform", "tanh_both", "uniform"]
grading = [1.0,2.0,1.0]

[[blocks]]
vertices = [4,5,7,6,12,13,15,14]
cells = [10,25,2]
grading_type = ["uniform", "geometric", "uniform"]
grading = [1.0,1.5,1.0]

[[boundaries]]
name = "inflow"
faces = [[3,0,8,11]]

[[boundaries]]
name = "outflow"
faces = [[7,6,14,15]]

[[boundaries]]
name = "walls"
faces = [[0,1,9,8],[1,2,10,9],[2,5,13,10],[5,7,15,13],[4,3,11,12],[6,4,12,14]]

[[boundaries]]
name = "sides"
faces = [[0,3,4,1],[1,4,5,2],[4,6,7,5],[8,9,12,11],[9,10,13,12],[12,13,15,14]]
"""

SMALL_BEND = BEND.replace("[30,12,2]", "[4,3,2]").replace("[10,12,2]", "[2,3,2]").replace("[10,25,2]", "[2,3,2]")


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "cell_gid long, ctype byte, nodes array<long>")


def nodes_of(spark, points):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "node_gid long, x double, y double, z double")


@pytest.mark.parametrize("ctype", list(UNIT))
def test_unit_cell(spark, ctype):
    points, volume = UNIT[ctype]
    cells, nodes = cells_of(spark, [(0, int(ctype), list(range(len(points))))]), nodes_of(spark, points)
    m = geometry.cell_metrics(cells, nodes).first()
    assert m["volume"] == pytest.approx(volume, abs=1e-12)
    assert [m["cx"], m["cy"], m["cz"]] == pytest.approx(list(np.mean(points, axis=0)) if ctype != CellType.PYRA else [0.5, 0.5, 0.25], abs=1e-12)
    f = geometry.face_metrics(fc.build_faces(cells), cells, nodes)
    assert f.count() == len(FACES[ctype])
    assert geometry.geometry_violations(f, geometry.cell_metrics(cells, nodes)).isEmpty()
    s = geometry.unit_face_closure(f).first()
    assert [s["sx"], s["sy"], s["sz"]] == pytest.approx([0, 0, 0], abs=1e-12)
    turned = cells.select("cell_gid", "ctype", mirrored(F.col("nodes"), F.col("ctype")).alias("nodes"))
    assert turned.first()["nodes"] == list(MIRRORED[ctype])
    assert geometry.cell_metrics(turned, nodes).first()["volume"] == pytest.approx(-volume, abs=1e-12)
    assert geometry.geometry_violations(f, geometry.cell_metrics(turned, nodes)).where("kind = 'volume'").count() == 1


def test_bend_closed_form(spark):
    """Two layers of 360 + 120 + 250 cells; 403 + 130 + 275 nodes on each of three levels."""
    mesh = generator.generate(spark, BEND)
    m = generator.macro_topology(generator.parse_config(BEND))
    assert (m.n_nodes, m.n_cells, m.n_edges, m.n_faces) == (3 * 808, 2 * 730, 28, 16)
    assert mesh.nodes.select("node_gid").distinct().count() == mesh.nodes.count() == 2424
    f = fc.build_faces(mesh.cells, mesh.surface)
    outer = 2 * 730 + 2 * (30 + 10 + 12 + 25 + 10 + 25 + 30 + 12)
    inner = (6 * 1460 - outer) // 2
    assert tuple(fc.face_stats(f).first()) == (inner + outer, outer, inner, 2 * inner)
    rows = geometry.face_metrics(f.where("patch_id IS NOT NULL"), mesh.cells, mesh.nodes).groupBy("patch_id").agg(F.count("*"), F.sum("area")).orderBy("patch_id").collect()
    assert [r[1] for r in rows] == [24, 20, 264, 1460]
    assert [r[2] for r in rows] == pytest.approx([0.5, 0.5, 7.0, 14.0])
    assert mesh.surface.agg(F.min("eid"), F.max("eid")).first() == (1461, 1460 + outer)
    assert geometry.cell_metrics(mesh.cells, mesh.nodes).agg(F.sum("volume")).first()[0] == pytest.approx(3.5)
    assert f.where("cell_b IS NULL AND patch_id IS NULL").isEmpty()


def test_unknown_cell_type(spark):
    for ctype in (CellType.QUAD, 77, None):
        with pytest.raises(Exception, match="no volume cell type"):
            half_faces(cells_of(spark, [(0, None if ctype is None else int(ctype), [0, 1, 2, 3])])).collect()


def test_div_beyond_doubles(spark):
    n = (1 << 60) + 12345
    gids = [0, n - 1, n // 3, (1 << 53) + 1]
    df = spark.createDataFrame([(g,) for g in gids], "g long")
    got = [r[0] for r in df.select(distribution.block_owner(F.col("g"), n, 7).alias("b")).collect()]
    starts = distribution.block_displacements(n, 7)
    assert got == [next(b for b in range(7) if starts[b] <= g < starts[b + 1]) for g in gids]


def test_levels_and_far_ends():
    """A path hung with a triangle: the far end is the path's."""
    nb = [[1], [0, 2], [1, 3], [2, 4, 5], [3, 5], [3, 4]]
    assert reorder.level_sets(nb, 2) == [[2], [1, 3], [0, 4, 5]]
    assert reorder.pseudo_peripheral(nb, 2) in (0, 4, 5) and len(reorder.level_sets(nb, reorder.pseudo_peripheral(nb, 3))) == 5


def test_turned_interface(spark):
    """A block whose axes are turned against its neighbour's still shares the nodes of the face."""
    text = """
        [mesh]
        vertices = [[0,0,0],[1,0,0],[1,1,0],[0,1,0],[0,0,1],[1,0,1],[1,1,1],[0,1,1],[2,0,0],[2,1,0],[2,0,1],[2,1,1]]
        [[blocks]]
        vertices = [0,1,2,3,4,5,6,7]
        cells = [2,3,4]
        [[blocks]]
        vertices = [1,2,9,8,5,6,11,10]
        cells = [3,2,4]
    """
    with pytest.raises(MeshError):
        generator.parse_config(text)  # left-handed as written
    text = text.replace("[1,2,9,8,5,6,11,10]", "[2,1,8,9,6,5,10,11]").replace("cells = [3,2,4]", "cells = [3,2,4]")
    try:
        mesh = generator.generate(spark, text)
    except MeshError:
        text = text.replace("[2,1,8,9,6,5,10,11]", "[5,6,11,10,1,2,9,8]")
        mesh = generator.generate(spark, text)
    stats = fc.face_stats(fc.build_faces(mesh.cells)).first()
    assert stats["n_inner"] == 2 * (1 * 12 + 2 * 8 + 3 * 6) + 12
    assert geometry.cell_metrics(mesh.cells, mesh.nodes).agg(F.min("volume"), F.sum("volume")).first()[1] == pytest.approx(2.0)


@pytest.mark.parametrize(
    "old,new",
    [
        ('name = "bend"', 'nome = "bend"'), ("[4,3,2]", "[4,0,2]"), ("[4,3,2]", "[4,4,2]"), ('"geometric"', '"cubic"'), ("[0,1,4,3,8,9,12,11]", "[1,0,3,4,9,8,11,12]"), ("[0,1,4,3,8,9,12,11]", "[0,1,4,3,8,9,12,99]"),
        ("[[3,0,8,11]]", "[[3,8,0,11]]"), ("[[3,0,8,11]]", "[[3,3,3,3]]"), ("grading = [2.0", "grading = [-2.0"), ('name = "bend"', "scale = 0.0"), ("[4,4,0.5]]", "[4,4,0.5],[9,9,9]]"),
    ],
)
def test_broken_configuration(old, new):
    assert old in SMALL_BEND
    with pytest.raises(MeshError):
        m = generator.macro_topology(generator.parse_config(SMALL_BEND.replace(old, new)))
        generator.resolve_patches(m.config)


def test_nonmanifold_fails(spark):
    cells = cells_of(spark, [(0, 0, [0, 1, 2, 3]), (1, 0, [0, 1, 2, 4]), (2, 0, [0, 1, 2, 5])])
    with pytest.raises(Exception, match="non-manifold"):
        fc.build_faces(cells).collect()
    assert fc.nonmanifold(cells).count() == 1


def test_mixed_stack(spark):
    """A hexahedron with a pyramid on top and a tetrahedron at the pyramid's side."""
    cells = cells_of(spark, [(0, 3, [0, 1, 2, 3, 4, 5, 6, 7]), (1, 1, [4, 5, 6, 7, 8]), (2, 0, [4, 8, 5, 9])])
    f = fc.build_faces(cells)
    assert f.where("cell_b IS NOT NULL").select("cell_a", "cell_b").orderBy("cell_a").collect() == [(0, 1), (1, 2)]
    assert half_faces(cells).where("k3 = -1").count() == 8


def test_prefix_sums():
    assert distribution.block_displacements(10, 4) == [0, 3, 6, 8, 10]


def test_ranges_last_wins(spark):
    e = spark.range(1, 30).withColumnRenamed("id", "eid")
    r = spark.createDataFrame([(0, 5, 20), (1, 12, 9), (2, 20, 20)], "patch_id int, eid_lo long, eid_hi long")
    got = {x["eid"]: x["patch_id"] for x in patch_of_eid(e, r, width=4).collect()}
    assert got == {k: 2 if k == 20 else 1 if 9 <= k <= 12 else 0 if 5 <= k <= 20 else None for k in range(1, 30)}


def scalar_hilbert(x, y, z, bits=21):
    """Skilling's transform, bit by bit on plain integers."""
    p = [x, y, z]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for a in range(3):
            if p[a] >> b & 1:
                p[0] ^= low
            else:
                swap = (p[0] ^ p[a]) & low
                p[0] ^= swap
                p[a] ^= swap
    p[1] ^= p[0]
    p[2] ^= p[1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if p[2] >> b & 1:
            t ^= (1 << b) - 1
    p = [v ^ t for v in p]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in p:
            key = key << 1 | (v >> b & 1)
    return key


def test_hilbert_key(spark):
    rng = random.Random(4)
    pts = [tuple(rng.randrange(1 << 21) for _ in range(3)) for _ in range(300)] + [(0, 0, 0), ((1 << 21) - 1,) * 3]
    df = spark.createDataFrame(pts, "x long, y long, z long")
    for r in df.select("*", hilbert_key(F.col("x"), F.col("y"), F.col("z")).alias("k")).collect():
        assert r["k"] == scalar_hilbert(r["x"], r["y"], r["z"])
    small = spark.range(512).selectExpr("id % 8 AS x", "(id div 8) % 8 AS y", "id div 64 AS z")
    path = [tuple(r)[:3] for r in small.select("*", hilbert_key(F.col("x"), F.col("y"), F.col("z"), bits=3).alias("k")).orderBy("k").collect()]
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_bandwidth_order():
    rng = random.Random(2)
    n = 40
    name = list(range(n))
    rng.shuffle(name)
    nb = [[] for _ in range(n)]
    for a, b in zip(name[:29], name[1:30]):  # a chain and ten lone cells
        nb[a].append(b)
        nb[b].append(a)
    order = reorder.bandwidth_order(n, nb)
    new = {old: k for k, old in enumerate(order)}
    assert sorted(order) == list(range(n)) and max(abs(new[a] - new[b]) for a in range(n) for b in nb[a]) == 1


@pytest.fixture(scope="module")
def small(spark):
    mesh = generator.generate(spark, SMALL_BEND)
    return Mesh(mesh.nodes.persist(), mesh.cells.persist(), mesh.surface.persist(), mesh.patches.persist())


@pytest.mark.parametrize("k,method,order", [(1, "hilbert", "NONE"), (3, "hilbert", "RCM"), (4, "rcb", "SFC"), (5, "hilbert", "HILBERT_SFC")])
def test_partition_and_validate(spark, small, k, method, order, tmp_path):
    p = pipeline.partition_mesh(small, k, method, order)
    sizes = [r["n_cells"] for r in partition.part_sizes(p.parts).collect()]
    assert len(sizes) == k and sum(sizes) == 48
    if method == "hilbert":
        assert max(sizes) - min(sizes) <= 1
    p.mesh.write(str(tmp_path / "m"))
    report = pipeline.check(spark, str(tmp_path / "m"))
    assert report.agg(F.sum("n_own"), F.sum("n_cut")).first() == (48, 2 * p.edge_cut)
    assert report.agg(F.sum("volume")).first()[0] == pytest.approx(3.5)


def test_validation_catches(small):
    p = pipeline.partition_mesh(small, 2)
    m = p.mesh
    assert validate.halo_violations(m.halo.where("NOT (direction = 'send' AND seq = 0 AND part = 0)")).count() == 1
    assert validate.zone_violations(type(m)(m.part_cells, m.part_nodes, m.part_faces.withColumn("patch_id", F.lit(None).cast("int")), m.halo)).where("kind = 'no_patch'").count() > 0
    assert validate.normal_violations(m.part_faces.withColumns({f"n{a}": -F.col(f"n{a}") for a in "xyz"}), m.part_cells).count() == m.part_faces.count()
    assert validate.order_violations(m.part_faces.withColumn("local_id", -F.col("local_id"))).count() > 0
    with pytest.raises(MeshError):
        validate.validate(m, p.n_faces + 1)


def test_vertex_ghosts_hold_face_ghosts(spark, small):
    f = fc.build_faces(small.cells, small.surface)
    parts = partition.block_partition(small.cells, 48, 4)
    side = localize.sides(f, parts)
    near, wide = localize.ghosts(side, parts), localize.ghosts(side, parts, "vertex", small.cells)
    assert near.exceptAll(wide).isEmpty() and wide.count() >= near.count()


def test_refinement_keeps_balance(spark, small):
    f = fc.build_faces(small.cells, small.surface).persist()
    start = small.cells.select("cell_gid", (F.col("cell_gid") % 3).cast("int").alias("part"))
    better = partition.refine(start, f, 3, epsilon=0.25, rounds=4)
    assert better.count() == 48 and max(r["n_cells"] for r in partition.part_sizes(better).collect()) <= math.ceil(48 * 1.25 / 3)
    assert partition.edge_cut(f, better).first()[0] < partition.edge_cut(f, start).first()[0]


@pytest.mark.parametrize("wide", [False, True])
def test_wall_distance(spark, small, wide):
    from heapq import heappop, heappush

    from meshloom.operators.connectivity import cell_cells_by_node, node_cells

    f = geometry.face_metrics(fc.build_faces(small.cells, small.surface), small.cells, small.nodes).persist()
    c = geometry.cell_metrics(small.cells, small.nodes).persist()
    edges = cell_cells_by_node(node_cells(small.cells)).select(F.col("cell_gid").alias("src"), F.col("other").alias("dst")) if wide else fc.dual_edges(f)
    got = {r["cell_gid"]: r["distance"] for r in auxgeom.wall_distance(c, f, edges, [2]).collect()}
    w = {}
    for r in auxgeom.edge_lengths(edges, c).collect():
        w.setdefault(r["src"], []).append((r["dst"], r["w"]))
    best = {r["cell_gid"]: r["d"] for r in auxgeom.wall_seeds(f, c, [2]).collect()}
    queue = [(d, x) for x, d in best.items()]
    queue.sort()
    while queue:
        d, u = heappop(queue)
        if d > best[u]:
            continue
        for v, x in w.get(u, []):
            if d + x < best.get(v, math.inf):
                best[v] = d + x
                heappush(queue, (d + x, v))
    assert got == pytest.approx(best)


@pytest.mark.parametrize("wide", [False, True])
def test_wall_distance_by_blocks(spark, small, wide, monkeypatch):
    """Blocks of five cells give what one block gives; a bound of sweeps leaves seeds, then farther cells."""
    from meshloom.operators.connectivity import cell_cells_by_node, node_cells

    f = geometry.face_metrics(fc.build_faces(small.cells, small.surface), small.cells, small.nodes).persist()
    c = geometry.cell_metrics(small.cells, small.nodes).persist()
    edges = cell_cells_by_node(node_cells(small.cells)).select(F.col("cell_gid").alias("src"), F.col("other").alias("dst")) if wide else fc.dual_edges(f)
    run = lambda **more: {r["cell_gid"]: r["distance"] for r in auxgeom.wall_distance(c, f, edges, [0], **more).collect()}
    whole = run()
    monkeypatch.setattr(auxgeom, "BLOCK", 5, raising=False)
    assert len(whole) == 48 and None not in whole.values() and run() == whole
    seeds = {r["cell_gid"]: r["d"] for r in auxgeom.wall_seeds(f, c, [0]).collect()}
    assert {g: d for g, d in run(max_sweeps=0).items() if d is not None} == seeds
    one = {g: d for g, d in run(max_sweeps=1).items() if d is not None}
    assert set(seeds) < set(one) and all(d >= whole[g] for g, d in one.items())
    apart = {r["cell_gid"]: r["distance"] for r in auxgeom.wall_distance(c, f, edges.where("src < 12 AND dst < 12"), [0]).collect()}
    assert len(apart) == 48 and {g for g, d in apart.items() if d is not None and g >= 12} <= set(seeds)


def test_wall_distance_jobs_do_not_follow_the_way(spark, monkeypatch):
    """A way of 160 cells is a handful of sweeps: the driver keeps something of each job."""
    monkeypatch.setattr(auxgeom, "BLOCK", 40, raising=False)
    n = 160
    c = spark.range(n).selectExpr("id AS cell_gid", "id + 0.5D AS cx", "0.5D AS cy", "0.5D AS cz")
    f = spark.createDataFrame([(0, 7, 0.0, 0.5, 0.5)], "cell_a long, patch_id int, fx double, fy double, fz double")
    edges = spark.range(n - 1).selectExpr("explode(array(struct(id AS src, id + 1 AS dst), struct(id + 1 AS src, id AS dst))) AS e").select("e.*")
    spark.sparkContext.setJobGroup("way", "way")
    try:
        got = {r["cell_gid"]: r["distance"] for r in auxgeom.wall_distance(c, f, edges, [7]).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {g: g + 0.5 for g in range(n)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("way")) < n


@pytest.mark.parametrize("plane", ["xy", "xz", "yz"])
def test_extrusion(spark, plane):
    flat = [(0, 0), (1, 0), (1, 1), (0, 1), (2, 0)]
    at = {"xy": lambda p: (*p, 5), "xz": lambda p: (p[0], 5, p[1]), "yz": lambda p: (5, *p)}[plane]
    nodes = nodes_of(spark, [at(p) for p in flat])
    cells = cells_of(spark, [(0, 5, [0, 3, 2, 1]), (1, 4, [1, 4, 2])])
    bars = spark.createDataFrame([(3, 4, [0, 1], 0, "low"), (4, 4, [1, 4], None, "low"), (5, 4, [4, 2], None, "rest"), (6, 4, [2, 3], None, "rest"), (7, 4, [3, 0], None, "rest")], "eid long, ftype byte, nodes array<long>, patch_id int, section string")
    mesh = extrude.extrude(Mesh(nodes, cells, bars, spark.createDataFrame([(0, "low", "BCWall")], "patch_id int, name string, cgns_type string")), 0.5)
    m = geometry.cell_metrics(mesh.cells, mesh.nodes)
    assert [r["volume"] for r in m.orderBy("cell_gid").collect()] == pytest.approx([0.5, 0.25])
    f = fc.build_faces(mesh.cells, mesh.surface)
    assert f.where("cell_b IS NULL AND patch_id IS NULL").isEmpty()
    assert {r["name"]: r["n"] for r in f.join(mesh.patches, "patch_id").groupBy("name").agg(F.count("*").alias("n")).collect()} == {"low": 2, "rest": 3, "Z_MIN": 2, "Z_MAX": 2}
    assert geometry.geometry_violations(geometry.face_metrics(f, mesh.cells, mesh.nodes), m).isEmpty()


def test_vtu_and_template(spark, small, tmp_path):
    p = pipeline.partition_mesh(small, 2)
    files = exports.write_vtu(p.mesh, f"file://{tmp_path}/vtu")
    assert files.count() == 4 and (tmp_path / "vtu/part_volume.pvtu").exists()
    text = (tmp_path / "vtu/part_volume_00000.vtu").read_text()
    assert 'NumberOfCells="24"' in text
    t = exports.bc_template(small.patches, p.mesh.part_faces)
    import tomllib

    assert [b["global_face_count"] for b in tomllib.loads(t)["boundary_condition"]] == [6, 4, 38, 48]


def test_store_round_trip(spark, small, tmp_path):
    small.write(str(tmp_path / "mesh"))
    again = Mesh.read(spark, str(tmp_path / "mesh"))
    assert again.cells.exceptAll(small.cells).isEmpty() and again.nodes.count() == small.nodes.count()


def test_empty_mesh(spark):
    cells = empty(spark, "cell_gid long, ctype byte, nodes array<long>")
    assert fc.build_faces(cells).isEmpty() and geometry.cell_metrics(cells, empty(spark, "node_gid long, x double, y double, z double")).isEmpty()


@pytest.mark.parametrize("ctype", list(UNIT))
def test_both_metrics_from_one_gathering(spark, ctype):
    points, _ = UNIT[ctype]
    cells, nodes = cells_of(spark, [(7, int(ctype), list(range(len(points))))]), nodes_of(spark, points)
    f = fc.build_faces(cells)
    for got, alone in zip(geometry.mesh_metrics(f, cells, nodes), (geometry.face_metrics(f, cells, nodes), geometry.cell_metrics(cells, nodes)), strict=True):
        assert got.columns == alone.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, alone.collect()))


MEASURED = ["cell_violations", "generator_report", "face_distance", "face_vector", "face_distance_inv", "geometry_contracts", "interp_weight", "non_ortho", "normal_violations", "part_report", "rcm_order", "zone_violations", "cell_metrics"]


@pytest.mark.parametrize("name", MEASURED)
def test_no_table_of_mesh_size_is_broadcast(spark, sf_dir, name):
    """Spark's estimate of exploded rows is small at any size, so joins must not go by it."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert plan.count("Broadcast") <= 2 * (name == "part_report")  # one row a part


def test_hilbert_order_broadcasts_the_box_alone(spark, sf_dir):
    """One row a part is broadcast; cells' corners meet the nodes by merging."""
    plan = QUERIES["hilbert_order"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == plan.count("BroadcastHashJoin") == 1


def test_owned_cells_are_numbered_as_local_cells(spark, small):
    f = fc.build_faces(small.cells, small.surface)
    parts = partition.block_partition(small.cells, 48, 4)
    local = localize.local_cells(parts, localize.ghosts(localize.sides(f, parts), parts)).where("donor IS NULL")
    own = localize.owned_cells(parts, geometry.cell_metrics(small.cells, small.nodes))
    row = lambda df: sorted(tuple(r) for r in df.select("part", "local_id", "cell_gid").collect())
    assert len(row(own)) == 48 and row(own) == row(local) and own.where("cx IS NULL").isEmpty()


def test_normals_without_nodes_or_ghosts(spark, small, sf_dir):
    """What normal_violations counts needs neither: the violations are those of the whole local mesh."""
    f, c = geometry.mesh_metrics(fc.build_faces(small.cells, small.surface), small.cells, small.nodes)
    f = f.withColumns({f"n{a}": F.when(F.col("cell_a") % 5 == 0, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"})
    parts = partition.block_partition(small.cells, 48, 4)
    m = localize.localize(small, f, c, parts)
    side = localize.sides(f, parts)
    faces = localize.local_faces(side, localize.local_cells(parts, localize.ghosts(side, parts)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    bad = rows(validate.normal_violations(faces, localize.owned_cells(parts, c)))
    assert bad and bad == rows(validate.normal_violations(m.part_faces, m.part_cells))
    plan = QUERIES["normal_violations"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 50
