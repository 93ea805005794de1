"""Multi-block hexahedral grids from a declarative configuration.

Macro topology (vertices, shared edges and faces, blocks) is small and resolved on the driver.
Within a block every node class (27 of them: low, inner, high on each axis) has ids that are
affine in (i, j, k). So one array of 27 x 4 integers a block gives every node's id as a column
expression, shared nodes included, and no node is ever merged or looked up.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshloom.functions.grading import Grading, fraction
from meshloom.functions.tfi import hexa
from meshloom.functions.topology import FACES, CellType, MeshError
from meshloom.sources.mesh import Mesh

CHUNK = 1 << 20  # rows that one task expands from one chunk row

# A block's corners in (i, j, k), and its faces' corners in (u, v) order.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


@dataclass
class Block:
    name: str
    vertices: list[int]
    cells: list[int]
    grading_type: list[Grading]
    grading: list[float]


@dataclass
class Patch:
    name: str
    faces: list[list[int]]


@dataclass
class Config:
    name: str
    vertices: list[tuple[float, float, float]]
    blocks: list[Block]
    boundaries: list[Patch] = field(default_factory=list)


def _keys(table: dict, allowed: set[str], where: str) -> None:
    if unknown := sorted(set(table) - allowed):
        raise MeshError(f"{where}: unknown key {unknown[0]!r}; allowed: {', '.join(sorted(allowed))}")


def _list(value, size: int | None, kinds, what: str) -> list:
    if not isinstance(value, list) or size is not None and len(value) != size or not all(isinstance(x, kinds) and not isinstance(x, bool) for x in value):
        raise MeshError(f"{what} must be a list of {size or 'some'} values")
    return value


def parse_config(text: str) -> Config:
    """Strict TOML; every broken contract is a MeshError."""
    root = tomllib.loads(text)
    _keys(root, {"mesh", "blocks", "boundaries"}, "root")
    mesh = root.get("mesh")
    if not isinstance(mesh, dict):
        raise MeshError("[mesh] is missing")
    _keys(mesh, {"name", "scale", "vertices"}, "[mesh]")
    scale = float(mesh.get("scale", 1.0))
    if scale <= 0:
        raise MeshError(f"[mesh].scale must be positive, not {scale}")
    if not mesh.get("vertices"):
        raise MeshError("[mesh].vertices is missing or empty")
    vertices = [tuple(float(c) * scale for c in _list(v, 3, (int, float), f"vertex {k}")) for k, v in enumerate(mesh["vertices"])]
    if not root.get("blocks"):
        raise MeshError("[[blocks]] is missing or empty")
    blocks = []
    for b, t in enumerate(root["blocks"]):
        _keys(t, {"name", "vertices", "cells", "grading_type", "grading"}, f"[[blocks]] {b}")
        name = t.get("name", f"block_{b}")
        corner = _list(t.get("vertices"), 8, int, f"block {name}: vertices")
        cells = _list(t.get("cells"), 3, int, f"block {name}: cells")
        if min(corner) < 0 or max(corner) >= len(vertices):
            raise MeshError(f"block {name}: a vertex is out of range")
        if min(cells) < 1:
            raise MeshError(f"block {name}: cell counts must be positive")
        kinds = [Grading.parse(g) for g in _list(t.get("grading_type", ["uniform"] * 3), 3, str, f"block {name}: grading_type")]
        amounts = [float(g) for g in _list(t.get("grading", [1.0] * 3), 3, (int, float), f"block {name}: grading")]
        if any(k is not Grading.UNIFORM and a <= 0 for k, a in zip(kinds, amounts, strict=True)):
            raise MeshError(f"block {name}: a grading must be positive")
        e = [[vertices[corner[c]][x] - vertices[corner[0]][x] for x in range(3)] for c in (1, 3, 4)]
        if _triple(*e) <= 1e-14:
            raise MeshError(f"block {name}: its axes are not right-handed")
        blocks.append(Block(name, corner, cells, kinds, amounts))
    patches = []
    for p, t in enumerate(root.get("boundaries", [])):
        _keys(t, {"name", "faces"}, f"[[boundaries]] {p}")
        name = t.get("name", f"patch_{p}")
        if not t.get("faces"):
            raise MeshError(f"patch {name}: faces is missing or empty")
        faces = [_list(f, 4, int, f"patch {name}: a face") for f in t["faces"]]
        for f in faces:
            if min(f) < 0 or max(f) >= len(vertices):
                raise MeshError(f"patch {name}: a vertex is out of range")
            a, b, d = ([vertices[f[k]][x] - vertices[f[0]][x] for x in range(3)] for k in (1, 2, 3))
            n = [u + v for u, v in zip(_cross(a, b), _cross(b, d), strict=True)]
            if sum(x * x for x in n) ** 0.5 <= 1e-14:
                raise MeshError(f"patch {name}: face {f} has no area")
        patches.append(Patch(name, faces))
    return Config(mesh.get("name", "Mesh"), vertices, blocks, patches)


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _triple(a, b, c) -> float:
    return sum(x * y for x, y in zip(_cross(a, b), c, strict=True))


@dataclass
class Macro:
    """ids[b]: 27 x 4 integers of block b; spans: (block, class) that own a node class."""

    config: Config
    ids: list[list[int]]
    spans: list[tuple[int, int]]
    n_nodes: int
    n_edges: int
    n_faces: int
    n_cells: int


def _class(code: int) -> tuple[int, int, int]:
    return code % 3, code // 3 % 3, code // 9


def macro_topology(config: Config) -> Macro:
    """Number vertices, then inner nodes of edges, faces and blocks, 1-based.

    A shared edge must have one cell count. A shared face takes its frame from the first block;
    another block's frame, turned or mirrored as it may be, is mapped to it. Where classes are
    shared, the last block gives the coordinates.
    """
    used = {v for b in config.blocks for v in b.vertices}
    if len(used) < len(config.vertices):
        raise MeshError(f"vertex {min(set(range(len(config.vertices))) - used)} belongs to no block")
    corner_at = {c: k for k, c in enumerate(CORNERS)}
    edges: dict[tuple, int] = {}
    faces: dict[tuple, tuple] = {}
    uses = []  # (block, code, kind, key, frame)
    for b, blk in enumerate(config.blocks):
        edge_codes, face_codes = [], []
        for code in range(27):
            free = [x for x in range(3) if _class(code)[x] == 1]
            (edge_codes if len(free) == 1 else face_codes if len(free) == 2 else []).append(code)
        # Fixed order of a block's edges and faces, by their corners.
        order_e = _by_corners(edge_codes, [(0, 1), (3, 2), (4, 5), (7, 6), (0, 3), (1, 2), (4, 7), (5, 6), (0, 4), (1, 5), (2, 6), (3, 7)])
        order_f = _by_corners(face_codes, [(0, 1, 2, 3), (0, 1, 5, 4), (1, 2, 6, 5), (3, 2, 6, 7), (0, 3, 7, 4), (4, 5, 6, 7)])
        for code, corners in order_e:
            axis = _class(code).index(1)
            u, v = (blk.vertices[c] for c in corners)
            key, n = (min(u, v), max(u, v)), blk.cells[axis]
            if edges.setdefault(key, n) != n:
                raise MeshError(f"edge {key}: {edges[key]} cells in one block, {n} in another")
            uses.append((b, code, "edge", key, (axis, u > v, n)))
        for code, corners in order_f:
            p, q = (x for x in range(3) if _class(code)[x] == 1)
            quad, size = [blk.vertices[c] for c in corners], (blk.cells[p], blk.cells[q])
            key = tuple(sorted(quad))
            faces.setdefault(key, (quad, size))
            uses.append((b, code, "face", key, (p, q, quad, size)))
    at = len(config.vertices) + 1
    start_e: dict[tuple, int] = {}
    for key, n in edges.items():
        start_e[key] = at
        at += n - 1
    start_f: dict[tuple, int] = {}
    for key, (_, (cu, cv)) in faces.items():
        start_f[key] = at
        at += (cu - 1) * (cv - 1)
    ids = [[0] * 108 for _ in config.blocks]
    owner: dict[tuple, tuple[int, int]] = {}
    for b, blk in enumerate(config.blocks):
        for code in range(27):
            cls = _class(code)
            if 1 not in cls:
                v = blk.vertices[corner_at[tuple(x // 2 for x in cls)]]
                ids[b][4 * code] = v + 1
                owner["v", v] = b, code
        nx, ny, nz = blk.cells
        inner = (nx - 1) * (ny - 1) * (nz - 1)
        step = [1, nx - 1, (nx - 1) * (ny - 1)]
        ids[b][4 * 13 : 4 * 14] = [at - sum(step), *step]
        if inner:
            owner["b", b] = b, 13
        at += inner
    for b, code, kind, key, frame in uses:
        if kind == "edge":
            axis, turned, n = frame
            row = [start_e[key] + n - 1, 0, 0, 0] if turned else [start_e[key] - 1, 0, 0, 0]
            row[1 + axis] = -1 if turned else 1
            count = n - 1
        else:
            p, q, quad, (mu, mv) = frame
            first, (cu, cv) = faces[key]
            spot = {first[0]: (0, 0), first[1]: (cu, 0), first[2]: (cu, cv), first[3]: (0, cv)}
            o, pu, pv = spot[quad[0]], spot[quad[1]], spot[quad[3]]
            du, dv = [(x - y) for x, y in zip(pu, o, strict=True)], [(x - y) for x, y in zip(pv, o, strict=True)]
            if {abs(x) for x in du} != {0, mu} or {abs(x) for x in dv} != {0, mv}:
                raise MeshError(f"face {key}: its cell counts differ between blocks")
            # (u, v) of the first block's frame: o + du * i / mu + dv * j / mv; id: start + (v-1)(cu-1) + (u-1)
            w = (1, cu - 1)
            row = [start_f[key] + sum(k * (x - 1) for k, x in zip(w, o, strict=True)), 0, 0, 0]
            row[1 + p] = sum(k * (x // mu) for k, x in zip(w, du, strict=True))
            row[1 + q] = sum(k * (x // mv) for k, x in zip(w, dv, strict=True))
            count = (mu - 1) * (mv - 1)
        ids[b][4 * code : 4 * code + 4] = row
        if count:
            owner[kind, key] = b, code
    return Macro(config, ids, sorted(owner.values()), at - 1, len(edges), len(faces), sum(x.cells[0] * x.cells[1] * x.cells[2] for x in config.blocks))


def _by_corners(codes: list[int], corners: list[tuple]) -> list[tuple[int, tuple]]:
    """The class code that spans each corner tuple, in the tuples' order."""
    out = []
    for some in corners:
        points = [CORNERS[c] for c in some]
        cls = tuple(1 if len({p[x] for p in points}) > 1 else 2 * points[0][x] for x in range(3))
        out.append((cls[0] + 3 * cls[1] + 9 * cls[2], some))
    assert sorted(c for c, _ in out) == sorted(codes)
    return out


def node_id(ids: Column, n: list[Column], at: list[Column]) -> Column:
    """Global id of node (i, j, k) of a block with cell counts ``n``, by its class's affine form."""
    code = None
    for x, (m, p) in enumerate(zip(n, at, strict=True)):
        c = F.when(p == 0, 0).when(p == m, 2 * 3**x).otherwise(3**x)
        code = c if code is None else code + c
    k = code * 4
    return F.get(ids, k) + F.get(ids, k + 1) * at[0] + F.get(ids, k + 2) * at[1] + F.get(ids, k + 3) * at[2]


BLOCK_ROW = "n0 long, n1 long, n2 long, ids array<long>"


def _block_row(m: Macro, b: int) -> tuple:
    return *m.config.blocks[b].cells, m.ids[b]


def _expand(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows (first, count, ...) to one row for each of first..first+count-1, named q. Chunks are
    bounded, so one huge block is shared out over many tasks."""
    cut = [(first + at, min(CHUNK, count - at), *rest) for first, count, *rest in rows for at in range(0, count, CHUNK)]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    df = spark.createDataFrame(cut, "first long, count long, " + schema)
    if len(cut) > 1:
        df = df.repartition(min(len(cut), 100_000))
    return df.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("q"), *names)


def generate_cells(spark: SparkSession, m: Macro) -> DataFrame:
    """cell_gid (blocks in order, i fastest), ctype, nodes; no shuffle but the chunks' own."""
    at, rows = 0, []
    for b, blk in enumerate(m.config.blocks):
        n = blk.cells[0] * blk.cells[1] * blk.cells[2]
        rows.append((0, n, at, *_block_row(m, b)))
        at += n
    df = _expand(spark, rows, "base long, " + BLOCK_ROW)
    q, n = F.col("q"), [F.col(f"n{x}") for x in range(3)]
    ijk = [q % n[0], F.expr("(q div n0) % n1"), F.expr("q div (n0 * n1)")]
    df = df.select((F.col("base") + q).alias("cell_gid"), "n0", "n1", "n2", "ids", *[c.alias(f"i{x}") for x, c in enumerate(ijk)])
    corner = [node_id(F.col("ids"), n, [F.col(f"i{x}") + d[x] for x in range(3)]) for d in CORNERS]
    return df.select("cell_gid", F.lit(int(CellType.HEXA)).cast("byte").alias("ctype"), F.array(*corner).alias("nodes"))


def generate_nodes(spark: SparkSession, m: Macro) -> DataFrame:
    """node_gid (1-based), x, y, z: each node class of the block that owns it, by interpolation."""
    rows = []
    for b, code in m.spans:
        blk, cls = m.config.blocks[b], _class(code)
        origin = [0 if c == 0 else 1 if c == 1 else n for c, n in zip(cls, blk.cells, strict=True)]
        shape = [n - 1 if c == 1 else 1 for c, n in zip(cls, blk.cells, strict=True)]
        corners = [m.config.vertices[v] for v in blk.vertices]
        rows.append((0, shape[0] * shape[1] * shape[2], *origin, *shape, *[[c[x] for c in corners] for x in range(3)], [g.value for g in blk.grading_type], blk.grading, *_block_row(m, b)))
    df = _expand(spark, rows, "o0 long, o1 long, o2 long, s0 long, s1 long, s2 long, cx array<double>, cy array<double>, cz array<double>, kind array<string>, amount array<double>, " + BLOCK_ROW)
    df = df.withColumns({"i0": F.expr("o0 + q % s0"), "i1": F.expr("o1 + (q div s0) % s1"), "i2": F.expr("o2 + q div (s0 * s1)")})
    t = [fraction(F.col(f"i{x}"), F.col(f"n{x}"), F.get("kind", F.lit(x)), F.get("amount", F.lit(x))).alias(f"t{x}") for x in range(3)]
    df = df.select("*", *t)
    at = [F.col(f"t{x}") for x in range(3)]
    xyz = [hexa([F.get(c, F.lit(k)) for k in range(8)], *at).alias(name) for c, name in (("cx", "x"), ("cy", "y"), ("cz", "z"))]
    return df.select(node_id(F.col("ids"), [F.col(f"n{x}") for x in range(3)], [F.col(f"i{x}") for x in range(3)]).alias("node_gid"), *xyz)


def resolve_patches(config: Config) -> list[list[tuple[int, int]]]:
    """(block, face) of each patch face: the first block face that it equals up to a cyclic turn."""
    out = []
    for p in config.boundaries:
        found = []
        for f in p.faces:
            turns = {tuple(f[k:] + f[:k]) for k in range(4)}
            hit = next(((b, s) for b, blk in enumerate(config.blocks) for s, face in enumerate(FACES[CellType.HEXA]) if tuple(blk.vertices[c] for c in face) in turns), None)
            if hit is None:
                raise MeshError(f"patch {p.name}: face {f} is no outward block face")
            found.append(hit)
        out.append(found)
    return out


def generate_surface(spark: SparkSession, m: Macro) -> tuple[DataFrame, DataFrame]:
    """Boundary quads (eid from cell count + 1, faces in the order of the configuration, u
    fastest, outward node order) and the patches."""
    eid, rows = m.n_cells + 1, []
    for p, faces in enumerate(resolve_patches(m.config)):
        for b, side in faces:
            n = m.config.blocks[b].cells
            u, v = [x for x in range(3) if len({CORNERS[c][x] for c in FACES[CellType.HEXA][side]}) > 1]
            fixed = 3 - u - v
            high = CORNERS[FACES[CellType.HEXA][side][0]][fixed]
            rows.append((0, n[u] * n[v], eid, p, side, u, v, fixed, (n[fixed] - 1) * high, n[u], *_block_row(m, b)))
            eid += n[u] * n[v]
    patches = spark.createDataFrame([(p, x.name, "BCTypeUserDefined") for p, x in enumerate(m.config.boundaries)], "patch_id int, name string, cgns_type string")
    schema = "base long, patch_id int, side int, au int, av int, fixed int, depth long, nu long, " + BLOCK_ROW
    df = _expand(spark, rows, schema)
    step_u, step_v = F.expr("q % nu"), F.expr("q div nu")
    at = [F.when(F.col("au") == x, step_u).when(F.col("av") == x, step_v).otherwise(F.col("depth")).alias(f"i{x}") for x in range(3)]
    df = df.select("*", *at)
    n = [F.col(f"n{x}") for x in range(3)]
    corner = [node_id(F.col("ids"), n, [F.col(f"i{x}") + d[x] for x in range(3)]) for d in CORNERS]
    df = df.select((F.col("base") + F.col("q")).alias("eid"), "patch_id", "side", F.array(*corner).alias("c"))
    turns = F.array(*[F.array(*[F.lit(c) for c in f]) for f in FACES[CellType.HEXA]])
    local = F.get(turns, F.col("side"))
    nodes = F.array(*[F.get(F.col("c"), F.get(local, F.lit(k))) for k in range(4)])
    return df.select("eid", F.lit(int(CellType.QUAD)).cast("byte").alias("ftype"), nodes.alias("nodes"), "patch_id"), patches


def generate(spark: SparkSession, config: Config | str) -> Mesh:
    m = macro_topology(parse_config(config) if isinstance(config, str) else config)
    surface, patches = generate_surface(spark, m)
    return Mesh(generate_nodes(spark, m), generate_cells(spark, m), surface, patches)
