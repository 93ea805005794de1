"""Cell and face metrics of a polyhedral mesh.

Corner coordinates are gathered with one join and one aggregation into plain columns. Face
arithmetic is column arithmetic and stays in generated code; cells are measured on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshloom.functions.topology import FACES, NODES_PER_TYPE, CellType, by_type
from meshloom.operators.faces import face_nodes
from meshloom.functions.vectors import Vec, add, cross, dot, norm, scale, sub, vec
from meshloom.plans.lineage import large

SMALL = 1e-15


def corners(rows: DataFrame, key: list[str], nodes: DataFrame, most: int) -> DataFrame:
    """Coordinates of the nodes array's members as columns x0,y0,z0,x1,..., null beyond its end."""
    long = rows.select(*key, F.posexplode("nodes").alias("pos", "node_gid"))
    joined = long.join(large(nodes), "node_gid")
    aggs = [F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}{k}") for k in range(most) for c in "xyz"]
    return joined.groupBy(*key).agg(*aggs)


def _corner(k: int) -> Vec:
    return F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"z{k}")


def cell_metrics(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell_gid, ctype, volume, cx, cy, cz.

    The signed volumes of the tetrahedra of anchor and face triangles add up; the centroid is
    their volume mean, or the anchor where the volume is not above 1e-15. The sums run in numpy on
    Arrow batches: a hexahedron has 24 tetrahedra, more than one generated method may hold.
    """
    return _measured_cells(corners(cells.select("cell_gid", "ctype", "nodes"), ["cell_gid", "ctype"], nodes, 8))


def _measured_cells(wide: DataFrame) -> DataFrame:
    present = [CellType.TET, CellType.PYRA, CellType.PRISM, CellType.HEXA]
    schema = "cell_gid long, ctype byte, volume double, cx double, cy double, cz double"

    def measure(batches):
        for b in batches:
            ctype = b.column(1).to_numpy()
            xyz = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(24)]).reshape(8, 3, -1)
            volume, centre = np.zeros(b.num_rows), np.zeros((3, b.num_rows))
            for t in present:
                at = np.flatnonzero(ctype == int(t))
                if len(at):
                    p = xyz[: NODES_PER_TYPE[t]][:, :, at]
                    volume[at], centre[:, at] = tet_sums(p, FACES[t])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (volume, *centre))], ["cell_gid", "ctype", "volume", "cx", "cy", "cz"])

    return wide.mapInArrow(measure, schema)


def tet_sums(p, faces):
    """Volume and centroid of cells, vectorised: ``p`` is [corner, axis, cell]."""
    anchor = p.mean(axis=0)
    volume, moment = np.zeros(p.shape[2]), np.zeros(p.shape[1:])
    for f in faces:
        q = [p[k] for k in f]
        if len(q) == 3:
            triangles = [tuple(q)]
        else:
            m = (q[0] + q[1] + q[2] + q[3]) * 0.25
            triangles = [(m, q[k], q[(k + 1) % 4]) for k in range(4)]
        for a, b, c in triangles:
            v = np.einsum("ij,ij->j", a - anchor, np.cross(b - anchor, c - anchor, axis=0)) / 6.0
            volume += v
            moment += v * (anchor + a + b + c) * 0.25
    safe = np.where(volume > SMALL, volume, 1.0)
    return volume, np.where(volume > SMALL, moment / safe, anchor)


def _area_vector(a: Vec, b: Vec, c: Vec) -> Vec:
    return scale(cross(sub(b, a), sub(c, a)), 0.5)


def face_metrics(faces: DataFrame, cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """``faces`` with area, unit normal nx, ny, nz (out of cell_a) and centroid fx, fy, fz.

    A quadrilateral is a fan of four triangles about its vertex mean; its centroid weighs their
    centroids by their areas.
    """
    n = [F.col(f"n{k}") for k in range(4)]
    named = face_nodes(faces, cells)
    key = faces.columns
    rows = named.select(*key, F.when(n[3].isNull(), F.array(*n[:3])).otherwise(F.array(*n)).alias("nodes"))
    small = corners(rows.select("cell_a", "lface_a", "nodes"), ["cell_a", "lface_a"], nodes, 4)
    return faces.join(large(_measured_faces(small, ["cell_a", "lface_a"])), ["cell_a", "lface_a"])


def _measured_faces(small: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, area, normal and centroid of rows with corners x0..z3."""
    p = [_corner(k) for k in range(4)]
    tri = F.col("x3").isNull()
    m = scale(add(add(p[0], p[1]), add(p[2], p[3])), 0.25)
    step = small.select(*keep, tri.alias("tri"), *[c.alias(f"{n}{k}") for k in range(4) for n, c in zip("xyz", p[k], strict=True)], *[c.alias(f"m{a}") for a, c in zip("xyz", m, strict=True)])
    m = vec("m")
    fans = [_area_vector(m, p[k], p[(k + 1) % 4]) for k in range(4)]
    whole = _area_vector(p[0], p[1], p[2])
    step = step.select(
        "*",
        *[F.when(F.col("tri"), w).otherwise(fans[0][x] + fans[1][x] + fans[2][x] + fans[3][x]).alias(f"s{a}") for x, (a, w) in enumerate(zip("xyz", whole, strict=True))],
        *[norm(fans[k]).alias(f"w{k}") for k in range(4)],
    )
    s = vec("s")
    weights = [F.col(f"w{k}") for k in range(4)]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    mids = [scale(add(add(m, p[k]), p[(k + 1) % 4]), 1.0 / 3.0) for k in range(4)]
    third = scale(add(add(p[0], p[1]), p[2]), 1.0 / 3.0)
    area = norm(s)
    return step.select(
        *keep, area.alias("area"),
        *[(c / area).alias(f"n{a}") for a, c in zip("xyz", s, strict=True)],
        *[F.when(F.col("tri"), third[x]).otherwise((mids[0][x] * weights[0] + mids[1][x] * weights[1] + mids[2][x] * weights[2] + mids[3][x] * weights[3]) / total).alias(f"f{a}") for x, a in enumerate("xyz")],
    )


def mesh_metrics(faces: DataFrame, cells: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What face_metrics and cell_metrics give, from one gathering of the cells' corners.

    A face takes its corners from the row of cell_a, so neither its nodes nor their coordinates
    are shuffled for it.
    """
    wide = corners(cells.select("cell_gid", "ctype", "nodes"), ["cell_gid", "ctype"], nodes, 8)
    place = by_type(F.col("ctype"), {t: F.array(*[F.lit(c) for f in FACES[t] for c in (*f, None)[:4]]) for t in FACES})
    keep = ["cell_a", "lface_a", *[c for c in faces.columns if c not in ("cell_a", "lface_a")]]
    own = faces.join(large(wide.withColumnRenamed("cell_gid", "cell_a")), "cell_a").withColumn("_place", place)
    at = [F.get("_place", F.col("lface_a") * 4 + k) for k in range(4)]
    axes = [F.array(*[F.col(f"{a}{k}") for k in range(8)]) for a in "xyz"]
    own = own.select(*keep, *[x.alias(f"_{a}") for a, x in zip("xyz", axes, strict=True)], *[p.alias(f"_p{k}") for k, p in enumerate(at)])
    small = own.select(*keep, *[F.get(f"_{a}", F.col(f"_p{k}")).alias(f"{a}{k}") for k in range(4) for a in "xyz"])
    return _measured_faces(small, keep), _measured_cells(wide)


def geometry_violations(faces: DataFrame, metrics: DataFrame) -> DataFrame:
    """kind, cell_gid of cells and faces that break a contract: volume, area, outwardness."""
    f, c = faces.select("cell_a", "area", "nx", "ny", "nz", "fx", "fy", "fz"), metrics.select(F.col("cell_gid").alias("cell_a"), "cx", "cy", "cz")
    out = dot(vec("n"), sub(vec("f"), vec("c"))) <= 0
    bad_cells = metrics.where(~(F.col("volume") > SMALL)).select(F.lit("volume").alias("kind"), "cell_gid")
    joined = f.join(large(c), "cell_a")
    kind = F.when(~(F.col("area") > SMALL), "area").when(out, "inward")
    return bad_cells.unionByName(joined.select(kind.alias("kind"), F.col("cell_a").alias("cell_gid")).where("kind IS NOT NULL"))


def summary(metrics: DataFrame, faces: DataFrame) -> DataFrame:
    """Total, least and largest volume; least and largest area. One row."""
    v = metrics.agg(F.sum("volume").alias("total_volume"), F.min("volume").alias("min_volume"), F.max("volume").alias("max_volume"), F.lit(1).alias("_"))
    a = faces.agg(F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.lit(1).alias("_"))
    return v.join(a, "_").drop("_")


def unit_face_closure(metric_faces: DataFrame) -> DataFrame:
    """Per cell the sum of its outward area vectors (zero for a closed cell): cell_gid, sx, sy, sz."""
    s = [F.col("area") * F.col(f"n{a}") for a in "xyz"]
    both = F.array(
        F.struct(F.col("cell_a").alias("cell_gid"), *[c.alias(f"s{a}") for c, a in zip(s, "xyz", strict=True)]),
        F.struct(F.col("cell_b").alias("cell_gid"), *[(-c).alias(f"s{a}") for c, a in zip(s, "xyz", strict=True)]),
    )
    rows = metric_faces.select(F.explode(both).alias("r")).select("r.*").where("cell_gid IS NOT NULL")
    return rows.groupBy("cell_gid").agg(*[F.sum(f"s{a}").alias(f"s{a}") for a in "xyz"])
