"""Cell topology as data, and the column expressions that apply it."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame, functions as F


class CellType(IntEnum):
    TET, PYRA, PRISM, HEXA, TRI, QUAD = range(6)


# Published element conventions. Nodes per type; faces as local nodes, outward by
# the right-hand rule; the node order of the mirrored element; VTK type codes.
NODES_PER_TYPE = {CellType.TET: 4, CellType.PYRA: 5, CellType.PRISM: 6, CellType.HEXA: 8, CellType.TRI: 3, CellType.QUAD: 4}
FACES = {
    CellType.TET: [(1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1)],
    CellType.PYRA: [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
    CellType.PRISM: [(0, 2, 1), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5), (3, 4, 5)],
    CellType.HEXA: [(0, 3, 2, 1), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7), (4, 5, 6, 7)],
}
MIRRORED = {
    CellType.TET: (0, 2, 1, 3),
    CellType.PYRA: (0, 3, 2, 1, 4),
    CellType.PRISM: (0, 2, 1, 3, 5, 4),
    CellType.HEXA: (0, 3, 2, 1, 4, 7, 6, 5),
}
VTK_TYPE = {CellType.TET: 10, CellType.PYRA: 14, CellType.PRISM: 13, CellType.HEXA: 12, CellType.TRI: 5, CellType.QUAD: 9}

LFACE_BITS = 8  # a half-face is packed as cell_gid * 8 + lface
FAR = (1 << 63) - 1


class MeshError(ValueError):
    """A mesh or a configuration breaks a contract."""


def by_type(ctype: Column, values: dict) -> Column:
    """The literal that belongs to a cell type; null for a type that isn't listed."""
    out = None
    for t, v in values.items():
        lit = v if isinstance(v, Column) else F.lit(v)
        out = F.when(ctype == int(t), lit) if out is None else out.when(ctype == int(t), lit)
    return out


def type_name(ctype: Column) -> Column:
    return by_type(ctype, {t: t.name for t in CellType})


def vtk_type(ctype: Column) -> Column:
    return by_type(ctype, VTK_TYPE)


def sorted_key(n0: Column, n1: Column, n2: Column, n3: Column) -> list[Column]:
    """Four node ids in rising order by a comparison network; a triangle (n3 null) has k3 = -1.

    Scalar columns stay inside generated code and make a hash-aggregation key; an array doesn't.
    """
    d = F.coalesce(n3, F.lit(FAR))
    lo1, hi1, lo2, hi2 = F.least(n0, n1), F.greatest(n0, n1), F.least(n2, d), F.greatest(n2, d)
    m1, m2 = F.greatest(lo1, lo2), F.least(hi1, hi2)
    k3 = F.greatest(hi1, hi2)
    return [F.least(lo1, lo2).alias("k0"), F.least(m1, m2).alias("k1"), F.greatest(m1, m2).alias("k2"), F.when(k3 == FAR, F.lit(-1)).otherwise(k3).cast("long").alias("k3")]


def face_structs(nodes: Column, ctype: CellType) -> Column:
    return F.array(*[
        F.struct(F.lit(i).cast("int").alias("lface"), *[(F.get(nodes, F.lit(f[j])) if j < len(f) else F.lit(None)).cast("long").alias(f"n{j}") for j in range(4)])
        for i, f in enumerate(FACES[ctype])
    ])


def half_faces(cells: DataFrame) -> DataFrame:
    """Every volume cell's faces: cell_gid, lface, n0..n3 (outward order), k0..k3 (sorted key).

    A cell of another type, or of none, is an error."""
    every = by_type(F.col("ctype"), {t: face_structs(F.col("nodes"), t) for t in FACES})
    every = F.coalesce(every, F.raise_error(F.concat(F.lit("no volume cell type: "), F.coalesce(F.col("ctype").cast("string"), F.lit("null")), F.lit(", cell "), F.col("cell_gid").cast("string"))))
    rows = cells.select("cell_gid", F.explode(every).alias("f")).select("cell_gid", "f.*")
    return rows.select("*", *sorted_key(*(F.col(f"n{j}") for j in range(4))))


def mirrored(nodes: Column, ctype: Column) -> Column:
    """The node list of the cell turned inside out."""
    return by_type(ctype, {t: F.array(*[F.get(nodes, F.lit(i)) for i in p]) for t, p in MIRRORED.items()})
