"""Auxiliary adjacencies as edge tables, built on demand and kept."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import DataFrame, functions as F

from meshloom.operators.faces import KEY, dual_edges


class Conn(IntFlag):
    CELL_FACES = 1
    CELL_CELLS_FACE = 2
    NODE_CELLS = 4
    NODE_FACES = 8
    CELL_CELLS_NODE = 16
    ALL = 31


def cell_faces(faces: DataFrame, face: list[str] | None = None) -> DataFrame:
    """cell_gid and the columns that name a face (its key by default)."""
    face = face or KEY
    return faces.select(*face, F.explode(F.array("cell_a", "cell_b")).alias("cell_gid")).where("cell_gid IS NOT NULL").select("cell_gid", *face)


def node_cells(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode("nodes").alias("node_gid"), "cell_gid").distinct()


def node_faces(faces: DataFrame) -> DataFrame:
    """node_gid and the key of each face at it; a triangle's empty slot is no node."""
    return faces.select(F.explode(F.array(*KEY)).alias("node_gid"), *KEY).where("node_gid >= 0")


def cell_cells_by_node(incidence: DataFrame) -> DataFrame:
    """cell_gid, other of cells with a common node: distinct, without itself. A node's cells are few
    (8 in a lattice), so the self-join grows with the mesh."""
    other = incidence.select("node_gid", F.col("cell_gid").alias("other"))
    return incidence.join(other, "node_gid").where("cell_gid <> other").select("cell_gid", "other").distinct()


class Connectivity:
    """Adjacencies of a mesh; each is made once, and node-to-cell serves cell-to-cell by node."""

    def __init__(self, cells: DataFrame, faces: DataFrame):
        self.cells, self.faces = cells, faces
        self._made: dict[Conn, DataFrame] = {}

    def build(self, which: Conn) -> Connectivity:
        make = {
            Conn.CELL_FACES: lambda: cell_faces(self.faces),
            Conn.CELL_CELLS_FACE: lambda: dual_edges(self.faces).select(F.col("src").alias("cell_gid"), F.col("dst").alias("other")),
            Conn.NODE_CELLS: lambda: node_cells(self.cells).persist(),
            Conn.NODE_FACES: lambda: node_faces(self.faces),
            Conn.CELL_CELLS_NODE: lambda: cell_cells_by_node(self[Conn.NODE_CELLS]),
        }
        for flag, f in make.items():
            if which & flag and flag not in self._made:
                self._made[flag] = f()
        return self

    def __getitem__(self, which: Conn) -> DataFrame:
        return self.build(which)._made[which]

    def row(self, which: Conn, key: int) -> DataFrame:
        """The list of one cell or node."""
        table = self[which]
        return table.where(F.col(table.columns[0]) == key)
