"""The four programs: generate, extrude, partition, check."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshloom.operators import extrude as ex, faces as fc, geometry, localize, partition, reorder, validate
from meshloom.plans.lineage import settled
from meshloom.sources import exports, generator
from meshloom.sources.mesh import LocalMesh, Mesh

log = logging.getLogger("meshloom")


def generate(spark: SparkSession, config_text: str, out: str, mode: str = "errorifexists") -> Mesh:
    """Configuration text to a stored mesh."""
    mesh = generator.generate(spark, config_text)
    mesh.write(out, mode)
    return Mesh.read(spark, out)


def extrude(spark: SparkSession, path: str, out: str, dz: float | None = None, mode: str = "errorifexists") -> Mesh:
    """A stored planar mesh to a stored mesh of one layer; a mesh with volume cells is stored as it is."""
    mesh = Mesh.read(spark, path)
    planar = mesh.cells.where("ctype < 4").isEmpty()
    (ex.extrude(mesh, dz) if planar else mesh).write(out, mode)
    return Mesh.read(spark, out)


@dataclass
class Partitioned:
    mesh: LocalMesh
    n_faces: int
    edge_cut: int
    parts: DataFrame


METHODS = {"hilbert": partition.hilbert_partition, "rcb": partition.rcb_partition}


def partition_mesh(mesh: Mesh, k: int, method: str = "hilbert", order: str = "NONE", ghosts: str = "face", refine_rounds: int = 0, check: bool = True) -> Partitioned:
    """Faces, geometry, parts, local meshes, order, validation.

    Geometry is computed once for the whole mesh, before it is partitioned: the curve needs
    centroids, and ghosts get theirs by a join.
    """
    faces = settled(fc.build_faces(mesh.cells, mesh.surface))
    cells = settled(geometry.cell_metrics(mesh.cells, mesh.nodes))
    measured = settled(geometry.face_metrics(faces, mesh.cells, mesh.nodes))
    parts = METHODS[method](cells, k)
    if refine_rounds:
        parts = partition.refine(parts, faces, k, rounds=refine_rounds)
    parts = settled(parts)
    local = reorder.reorder(localize.localize(mesh, measured, cells, parts, ghosts), order)
    local = LocalMesh(*(settled(t) for t in (local.part_cells, local.part_nodes, local.part_faces, local.halo)))
    n, cut = faces.count(), partition.edge_cut(faces, parts).first()[0]
    log.info("faces %d, cut %d", n, cut)
    if check:
        validate.validate(local, n)
    return Partitioned(local, n, cut, parts)


def run_partition(spark: SparkSession, path: str, out: str, k: int, bc: str | None = None, vtu: str | None = None, **how) -> Partitioned:
    """A stored mesh to a stored partitioned mesh, a template of boundary conditions, VTU pieces."""
    mesh = Mesh.read(spark, path)
    p = partition_mesh(mesh, k, **how)
    p.mesh.write(out)
    exports.write_text(bc or f"{out}.bc", exports.bc_template(mesh.patches, p.mesh.part_faces))
    if vtu:
        exports.write_vtu(p.mesh, vtu, "part")
    return p


def check(spark: SparkSession, path: str, vtu: str | None = None) -> DataFrame:
    """Validate a stored partitioned mesh; the report has a row for each part."""
    m = LocalMesh.read(spark, path)
    whole = F.sum((F.col("zone") != 1).cast("long")) + F.expr("sum(cast(zone = 1 as bigint)) div 2")
    validate.validate(m, m.part_faces.agg(whole).first()[0])
    if vtu:
        exports.write_vtu(m, vtu, "loaded")
    return validate.part_report(m)
