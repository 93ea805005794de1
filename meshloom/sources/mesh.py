"""A mesh as tables, and its store: one Parquet directory for each table."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meshloom.functions.topology import MeshError

@dataclass(frozen=True)
class Mesh:
    """Global mesh: node coordinates, volume cells, surface elements, patches."""

    nodes: DataFrame
    cells: DataFrame
    surface: DataFrame
    patches: DataFrame

    def write(self, path: str, mode: str = "errorifexists") -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode(mode).parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Mesh:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))

    def with_(self, **tables: DataFrame) -> Mesh:
        return replace(self, **tables)


# Read with their schemas: a mesh of one part has no halo, and so no file of it.
LOCAL = {
    "part_cells": "cell_gid long, local_id int, donor int, ctype byte, volume double, cx double, cy double, cz double, nodes array<long>, part int",
    "part_nodes": "node_gid long, local_id int, is_owned boolean, x double, y double, z double, part int",
    "part_faces": "local_id int, owner int, neigh int, owner_gid long, neigh_gid long, nb_part int, patch_id int, lface int, zone int, nodes array<long>, area double, nx double, ny double, nz double, fx double, fy double, fz double, part int",
    "halo": "nb_part int, direction string, seq int, local_id int, cell_gid long, part int",
}


@dataclass(frozen=True)
class LocalMesh:
    """The partitioned mesh: each table has a column ``part``, by which it is stored."""

    part_cells: DataFrame
    part_nodes: DataFrame
    part_faces: DataFrame
    halo: DataFrame

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Partitioned by ``part``: a reader of one part lists and opens that part's files only."""
        for f in fields(self):
            getattr(self, f.name).repartition("part").write.mode(mode).partitionBy("part").parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, part: int | None = None) -> LocalMesh:
        tables = [spark.read.schema(LOCAL[f.name]).parquet(f"{path}/{f.name}") for f in fields(cls)]
        if part is not None:
            tables = [t.where(F.col("part") == part) for t in tables]
        return cls(*tables)

    def counts(self) -> DataFrame:
        """Per part what a loader derives: owned and ghost cells, owned-used nodes, faces by zone."""
        c = self.part_cells.groupBy("part").agg(F.sum(F.col("donor").isNull().cast("long")).alias("n_own"), F.sum(F.col("donor").isNotNull().cast("long")).alias("n_ghost"))
        n = self.part_nodes.groupBy("part").agg(F.sum(F.col("is_owned").cast("long")).alias("n_nodes_own"), F.count("*").alias("n_nodes"))
        z = [F.sum((F.col("zone") == k).cast("long")).alias(f"n_zone{k}") for k in range(3)]
        f = self.part_faces.groupBy("part").agg(*z)
        return c.join(n, "part").join(f, "part")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def classify_sections(sections: DataFrame, n_cells: int) -> DataFrame:
    """Element sections to volume or surface, with the dense number of a volume section's first cell.

    ``sections`` (name, ctype, start, end) is metadata, a few rows a mesh. A section that starts
    within the cell count is a volume section; volume sections are numbered by start. Bars are
    skipped. The volume counts must add up to ``n_cells``.
    """
    rows = sorted((r["start"], r["end"], r["name"], r["ctype"]) for r in sections.where("ctype IS NULL OR ctype >= 0").collect())
    out, at = [], 0
    for start, end, name, ctype in rows:
        volume = start <= n_cells
        out.append((name, ctype, start, end, volume, at if volume else None))
        at += end - start + 1 if volume else 0
    if at != n_cells:
        raise MeshError(f"volume sections hold {at} cells, the zone says {n_cells}")
    return sections.sparkSession.createDataFrame(out, "name string, ctype int, start long, end long, is_volume boolean, cell_offset long")


def section_elements(elements: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section, ordinal, ctype, nodes 1-based of any integer width) to cells and surface elements, ids 0-based."""
    zero = F.transform("nodes", lambda n: n.cast("long") - 1)
    # sections are metadata, bounded by the file's section list
    rows = elements.join(F.broadcast(sections.select(F.col("name").alias("section"), "start", "is_volume", "cell_offset")), "section")
    cells = rows.where("is_volume").select((F.col("cell_offset") + F.col("ordinal")).alias("cell_gid"), F.col("ctype").cast("byte").alias("ctype"), zero.alias("nodes"))
    surface = rows.where("NOT is_volume").select((F.col("start") + F.col("ordinal")).alias("eid"), F.col("ctype").cast("byte").alias("ftype"), zero.alias("nodes"))
    return cells, surface


def patch_of_eid(elements: DataFrame, patch_ranges: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``elements`` (eid, ...) with patch_id: of the ranges that hold an eid the last patch wins;
    null where none does.

    A range join as an equi-join: ranges are cut into buckets of ``width`` ids, so neither side is
    matched against rows far away. Range ends may come in either order.
    """
    lo, hi = F.least("eid_lo", "eid_hi"), F.greatest("eid_lo", "eid_hi")
    w = F.lit(width)
    r = patch_ranges.select("patch_id", lo.alias("lo"), hi.alias("hi"))
    r = r.select("*", F.explode(F.sequence(F.floor(F.col("lo") / w).cast("long"), F.floor(F.col("hi") / w).cast("long"))).alias("bucket"))
    e = elements.withColumn("bucket", F.floor(F.col("eid") / w).cast("long"))
    hit = e.join(r, (e.bucket == r.bucket) & e.eid.between(r.lo, r.hi)).groupBy("eid").agg(F.max("patch_id").alias("patch_id"))
    return elements.join(hit, "eid", "left")
