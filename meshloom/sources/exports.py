"""Text exports: VTU pieces with a PVTU index, boundary-condition templates, section layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F

from meshloom.functions.topology import VTK_TYPE, CellType
from meshloom.sources.mesh import LocalMesh, Mesh

# Solver boundary conditions by boundary type, and the parameters of a template.
DEFAULT_BC = {
    "BCWall": "WALL_ADIABATIC", "BCWallViscous": "WALL_ADIABATIC", "BCWallInviscid": "SYMMETRY", "BCSymmetryPlane": "SYMMETRY",
    "BCInflow": "INLET_TOTAL_TP", "BCInflowSubsonic": "INLET_TOTAL_TP", "BCInflowSupersonic": "INLET_TOTAL_TP",
    "BCOutflow": "OUTLET_BACK_PRESSURE", "BCOutflowSubsonic": "OUTLET_BACK_PRESSURE", "BCFarfield": "FARFIELD",
}
OTHER_BC = "USER_DEFINED"
PARAMETERS = ["p0 = 101325.0", "T0 = 300.0", "p_back = 101325.0", "T_wall = 300.0", "direction = [1.0, 0.0, 0.0]", "mach_inf = 0.8", "alpha = 0.0", "beta = 0.0"]


def default_bc(cgns_type: Column) -> Column:
    out = None
    for k, v in DEFAULT_BC.items():
        out = F.when(cgns_type == k, v) if out is None else out.when(cgns_type == k, v)
    return out.otherwise(OTHER_BC)


def bc_template(patches: DataFrame, faces: DataFrame) -> str:
    """TOML text with a table for each patch (a mesh has some dozens): name, type, face count, default."""
    n = faces.where("patch_id IS NOT NULL").groupBy("patch_id").agg(F.count("*").alias("n"))
    rows = patches.join(n, "patch_id", "left").select("patch_id", "name", "cgns_type", F.coalesce("n", F.lit(0)).alias("n"), default_bc(F.col("cgns_type")).alias("bc")).orderBy("patch_id").collect()
    out = ["# Boundary conditions: one table for each patch. Edit `type`, uncomment what it needs.", f"# patches: {len(rows)}", f"# boundary faces: {sum(r['n'] for r in rows)}", ""]
    for r in rows:
        out += ["[[boundary_condition]]", f"patch_id = {r['patch_id']}", f'name = "{r["name"]}"', f'cgns_type = "{r["cgns_type"]}"', f"global_face_count = {r['n']}", f'type = "{r["bc"]}"', *[f"# {p}" for p in PARAMETERS], ""]
    return "\n".join(out)


def write_text(path: str, text: str) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(at) as f:
        f.write(text.encode())


def _array(name: str, kind: str, values, width: int = 1) -> str:
    comps = f' NumberOfComponents="{width}"' if width > 1 else ""
    return f'<DataArray type="{kind}" Name="{name}"{comps} format="ascii">\n{" ".join(values)}\n</DataArray>'


def vtu_piece(points: np.ndarray, cells: list[np.ndarray], types: list[int], fields: dict[str, np.ndarray]) -> str:
    """One unstructured-grid file, ASCII: points with 16 digits, fields with 10."""
    offsets = np.cumsum([len(c) for c in cells]) if cells else np.empty(0, int)
    body = [
        '<?xml version="1.0"?>', '<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian">', "<UnstructuredGrid>",
        f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(cells)}">', "<Points>", _array("Points", "Float64", (f"{x:.16g}" for p in points for x in p), 3), "</Points>", "<Cells>",
        _array("connectivity", "Int64", (str(x) for c in cells for x in c)), _array("offsets", "Int64", map(str, offsets)), _array("types", "UInt8", map(str, types)), "</Cells>", "<CellData>",
        *[_array(k, "Float64", (f"{x:.10e}" for x in v)) for k, v in fields.items()], "</CellData>", "</Piece>", "</UnstructuredGrid>", "</VTKFile>",
    ]
    return "\n".join(body) + "\n"


def write_vtu(m: LocalMesh, folder: str, stem: str = "part") -> DataFrame:
    """A volume and a boundary piece for each part, written where the part's rows are; the index
    files at the driver. ``folder`` is a URI that all executors reach. Gives part, file."""
    cells = m.part_cells.where("donor IS NULL").select("part", F.lit("volume").alias("what"), F.col("local_id").alias("id"), F.col("ctype").cast("int").alias("kind"), "nodes", F.col("volume").alias("field"))
    face_kind = F.when(F.size("nodes") == 3, int(CellType.TRI)).otherwise(int(CellType.QUAD))
    rim = m.part_faces.where("zone = 2").select("part", F.lit("boundary").alias("what"), F.col("local_id").alias("id"), face_kind.alias("kind"), "nodes", F.coalesce("patch_id", F.lit(-1)).cast("double").alias("field"))
    rows = cells.unionByName(rim).withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double"), "z": F.lit(None).cast("double")})
    points = m.part_nodes.select("part", F.lit("point").alias("what"), F.col("local_id").alias("id"), F.lit(None).cast("int").alias("kind"), F.array("node_gid").alias("nodes"), F.lit(None).cast("double").alias("field"), "x", "y", "z")

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        p = pdf[pdf["what"] == "point"].sort_values("id")
        number = {n[0]: k for k, n in enumerate(p["nodes"])}
        done = []
        for what, field in (("volume", "volume"), ("boundary", "patch")):
            c = pdf[pdf["what"] == what].sort_values("id")
            local = [np.array([number[x] for x in n]) for n in c["nodes"]]
            text = vtu_piece(p[["x", "y", "z"]].to_numpy(), local, [VTK_TYPE[CellType(int(k))] for k in c["kind"]], {field: c["field"].to_numpy()})
            name = f"{stem}_{what}_{part:05d}.vtu"
            write_text(f"{folder}/{name}", text)
            done.append((part, name))
        return pd.DataFrame(done, columns=["part", "file"])

    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    files = rows.unionByName(points).groupBy("part").applyInPandas(piece, "part int, file string").persist()
    names = sorted(r["file"] for r in files.collect())  # two a part
    for what, field in (("volume", "volume"), ("boundary", "patch")):
        pieces = "\n".join(f'<Piece Source="{n}"/>' for n in names if f"_{what}_" in n)
        write_text(f"{folder}/{stem}_{what}.pvtu", f'<?xml version="1.0"?>\n<VTKFile type="PUnstructuredGrid" version="0.1" byte_order="LittleEndian">\n<PUnstructuredGrid GhostLevel="0">\n<PPoints><PDataArray type="Float64" NumberOfComponents="3"/></PPoints>\n<PCellData><PDataArray type="Float64" Name="{field}"/></PCellData>\n{pieces}\n</PUnstructuredGrid>\n</VTKFile>\n')
    return files


def bc_output_type(cgns_type: Column) -> Column:
    """The boundary type that an exchange file carries: known ones as they are, others user-defined."""
    return F.when(cgns_type.isin(*DEFAULT_BC), cgns_type).otherwise("BCTypeUserDefined")


def section_layout(mesh: Mesh) -> DataFrame:
    """name, kind, n, start, end: element sections in file order with running element ids.

    Volume sections by type HEXA, PRISM, TET, PYRA; then for each patch its quads and its triangles
    (suffix _tri). Counts come from one aggregation; the running sum is over sections.
    """
    rank = {CellType.HEXA: 0, CellType.PRISM: 1, CellType.TET: 2, CellType.PYRA: 3}
    name = F.coalesce(*[F.when(F.col("ctype") == int(t), f"Volume_{t.name}") for t in rank])
    order = F.coalesce(*[F.when(F.col("ctype") == int(t), r) for t, r in rank.items()])
    vol = mesh.cells.groupBy("ctype").agg(F.count("*").alias("n")).select(name.alias("name"), F.lit("volume").alias("kind"), "n", order.alias("o"))
    tri = F.col("ftype") == int(CellType.TRI)
    srf = mesh.surface.groupBy("patch_id", "ftype").agg(F.count("*").alias("n")).join(mesh.patches.select("patch_id", "name"), "patch_id")
    srf = srf.select(F.when(tri, F.concat("name", F.lit("_tri"))).otherwise(F.col("name")).alias("name"), F.lit("surface").alias("kind"), "n", (F.lit(10) + 2 * F.col("patch_id") + tri.cast("int")).alias("o"))
    w = Window.partitionBy(F.lit(0)).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    return vol.unionByName(srf).withColumn("end", F.sum("n").over(w)).select("name", "kind", "n", (F.col("end") - F.col("n") + 1).alias("start"), "end")


def require_h5py():
    """Binary exchange formats need h5py, which is optional; Parquet is the native store."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("the HDF5 and CGNS adapters need h5py; the Parquet store doesn't") from e
    return h5py
