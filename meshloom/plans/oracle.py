"""The queries again, as plain SQL over the driver's tables."""

from __future__ import annotations

from meshloom.plans.queries import DIGITS, GRADINGS, K, TFI_CORNERS

# The lattice: cells, their corners, half-faces, faces, sides, parts.
_CTE = {
    "n": ("", "SELECT count(*)::BIGINT AS n, (count(*) // 500)::BIGINT AS nz FROM orders"),
    "cells": ("", "SELECT o_orderkey AS cell_gid, o_orderkey % 25 AS i, (o_orderkey // 25) % 20 AS j, o_orderkey // 500 AS k, o_orderkey % 25 + 26 * ((o_orderkey // 25) % 20) + 546 * (o_orderkey // 500) AS b FROM orders"),
    "corner": ("", "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 27), (3, 26), (4, 546), (5, 547), (6, 573), (7, 572)) t(pos, off)"),
    "cn": ("cells corner", "SELECT cell_gid, pos, (b + off)::BIGINT AS node_gid FROM cells, corner"),
    "nodes": ("n", "SELECT g AS node_gid, (g % 26) / 4.0::DOUBLE AS x, ((g // 26) % 21) / 8.0::DOUBLE AS y, (g // 546) / 16.0::DOUBLE AS z FROM (SELECT unnest(range(546 * (nz + 1)))::BIGINT AS g FROM n)"),
    "ft": ("", "SELECT * FROM (VALUES (0, 0, 26, 27, 1, 4), (1, 0, 1, 547, 546, 2), (2, 1, 27, 573, 547, 1), (3, 27, 26, 572, 573, 3), (4, 26, 0, 546, 572, 0), (5, 546, 547, 573, 572, 5)) t(lface, o0, o1, o2, o3, side)"),
    "half": ("cells ft", "SELECT cell_gid, lface, side, (b + o0)::BIGINT AS n0, (b + o1)::BIGINT AS n1, (b + o2)::BIGINT AS n2, (b + o3)::BIGINT AS n3, list_sort([b + o0, b + o1, b + o2, b + o3]) AS s FROM cells, ft"),
    "faces": ("half", "SELECT s[1]::BIGINT AS k0, s[2]::BIGINT AS k1, s[3]::BIGINT AS k2, s[4]::BIGINT AS k3, min(cell_gid) AS cell_a, arg_min(lface, cell_gid) AS lface_a, CASE WHEN count(*) = 2 THEN max(cell_gid) END AS cell_b, CASE WHEN count(*) = 2 THEN arg_max(lface, cell_gid) END AS lface_b, CASE WHEN count(*) = 1 THEN min(side) END AS patch_id FROM half GROUP BY s"),
    "dual": ("faces", "SELECT cell_a AS src, cell_b AS dst FROM faces WHERE cell_b IS NOT NULL UNION ALL SELECT cell_b, cell_a FROM faces WHERE cell_b IS NOT NULL"),
    "parts": ("n", f"SELECT o_orderkey AS cell_gid, (o_orderkey * {K} // n)::INT AS part FROM orders, n"),
    "sides": ("faces parts", "SELECT a.part, cell_a AS owner_gid, cell_b AS neigh_gid, CASE WHEN a.part <> b.part THEN b.part END AS nb_part, patch_id, lface_a AS lface FROM faces JOIN parts a ON cell_a = a.cell_gid LEFT JOIN parts b ON cell_b = b.cell_gid UNION ALL SELECT b.part, cell_b, cell_a, a.part, NULL, lface_b FROM faces JOIN parts a ON cell_a = a.cell_gid JOIN parts b ON cell_b = b.cell_gid WHERE a.part <> b.part"),
    "ghosts": ("sides", "SELECT DISTINCT part, nb_part AS donor, neigh_gid AS cell_gid FROM sides WHERE nb_part IS NOT NULL"),
    "local": ("parts ghosts", "SELECT part, (row_number() OVER (PARTITION BY part ORDER BY donor NULLS FIRST, cell_gid) - 1)::INT AS local_id, cell_gid, donor FROM (SELECT part, cell_gid, NULL::INT AS donor FROM parts UNION ALL SELECT part, cell_gid, donor FROM ghosts)"),
    "gseq": ("ghosts", "SELECT *, (row_number() OVER (PARTITION BY part, donor ORDER BY cell_gid) - 1)::INT AS seq FROM ghosts"),
    "mid": ("cells", "SELECT cell_gid, (i + 0.5) / 4 AS cx, (j + 0.5) / 8 AS cy, (k + 0.5) / 16 AS cz FROM cells"),
    "fm": ("faces mid", "SELECT f.*, CASE lface_a WHEN 2 THEN 1.0 WHEN 4 THEN -1.0 ELSE 0 END AS nx, CASE lface_a WHEN 3 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0 END AS ny, CASE lface_a WHEN 5 THEN 1.0 WHEN 0 THEN -1.0 ELSE 0 END AS nz, CASE WHEN lface_a IN (0, 5) THEN 1/32.0 WHEN lface_a IN (2, 4) THEN 1/128.0 ELSE 1/64.0 END AS area, cx, cy, cz FROM faces f JOIN mid ON cell_a = cell_gid"),
    "zoned": ("sides", "SELECT *, CASE WHEN neigh_gid IS NULL THEN 2 WHEN nb_part IS NOT NULL THEN 1 ELSE 0 END AS zone FROM sides"),
    "zsort": ("zoned local", "SELECT z.part, (row_number() OVER (PARTITION BY z.part ORDER BY zone, CASE WHEN zone = 2 THEN patch_id ELSE o.local_id END, CASE WHEN zone = 2 THEN o.local_id ELSE h.local_id END, lface) - 1)::INT AS local_id, zone, owner_gid, lface, patch_id FROM zoned z JOIN local o ON o.part = z.part AND o.cell_gid = owner_gid LEFT JOIN local h ON h.part = z.part AND h.cell_gid = neigh_gid"),
}


def _with(need: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in _CTE[name][0].split():
            add(x)
        if name not in order:
            order.append(name)

    for x in need.split():
        add(x)
    return ("WITH " + ", ".join(f"{x} AS ({_CTE[x][1]})" for x in order) + " " if order else "") + body


def _r(e: str, name: str) -> str:
    return f"round(({e})::DOUBLE, {DIGITS}) + 0.0 AS {name}"


_S = "i / 64.0"
_GRADING = {
    "uniform": _S,
    "geometric": "(1 - pow(pow({a}, 1.0 / 63), i)) / (1 - pow(pow({a}, 1.0 / 63), 64))",
    "tanh_start": f"1 - tanh({{a}} * (1 - {_S})) / tanh({{a}})",
    "tanh_end": f"tanh({{a}} * {_S}) / tanh({{a}})",
    "tanh_both": f"0.5 * (1 + tanh({{a}} * (2 * {_S} - 1)) / tanh({{a}}))",
}


def _tfi(axis: int) -> str:
    w = ["(1-u)*(1-v)*(1-w)", "u*(1-v)*(1-w)", "u*v*(1-w)", "(1-u)*v*(1-w)", "(1-u)*(1-v)*w", "u*(1-v)*w", "u*v*w", "(1-u)*v*w"]
    return " + ".join(f"{float(c[axis])} * {x}" for c, x in zip(TFI_CORNERS, w, strict=True))


_NONE = "SELECT 0::BIGINT AS violations"
_KEYS = "k0, k1, k2, k3"

ORACLE_SQL: dict[str, str] = {
    "block_distribution": _with("n", "SELECT r AS block, (r * (n // 7) + least(r, n % 7))::BIGINT AS first, ((r + 1) * (n // 7) + least(r + 1, n % 7))::BIGINT AS \"end\" FROM (SELECT unnest(range(7))::BIGINT AS r), n"),
    "block_owner_lookup": _with("n", "SELECT o_orderkey AS cell_gid, r AS block FROM orders JOIN (SELECT r, r * (n // 7) + least(r, n % 7) AS lo, (r + 1) * (n // 7) + least(r + 1, n % 7) AS hi FROM (SELECT unnest(range(7))::BIGINT AS r), n) ON o_orderkey >= lo AND o_orderkey < hi"),
    "rank_exscan": _with("parts", "SELECT part, count(*) AS n_cells, coalesce(sum(count(*)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM parts GROUP BY part"),
    "csr_offsets": _with("dual parts", "SELECT part, cell_gid, degree, sum(degree) OVER (PARTITION BY part ORDER BY cell_gid)::BIGINT AS row_end FROM parts JOIN (SELECT src AS cell_gid, count(*) AS degree FROM dual GROUP BY src) USING (cell_gid)"),
    "global_cell_rank": _with("cells", "SELECT cell_gid, k + i AS key, row_number() OVER (ORDER BY k + i, cell_gid) - 1 AS rank FROM cells"),
    **{f"grading_{n}": f"SELECT i, round(CASE i WHEN 0 THEN 0.0 WHEN 64 THEN 1.0 ELSE {_GRADING[n].format(a=a)} END::DOUBLE, {DIGITS}) AS s FROM (SELECT unnest(range(65))::BIGINT AS i)" for n, a in GRADINGS.items()},
    "tfi_nodes": _with("nodes n", f"SELECT node_gid, {_r(_tfi(0), 'x')}, {_r(_tfi(1), 'y')}, {_r(_tfi(2), 'z')} FROM (SELECT node_gid, x / 6.25 AS u, y / 2.5 AS v, z / (nz / 16.0::DOUBLE) AS w FROM nodes, n)"),
    "generator_report": _with("n", "SELECT unnest(['n_cells', 'n_nodes', 'last_node', 'n_faces', 'n_patched', 'volume', 'inlet_area', 'bottom_area']) AS measure, unnest([22.0 * 8 * nz, 23.0 * 9 * (nz + 1), 23.0 * 9 * (nz + 1), 23.0 * 8 * nz + 22.0 * 9 * nz + 22.0 * 8 * (nz + 1), 8.0 * nz + 22.0 * 8, 3.0, 1.0, 3.0])::DOUBLE AS value FROM n"),
    "lattice_cells": _with("cn", "SELECT * FROM cn"),
    "lattice_nodes": _with("nodes", "SELECT * FROM nodes"),
    "boundary_quads": _with("half faces n", "SELECT n + 1 + 6 * cell_gid + side AS eid, side AS patch_id, n0, n1, n2, n3 FROM half JOIN faces ON cell_a = cell_gid AND lface_a = lface AND cell_b IS NULL, n"),
    "plane_span": "SELECT 2.5::DOUBLE AS span_x, 0.0::DOUBLE AS span_y, 1.25::DOUBLE AS span_z, 'x' AS u, 'z' AS v",
    "extrude_nodes": "SELECT (g + 36 * up)::BIGINT AS node_gid, (g % 6) / 2.0::DOUBLE AS x, (g // 6) / 4.0::DOUBLE AS y, up * 0.25::DOUBLE AS z FROM (SELECT unnest(range(36)) AS g), (SELECT unnest([0, 1]) AS up)",
    "extrude_cells": "SELECT n_nationkey::BIGINT AS cell_gid, pos, (n_nationkey % 5 + 6 * (n_nationkey // 5) + off)::BIGINT AS node_gid FROM nation, (VALUES (0, 0), (1, 1), (2, 7), (3, 6), (4, 36), (5, 37), (6, 43), (7, 42)) t(pos, off)",
    "extrude_caps": "SELECT * FROM (VALUES (0, 'named', 'BCWall', 2::BIGINT, 26::BIGINT, 27::BIGINT), (1, 'south', 'UserDefined', 3, 28, 30), (2, 'Z_MIN', 'SymmetryPlane', 25, 31, 55), (3, 'Z_MAX', 'SymmetryPlane', 25, 56, 80)) t(patch_id, name, cgns_type, n, first, last)",
    "eid_patch_last_wins": "SELECT o_orderkey + 1 AS eid, max(n_nationkey) AS patch_id FROM orders LEFT JOIN nation ON o_orderkey + 1 BETWEEN n_nationkey * 50 AND n_nationkey * 50 + 90 GROUP BY o_orderkey",
    "section_classes": _with("n", "SELECT unnest(['a', 'b', 'side']) AS name, unnest([true, true, false]) AS is_volume, unnest([0, n // 3, NULL])::BIGINT AS cell_offset FROM n"),
    "half_face_keys": _with("half", "SELECT cell_gid, lface, n0, n1, n2, n3, s[1]::BIGINT AS k0, s[2]::BIGINT AS k1, s[3]::BIGINT AS k2, s[4]::BIGINT AS k3 FROM half"),
    "face_match": _with("faces", f"SELECT {_KEYS}, cell_a, lface_a, cell_b, lface_b FROM faces"),
    "face_stats": _with("faces", "SELECT count(*) AS n_faces, count(*) - count(cell_b) AS n_boundary, count(cell_b) AS n_inner, 2 * count(cell_b) AS n_dual FROM faces"),
    "nonmanifold_check": _with("cells half", "SELECT s[1]::BIGINT AS k0, s[2]::BIGINT AS k1, s[3]::BIGINT AS k2, s[4]::BIGINT AS k3, count(*) AS n FROM (SELECT s FROM half UNION ALL SELECT s FROM half JOIN cells USING (cell_gid) WHERE i = 0) GROUP BY s HAVING count(*) > 2"),
    "boundary_patch_match": _with("faces", "SELECT cell_a, lface_a, patch_id FROM faces WHERE cell_b IS NULL"),
    "orphan_surface_elements": _with("faces n", "SELECT n + 1 + 6 * cell_a + patch_id + 10000000 AS eid FROM faces, n WHERE cell_b IS NULL AND patch_id <> 2"),
    "dual_edges": _with("dual", "SELECT * FROM dual"),
    "dual_degree": _with("dual", "SELECT src AS cell_gid, count(*) AS degree, min(dst) AS first FROM dual GROUP BY src"),
    "partition_block_stats": _with("parts", "SELECT part, count(*) AS n_cells FROM parts GROUP BY part"),
    "edge_cut": _with("faces n", "SELECT count(*) AS edge_cut FROM faces, n WHERE cell_b IS NOT NULL AND cell_a * 4 // n <> cell_b * 4 // n"),
    "imbalance": _with("n", f"SELECT count(*) AS n_parts, min(c) AS min_cells, {_r('avg(c)', 'avg_cells')}, max(c) AS max_cells, {_r('(max(c) - avg(c)) / avg(c) * 100', 'imbalance')} FROM (SELECT count(*) AS c FROM orders, n GROUP BY o_orderkey * 7 // n)"),
    "hilbert_partition_sizes": _with("n", f"SELECT r AS part, (n // {K} + CASE WHEN r < n % {K} THEN 1 ELSE 0 END)::BIGINT AS n_cells FROM (SELECT unnest(range({K}))::INT AS r), n"),
    "part_rank_map": "SELECT (row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1)::INT AS part, s_suppkey AS rank FROM supplier",
    "face_sides": _with("sides", "SELECT * FROM sides"),
    "ghost_cells": _with("ghosts", "SELECT * FROM ghosts"),
    "vertex_ghost_cells": _with("cn parts", "SELECT DISTINCT p.part, q.part AS donor, d.cell_gid FROM cn c JOIN parts p ON p.cell_gid = c.cell_gid JOIN cn d ON d.node_gid = c.node_gid JOIN parts q ON q.cell_gid = d.cell_gid WHERE p.part <> q.part"),
    "halo_recv": _with("gseq local", "SELECT g.part, g.donor AS nb_part, seq, local_id, g.cell_gid FROM gseq g JOIN local l ON l.part = g.part AND l.cell_gid = g.cell_gid"),
    "halo_send": _with("gseq local", "SELECT g.donor AS part, g.part AS nb_part, seq, local_id, g.cell_gid FROM gseq g JOIN local l ON l.part = g.donor AND l.cell_gid = g.cell_gid"),
    "halo_symmetry": _NONE,
    "local_cell_numbering": _with("local", "SELECT * FROM local"),
    "local_node_numbering": _with("cn local", "SELECT part, (row_number() OVER (PARTITION BY part ORDER BY is_owned DESC, node_gid) - 1)::INT AS local_id, node_gid, is_owned FROM (SELECT part, node_gid, bool_or(donor IS NULL) AS is_owned FROM local JOIN cn USING (cell_gid) GROUP BY part, node_gid)"),
    "local_face_order": _with("sides local", "SELECT s.part, (row_number() OVER (PARTITION BY s.part ORDER BY o.local_id, h.local_id NULLS FIRST, lface) - 1)::INT AS local_id, owner_gid, neigh_gid, lface FROM sides s JOIN local o ON o.part = s.part AND o.cell_gid = owner_gid LEFT JOIN local h ON h.part = s.part AND h.cell_gid = neigh_gid"),
    "bbox": _with("cells parts", "SELECT part, min(i) / 4.0::DOUBLE AS min_x, (max(i) + 1) / 4.0::DOUBLE AS max_x, min(j) / 8.0::DOUBLE AS min_y, (max(j) + 1) / 8.0::DOUBLE AS max_y, min(k) / 16.0::DOUBLE AS min_z, (max(k) + 1) / 16.0::DOUBLE AS max_z FROM cells JOIN parts USING (cell_gid) GROUP BY part"),
    "global_face_counts": _with("faces sides", "SELECT (SELECT count(*) FROM faces) AS n_faces, (SELECT count(*) // 2 FROM sides WHERE nb_part IS NOT NULL)::BIGINT AS n_cut, (SELECT count(patch_id) FROM faces) AS n_patched"),
    "cell_metrics": _with("mid", f"SELECT cell_gid, {_r('1 / 512.0', 'volume')}, {_r('cx', 'cx')}, {_r('cy', 'cy')}, {_r('cz', 'cz')} FROM mid"),
    "face_metrics": _with("fm", f"SELECT cell_a, lface_a, {_r('area', 'area')}, {_r('nx', 'nx')}, {_r('ny', 'ny')}, {_r('nz', 'nz')}, {_r('cx + nx / 8', 'fx')}, {_r('cy + ny / 16', 'fy')}, {_r('cz + nz / 32', 'fz')} FROM fm"),
    "patch_area": _with("fm", f"SELECT patch_id, count(*) AS n_faces, {_r('sum(area)', 'area')} FROM fm WHERE patch_id IS NOT NULL GROUP BY patch_id"),
    "domain_volume": _with("n", f"SELECT n AS n_cells, {_r('n / 512.0', 'volume')}, {_r('1 / 512.0', 'smallest')}, {_r('1 / 512.0', 'largest')} FROM n"),
    "geometry_contracts": _NONE,
    "closed_cells": "SELECT o_orderkey AS cell_gid, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 0.0::DOUBLE AS sz FROM orders",
    "face_zone_sort": _with("zsort", "SELECT part, local_id, zone, owner_gid, lface FROM zsort"),
    "zone_counts": _with("zoned", "SELECT part, " + ", ".join(f"count(*) FILTER (zone = {z}) AS n_zone{z}" for z in range(3)) + " FROM zoned GROUP BY part"),
    "patch_face_ranges": _with("zoned", "SELECT part, patch_id, count(*) AS n_faces, count(*) AS width FROM zoned WHERE zone = 2 GROUP BY part, patch_id"),
    "cell_faces": _with("half", f"SELECT cell_gid, s[1]::BIGINT AS k0, s[2]::BIGINT AS k1, s[3]::BIGINT AS k2, s[4]::BIGINT AS k3 FROM half"),
    "cell_cells_face": _with("dual", "SELECT src AS cell_gid, dst AS other FROM dual"),
    "node_cells": _with("cn", "SELECT node_gid, cell_gid FROM cn"),
    "node_faces": _with("faces", f"SELECT unnest([{_KEYS}]) AS node_gid, {_KEYS} FROM faces"),
    "cell_cells_node": _with("cn", "SELECT DISTINCT a.cell_gid, b.cell_gid AS other FROM cn a JOIN cn b ON a.node_gid = b.node_gid AND a.cell_gid <> b.cell_gid"),
    "part_supplier_incidence": "WITH r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT s AS cell_gid, count(*) AS others FROM (SELECT DISTINCT a.s, b.s AS t FROM r a JOIN r b ON a.p = b.p AND a.s <> b.s) GROUP BY s",
    "face_vector": _with("fm", f"SELECT cell_a, lface_a, {_r('nx / 4', 'dx')}, {_r('ny / 8', 'dy')}, {_r('nz / 16', 'dz')} FROM fm"),
    "face_distance": _with("fm", f"SELECT cell_a, lface_a, {_r('abs(nx) / 4 + abs(ny) / 8 + abs(nz) / 16', 'distance')} FROM fm"),
    "face_distance_inv": _with("fm", f"SELECT cell_a, lface_a, {_r('1 / (abs(nx) / 4 + abs(ny) / 8 + abs(nz) / 16)', 'inverse_distance')} FROM fm"),
    "interp_weight": _with("faces", "SELECT cell_a, lface_a, 0.5::DOUBLE AS weight FROM faces"),
    "non_ortho": _with("faces", "SELECT cell_a, lface_a, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz FROM faces"),
    "wall_distance": _with("mid", f"SELECT cell_gid, {_r('cz', 'distance')} FROM mid"),
    "face_conservation": _with("zoned", "SELECT count(*) FILTER (zone = 0) AS n_pure, count(*) FILTER (zone = 1) AS n_cut, count(*) FILTER (zone = 2) AS n_boundary, true AS balanced FROM zoned"),
    **dict.fromkeys(["order_violations", "normal_violations", "zone_violations", "cell_violations"], _NONE),
    "part_report": _with("local zoned", f"SELECT part, n_own, n_ghost, {_r('n_own / 512.0', 'volume')}, n_faces, n_cut FROM (SELECT part, count(*) FILTER (donor IS NULL) AS n_own, count(donor) AS n_ghost FROM local GROUP BY part) JOIN (SELECT part, count(*) AS n_faces, count(nb_part) AS n_cut FROM zoned GROUP BY part) USING (part)"),
    "patch_report": _with("fm", f"SELECT patch_id, count(*) AS n_faces, {_r('sum(area)', 'area')} FROM fm WHERE patch_id IS NOT NULL GROUP BY patch_id"),
    "bc_default_type": """
        WITH known(name, bc) AS (VALUES ('BCWall', 'WALL_ADIABATIC'), ('BCWallViscous', 'WALL_ADIABATIC'), ('BCWallInviscid', 'SYMMETRY'), ('BCSymmetryPlane', 'SYMMETRY'),
            ('BCInflow', 'INLET_TOTAL_TP'), ('BCInflowSubsonic', 'INLET_TOTAL_TP'), ('BCInflowSupersonic', 'INLET_TOTAL_TP'), ('BCOutflow', 'OUTLET_BACK_PRESSURE'), ('BCOutflowSubsonic', 'OUTLET_BACK_PRESSURE'), ('BCFarfield', 'FARFIELD')),
        names AS (SELECT 'BC' || upper(event_type[1]) || lower(event_type[2:]) AS name FROM events UNION ALL SELECT name FROM known)
        SELECT name, count(*) AS n, coalesce(any_value(bc), 'USER_DEFINED') AS bc, CASE WHEN any_value(bc) IS NULL THEN 'BCTypeUserDefined' ELSE name END AS written FROM names LEFT JOIN known USING (name) GROUP BY name
    """,
    "vtk_type_counts": "SELECT count(*) AS n, ['TET', 'PYRA', 'PRISM', 'HEXA', 'TRI', 'QUAD'][p_size % 6 + 1] AS name, [10, 14, 13, 12, 5, 9][p_size % 6 + 1] AS vtk FROM part GROUP BY p_size % 6",
    "section_layout": _with("faces n", """SELECT name, kind, n, ("end" - n + 1)::BIGINT AS start, "end" FROM (SELECT *, (sum(n) OVER (ORDER BY o))::BIGINT AS "end" FROM (
        SELECT 'Volume_HEXA' AS name, 'volume' AS kind, n, -1 AS o FROM n
        UNION ALL SELECT ['x_min', 'x_max', 'y_min', 'y_max', 'z_min', 'z_max'][patch_id + 1], 'surface', count(*), patch_id FROM faces WHERE cell_b IS NULL GROUP BY patch_id))"""),
}
