"""Shortest ways from seeds over weighted edges, by blocks of cells.

A block's cells and edges are one packed row, which one process relaxes until nothing falls any
more; only offers over edges between blocks are shuffled. So a sweep is a crossing from block to
block, not an edge, and the number of jobs doesn't follow the number of cells on a way.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshloom.plans.lineage import settled

# graph: a block's packed cells and edges; dist: its cells' distances; cell_gid, d: an offer to a cell of the block
ROW = "block int, graph binary, dist binary, cell_gid long, d double"
SCHEMA = pa.schema([("block", pa.int32()), ("graph", pa.binary()), ("dist", pa.binary()), ("cell_gid", pa.int64()), ("d", pa.float64())])


def _rows(block: int, graph: bytes | None = None, dist: bytes | None = None) -> pa.Table:
    return pa.table([[block], [graph], [dist], [None], [None]], schema=SCHEMA)


def _offers(blocks, cells, d) -> pa.Table:
    none = pa.nulls(len(cells), pa.binary())
    return pa.table([pa.array(blocks, pa.int32()), none, none, pa.array(cells, pa.int64()), pa.array(d, pa.float64())], schema=SCHEMA)


def pack(rows: pa.Table) -> pa.Table:
    """One block's cells (rows without dst) and edges as one row: edges within it by the cells'
    places in their order (``first``, ``to``, ``w``), edges out of it (``x_``) by the other cell's id."""
    block = rows.column("block")[0].as_py()
    lone = rows.column("dst").is_null()
    cells = np.unique(rows.filter(lone).column("src").to_numpy())
    e = rows.filter(rows.column("dst").is_valid())
    src, dst, to_block, w = (e.column(c).to_numpy() for c in ("src", "dst", "to_block", "w"))
    at, inner = np.searchsorted(cells, src), to_block == block
    order = np.argsort(at[inner], kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(at[inner], minlength=len(cells)))])
    to = np.searchsorted(cells, dst[inner])[order]
    out = io.BytesIO()
    np.savez(out, cells=cells, first=first, to=to.astype(np.int32), w=w[inner][order], x_from=at[~inner].astype(np.int32), x_block=to_block[~inner], x_to=dst[~inner], x_w=w[~inner])
    return _rows(block, graph=out.getvalue())


def _falls(offer, d, rel_tol: float):
    return np.where(np.isinf(d), offer < np.inf, offer < d * (1 - rel_tol) if rel_tol else offer < d)


def _unpack(rows: pa.Table):
    """A block's graph, its distances so far, and the offers to its cells."""
    graph, dist, at = rows.column("graph"), rows.column("dist"), rows.column("cell_gid")
    g = np.load(io.BytesIO(graph.drop_null()[0].as_py()))
    known = dist.drop_null()
    d = np.frombuffer(known[0].as_py()).copy() if len(known) else np.full(len(g["cells"]), np.inf)
    offers = rows.filter(at.is_valid())
    return g, d, np.searchsorted(g["cells"], offers.column("cell_gid").to_numpy()), offers.column("d").to_numpy()


def relax_block(d, to, offer, first, target, w, rel_tol: float):
    """Take the offers into ``d`` and pass them on along the edges for as long as a distance falls;
    tells which did."""
    fell = np.zeros(len(d), bool)
    while True:
        falls = _falls(offer, d[to], rel_tol)
        to, offer = to[falls], offer[falls]
        if not len(to):
            return fell
        np.minimum.at(d, to, offer)
        fresh = np.unique(to)
        fell[fresh] = True
        n = first[fresh + 1] - first[fresh]
        e = np.repeat(first[fresh] - np.cumsum(n) + n, n) + np.arange(n.sum())
        to, offer = target[e], np.repeat(d[fresh], n) + w[e]


def shortest_ways(blocks: DataFrame, edges: DataFrame, seeds: DataFrame, max_sweeps: int | None = None, rel_tol: float = 0.0) -> DataFrame:
    """cell_gid, d of every cell: the least of a seed's d and the edges from there; null where no way leads.

    ``blocks`` has cell_gid, block; ``edges`` block, src, dst, to_block, w; ``seeds`` block, cell_gid, d.
    A sweep relaxes the blocks that have offers, each to its end, and makes offers to cells of
    others; the last one makes none. Every sweep ends in a checkpoint. ``max_sweeps`` bounds them:
    then every way of that many edges is weighed, and many longer ones.
    """
    cells = blocks.select("block", F.col("cell_gid").alias("src"), *[F.lit(None).cast(t).alias(c) for c, t in (("dst", "long"), ("to_block", "int"), ("w", "double"))])
    graph = settled(cells.unionByName(edges).groupBy("block").applyInArrow(pack, ROW))
    none = [F.lit(None).cast("binary").alias(c) for c in ("graph", "dist")]
    state = settled(seeds.where("d IS NOT NULL").select("block", *none, "cell_gid", "d"))

    def sweep(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        g, d, to, offer = _unpack(rows)
        fell = relax_block(d, to, offer, g["first"], g["to"], g["w"], rel_tol)
        out = fell[g["x_from"]]
        target, there, offer = g["x_to"][out], g["x_block"][out], (d[g["x_from"]] + g["x_w"])[out]
        order = np.lexsort((offer, target))
        least = order[np.unique(target[order], return_index=True)[1]]  # the least offer to each cell
        return pa.concat_tables([_rows(block, dist=d.tobytes()), _offers(there[least], target[least], offer[least])])

    def ended(rows: pa.Table) -> pa.Table:
        g, d, to, offer = _unpack(rows)
        falls = _falls(offer, d[to], rel_tol)  # none but those that max_sweeps left
        np.minimum.at(d, to[falls], offer[falls])
        return pa.table([pa.array(g["cells"]), pa.array(d, mask=np.isinf(d))], names=["cell_gid", "d"])

    swept = 0
    while max_sweeps is None or swept < max_sweeps:
        # one row a block
        active = [r["block"] for r in state.where("cell_gid IS NOT NULL").select("block").distinct().collect()]
        if not active:
            break
        swept += 1
        here = F.col("block").isin(active)
        state = settled(graph.where(here).unionByName(state.where(here)).groupBy("block").applyInArrow(sweep, ROW).unionByName(state.where(~here)))
    return graph.unionByName(state).groupBy("block").applyInArrow(ended, "cell_gid long, d double")
