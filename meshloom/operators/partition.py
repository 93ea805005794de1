"""Partitions of cells: space-filling curve, coordinate bisection, refinement; cut and balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meshloom.functions.hilbert import BITS, hilbert_key
from meshloom.operators.distribution import block_owner, div, global_rank
from meshloom.operators.faces import dual_edges
from meshloom.plans.lineage import settled


def box_key(metrics: DataFrame, by: list[str]) -> DataFrame:
    """``metrics`` with hkey: the Hilbert key of a cell's centroid in the bounding box of its group
    (all cells where ``by`` is empty), one scale for all axes, truncated to 21 bits."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("cx", "cy", "cz") for n, f in (("lo", F.min), ("hi", F.max))]
    box = metrics.groupBy(*by).agg(*bounds) if by else metrics.agg(*bounds)
    span = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in ("cx", "cy", "cz")])
    top = float((1 << BITS) - 1)
    box = box.withColumn("_scale", F.lit(top) / F.when(span <= 1e-15, F.lit(1.0)).otherwise(span))
    # one row for each group: the parts of a mesh, or one
    rows = metrics.join(F.broadcast(box), by) if by else metrics.join(F.broadcast(box.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    q = [F.greatest(F.lit(0.0), F.least(F.lit(top), (F.col(c) - F.col(f"lo_{c}")) * F.col("_scale"))).cast("long") for c in ("cx", "cy", "cz")]
    return rows.select(*metrics.columns, hilbert_key(*q).alias("hkey"))


def hilbert_partition(metrics: DataFrame, k: int) -> DataFrame:
    """cell_gid, part: equal pieces of the Hilbert order (ties by id). Never more than one cell apart."""
    metrics = settled(metrics.select("cell_gid", "cx", "cy", "cz"))  # read for their number, their box and the order
    n = metrics.count()
    keyed = settled(box_key(metrics, []).select("hkey", "cell_gid"))  # the range partitioning reads the keys twice
    ranked = global_rank(keyed, ["hkey", "cell_gid"])
    return ranked.select("cell_gid", block_owner(F.col("rank"), n, k).cast("int").alias("part"))


def block_partition(cells: DataFrame, n: int, k: int) -> DataFrame:
    """cell_gid, part = cell_gid * k div n, for cells numbered 0..n-1."""
    return cells.select("cell_gid", div(F.col("cell_gid") * k, F.lit(n)).cast("int").alias("part"))


def rcb_partition(metrics: DataFrame, k: int, accuracy: int = 10_000) -> DataFrame:
    """cell_gid, part by recursive coordinate bisection: every group is cut at the quantile of its
    longest axis that its share of parts asks for; one small aggregation a level."""
    df = metrics.select("cell_gid", "cx", "cy", "cz").withColumns({"lo": F.lit(0), "n": F.lit(k)})
    for _ in range(max(0, (k - 1).bit_length())):
        spans = [(F.max(c) - F.min(c)).alias(f"s_{c}") for c in ("cx", "cy", "cz")]
        left = F.floor(F.col("n") / 2)
        g = df.groupBy("lo", "n").agg(*spans, *[F.percentile_approx(c, F.array(*[F.lit(x / 64) for x in range(65)]), accuracy).alias(f"q_{c}") for c in ("cx", "cy", "cz")])
        axis = F.when((F.col("s_cx") >= F.col("s_cy")) & (F.col("s_cx") >= F.col("s_cz")), "cx").when(F.col("s_cy") >= F.col("s_cz"), "cy").otherwise("cz")
        at = F.round(64 * left / F.col("n")).cast("int")
        g = g.select("lo", "n", axis.alias("axis"), F.when(axis == "cx", F.get("q_cx", at)).when(axis == "cy", F.get("q_cy", at)).otherwise(F.get("q_cz", at)).alias("cut"))
        # one row for each group so far: k at most
        df = df.join(F.broadcast(g), ["lo", "n"])
        here = F.when(F.col("axis") == "cx", F.col("cx")).when(F.col("axis") == "cy", F.col("cy")).otherwise(F.col("cz"))
        go = (here > F.col("cut")) & (F.col("n") > 1)
        half = F.floor(F.col("n") / 2).cast("int")
        df = df.select("cell_gid", "cx", "cy", "cz", F.when(go, F.col("lo") + half).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n") <= 1, F.col("n")).when(go, F.col("n") - half).otherwise(half).alias("n"))
    return df.select("cell_gid", F.col("lo").cast("int").alias("part"))


def refine(parts: DataFrame, faces: DataFrame, k: int, epsilon: float = 0.03, rounds: int = 4) -> DataFrame:
    """Label propagation within a balance bound: boundary cells go where more of their neighbours are.

    In even rounds cells move to higher parts only, in odd rounds to lower ones, so neighbours
    don't swap. Of the cells that would enter a part, those with the largest gain do, as far as the
    part has room; a part is never larger than (1 + epsilon) times the mean. Each round ends in a
    checkpoint.
    """
    edges = dual_edges(faces).persist()
    limit = -(-int(parts.count() * (1 + epsilon)) // k)
    cur = parts
    for r in range(rounds):
        p = cur.select(F.col("cell_gid").alias("src"), F.col("part").alias("mine"))
        q = cur.select(F.col("cell_gid").alias("dst"), F.col("part").alias("theirs"))
        votes = edges.join(p, "src").join(q, "dst").groupBy("src", "mine", "theirs").agg(F.count("*").alias("n"))
        side = F.col("theirs") > F.col("mine") if r % 2 == 0 else F.col("theirs") < F.col("mine")
        best = votes.groupBy("src", "mine").agg(F.sum(F.when(F.col("theirs") == F.col("mine"), F.col("n")).otherwise(0)).alias("stay"), F.max(F.when(side, F.struct("n", (-F.col("theirs")).alias("t")))).alias("go"))
        best = best.where(F.col("go.n") > F.col("stay")).select("src", (-F.col("go.t")).alias("to"), (F.col("go.n") - F.col("stay")).alias("gain"))
        room = cur.groupBy(F.col("part").alias("to")).agg((F.lit(limit) - F.count("*")).alias("room"))
        w = Window.partitionBy("to").orderBy(F.desc("gain"), "src")
        # room: one row a part
        moves = best.withColumn("rn", F.row_number().over(w)).join(F.broadcast(room), "to").where(F.col("rn") <= F.col("room")).select(F.col("src").alias("cell_gid"), F.col("to"))
        cur = cur.join(moves, "cell_gid", "left").select("cell_gid", F.coalesce("to", "part").cast("int").alias("part"))
        cur = settled(cur)
    return cur


def cut_faces(faces: DataFrame, parts: DataFrame) -> DataFrame:
    """Inner faces between parts: the columns of ``faces``, part_a, part_b."""
    a = parts.select(F.col("cell_gid").alias("cell_a"), F.col("part").alias("part_a"))
    b = parts.select(F.col("cell_gid").alias("cell_b"), F.col("part").alias("part_b"))
    return faces.where("cell_b IS NOT NULL").join(a, "cell_a").join(b, "cell_b").where("part_a <> part_b")


def edge_cut(faces: DataFrame, parts: DataFrame) -> DataFrame:
    return cut_faces(faces, parts).agg(F.count("*").alias("edge_cut"))


def part_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("n_cells"))


def balance(parts: DataFrame) -> DataFrame:
    """n_parts, min, mean and max cells, imbalance in percent of the mean."""
    s = part_sizes(parts)
    mean = F.avg("n_cells")
    return s.agg(F.count("*").alias("n_parts"), F.min("n_cells").alias("min_cells"), mean.alias("avg_cells"), F.max("n_cells").alias("max_cells"), ((F.max("n_cells") - mean) / mean * 100).alias("imbalance"))


def part_map(nodes_of_rank: DataFrame) -> DataFrame:
    """part, rank: ranks ordered by (node_id, rank) take parts in turn. One row a rank."""
    w = Window.partitionBy(F.lit(0)).orderBy("node_id", "rank")
    return nodes_of_rank.select((F.row_number().over(w) - 1).cast("int").alias("part"), "rank")


def inverse_map(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("rank"), F.col("part"))
