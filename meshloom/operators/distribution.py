"""Block distributions and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshloom.plans.lineage import settled


def div(a: Column, b: Column) -> Column:
    """The whole quotient of longs, exact at any size."""
    return F.call_function("div", a, b)


def block_start(r: Column, n: Column, p: Column) -> Column:
    """First element of block r when n elements go to p balanced blocks, the first n % p one larger."""
    return r * div(n, p) + F.least(r, n % p)


def block_displacements(n: int, p: int) -> list[int]:
    return [r * (n // p) + min(r, n % p) for r in range(p + 1)]


def block_owner(g: Column, n: int, p: int) -> Column:
    """The block that holds element g in closed form; -1 outside 0..n-1."""
    small, extra = divmod(n, p)
    border = extra * (small + 1)
    big = div(g, F.lit(small + 1))
    rest = F.lit(extra).cast("long") + div(g - border, F.lit(max(small, 1)))
    return F.when((g < 0) | (g >= n), F.lit(-1).cast("long")).when(g < border, big).otherwise(rest)


def exclusive_prefix(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` by ``key`` over a small table (one row per part or section)."""
    w = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def inclusive_offsets(df: DataFrame, part: str, key: str, value: str, out: str) -> DataFrame:
    """Inclusive offsets within each part: where a row's list ends."""
    w = Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w).cast("long"))


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Rank 0..n-1 in the total order of ``order``, without one task seeing all rows.

    One range partitioning, written; a row's number within its range comes with the sort, and the
    ranges' own offsets are one row a partition.
    """
    # partition in the upper bits, row in the lower 33
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_p", F.shiftright("_m", 33))
    offsets = exclusive_prefix(ranged.groupBy("_p").count(), "_p", "count", "_at").select("_p", "_at")
    # offsets: one row for each shuffle partition
    rank = F.col("_at") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(offsets), "_p").withColumn(out, rank).drop("_p", "_at", "_m")
