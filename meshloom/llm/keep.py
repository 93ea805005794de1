"""Take the rows that an operator decided against out of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from meshloom.llm.common import Scratch

SMALL = 1_000_000  # keys up to a third of this count are broadcast (some 32 MB), more are joined by shuffle


def without_rows(docs: DataFrame, key: Column, decisions: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows that ``decisions`` (doc_id, key, the boolean ``kept``: a row for each row) decides against.

    A row is known by its id, which may be null, and ``key``, a digest of its text: rows that share
    an id and hold different texts are decided on apart. Where rows share both, one stays: the
    longest text, then the last in order. All columns of ``docs`` come back in their order.
    """
    scratch = Scratch(docs.sparkSession, name)
    odd_id, odd_key = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "key"))  # no column of docs is named so
    per_row = decisions.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = scratch.put(per_row.where("NOT kept OR n > 1").select(F.col("doc_id").alias(odd_id), F.col("key").alias(odd_key), "kept"), "odd")
    small = odd.count() * 3 <= SMALL  # a digest is some three times as wide as an id

    def those(which: str) -> DataFrame:
        some = odd.where(which).select(odd_id, odd_key)
        return F.broadcast(some) if small else some

    same = F.col("doc_id").cast("long").eqNullSafe(F.col(odd_id)) & (key == F.col(odd_key))
    if odd.where("kept").isEmpty():
        return docs.join(those("NOT kept"), same, "left_anti")
    once = docs.join(those("true"), same, "left_anti")
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    best = F.max_by(F.struct(*docs.columns), F.struct(F.char_length("text"), "text", others)).alias("best")
    again = docs.join(those("kept"), same, "left_semi").groupBy(F.col("doc_id").alias(odd_id), key.alias(odd_key)).agg(best)
    return once.unionByName(again.select("best.*"))
