"""Cutting the lineage of iterative plans; keeping tables of mesh size off the driver."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast.

    Spark estimates exploded rows by the size of the rows before them: a table of keys of a few MB,
    a generator's few chunk rows. A join that trusts that collects the whole mesh on the driver.
    """
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that driver and executors share, spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process (tests) a temporary folder takes its
    place. On a cluster it must be set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="meshloom-"))
    return df.checkpoint()
