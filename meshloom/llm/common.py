"""Helpers the training-data operators share: scratch tables, sizes, worker caches."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# The six ASCII characters that separate words in every operator here.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs in one process (tests) a temporary folder is chosen and
    recorded in the session, so that one session keeps one folder. On a cluster it must be set.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meshloom-")
        spark.conf.set(key, found)
    return found.rstrip("/")


class Scratch:
    """Written tables that cut lineage: a lost executor costs one stage, not the whole plan.

    ``put`` writes a DataFrame as Parquet below the shared folder and returns it reread;
    ``drop`` deletes a table that no later plan reads. What is left is deleted when the driver's
    JVM ends, since only DataFrames of its session read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def path(self, name: str) -> str:
        if not self._n:
            fs, root = self._at(self.root)
            fs.mkdirs(root)
            fs.deleteOnExit(root)
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        self._write(df.write.option("compression", "zstd"), lambda w: w.parquet(path))
        return self._hold(self.spark.read.schema(df.schema).parquet(path), path)

    def put_buckets(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """As ``put``, in ``n`` buckets by ``key``: later joins by it shuffle the other side alone."""
        path, table = self.path(name), f"meshloom_{uuid.uuid4().hex}"
        self._write(df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd"), lambda w: w.saveAsTable(table))
        return self._hold(self.spark.table(table), path)

    def _write(self, writer, how) -> None:
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, "false")
        self.spark.conf.set(cleanup, "true")  # the written table stands for the plan: its shuffle files can go
        try:
            how(writer)
        finally:
            self.spark.conf.set(cleanup, before)

    def _hold(self, df: DataFrame, path: str) -> DataFrame:
        self._paths[id(df)] = path
        self.sweep()
        return df

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self._paths.pop(id(df), None):
                self.delete(path)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def sweep(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that have ended."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, without running it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def n_partitions(df: DataFrame, target: int = 32 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, more if the input is larger.

    A plan that doesn't read files has no size; Catalyst then assumes exabytes, which counts as
    unknown here and leaves the session's number.
    """
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return conf if size > 1 << 50 else max(conf, min(1_000_000, size // target + 1))


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text counts as empty. Other columns don't travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


class Cache(dict):
    """A bounded memo: ``fn`` of each key, emptied when ``cap`` keys are held.

    Values depend on the key only, so emptying it changes speed and never results.
    """

    def __init__(self, fn, cap: int, longest: int = 64):
        super().__init__()
        self.fn, self.cap, self.longest = fn, cap, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.cap:
                self.clear()
            self[key] = value
        return value


def release_memos() -> None:
    """Drop what a reused worker keeps of other operators: their tokenizers, built again when needed, and
    memory that its allocators have freed and not given back."""
    for module, name in (("meshloom.llm.word_tokens", "word_encoder"), ("meshloom.llm.byte_bpe", "byte_bpe")):
        if module in sys.modules:
            getattr(sys.modules[module], name).cache_clear()
    release_memory()


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def each_text(texts: pa.Array, rows: int = 1000):
    """The texts of a column, a few of them as Python strings at a time."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()
