"""Operator 5: exact duplicates by sorting content.

1. Every Arrow batch is normalised and its equal texts are folded into one leader with the list
   of its members, so a text that a third of all rows hold costs one row for each batch.
2. A bounded sample of keys gives splitters, and leaders go to the bucket between two splitters.
   A key is the first HEAD bytes of the normalised text; of texts that agree in these, a digest
   keeps equal ones together. A key that spans several splitters is hot: its leaders are dealt
   over all of its buckets.
3. Each bucket is sorted by the whole normalised bytes (Spark's external sort, which spills), and
   neighbours are compared in full while the rows stream by. A run of equal neighbours gives one
   row: the row that stays, how many rows there are, and which.
4. The runs of hot keys, of which each bucket may hold one, are sorted by their bytes and compared
   as neighbours once more.

Whether texts are equal is decided by these comparisons alone; digests only choose buckets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from meshloom.llm.common import SPACE, SPACE_BYTES, Scratch, each_text, id_text, n_partitions, release_memory, release_memos

LEADER = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("norm", pa.binary()), ("n_chars", pa.int64()), ("lead", pa.int64()), ("members", pa.list_(pa.int64()))])
LEADER_SQL = "bucket int, hot boolean, norm binary, n_chars long, lead long, members array<long>"
RUN = pa.schema([("run", pa.int64()), ("hot", pa.binary()), ("sha", pa.string()), ("n_chars", pa.int64()), ("lead", pa.int64()), ("size", pa.int64()), ("members", pa.list_(pa.int64()))])
RUN_SQL = "run long, hot binary, sha string, n_chars long, lead long, size long, members array<long>"
HEAD = 256  # bytes of content in a splitter key
MOST_KEYS, MOST_BUCKETS = 1_000_000, 100_000  # what comes to the driver: at most so many keys, of 264 bytes


def normalise(text: str) -> bytes:
    return text.encode().translate(None, SPACE_BYTES)


def content_digest(text: Column) -> Column:
    """``text_sha256`` of a text."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE, ""), 256)


def _key(norm: bytes) -> bytes:
    return norm[:HEAD].ljust(HEAD, b"\0") + sha256(norm).digest()[:8]


def splitters(rows: DataFrame, buckets: int, per_bucket: int = 24) -> list[bytes]:
    """``buckets - 1`` keys at even ranks of a sample of ``per_bucket`` keys for each bucket (fewer where
    that is over MOST_KEYS)."""
    if buckets < 2:
        return []
    n = rows.count()
    wanted = min(buckets * per_bucket, MOST_KEYS)
    some = rows if n <= wanted else rows.sample(fraction=min(1.0, 1.2 * wanted / n), seed=17)

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(normalise(t)) for t in each_text(b.column(0))], pa.binary())], ["key"])

    found = sorted(bytes(r[0]) for r in some.select("text").mapInArrow(keys, "key binary").limit(2 * wanted).collect())
    return [found[k * len(found) // buckets] for k in range(1, buckets)] if found else []


def _before(a: tuple, b: tuple) -> bool:
    """Whether row a = (n_chars, id) is kept rather than b: longer first, then the smaller id; null ids last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _runs(batches):
    """Rows (norm, n_chars, lead, members, perhaps size and hot) sorted by content, the row that stays first, to
    runs of equal neighbours: (norm, n_chars, lead, size, [members of each row])."""
    norm = None
    for b in batches:
        cols = {f.name: b.column(k).to_pylist() for k, f in enumerate(b.schema)}
        sizes = cols.get("size") or map(len, cols["members"])
        hots = cols["hot"] if "hot" in cols else [None] * b.num_rows
        for text, n_chars, lead, size, members, hot in zip(cols["norm"], cols["n_chars"], cols["lead"], sizes, cols["members"], hots, strict=True):
            if text != norm:
                if norm is not None:
                    yield norm, best, total, parts, is_hot
                norm, best, total, parts, is_hot = text, (n_chars, lead), 0, [], False
            total += size
            parts.append(members)
            is_hot = is_hot or hot
    if norm is not None:
        yield norm, best, total, parts, is_hot


def content_runs(docs: DataFrame) -> DataFrame:
    """A row for each run of equal texts in a sorted bucket: its number, the row that stays, the members.

    ``hot`` is the text itself where other buckets may hold it too, else null.
    """
    rows = id_text(docs)
    buckets = min(n_partitions(rows), MOST_BUCKETS)
    cuts = splitters(rows, buckets)

    def fold(batches):
        release_memos()
        task = TaskContext.get().partitionId()
        for b in batches:
            groups: dict[bytes, list] = {}
            for doc, text in zip(b.column(0).to_pylist(), each_text(b.column(1)), strict=True):
                norm, me = normalise(text), (len(text), doc)
                if (g := groups.get(norm)) is None:
                    groups[norm] = [me, [doc]]
                else:
                    g[1].append(doc)
                    if _before(me, g[0]):
                        g[0] = me
            out: list[list] = [[] for _ in LEADER]
            for norm, (best, members) in groups.items():
                key = _key(norm)
                lo, hi = bisect_left(cuts, key), bisect_right(cuts, key)
                hot = hi - lo > 1  # the key is itself several splitters
                at = lo + 1 + hash((task if best[1] is None else best[1], 1)) % (hi - lo) if hot else hi
                for to, x in zip(out, (at, hot, norm, *best, members), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, LEADER, strict=True)], schema=LEADER)
            del groups, out
            release_memory()

    def neighbours(batches):
        out, held, k = [], 0, 0
        bucket = TaskContext.get().partitionId() << 40

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(RUN)], schema=RUN)

        for norm, best, total, parts, hot in _runs(batches):
            out.append((bucket + k, norm if hot else None, sha256(norm).hexdigest(), *best, total, list(chain.from_iterable(parts))))
            k, held = k + 1, held + total
            if held >= 10_000:
                yield flush()
                out, held = [], 0
                release_memory()
        if out:
            yield flush()

    dealt = rows.mapInArrow(fold, LEADER_SQL).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("norm", F.desc("n_chars"), F.asc_nulls_last("lead"))
    return dealt.mapInArrow(neighbours, RUN_SQL)


def settled(hot: DataFrame) -> DataFrame:
    """run, n_chars, lead, size: of runs that different buckets hold, what holds for the whole text.

    At most one row for each bucket and hot text comes here. They are dealt by digest, sorted by
    the texts, and compared as neighbours.
    """

    def join(batches):
        for _, best, total, runs, _ in _runs(batches):
            n, numbers = sum(map(len, runs)), pa.array(list(chain.from_iterable(runs)), pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, *(pa.array([x] * n, pa.int64()) for x in (*best, total))], ["run", "n_chars", "lead", "size"])

    rows = hot.select("sha", F.col("hot").alias("norm"), "n_chars", "lead", "size", F.array("run").alias("members"))
    dealt = rows.repartition(F.col("sha")).sortWithinPartitions("norm", F.desc("n_chars"), F.asc_nulls_last("lead"))
    return dealt.select("norm", "n_chars", "lead", "size", "members").mapInArrow(join, "run long, n_chars long, lead long, size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The decision on every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the ASCII white space. Of equal texts the
    one with the most code points stays, then the smallest id (null ids last). Null, empty and
    all-white texts are one group. An id names one document: where the id that stays repeats with
    the same content, all its rows are kept. Other columns are not carried; an empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    runs = scratch.put(content_runs(docs), "runs")
    out = ("lead", "size", "sha", "members")
    own = runs.where("hot IS NULL").select(*out)
    hot = runs.where("hot IS NOT NULL")
    spread = hot.select("run", "sha", "members").join(settled(hot).select("run", "lead", "size"), "run").select(*out)
    rows = own.unionByName(spread).select(F.explode("members").alias("doc_id"), F.col("lead").alias("keep_id"), F.col("size").alias("group_size"), F.col("sha").alias("text_sha256"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
