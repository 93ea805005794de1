"""Operator 6: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; its embedding is the number of bits set in
each. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The embedding's axes are dealt into six groups (more where there are very many
fingerprints): at a distance of 3 at most three groups can differ, so two linked fingerprints
share a grid cell, the exact coordinates on some of the groups, all but three. Within cells the Manhattan bound is tested first, then the Hamming
distance itself. Documents with one fingerprint are one point, so copies never meet in pairs,
and a cell passes on a spanning forest of its links, never all of its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from meshloom.llm.common import Scratch, id_text, release_memos
from meshloom.llm.components import connected_components

BITS, SEGMENT = 64, 2
DISTANCE = 3
# Groups of axes up to so many points: a cell of six groups has some 2**24 values, one of eight 2**30, one of ten 2**33.
GROUPS = ((1 << 23, 6), (1 << 29, 8), (1 << 62, 10))
CELL = 2048  # points that are compared with each other in one piece
SEED = 42

EVEN = 0x5555555555555555


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 of every word shingle; zero without words."""
    return fingerprints([text], words)[0].item()


def fingerprints(texts: list[str], words: int = 3) -> np.ndarray:
    """Fingerprints of many texts. Bytes are lower-cased and split as ASCII: A-Z, and the six
    white space characters."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        w = text.encode().lower().split()
        if not w:
            continue
        if len(w) > words:
            w = list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
        else:
            w = [b" ".join(w)]
        total, n = np.zeros(BITS, np.int64), len(w)
        for at in range(0, n, 4096):
            h = np.array([xxh64_intdigest(x, SEED) for x in w[at : at + 4096]], "<u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprint_table(docs: DataFrame, words: int = 3, key: Column | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; also ``key``, a string, where given."""
    more = [] if key is None else ["key"]

    def run(batches):
        release_memos()
        for b in batches:
            fp = [fingerprints(b.column(1).slice(at, 1000).to_pylist(), words) for at in range(0, b.num_rows, 1000)]
            fp = pa.array(np.concatenate([np.empty(0, np.uint64), *fp]).view("<i8"))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, *b.columns[2:]], ["doc_id", "fp", *more])

    rows = id_text(docs) if key is None else id_text(docs).withColumn("key", key)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", key string" * len(more))


def _masks(groups: int) -> list[int]:
    """For each choice of all axis groups but three: the bits of the embedding that a cell fixes."""
    segments = np.array_split(np.arange(BITS // SEGMENT), groups)
    group = [sum(0b11 << (SEGMENT * int(s)) for s in g) for g in segments]
    out = [sum(group[g] for g in some) for some in combinations(range(groups), groups - DISTANCE)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def embedding(x: Column) -> Column:
    """Bits set in each two-bit segment, in unary (0, 01, 11), so that the Manhattan distance of
    two embeddings is the number of bits in which they differ."""
    half, even = F.shiftrightunsigned(x, 1), F.lit(EVEN)
    any_bit, both = x.bitwiseOR(half).bitwiseAND(even), x.bitwiseAND(half).bitwiseAND(even)
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def _embed(x: np.ndarray) -> np.ndarray:
    even = np.uint64(EVEN)
    half = x >> np.uint64(1)
    return ((x | half) & even) | (((x & half) & even) << np.uint64(1))


def _near(x: np.ndarray, y: np.ndarray, ex: np.ndarray, ey: np.ndarray) -> np.ndarray:
    """Where x and y are within the distance: the Manhattan bound first, then the bits."""
    maybe = np.bitwise_count(ex ^ ey) <= DISTANCE
    return maybe & (np.bitwise_count(x ^ y) <= DISTANCE)


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the points of one cell as all of their links within it would."""
    m, e = len(fp), _embed(fp)
    label = np.arange(m)
    for at in range(0, m - 1, 256):
        end = min(at + 256, m)
        i, j = np.nonzero(_near(fp[at:end, None], fp[None, at:], e[at:end, None], e[None, at:]))
        i, j = (i + at)[i < j], (j + at)[i < j]
        while len(i) and (label[i] != label[j]).any():
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    child = np.flatnonzero(label != np.arange(m))
    return fp[child], fp[label[child]]


def _verify(batches):
    """Sorted rows (cell columns..., fp) to links; a cell may span batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        cells = [t.column(k).to_numpy() for k in range(t.num_columns - 1)]
        n = t.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cells])
        starts = np.flatnonzero(new)
        cut = int(starts[-1])  # the last cell may go on in the next batch
        rest = t.slice(cut).combine_chunks()
        yield from _links(t.column(t.num_columns - 1).to_numpy()[:cut], starts[:-1], cut)
    if rest is not None and rest.num_rows > 1:
        yield from _links(rest.column(rest.num_columns - 1).to_numpy(), np.array([0]), rest.num_rows)


def _links(fp: np.ndarray, starts: np.ndarray, n: int):
    if not len(starts):
        return
    fp = fp.view("<u8")
    sizes = np.diff(np.r_[starts, n])
    a, b = [], []
    small = sizes <= 16
    for d in range(1, 16):  # all cells of up to 16 points at once, by distance in the row order
        some = starts[small & (sizes > d)]
        if not len(some):
            break
        lens = sizes[small & (sizes > d)] - d
        i = np.repeat(some - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
        x, y = fp[i], fp[i + d]
        hit = _near(x, y, _embed(x), _embed(y))
        a.append(x[hit])
        b.append(y[hit])
    for s, m in zip(starts[~small], sizes[~small], strict=True):
        x, y = _forest(fp[s : s + m])
        a.append(x)
        b.append(y)
    x, y = (np.concatenate(p) for p in (a, b)) if a else (fp[:0], fp[:0])
    if len(x):
        yield pa.RecordBatch.from_arrays([pa.array(x.view("<i8")), pa.array(y.view("<i8"))], ["a", "b"])


def links(points: DataFrame, scratch: Scratch, groups: int | None = None) -> DataFrame:
    """Links a, b that connect the distinct fingerprints of ``points`` (fp) within the distance.

    Each point goes to 20 cells (56 or 120 with more groups). A cell of more than CELL points is split into blocks, and every
    two blocks are compared in a group of their own, so no task holds more than a few blocks.
    """
    n_points = points.count()
    groups = groups or next(g for most, g in GROUPS if n_points <= most)
    fixed = _masks(groups)
    masks = F.array(*[F.struct(F.lit(k).cast("int").alias("grid"), F.lit(m).cast("long").alias("mask")) for k, m in enumerate(fixed)])
    cells = points.select("fp", F.explode(masks).alias("g")).select(F.col("g.grid").alias("grid"), embedding(F.col("fp")).bitwiseAND(F.col("g.mask")).alias("cell"), "fp")
    # 24 bytes a row, 32 MB a partition
    n = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, n_points * len(fixed) * 24 // (32 << 20) + 1))
    hot = scratch.put(cells.groupBy("grid", "cell").count().where(F.col("count") > CELL), "hot")
    if hot.isEmpty():
        dealt = cells.repartition(n, "grid", "cell").sortWithinPartitions("grid", "cell")
        return dealt.mapInArrow(_verify, "a long, b long")
    all_cells = cells.join(hot, ["grid", "cell"], "left")
    blocks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(CELL / 2)).cast("int")
    split = all_cells.withColumn("blocks", F.when(F.col("count").isNull(), 1).otherwise(blocks)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    by = ["grid", "cell", "i", "j"]
    return pairs.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_verify, "a long, b long")


def _by_fingerprint(prints: DataFrame, points: DataFrame, values: DataFrame, how: str = "inner") -> DataFrame:
    """``prints`` joined with ``values``, at most a row for each fp. ``points`` has every fp's number of rows, n.

    Fingerprints of more than 100 rows and a hundred-thousandth of all rows, at most a hundred thousand of them,
    are joined by broadcast, so that no task gets all rows of one; the others by shuffle.
    """
    total = points.agg(F.sum("n")).first()[0] or 0
    hot = points.where(F.col("n") > max(100, total // 100_000)).select("fp")
    if hot.isEmpty():
        return prints.join(values, "fp", how)
    few = F.broadcast(hot)
    own = few.join(values, "fp", how)
    rest = prints.join(few, "fp", "left_anti").join(values, "fp", how)
    return prints.join(F.broadcast(own), "fp").unionByName(rest)


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    One row per input row. Texts without words, null and empty ones included, have fingerprint
    zero and are linked like any other. Rows without a doc_id get their component's smallest id,
    null if no row of it has one. Other columns are not carried; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprint_table(docs, words), "prints")
    points = scratch.put(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points")
    roots = scratch.put(connected_components(scratch.put(links(points, scratch), "near")), "roots")
    # Most points have no link and are their own component: only linked points are aggregated.
    linked = roots.join(points, roots.node == points.fp).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    point_component = points.join(linked.join(least, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    point_component = scratch.put(point_component, "component")
    return _by_fingerprint(prints, points, point_component).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def simhash_keepers(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, key (``text_digest``), kept: the decision on every row.

    Of every component the row with the smallest id stays (null ids last); where that id has
    several texts in the component, the one with the least fingerprint, then digest. Rows with the
    same id and text share their decision.
    """
    scratch = Scratch(docs.sparkSession, "simhash_keep")
    prints = scratch.put(fingerprint_table(docs, words, text_digest(F.col("text"))), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "fp", "key")
    points = scratch.put(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "points")
    roots = scratch.put(connected_components(scratch.put(links(points.select("fp"), scratch), "near")), "roots")
    linked = roots.join(points, roots.node == points.fp).select("fp", "root", "first")
    winners = linked.groupBy("root").agg(F.min("first").alias("first"))
    lost = linked.select("fp", "root").join(winners, "root").where("fp <> first.fp").select("fp")
    lead = scratch.put(points.join(lost, "fp", "left_anti").select("fp", "first"), "lead")
    kept = F.col("first").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    return _by_fingerprint(prints, points, lead, "left").select("doc_id", "key", F.coalesce(kept, F.lit(False)).alias("kept"))
