"""Operator 3: best-fit packing of token pieces by a distributed grouping genetic algorithm.

Pieces are dealt by hash into blocks of bounded size. Every block is evolved on several
islands at once; a chromosome is a packing, its genes are whole bins. An island starts from
best fits of random orders. Crossover injects well-filled bins of one parent into the other,
drops the bins that hold an injected piece a second time, and best-fits the displaced pieces;
mutation opens some of the bins that aren't full. Between epochs the best packing of each island
moves to the next island. The better filled bins of a round are closed; the others are opened, and
their pieces dealt into fewer blocks with those of other blocks, round by round, until one block
holds them all; so the loss of a block's last bins doesn't grow with the number of blocks.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshloom.llm.common import Scratch, id_text, release_memory
from meshloom.llm.word_tokens import word_encoder

ITEM = np.dtype([("doc_id", "<i8"), ("null", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
OUT_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every text's ids and the end id, cut into pieces of at most ``capacity`` tokens.

    Columns: doc_id, piece (from 0), start, length, ids_crc32. A null text counts as empty and
    is one piece with the end id. Only texts longer than ``capacity`` are cut.
    """

    def run(batches):
        release_memory()
        enc = word_encoder(tokenizer)
        for b in batches:
            for first, ids, at in enc.blocks(b.column(1)):
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))  # with every text's end id
                n = np.diff(at)
                cuts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                a, data = (at[row] + start) * 4, memoryview(ids).cast("B")
                crc = [zlib.crc32(data[x:z]) for x, z in zip(a.tolist(), (a + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return id_text(docs).mapInArrow(run, PIECE_SCHEMA)


class Packing:
    """Bins over items 0..n-1 of given lengths."""

    __slots__ = ("cap", "size", "bins", "fill")

    def __init__(self, cap: int, size: list[int], bins: list[list[int]] | None = None):
        self.cap, self.size = cap, size
        self.bins = bins or []
        self.fill = [sum(map(size.__getitem__, b)) for b in self.bins]

    def best_fit(self, items) -> None:
        """Each item, in the given order, into the fullest bin that still takes it."""
        cap, size, bins, fill = self.cap, self.size, self.bins, self.fill
        room: list[list[int]] = [[] for _ in range(cap + 1)]  # bins by free space
        free = 0  # bit r is set when some bin has r free
        for b, f in enumerate(fill):
            room[cap - f].append(b)
            free |= 1 << (cap - f)
        for x in items:
            s = size[x]
            fits = free >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    free ^= 1 << r
            else:
                b, r = len(bins), cap
                bins.append([])
                fill.append(0)
            bins[b].append(x)
            fill[b] += s
            r -= s
            if not room[r]:
                free |= 1 << r
            room[r].append(b)

    def score(self) -> tuple[int, float]:
        """Fewer bins first; then bins as unequally full as can be (more is better)."""
        return -len(self.bins), sum(f * f for f in self.fill)

    def genes(self) -> np.ndarray:
        out = np.empty(len(self.size), "<i4")
        for k, b in enumerate(self.bins):
            out[b] = k
        return out

    @classmethod
    def of(cls, cap: int, size: list[int], genes: np.ndarray) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(genes.max(initial=-1)) + 1)]
        for x, b in enumerate(genes.tolist()):
            bins[b].append(x)
        return cls(cap, size, [b for b in bins if b])


def cross(rng: random.Random, mother: Packing, father: Packing, share: float, mutation: float = 0.25) -> Packing:
    """Inject a share of the father's well-filled bins into the mother."""
    order = sorted(range(len(father.bins)), key=lambda b: (-father.fill[b], b))
    full = order[: max(1, len(order) // 2)]
    chosen = rng.sample(full, max(1, int(len(full) * share)))
    injected = set().union(*(father.bins[b] for b in chosen))
    kept, displaced = [], []
    for f, b in zip(mother.fill, mother.bins, strict=True):
        if injected.isdisjoint(b):
            kept.append((f, b))
        else:
            displaced += [x for x in b if x not in injected]
    # Mutation: the emptiest bins, and some that aren't full, are opened too, so that their pieces can find closer fits.
    kept.sort(key=lambda x: x[0])
    emptiest = 1 + int(len(kept) * mutation * rng.random())
    child = Packing(mother.cap, mother.size)
    for k, (f, b) in enumerate(kept):
        if k < emptiest or f < mother.cap and rng.random() < mutation:
            displaced += b
        else:
            child.bins.append(list(b))
            child.fill.append(f)
    child.bins += [list(father.bins[b]) for b in chosen]
    child.fill += [father.fill[b] for b in chosen]
    child.best_fit(sorted(displaced, key=lambda x: (-child.size[x], x)))
    return child


def evolve(size: list[int], cap: int, population: list[np.ndarray], wanted: int, generations: int, seed: int) -> tuple[list[np.ndarray], int, int]:
    """One epoch on one island: the population, best first; the fewest bins before it; the crossovers made.

    An empty population is made of best fits of random orders. An island rests as soon as its best
    packing can't be better: all bins but one are full.
    """
    rng = random.Random(seed)
    folk = [Packing.of(cap, size, g) for g in population]
    while len(folk) < wanted:
        p, order = Packing(cap, size), list(range(len(size)))
        rng.shuffle(order)
        p.best_fit(order)
        folk.append(p)
    folk.sort(key=Packing.score, reverse=True)
    before, crossed = len(folk[0].bins), 0
    for _ in range(generations if len(folk) > 1 else 0):
        if sum(f < cap for f in folk[0].fill) <= 1:
            break
        better = max(2, len(folk) // 2)
        for k in range(better if len(folk) > 2 else 1, len(folk)):  # the better half has children in place of the worse
            folk[k] = cross(rng, *rng.sample(folk[:better], 2), rng.uniform(0.2, 0.6))
            crossed += 1
        folk.sort(key=Packing.score, reverse=True)
    return [p.genes() for p in folk], before, crossed


STATE = "block long, island int, n_bins int, first_bins int, crossed int, items binary, folk binary, best binary"
STATE_NAMES = [c.split(" ")[0] for c in STATE.split(", ")]


def _state(block: int, island: int, items: np.ndarray, evolved: tuple, first_bins: int | None = None, crossed: int = 0) -> dict:
    folk, before, now = evolved
    values = (block, island, int(folk[0].max(initial=-1)) + 1, before if first_bins is None else first_bins, crossed + now, items.tobytes(), np.stack(folk).tobytes(), folk[0].tobytes())
    return dict(zip(STATE_NAMES, values, strict=True))


def pack(pieces: DataFrame, capacity: int = 4096, block_items: int = 8192, islands: int = 2, population: int = 6, generations: int = 5, epochs: int = 3, seed: int = 7, poor: int = 64, report: list | None = None) -> DataFrame:
    """Pack pieces into sequences of at most ``capacity`` tokens.

    ``pieces`` is the table of ``token_pieces``, written (it is read more than once); every row
    comes back once, with sequence_id and offset (gapless from 0 in its sequence). After each
    round the bins with at most ``poor`` free tokens are closed, twice as many free tokens in every
    next round; the pieces of the others go on until one block holds them all, and with them
    those of full bins without a large piece, as many as the others have room for. An empty table gives no rows; null and repeated ids are rows like others. A block has
    ``block_items`` rows on average, however many rows are equal, since rows are dealt by their
    place in the table. ``report``, a list, gets for each round the blocks, the fewest bins the
    tokens need by block, the bins of the first populations' best, the bins in the end, and the
    crossovers made.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    left, done = pieces, None

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        items = np.empty(len(pdf), ITEM)
        items["null"] = pdf["doc_id"].isna()
        items["doc_id"] = pdf["doc_id"].fillna(0).astype("int64")
        for to, of in (("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
            items[to] = pdf[of]
        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        return pd.DataFrame([_state(block, island, items, evolve(items["length"].tolist(), capacity, [], population, generations, hash((seed, block, island, 0))))])

    def again(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                items = np.frombuffer(r.items, ITEM)
                folk = list(np.frombuffer(r.folk, "<i4").reshape(-1, len(items)))
                if r.guest is not None and len(folk) > 1:
                    folk[-1] = np.frombuffer(r.guest, "<i4")
                evolved = evolve(items["length"].tolist(), capacity, folk, len(folk), generations, hash((seed, r.block, r.island, r.epoch)))
                rows.append(_state(r.block, r.island, items, evolved, r.first_bins, r.crossed))
            yield pd.DataFrame(rows, columns=STATE_NAMES)

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                items = np.frombuffer(r.items, ITEM)
                bins = np.frombuffer(r.best, "<i4").astype("i8")
                order = np.lexsort((np.arange(len(items)), bins))
                items, bins = items[order], bins[order]
                length = items["length"].astype("i8")
                ends = np.cumsum(length)
                first = np.r_[True, bins[1:] != bins[:-1]] if len(bins) else np.zeros(0, bool)
                base = (ends - length)[first]
                k = np.cumsum(first) - 1
                heads = np.flatnonzero(first)
                fill, largest = np.add.reduceat(length, heads)[k], np.maximum.reduceat(length, heads)[k]
                yield pd.DataFrame({
                    "doc_id": pd.array(np.where(items["null"], 0, items["doc_id"]), dtype="Int64"), "piece": items["piece"], "start": items["start"], "length": length, "ids_crc32": items["crc"].astype("i8"),
                    "sequence_id": (np.int64(r.block) << 24) | bins, "offset": ends - length - base[k], "fill": fill, "largest": largest,
                }).assign(doc_id=lambda d, n=items["null"]: d["doc_id"].mask(n))

    n, rnd = left.count(), 0
    while n:
        blocks = -(-n // block_items)
        place = F.xxhash64(F.lit(seed + rnd), F.monotonically_increasing_id())  # of a written table's row: the same when read again
        dealt = left.withColumn("block", F.pmod(place, F.lit(blocks))).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        state = scratch.put(dealt.groupBy("block", "island").applyInPandas(begin, STATE), f"state{rnd}")
        for epoch in range(1, epochs):
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
            moved = state.join(elite, ["block", "island"], "left").withColumn("epoch", F.lit(epoch))
            newer = scratch.put(moved.mapInPandas(again, STATE), f"state{rnd}-{epoch}")
            scratch.drop(state)
            state = newer
        best = state.groupBy("block").agg(F.min_by(F.struct("items", "best"), F.struct("n_bins", "island")).alias("s")).select("block", "s.items", "s.best")
        placed = scratch.put(best.mapInPandas(unpack, OUT_SCHEMA + ", fill long, largest long"), f"placed{rnd}")
        if report is not None:
            least = placed.groupBy(F.shiftright("sequence_id", 24)).agg(F.ceil(F.sum("length") / capacity).alias("n")).agg(F.sum("n")).first()[0]
            per_block = state.groupBy("block").agg(F.min("first_bins").alias("f"), F.min("n_bins").alias("n"), F.sum("crossed").alias("c"))
            report.append((blocks, least, *per_block.agg(F.sum("f"), F.sum("n"), F.sum("c")).first()))
        scratch.drop(state)
        if blocks == 1:
            closed, left = placed, None
        else:
            # Bins of small pieces alone are opened as well, as far as the poor bins' free space can take them.
            is_poor = F.col("fill") < capacity - (poor << rnd)
            bins = placed.where("offset = 0").groupBy(is_poor.alias("poor"), "largest").agg(F.sum("fill"), F.sum(capacity - F.col("fill")))
            bins = sorted(map(tuple, bins.collect()))  # two rows for each length of a piece
            room, small = sum(r[3] for r in bins if r[0]), 0
            for _, largest, tokens, _ in (r for r in bins if not r[0]):
                if (room := room - tokens) < 0:
                    break
                small = largest
            opened = is_poor | (F.col("largest") <= small)
            closed, left = placed.where(~opened), placed.where(opened).select(*[c.split(" ")[0] for c in PIECE_SCHEMA.split(", ")])
        # A round owns a range of sequence ids: block and bin take the lower bits.
        closed = closed.drop("fill", "largest").withColumn("sequence_id", F.col("sequence_id") + F.lit(rnd << 56))
        done = closed if done is None else done.unionByName(closed)
        n, rnd = left.count() if left is not None else 0, rnd + 1
    return done if done is not None else spark.createDataFrame([], OUT_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, **how) -> DataFrame:
    """``token_pieces`` then ``pack``: one row for each piece. Other columns are not carried."""
    scratch = Scratch(docs.sparkSession, "pieces")
    return pack(scratch.put(token_pieces(docs, tokenizer, capacity), "pieces"), capacity, **how)
