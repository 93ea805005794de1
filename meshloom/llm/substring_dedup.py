"""Operator 8: repeated passages by level-wise doubling of windows.

A passage of 20 words that occurs twice has every shorter window of it twice. So windows of the
shortest length are counted first, over all documents; only where one is repeated is it
extended to twice its length and counted again, up to the full length. At the shortest length
one window stands for each full one: the one with the least hash in it, which two copies of a
passage share. That keeps an eighth of the positions and loses no repetition.

Windows of the lower levels are identified by 63 bits of hash, which can only let more windows
through; full ones by 63 bits and 32 of a second, independent hash. Both mix every word's bytes,
eight at a time, in a chain; those of longer windows are made from those of their halves.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from meshloom.llm.common import Scratch, id_text, n_partitions, release_memos

LAST = (1 << 63) - 1  # stands for a null doc_id: after all others
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window from those of its halves."""
    return _mix(a * ODD + (b ^ (b >> np.uint64(29))))


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least (the first of equals)."""
    best, at, span = x.copy(), np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        n = len(best) - step
        later = best[step:] < best[:n]
        at = np.where(later, at[step:], at[:n])
        best = np.where(later, best[step:], best[:n])
        span += step
    return at


LANES = 32  # words of more than so many times eight bytes are hashed one by one
FIRST, SECOND = 0x243F6A8885A308D3, 0x13198A2E03707344  # seeds
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the lowest k bytes


def _hash_words(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word: its bytes, eight at a time, go through a chain of mixes. ``data`` has eight
    bytes more than the words."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from every place on
    h = _mix(lens.astype(np.uint64) + np.uint64(seed))
    some = np.arange(len(lens))
    for lane in range(LANES):
        at, left = starts[some] + 8 * lane, lens[some] - 8 * lane
        h[some] = _mix(h[some] ^ (eight[at] & KEEP[np.minimum(left, 8)]))
        some = some[left > 8]
        if not len(some):
            break
    for k in some.tolist():
        h[k] = xxh3_64_intdigest(data[starts[k] : starts[k] + lens[k]].tobytes(), seed)
    return h


class Words:
    """The words of many texts, side by side, and hashes of each."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts)
        values = split.flatten()
        ends = values.offsets.to_numpy() if hasattr(values, "offsets") else np.frombuffer(values.buffers()[1], "<i4")[values.offset : values.offset + len(values) + 1]
        self.starts, self.lens = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        real = self.lens > 0  # white space at either end of a text leaves empty ones
        if not real.all():
            self.starts, self.lens, text = self.starts[real], self.lens[real], text[real]
        raw = values.buffers()[2]
        self.data = np.zeros((raw.size if raw else 0) + 8, np.uint8)
        if raw:
            self.data[:-8] = np.frombuffer(raw, np.uint8)
        self.text = text
        self.first = np.searchsorted(text, np.arange(len(texts)))  # a text's first word

    def hash(self, seed: int = FIRST) -> np.ndarray:
        return _hash_words(self.data, self.starts, self.lens, seed)


class Windows:
    """The windows of many texts at every level; places are those of ``Words``."""

    def __init__(self, words: Words, base: int, full: int):
        self.base, self.full = base, full
        n = max(0, len(words.text) - full + 1)
        self.live = np.flatnonzero(words.text[:n] == words.text[full - 1 :]) if n else np.empty(0, np.int64)  # windows within one text
        if not n:
            return
        self.words = words
        self.hash = dict(self._levels(words.hash()))
        # where[L][p]: the window of length L that stands for the full window at p
        place = np.arange(n)
        self.where = {base: _sliding_argmin(self.hash[base], full - base + 1)}
        size = base
        while size * 2 < full:
            s = self.where[size]
            self.where[size * 2] = np.where(s + 2 * size <= place + full, s, s - size)
            size *= 2

    def _levels(self, of: np.ndarray):
        """(size, hashes of all windows of that many words)."""
        h = np.zeros(len(of) - self.base + 1, np.uint64)
        for k in range(self.base):
            h = h * ODD + of[k : k + len(h)]
        h, size = _mix(h), self.base
        yield size, h
        while size * 2 <= self.full:
            h = _joined(h[:-size], h[size:])
            size *= 2
            yield size, h

    def second(self, places: np.ndarray) -> np.ndarray:
        """32 bits of the second hash of full windows."""
        *_, (_, h) = self._levels(self.words.hash(SECOND))
        return h[places] >> np.uint64(32)

    def candidates(self, size: int, survivors: np.ndarray | None) -> np.ndarray:
        """Places of windows of ``size`` words whose half (or nothing, at the base) is repeated;
        for the full size, of full windows."""
        live = self.live
        if not len(live):
            return live
        if survivors is not None:
            held = np.zeros(len(self.hash[self.base]), bool)
            held[survivors] = True
            live = live[held[self.where[size // 2][live]]]
        if size == self.full:
            return live
        chosen = np.zeros(len(self.hash[self.base]), bool)
        chosen[self.where[size][live]] = True
        return np.flatnonzero(chosen)


BLOCK = 4 << 20  # bytes of text that a worker takes at a time; a longer text is a block alone


# A row is four longs, since all candidate windows cross the network. ``route`` is a window's hash
# with an even last bit, or an odd number where the row is decided already; ``rid`` is the text's row;
# ``tag`` packs the second hash of full windows (32 bits), the state (2 bits) and the place in words
# (30 bits).
ROWS = "route long, doc long, rid long, tag long"
FOUND = "rid long, at array<int>"
SINGLE, KNOWN, SEVERAL = 0, 1, 2
PLACES = 30


def _keyed(docs: DataFrame) -> DataFrame:
    """rid, doc, doc_id, text: a number for each row, and its place in the order of documents."""
    return id_text(docs).select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "doc_id", "text")


def _places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of each text, one text after another, and where in them each text's begin; from
    lists of lists of places. A text without a list has none."""
    inner = lists.flatten()
    at = inner.flatten().to_numpy()
    in_list = np.r_[0, np.cumsum(pc.list_value_length(inner).to_numpy())]
    n = pc.list_value_length(lists).fill_null(0).to_numpy()
    return at, in_list[np.r_[0, np.cumsum(n)]]


def _gather(size: int, base: int, full: int):
    """Documents (with what survived of them) to rows of candidate windows of ``size`` words.

    Each block is aggregated first. Of equal windows in it one goes on under its hash; what the
    block itself decides (a window is repeated; a full window has an earlier copy) is routed by
    document instead, so a passage in a third of all documents costs its hash's task one row
    for each block.
    """

    def blocks(batches):
        for b in batches:
            cols = {f.name: b.column(k) for k, f in enumerate(b.schema)}
            doc_of, rid_of, texts = cols["doc"].to_numpy(), cols["rid"].to_numpy(), cols["text"]
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            at = 0
            while at < len(texts):
                done = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
                yield texts.slice(at, end - at), _places(cols["at"].slice(at, end - at)) if "at" in cols else None, doc_of[at:end], rid_of[at:end]
                at = end

    def run(batches):
        release_memos()
        for texts, old, doc_of, rid_of in blocks(batches):
            words = Words(texts)
            survivors = None
            if old is not None:
                survivors = old[0] + np.repeat(words.first, np.diff(old[1]))
            w = Windows(words, base, full)
            c = w.candidates(size, survivors)
            if not len(c):
                continue
            key, doc = w.hash[size][c] & ~np.uint64(1), words.text[c]
            second = w.second(c) if size == full else np.zeros(len(c), np.uint64)
            at = c - words.first[doc]
            d, t = doc_of[doc], rid_of[doc]
            del w, words
            order = np.lexsort((at, t, d, second, key))
            key, second, at, d, t = key[order], second[order], at[order], d[order], t[order]
            first = np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]
            state = np.full(len(key), KNOWN, np.int8)
            if size < full:
                starts = np.flatnonzero(first)
                state[starts] = np.where(np.diff(np.r_[starts, len(key)]) > 1, SEVERAL, SINGLE)
            else:
                lead = d[np.flatnonzero(first)][np.cumsum(first) - 1]
                new_row = first | np.r_[True, t[1:] != t[:-1]]
                state[(d == lead) & new_row] = SINGLE
            mixed = (t.view(np.uint64) * ODD) ^ at.astype(np.uint64)
            one = np.uint64(1)
            route = np.where(state == KNOWN, _mix(mixed) | one, key).view(np.int64)
            tag = (second.astype(np.uint64) << np.uint64(32)).view(np.int64) | (state.astype(np.int64) << PLACES) | at
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route, d, t, tag)], ["route", "doc", "rid", "tag"])

    return run


def _by_document(t: np.ndarray, at: np.ndarray):
    if not len(t):
        return
    order = np.lexsort((at, t))
    t, at = t[order], at[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    offsets = pa.array(np.r_[first, len(t)].astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.ListArray.from_arrays(offsets, pa.array(at))], ["rid", "at"])


def _decide(full: bool):
    """Rows sorted by (route, second hash, doc) to the places that survive (or, of full windows, have
    an earlier copy), by document. A run of one window may span batches: only its hashes, its first
    document and at most one row wait for the next batch."""

    def run(batches):
        last = None  # (route, second hash, first doc) of the run that the previous batch ended in
        held = None  # its last row, where whether it survives is still open
        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
                held = None
            n = t.num_rows
            if not n:
                continue
            t = t.combine_chunks()
            route, d, rid, tag = (t.column(k).to_numpy() for k in range(4))
            state, second, at = (tag >> PLACES) & 3, tag >> 32, (tag & ((1 << PLACES) - 1)).astype(np.int32)
            known = state == KNOWN
            same = np.zeros(n, bool)
            same[1:] = (route[1:] == route[:-1]) & (second[1:] == second[:-1])
            same[0] = last is not None and last[:2] == (int(route[0]), int(second[0]))
            if full:
                start = np.flatnonzero(~same)
                run_of = np.cumsum(~same)  # 0: the run that goes on from the previous batch
                firsts = np.r_[last[2] if same[0] else 0, d[start]]
                hit = known | (d > firsts[run_of])
                last = (int(route[-1]), int(second[-1]), int(firsts[run_of[-1]]))
            else:
                follows = np.r_[same[1:], False]
                hit = known | (state == SEVERAL) | same | follows
                if not hit[-1]:
                    held = t.slice(n - 1)
                    # the held row is seen again at the head of the next batch, after what precedes it here
                    last = (int(route[-2]), int(second[-2]), 0) if n > 1 else last
                else:
                    last = (int(route[-1]), int(second[-1]), 0)
            yield from _by_document(rid[hit], at[hit])

    return run


def _levels(base: int, full: int) -> list[int]:
    out = [base]
    while out[-1] < full:
        out.append(out[-1] * 2)
    if out[-1] != full:
        raise ValueError(f"{full} is not {base} doubled")
    return out


def repeated_windows(rows: DataFrame, scratch: Scratch, n: int, full: int = 20, base: int = 5) -> DataFrame:
    """rid, at: the places of full windows that an earlier document, or an earlier place of the same
    one, has as well; a few rows for each document. ``rows`` is ``_keyed``, in buckets by rid."""
    found = None
    for size in _levels(base, full):
        source = rows.select("rid", "doc", "text")
        if found is not None:
            source = source.join(found.groupBy("rid").agg(F.collect_list("at").alias("at")), "rid")
        dealt = source.mapInArrow(_gather(size, base, full), ROWS).repartition(n, "route").sortWithinPartitions("route", F.shiftright("tag", 32), "doc")
        newer = scratch.put(dealt.mapInArrow(_decide(size == full), FOUND), f"level{size}")
        if found is not None:
            scratch.drop(found)
        found = newer
    return found


def substring_dedup(docs: DataFrame, full: int = 20, base: int = 5, texts: bool = False) -> DataFrame:
    """Every document without the words of windows that start earlier elsewhere.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), with
    ``texts`` also kept_text. ``full`` must be ``base`` doubled some times. Windows are judged on
    the input. Earlier is a smaller doc_id, or an earlier place in the same document; null ids
    come last, and of rows that share an id (or have none) none is earlier than another. Null and
    empty texts have no words; an empty table gives no rows; other columns are not carried.
    """
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    n = min(n_partitions(docs, 16 << 20), 100_000)
    keyed = scratch.put_buckets(_keyed(docs), "texts", "rid", n)  # the one shuffle of whole texts
    found = repeated_windows(keyed, scratch, n, full, base)
    per_doc = found.groupBy("rid").agg(F.collect_list("at").alias("at"))
    rows = keyed.join(per_doc, "rid", "left").select("doc_id", "text", "at")

    def cut(batches):
        for b in batches:
            n, gone, sha, kept_texts = [], [], [], []
            places, of = _places(b.column(2))
            for text, a, z in zip(b.column(1).to_pylist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
                words = text.encode().split()
                kept = words
                if a < z:
                    mark = np.zeros(len(words) + 1, np.int8)
                    mark[places[a:z]] = 1
                    c = np.cumsum(mark, dtype=np.int64)[: len(words)]
                    before = np.r_[np.zeros(min(full, len(c)), np.int64), c[:-full]]
                    kept = list(compress(words, (c == before).tolist()))
                n.append(len(words))
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sha.append(sha256(joined).hexdigest())
                if texts:
                    kept_texts.append(joined.decode())
            more = [pa.array(kept_texts, pa.string())] if texts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *more], ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
