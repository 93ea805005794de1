"""Byte-level BPE from a tokenizer JSON file: vocabulary, merges, pre-tokenisation.

Two ways to encode a piece of text share these tables:

* ``encode_piece`` keeps a priority queue of merge ranks over a doubly linked symbol list and
  skips queue entries that no longer describe two adjacent live symbols;
* ``prefix_tokens`` fills a table over all prefixes of the piece: the last token of each
  prefix's encoding and how many tokens that encoding has.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex

from meshloom.llm.common import Cache

# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = regex.compile(r"\s{2,}")
SHIFT = 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str, cache: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        to_byte = byte_symbols()
        raw = {text: bytes(map(to_byte.__getitem__, text)) for text in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.vocab = {raw[t]: i for t, i in ids.items()}
        self.bytes_of = {i: raw[t] for t, i in ids.items()}
        self.byte_id = [self.vocab[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        self.parts: dict[int, tuple[int, int]] = {}
        self.formed: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (pair if isinstance(pair, list) else pair.split(" "))
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank[x << SHIFT | y] = r
            self.result.append(z)
            self.parts.setdefault(z, (x, y))
            self.formed.setdefault(z, r)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pattern = regex.compile(PIECES)
        self.longest = max(map(len, self.vocab))
        self.starts = {t[:k] for t in self.vocab for k in range(1, len(t))}
        self.ids = Cache(lambda piece: tuple(self.encode_piece(piece.encode())), cache)
        self.steps = Cache(self._steps, cache)
        self.runs = Cache(self._run, 10_000)
        self._spines: dict[tuple[int, bool], tuple] = {}
        self._fit: dict[int, bool] = {}

    # -- text to pieces

    def segments(self, text: str):
        """Alternating ordinary text and special token ids, as the file's library splits them."""
        if self._special is None or not any(s in text for s in self.specials):
            yield text, None
            return
        at = 0
        for m in self._special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.specials[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    # -- priority queue over a linked list

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        sym = [self.byte_id[b] for b in piece]
        if n < 2:
            return sym
        rank, result = self.rank.get, self.result
        bits = n.bit_length()
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << bits | i for i in range(n - 1) if (r := rank(sym[i] << SHIFT | sym[i + 1])) is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, r = top & mask, top >> bits
            j = after[i]
            if j >= n or sym[i] < 0 or rank(sym[i] << SHIFT | sym[j]) != r:
                continue  # stale: one of the two symbols has been merged since
            new = sym[i] = result[r]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(new << SHIFT | sym[k])) is not None:
                    heappush(queue, q << bits | i)
            h = before[i]
            if h >= 0 and (q := rank(sym[h] << SHIFT | new)) is not None:
                heappush(queue, q << bits | h)
        return [s for s in sym if s >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            if special is not None:
                out.append(special)
            else:
                for ids in map(self.ids.__getitem__, self.pattern.findall(part)):
                    out += ids
        return out

    def decode(self, ids) -> str:
        """Concatenated vocabulary bytes; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    # -- table over all prefixes

    def _edge(self, token: int, right: bool) -> tuple:
        """(token, rank at which it is consumed) along one edge of a token's merge tree, innermost first."""
        if (found := self._spines.get((token, right))) is None:
            out, end, t = [], len(self.result), token
            while True:
                out.append((t, end))
                if t not in self.parts:
                    break
                end = self.formed[t]
                t = self.parts[t][right]
            found = self._spines[token, right] = tuple(reversed(out))
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of ``left + right`` is just these two tokens.

        Walk the boundary outwards in order of merge rank: the pair at the boundary must never
        be mergeable before one of its two symbols is consumed inside its own token. Equal
        ranks go to the leftmost pair.
        """
        key = left << SHIFT | right
        if (known := self._fit.get(key)) is not None:
            return known
        a, b = self._edge(left, True), self._edge(right, False)
        i = j = 0
        good = True
        rank = self.rank.get
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            r = rank(x << SHIFT | y)
            if r is not None and r < x_end and r <= y_end:
                good = False
                break
            if i == len(a) - 1 and j == len(b) - 1:
                break
            if j == len(b) - 1 or i < len(a) - 1 and x_end <= y_end:
                i += 1
            else:
                j += 1
        if len(self._fit) >= 2_000_000:
            self._fit.clear()
        self._fit[key] = good
        return good

    def prefix_tokens(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For every k: the last token of the encoding of ``piece[:k]``, and its token count.

        An encoding's prefixes (in tokens) are encodings, and neighbours that fit make a whole
        that fits, so exactly one token can end each prefix: ``last[j] = t`` where ``t`` spans
        i..j and fits ``last[i]``.
        """
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        vocab, starts, fits, longest = self.vocab.get, self.starts, self.fits, self.longest
        for i in range(n):
            before, k = last[i], count[i] + 1
            for j in range(i + 1, min(n, i + longest) + 1):
                t = piece[i:j]
                token = vocab(t)
                if token is not None and last[j] < 0 and (i == 0 or fits(before, token)):
                    last[j] = token
                    count[j] = k
                if t not in starts:
                    break
        return last, count

    def _steps(self, piece: str) -> bytes:
        """By how much each code point of a piece changes the token count, as signed bytes; empty where one byte can't hold it."""
        table, at, counts = self.prefix_tokens(piece.encode())[1], 0, [0]
        for ch in piece:
            at += len(ch.encode())
            counts.append(table[at])
        if piece in ("'re", "'ve", "'ll"):  # a prefix that ends inside holds the apostrophe and the letter apart
            counts[2] = 2
        steps = [y - x for x, y in zip(counts, counts[1:], strict=False)]
        return array("b", steps).tobytes() if all(-128 <= x < 128 for x in steps) else b""

    def prefix_steps(self, text: str) -> bytes:
        """The table over all prefixes, as the change of the exact token count from each prefix to the next:
        a signed byte for each code point, or four bytes for each where a byte can't hold them all."""
        special = self._special is not None and any(s in text for s in self.specials)
        out = b"" if special else b"".join(map(self.steps.__getitem__, self.pattern.findall(text)))
        if len(out) != len(text):
            return _packed(np.array(self.prefix_counts(text)))
        if RUN.search(text) is None:
            return out
        # A prefix that ends in a run of white space holds it as one piece, up to there.
        counts = np.zeros(len(text) + 1, np.int64)
        np.cumsum(np.frombuffer(out, np.int8), out=counts[1:])
        for m in RUN.finditer(text):
            counts[m.start() + 1 : m.end() + 1] = counts[m.start()] + np.array(self.runs[m[0]])
        return _packed(counts)

    def _run(self, run: str) -> tuple[int, ...]:
        table, at, out = self.prefix_tokens(run.encode())[1], 0, []
        for ch in run:
            at += len(ch.encode())
            out.append(table[at])
        return tuple(out)

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of ``text[:k]`` for every k from 0 to len(text).

        The pattern looks ahead in two places. A run of white space gives its last character to
        what follows, so a prefix that ends in a run holds it as one piece; and a prefix that
        ends inside a contraction holds the apostrophe and the letter apart. A special token's
        string counts as text until it is complete.
        """
        out = [0]
        plain, before = "", 0  # the ordinary text since the last special token, and the tokens before it
        for part, special in self.segments(text):
            if special is None:
                plain = part
                out += [before + k for k in self._plain_prefixes(part)[1:]]
            else:
                whole = self._plain_prefixes(plain + part)
                out += [before + k for k in whole[len(plain) + 1 : -1]]
                before = before + whole[len(plain)] + 1
                out.append(before)
                plain = ""
        return out

    def _plain_prefixes(self, text: str) -> list[int]:
        out = [0] * (len(text) + 1)
        done = 0
        run, at_run = -1, 0  # where the current white space run begins, tokens before it
        for m in self.pattern.finditer(text):
            piece, s = m[0], m.start()
            table = self.prefix_tokens(piece.encode())[1]
            at = 0
            for k, ch in enumerate(piece, 1):
                at += len(ch.encode())
                out[s + k] = done + table[at]
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                out[s + 2] = done + 2
            lead = len(piece) - len(piece.lstrip()) if piece[0].isspace() else 0
            lead = len(regex.match(r"\s*", piece)[0]) if lead else 0
            if lead:
                if run < 0:
                    run, at_run = s, done
                whole = self.prefix_tokens(text[run : s + lead].encode())[1]
                at = len(text[run:s].encode())
                for k in range(1, lead + 1):
                    at += len(text[s + k - 1].encode())
                    out[s + k] = at_run + whole[at]
            if lead < len(piece):
                run = -1
            done += table[-1]
            if lead < len(piece):
                out[m.end()] = done
        return out


def _packed(counts: np.ndarray) -> bytes:
    steps = np.diff(counts)
    small = not len(steps) or (steps.min() >= -128 and steps.max() < 128)
    return steps.astype("i1" if small else "<i4").tobytes()


def unpacked(steps: bytes, n_chars: int) -> np.ndarray:
    """The exact token count of every prefix, from 0 to ``n_chars`` code points."""
    out = np.zeros(n_chars + 1, np.int64)
    np.cumsum(np.frombuffer(steps, "i1" if len(steps) == n_chars else "<i4"), out=out[1:])
    return out


@lru_cache(maxsize=4)
def byte_bpe(path: str, cache: int = 1_000_000) -> ByteBPE:
    """One instance for each worker process; a lost worker builds it again from the file."""
    return ByteBPE(path, cache)
