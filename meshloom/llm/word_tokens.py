"""Whole-text encoding with the tokenizers library, by way of a bounded memo of words.

A file whose normaliser and pre-tokeniser treat white space only as a border (it is collapsed,
then dropped) encodes a text as the concatenation of its words' encodings. Such a file is
recognised by its configuration; with any other file texts go to the library whole.

Texts are split by ASCII white space only: what else the library calls white space is a border
inside a word, which the library meets when it encodes the word. A block of texts is split and
its words numbered by Arrow, so Python sees each different word of a block once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meshloom.llm.byte_bpe import byte_symbols
from meshloom.llm.common import Cache, release_memory

# The configuration that makes words independent of each other.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

# Letters, then ASCII punctuation other than the apostrophe: always two pieces.
TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
LONGEST = 64
CHUNK = 2000
NONE = pa.array([], pa.string()), pa.array([], pa.large_binary())
BLOCK = 8 << 20  # bytes of text that are split at a time; a longer text is a block alone
LATIN = "\u0250"  # letters before it are their own composed form; all but one have one lower-case letter
DOTTED = "\u0130"


class WordEncoder:
    def __init__(self, path: str, cap: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._independent(spec)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.n_ids = size
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(size, bool)
        if suffix:
            for token, i in spec["model"]["vocab"].items():
                self.ends[i] = token.endswith(suffix)
        self.has_ends = bool(suffix)
        self.tails = Cache(self._whole, 10_000)
        self.symbols = {b: ch for ch, b in byte_symbols().items()}
        self.cap = cap
        self.keys, self.values = NONE

    @staticmethod
    def _independent(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or []
        return (
            [n["type"] for n in norm.get("normalizers") or []] == NORMALIZERS
            and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and norm["normalizers"][1]["content"] == " "
            and len(steps) == 2
            and steps[0] == {"type": "Split", "pattern": {"Regex": SPLIT_PATTERN}, "behavior": "Removed", "invert": True}
            and steps[1].get("type") == "ByteLevel"
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """ids of different words.

        A run of Latin letters is one piece, which the normaliser only lower-cases: it goes to the
        library's model directly, as symbols for its bytes; ASCII punctuation after it is encoded
        apart. Other words of letters go to the library many at a time: each is one piece there and
        ends in the one token that carries the end-of-word mark. What is left goes word by word.
        """
        out: dict[str, bytes] = {"": b""}
        plain, rest = [], []
        if self.has_ends:
            tokenize, symbols, tail, cores, split = self.library.model.tokenize, self.symbols, self.tails, {}, TAIL.fullmatch
            for w in words:
                letters, marks = w, ""
                if not w.isalpha():
                    if (m := split(w)) is None:
                        rest.append(w)
                        continue
                    letters, marks = m.groups()
                if letters.isascii():
                    core = letters.lower()
                elif max(letters) < LATIN and DOTTED not in letters and letters.isalpha():
                    core = letters.lower().encode().decode("latin-1").translate(symbols)
                else:
                    (rest if marks or len(w) > LONGEST else plain).append(w)
                    continue
                if (ids := cores.get(core)) is None:
                    ids = cores[core] = array("I", [t.id for t in tokenize(core)]).tobytes()
                out[w] = ids + tail[marks] if marks else ids
        else:
            rest = words
        for at in range(0, len(plain), CHUNK):
            some = plain[at : at + CHUNK]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, a = ids.tobytes(), 0
                for w, z in zip(some, (stops * 4).tolist(), strict=True):
                    out[w] = raw[a:z]
                    a = z
            else:
                rest += some
        for at in range(0, len(rest), CHUNK):
            some = rest[at : at + CHUNK]
            for w, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def _ids(self, words: pa.Array) -> pa.Array:
        """ids of different words, from the memo or learned now. The memo is a pair of Arrow arrays."""
        at = pc.index_in(words, value_set=self.keys)
        new = words.filter(pc.is_null(at))
        if not len(new):
            return self.values.take(at)
        asked = new.to_pylist()
        known = self._learn(asked)
        learned = pa.array([known[w] for w in asked], pa.large_binary())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.values) + np.arange(len(new))
        found = pa.concat_arrays([self.values, learned]).take(pa.array(place))
        if len(self.keys) + len(new) > self.cap:
            self.keys, self.values = NONE  # the memo is bounded; what was in it is encoded again when met
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        self.keys, self.values = pa.concat_arrays([self.keys, new.filter(short)]), pa.concat_arrays([self.values, learned.filter(short)])
        if len(self.keys) > self.cap:
            self.keys, self.values = NONE
        return found

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            whole = [self._whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(whole), "<u4"), np.cumsum([0, *(len(x) // 4 for x in whole)])
        words = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = words.values.dictionary_encode()
        # One look-up for each different word of the block; then its ids are gathered for every place.
        ids = self._ids(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset : ids.offset + len(ids) + 1]
        data = ids.buffers()[2]
        flat = np.frombuffer(data, "<u4", int(ends[-1]) // 4) if data is not None and len(ids) else np.empty(0, "<u4")
        at = words.offsets.to_numpy() - words.offsets[0].as_py()
        return flat, ends[at] // 4

    def blocks(self, texts: pa.Array):
        """(first text, ids, offsets) of block after block: text ``first + k`` has the ids
        ``ids[offsets[k]:offsets[k + 1]]``, unsigned 32-bit, without special tokens."""
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(texts):
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
            yield at, *self._block(texts.slice(at, end - at))
            release_memory()
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without special tokens."""
        return [ids[a:z].tobytes() for _, ids, at in self.blocks(pa.array(texts, pa.string())) for a, z in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def word_encoder(path: str, cap: int = 1_000_000) -> WordEncoder:
    return WordEncoder(path, cap)
