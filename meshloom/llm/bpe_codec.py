"""Operator 7: BPE encoding by a priority queue of merges, and decoding by the vocabulary."""

from __future__ import annotations

from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from meshloom.llm.byte_bpe import byte_bpe
from meshloom.llm.common import id_text


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every text; null and empty texts have no ids."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded text). One row per input row; null counts as empty.
    Ids stay in the worker, so that no token array crosses to the JVM.
    """

    def run(batches):
        bpe = byte_bpe(tokenizer)
        ids_of, bytes_of = bpe.ids.__getitem__, bpe.bytes_of.__getitem__
        digits = list(map(str, range(max(bpe.bytes_of) + 1))).__getitem__
        for b in batches:
            n, coded, decoded = [], [], []
            for text in b.column(1).to_pylist():
                ids: list[int] = []
                for part, special in bpe.segments(text):
                    if special is not None:
                        ids.append(special)
                    else:
                        ids += chain.from_iterable(map(ids_of, bpe.pattern.findall(part)))
                n.append(len(ids))
                coded.append(sha256(",".join(map(digits, ids)).encode()).hexdigest())
                back = b"".join(map(bytes_of, ids)).decode("utf-8", "replace")
                decoded.append(sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
