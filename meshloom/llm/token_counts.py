"""Operator 2: exact token counts from a stored table over all prefixes.

The dynamic program over prefixes (``ByteBPE.prefix_tokens``) gives the exact count of every prefix of
a text. The table is stored; counts, limits and truncations are read from it, and no text is encoded
a second time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshloom.llm.byte_bpe import byte_bpe, unpacked
from meshloom.llm.common import Scratch, id_text

ROWS = 1000  # texts in a batch of the table


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, steps: the table of every text, a row for each input row.

    ``steps`` has, for each code point, by how much it changes the exact token count (see
    ``ByteBPE.prefix_steps``). Null and empty texts have none. Other columns are not carried.
    Narrow: no shuffle; each worker holds one vocabulary and a bounded memo of pieces.
    """

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                texts = b.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([bpe.prefix_steps(t) for t in texts], pa.binary())],
                    ["doc_id", "n_bytes", "n_chars", "steps"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_chars long, steps binary")


def counts(table: DataFrame, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, from a table of prefixes alone."""

    def run(batches):
        for b in batches:
            n = np.array([unpacked(s, k)[-1] for k, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return table.select("doc_id", "n_bytes", "n_chars", "steps").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncated(table: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_total: the longest prefix within ``budget`` tokens, from a table of prefixes alone."""

    def run(batches):
        for b in batches:
            rows = []
            for k, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = unpacked(s, k)
                kept = int(np.flatnonzero(n <= max(0, budget))[-1])
                rows.append((kept, int(n[kept]), int(n[-1])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_chars", "n_tokens", "n_total"])

    return table.select("doc_id", "n_chars", "steps").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_total long")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens: ``counts`` of a
    written ``prefix_table``.

    Columns: doc_id, n_bytes, n_tokens, over_limit. One row per input row, repeated ids
    included; null and empty texts have 0 bytes and 0 tokens. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "token_counts")
    return counts(scratch.put(prefix_table(docs, tokenizer), "prefixes"), limit)


def truncations(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """``truncated`` of a written ``prefix_table``: null and empty texts give zeros."""
    scratch = Scratch(docs.sparkSession, "truncations")
    return truncated(scratch.put(prefix_table(docs, tokenizer), "prefixes"), budget)
