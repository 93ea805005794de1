"""Operator 1: quality rules in DataFrame functions alone.

Base counts come from each text by array functions. The verdict is a log-likelihood ratio:
word and punctuation runs, and pairs of neighbours, are hashed into buckets; one multinomial is
counted over the trusted documents, one over the whole corpus; a document's score is the mean
of log p(trusted) - log p(raw) over its n-grams, held against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from meshloom.llm.common import SPACE

# What a symbol is, the shortest text, the largest share of repeated words, in percent.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50
GRAM = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"

BUCKETS = 1 << 14  # a power of two: a bucket is the hash's lowest bits
THRESHOLD = -0.1
FEW = 32  # up to so many repeated hashes of a text are looked up one by one; beyond it all of its windows are compared
SMALL = 1_000_000  # trusted ids up to this count are broadcast (some 24 MB), more are joined by shuffle


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_base``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Each select gives an array a name, so that no array function computes it again per element.
    Windows whose hash is repeated are compared as text: equal ones are neighbours after a sort, and
    the positions they start at cover up to three words each.
    """
    own = docs.columns
    step = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    step = step.select(*own, "_t", _words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_l"))
    w = F.col("_w")
    n = F.size(w) - 2
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    step = step.select(*own, "_t", "_w", "_l", hashes.alias("_h")).select("*", F.sort_array("_h").alias("_r"))
    r, h, d = F.col("_r"), F.col("_h"), F.col("_d")
    step = step.select("*", F.array_distinct(F.filter(r, lambda x, i: x == F.get(r, i + 1))).alias("_d"))
    # Equal windows have equal hashes: only places of hashes that occur again need their text compared.
    every = F.sequence(F.lit(0), n - 1)
    places = F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= FEW, F.filter(every, lambda i: F.array_contains(d, F.get(h, i)))).otherwise(every)
    step = step.select(*own, "_t", "_w", "_l", places.alias("_c"))
    windows = F.transform(F.col("_c"), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i")))
    step = step.select(*own, "_t", "_w", "_l", F.sort_array(windows).alias("_s"))
    s = F.col("_s")
    again = F.filter(s, lambda x, i: (x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"]))
    step = step.select(*own, "_t", "_w", "_l", F.sort_array(F.transform(again, lambda x: x["i"])).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    base = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return step.select(*own, base.alias("_base"))


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GRAM), F.lit(0))


def _bucket(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, n (in all documents), n_trusted: counts over every document and whole text.

    ``trusted`` has the doc_ids of the target corpus. The n-grams are counted per task before
    the shuffle, so no more than BUCKETS rows leave a task.
    """
    ids = trusted.select(F.col("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(1))
    if ids.count() <= SMALL:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    step = marked.select(F.coalesce("_trusted", F.lit(0)).alias("t"), _grams(F.col("text")).alias("g"))
    g = F.col("g")
    pairs = F.transform(F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))), lambda x, i: _bucket(x, F.get(g, i + 1)))
    return step.select("t", F.explode(F.concat(F.transform(g, lambda x: _bucket(x)), pairs)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("n_trusted"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(trusted) - log p(raw) by bucket, one added to each count. BUCKETS rows come to the
    driver. Without any trusted document all ratios are zero."""
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, n, n_trusted in counts.collect():
        raw[bucket] += n
        target[bucket] += n_trusted
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def llr_score(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_score``: the mean log ratio of the text's n-grams; 0 without any."""
    own, table = docs.columns, F.lit(ratios)
    step = docs.select(*own, _grams(F.col(text)).alias("_g"))
    g = F.col("_g")
    n = F.size(g)
    ratio = F.transform(g, lambda x, i: F.get(table, _bucket(x)) + F.when(i + 1 < n, F.get(table, _bucket(x, F.get(g, i + 1)))).otherwise(F.lit(0.0)))
    total = F.aggregate(ratio, F.lit(0.0), lambda a, x: a + x)
    return step.select(*own, F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0)).alias("_score"))


def _verdict(threshold: float) -> tuple[Column, Column]:
    b = F.col("_base")
    failed = (b["n_words"] < LEAST_WORDS) | (100 * b["n_repeat_words"] > MOST_REPEATED * b["n_words"])
    return failed, ~failed & (F.col("_score") >= F.lit(threshold))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    One row per input row; a null text has no words and fails. ``llr`` is the score. Other
    columns are not carried. Repeated doc_ids are rows of their own; ids named twice in
    ``trusted`` count once; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = log_ratios(gram_counts(rows, trusted))
    scored = llr_score(base_counts(rows), ratios)
    failed, kept = _verdict(threshold)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # One struct with a row number in it: a filter on any column of the result stays above it, and
    # isn't pushed below the selects of base_counts (see keep_quality).
    whole = F.struct("doc_id", *(F.col(f"_base.{c}").alias(c) for c in counts), failed.alias("base_failed"), kept.alias("kept"), F.col("_score").alias("llr"), F.monotonically_increasing_id().alias("n"))
    return scored.select(whole.alias("r")).select("r.doc_id", *(f"r.{c}" for c in counts), "r.base_failed", "r.kept", "r.llr")


def keep_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns and no others."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    ratios = log_ratios(gram_counts(docs, trusted))
    # A row number that isn't a function of the row keeps the filter where it is: pushed below the
    # selects of base_counts, it would compute their arrays again for every element.
    judged = llr_score(base_counts(rows), ratios).select("_row", _verdict(threshold)[1].alias("_kept"), F.monotonically_increasing_id().alias("_n"))
    return judged.where(F.col("_kept") & (F.col("_n") >= 0)).select("_row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents labelled as of good quality and not toxic: the target corpus."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
