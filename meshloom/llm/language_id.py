"""Operator 9: language of texts by a linear-chain conditional random field over words.

Word features (affixes, character n-grams, membership in each language's lexicon) and label transitions
are learned together by gradient ascent on the conditional likelihood, with forward-backward over
word sequences. Some training sequences switch language in the middle, so that the transitions
learn how often neighbours differ. A text is one chain, however long; its language is the label
with the highest mean posterior over its words.

A word is a run of letters; a run of more than PIECE letters counts as several words, PIECE
letters each.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meshloom.llm.common import id_text

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PIECE = 48


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    out = WORD.findall(text.lower())
    if not all(map(str.isalpha, out)):  # digits of other kinds, as in m², part words
        out = ["".join(run) for w in out for letters, run in groupby(w, str.isalpha) if letters]
    if max(map(len, out), default=0) > PIECE:
        out = [w[k : k + PIECE] for w in out for k in range(0, len(w), PIECE)]
    return out


def features(w: str) -> list[str]:
    """Affixes of one to four letters, inner n-grams of two and three, and the word itself."""
    n = len(w)
    out = ["=" + w]
    out += ["<" + w[:k] for k in range(1, min(4, n) + 1)]
    out += [">" + w[-k:] for k in range(1, min(4, n) + 1)]
    out += [w[i : i + 2] for i in range(n - 1)]
    out += [w[i : i + 3] for i in range(n - 2)]
    return out


def lexicons(words: list[tuple[int, list[str]]], size: int = 1000, least: int = 3) -> dict[str, list[str]]:
    """word -> a feature for each language whose lexicon has it: its ``size`` most frequent words, ``least`` times at least."""
    counts: dict[int, Counter] = {}
    for lang, ws in words:
        counts.setdefault(lang, Counter()).update(ws)
    out: dict[str, list[str]] = {}
    for lang in sorted(counts):
        for w, n in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:size]:
            if n >= least:
                out.setdefault(w, []).append(f"#{lang}")
    return out


class Model(NamedTuple):
    langs: list[str]
    index: dict[str, int]  # feature -> row of weights
    weights: np.ndarray  # float32 [features, langs]
    moves: np.ndarray  # float32 [langs, langs]: log potentials from a word's label to the next one's
    lexicon: dict[str, list[str]]  # word -> features of the lexicons that have it


def posteriors(emit: np.ndarray, valid: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``emit``: [time, chain, label] log potentials; ``valid``: [time, chain]. Gives the label
    posteriors, and for training the expected label pairs of each step, [time - 1, chain, label,
    label] summed over chains and time.
    """
    steps, n, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(moves)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ m) * e[t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (e[t + 1] * beta[t + 1]) @ m.T
        b /= b.sum(axis=1, keepdims=True)
        beta[t] = np.where(valid[t + 1][:, None], b, 1)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    return post, np.stack([alpha, e * beta]) if k else np.empty(0)


STEPS = 1024  # steps of a chain that are held at a time


def posterior_sums(rows: np.ndarray, widths: np.ndarray, potentials: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over whole chains of any lengths, longest first: label posteriors, summed over each chain.

    ``rows`` are places in ``potentials`` (not logs), step after step; ``widths`` is how many
    chains have each step. Only what the forward pass had at every STEPS-th step is kept; in
    between it is made again when the backward pass gets there.
    """
    k = potentials.shape[1]
    steps, m = len(widths), np.exp(moves)
    off = np.r_[0, np.cumsum(widths)]
    total = np.zeros((int(widths[0]) if steps else 0, k))

    def forward(a, t):
        e = potentials[rows[off[t] : off[t + 1]]]
        a = e if a is None else (a[: len(e)] @ m) * e
        return a / a.sum(axis=1, keepdims=True)

    kept, alpha = [], None
    for start in range(0, steps, STEPS):
        kept.append(alpha)
        if start + STEPS < steps:
            for t in range(start, start + STEPS):
                alpha = forward(alpha, t)
    right = None  # what the step after gives: its potentials times what follows it
    for start in range((steps - 1) // STEPS * STEPS, -1, -STEPS):
        alphas, alpha = [], kept.pop()
        for t in range(start, min(start + STEPS, steps)):
            alpha = forward(alpha, t)
            alphas.append(alpha)
        for t in range(start + len(alphas) - 1, start - 1, -1):
            post = alphas.pop()
            e = potentials[rows[off[t] : off[t + 1]]]
            if right is None:
                right = e / e.sum(axis=1, keepdims=True)
            else:
                beta = right @ m.T
                n = len(beta)
                post[:n] *= beta
                post[:n] /= post[:n].sum(axis=1, keepdims=True)
                e[:n] *= beta
                right = e / e.sum(axis=1, keepdims=True)
            total[: len(post)] += post
    return total


def pair_counts(both: np.ndarray, valid: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected label pairs, summed, from what ``posteriors`` gives."""
    alpha, right = both
    m = np.exp(moves)
    total = np.zeros_like(m)
    for t in range(len(alpha) - 1):
        on = valid[t + 1]
        p = alpha[t][on][:, :, None] * m[None] * right[t + 1][on][:, None, :]
        total += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return total


def train(texts: list[tuple[str, str]], epochs: int = 3, rate: float = 0.3, decay: float = 1e-5, switch: float = 0.3, most_features: int = 300_000, seed: int = 11) -> Model:
    """Fit on (language, text) pairs, on chains of 32 words. Deterministic in the order of ``texts``.
    At most ``most_features`` features, fewer where there are very many languages."""
    rng = np.random.default_rng(seed)
    langs = sorted({x for x, _ in texts})
    number = {x: k for k, x in enumerate(langs)}
    words = [(number[x], words_of(t)) for x, t in texts]
    words = [(x, w) for x, w in words if w]
    counts: dict[str, int] = {}
    lexicon = lexicons(words)
    feats = {w: features(w) + lexicon.get(w, []) for w in {w for _, ws in words for w in ws}}
    for _, ws in words:
        for w in ws:
            for f in feats[w]:
                counts[f] = counts.get(f, 0) + 1
    chosen = sorted((f for f, n in counts.items() if n > 1), key=lambda f: (-counts[f], f))[: min(most_features, 40_000_000 // max(1, len(langs)))]
    index = {f: k for k, f in enumerate(sorted(chosen))}
    ids = {w: np.array([index[f] for f in fs if f in index], np.int64) for w, fs in feats.items()}
    k = len(langs)
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    by_lang = [[j for j, (x, _) in enumerate(words) if x == y] for y in range(k)]
    length = 32
    for _ in range(epochs):
        chains = []
        for x, ws in words:
            for at in range(0, len(ws), length):
                part = [(w, x) for w in ws[at : at + length]]
                if k > 1 and rng.random() < switch:  # go on in another language from some word on
                    y = int(rng.integers(k - 1))
                    y += y >= x
                    other = words[by_lang[y][int(rng.integers(len(by_lang[y])))]][1]
                    cut = int(rng.integers(1, len(part) + 1))
                    start = int(rng.integers(max(1, len(other) - length)))
                    part = part[:cut] + [(w, y) for w in other[start : start + length - cut]]
                chains.append(part)
        order = rng.permutation(len(chains))
        for at in range(0, len(order), 128):
            some = [chains[j] for j in order[at : at + 128]]
            n = len(some)
            emit, valid, gold = np.zeros((length, n, k)), np.zeros((length, n), bool), np.zeros((length, n), np.int64)
            flat, place = [], []
            for c, chain in enumerate(some):
                for t, (w, x) in enumerate(chain):
                    valid[t, c], gold[t, c] = True, x
                    if len(ids[w]):
                        flat.append(ids[w])
                        place.append(t * n + c)
            lens = np.array([len(f) for f in flat])
            rows = np.concatenate(flat)
            slot = np.repeat(np.array(place), lens)
            e = emit.reshape(-1, k)
            np.add.at(e, slot, weights[rows])
            post, both = posteriors(emit, valid, moves)
            diff = -post * valid[:, :, None]
            tt, cc = np.nonzero(valid)
            diff[tt, cc, gold[tt, cc]] += 1
            grad_w = np.zeros_like(weights)
            np.add.at(grad_w, rows, diff.reshape(-1, k)[slot])
            grad_m = -pair_counts(both, valid, moves)
            np.add.at(grad_m, (gold[:-1][valid[1:]], gold[1:][valid[1:]]), 1)
            for value, grad, seen in ((weights, grad_w / n, seen_w), (moves, grad_m / n, seen_m)):
                grad -= decay * value
                seen += grad * grad
                value += rate * grad / np.sqrt(seen)
    return Model(langs, index, weights.astype(np.float32), moves.astype(np.float32), lexicon)


GROUP = 4 << 20  # characters of text, for each four languages, that are tagged at a time


class Tagger:
    """Word potentials, kept for words that were met (a bounded memo), and document decisions."""

    def __init__(self, model: Model, cap: int = 500_000):
        self.model, self.cap = model, cap
        self.row: dict[str, int] = {}
        self.table = np.zeros((cap, len(model.langs)), np.float32)

    def learn(self, new: list[str]) -> None:
        get, lexicon = self.model.index.get, self.model.lexicon
        flat, lens = [], []
        for w in new:
            f = [i for x in features(w) if (i := get(x)) is not None]
            if w in lexicon:
                f += [i for x in lexicon[w] if (i := get(x)) is not None]
            flat += f or [0]
            lens.append(len(f))
        n = np.array(lens)
        starts = np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1)
        sums = np.add.reduceat(self.model.weights[np.array(flat)], starts, axis=0) if len(self.model.weights) else np.zeros((len(new), len(self.model.langs)), np.float32)
        sums[n == 0] = 0
        at = len(self.row)
        self.table[at : at + len(new)] = np.exp(sums - sums.max(axis=1, keepdims=True))
        self.row.update(zip(new, range(at, at + len(new)), strict=True))

    def tag(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text. Texts of like length are tagged together."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        most = max(1, GROUP * 4 // max(4, len(self.model.langs)))
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        at = 0
        while at < len(order):
            end, size = at + 1, len(texts[order[at]])
            while end < len(order) and size + len(texts[order[end]]) <= most:
                size += len(texts[order[end]])
                end += 1
            some = order[at:end]
            for k, found in zip(some, self._tag([words_of(texts[k]) for k in some]), strict=True):
                out[k] = found
            at = end
        return out

    def _rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The row of the table for every word, of one document after another."""
        row = self.row
        met = set().union(*docs)
        fresh = sorted(met.difference(row))
        if len(row) + len(fresh) > self.cap:
            row.clear()
            fresh = sorted(met)
            if len(fresh) > self.cap:  # a group with more different words than the memo holds
                self.cap = len(fresh)
                self.table = np.zeros((self.cap, len(self.model.langs)), np.float32)
        if fresh:
            self.learn(fresh)
        get = row.__getitem__
        return [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in docs]

    def _tag(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        langs, rows = self.model.langs, self._rows(docs)
        sizes = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(-sizes, kind="stable")  # the longest chain first
        order = order[: int((sizes > 0).sum())]
        out = [(UNKNOWN, 0.0)] * len(docs)
        if not len(order):
            return out
        lens = sizes[order]
        widths = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), "right")  # chains with more words than that
        step = np.concatenate([np.arange(n) for n in lens])
        place = (np.cumsum(widths) - widths)[step] + np.repeat(np.arange(len(lens)), lens)
        flat = np.empty(len(place), np.int32)
        flat[place] = np.concatenate([rows[k] for k in order])
        total = posterior_sums(flat, widths, self.table, self.model.moves)
        best = total.argmax(axis=1)
        for k, y, t, n in zip(order.tolist(), best.tolist(), total, lens.tolist(), strict=True):
            out[k] = (langs[y], float(min(1.0, max(0.0, t[y] / n))))
        return out


def fit(docs: DataFrame, per_lang: int = 300, most_texts: int = 8_000, text_chars: int = 2_000) -> Model:
    """Learn from a bounded sample of labelled documents outside the held-out fold.

    Of each language the ``per_lang`` documents with the smallest id hashes (fewer where that would be
    more than ``most_texts`` in all), of each the first ``text_chars`` characters. Where there are more
    than ``most_texts`` languages, the most frequent ones are learned. One scan counts the
    languages, one finds the sample's ids, one its texts; only the sample comes to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_texts).collect()
    if not langs:
        return Model([], {}, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), {})
    each = min(per_lang, most_texts // len(langs))
    # Ids whose hash is in the lowest part, large enough to hold ``each`` of the language all but surely.
    part = spark.createDataFrame([(r["lang"], min(1.0, (each + 6 * each**0.5 + 6) / r["count"])) for r in langs], "lang string, part double")
    place = F.xxhash64("doc_id").bitwiseAND((1 << 40) - 1)
    low = rows.select("doc_id", "lang", place.alias("place")).join(F.broadcast(part), "lang").where(F.col("place") < F.col("part") * (1 << 40))
    found: dict[str, list] = {}
    for lang, at, doc in sorted(tuple(r) for r in low.select("lang", "place", "doc_id").distinct().collect()):
        if len(some := found.setdefault(lang, [])) < each:
            some.append(doc)
    chosen = spark.createDataFrame([(d,) for d in sorted({d for some in found.values() for d in some})], "doc_id long")  # at most most_texts
    wanted = {(lang, d) for lang, some in found.items() for d in some}
    texts = rows.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "lang", F.substring("text", 1, text_chars).alias("text")).limit(2 * most_texts).collect()
    return train([(r[1], r[2]) for r in sorted(map(tuple, texts)) if (r[1], r[0]) in wanted])


_TAGGERS: dict[str, Tagger] = {}  # of this worker process: the one of the last model


def _tagger(key: str, model: Model) -> Tagger:
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(model)
    return _TAGGERS[key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone.

    ``und`` with score 0 where the text is null or has no letter. A null id is not held out. One
    row per input row; other columns are not carried.
    """
    holder = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    key = uuid.uuid4().hex

    def run(batches):
        tagger = _tagger(key, holder.value)
        for b in batches:
            got = tagger.tag(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = id_text(docs).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """``fit`` then ``predict``: only text and lang of the learning folds are learned from."""
    return predict(docs, fit(docs))
