"""Each operator against brute force, on awkward documents and on an empty table."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import SCHEMA, base_quality, components, cut_repeats, fingerprint, rows, squeeze, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshloom.llm import bpe_codec, exact_dedup, keep, language_id, packing, quality, secret_scan, simhash, substring_dedup, token_counts, token_files
from meshloom.llm import byte_bpe as byte_bpe_module
from meshloom.llm.byte_bpe import byte_bpe, unpacked
from meshloom.llm.common import Scratch
from meshloom.llm.components import connected_components
from meshloom.llm.word_tokens import WordEncoder

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    out = {r["doc_id"]: r for r in df.collect()}
    return out


@pytest.fixture(scope="module")
def plain():
    """doc_id -> text of the fixture."""
    return {r[0]: r[1] for r in rows()}


# -- 1

def test_quality(spark, docs, none, plain):
    trusted = spark.createDataFrame([(11,), (11,), (25,), (None,), (999,)], "doc_id long")
    got = by_id(quality.quality(docs, trusted))
    assert len(got) == len(plain)
    for d, t in plain.items():
        n = base_quality(t)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, d
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)
    assert quality.quality(none, trusted).isEmpty()
    assert {r["llr"] for r in quality.quality(docs, trusted.limit(0)).collect()} == {0.0}


def test_quality_scores(spark, docs, plain):
    """Scores by hand: Spark's hash is XXH64 with seed 42, chained over columns."""
    import regex

    trusted = {11, 25}
    grams = {}
    for d, t in plain.items():
        g = regex.findall(quality.GRAM.replace("\\s", r" \t\n\x0b\f\r"), t or "")
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        h += [xxhash.xxh64_intdigest(y.encode(), xxhash.xxh64_intdigest(x.encode(), 42)) for x, y in zip(g, g[1:])]
        grams[d] = [x % quality.BUCKETS for x in h]
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for d, h in grams.items():
        np.add.at(raw, h, 1)
        if d in trusted:
            np.add.at(target, h, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = by_id(quality.quality(docs, spark.createDataFrame([(d,) for d in trusted], "doc_id long")))
    for d, h in grams.items():
        assert got[d]["llr"] == pytest.approx(ratio[h].mean() if h else 0.0, abs=1e-9), d


def test_keep_quality_has_the_same_verdict(spark, docs):
    trusted = spark.createDataFrame([(11,), (25,)], "doc_id long")
    kept = quality.keep_quality(docs, trusted)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in by_id(quality.quality(docs, trusted)).items() if r["kept"]}


# -- 2, 7

def test_token_counts(docs, none, plain):
    tk = Tokenizer.from_file(BYTE)
    got = by_id(token_counts.token_counts(docs, BYTE, limit=100))
    for d, t in plain.items():
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[d])[1:] == (len((t or "").encode()), n, n > 100)
    assert token_counts.token_counts(none, BYTE).isEmpty()


def test_prefix_counts_are_exact():
    tk, bpe, rng = Tokenizer.from_file(BYTE), byte_bpe(BYTE), random.Random(3)
    bits = ["a", "the", "'", "s", "ll", "re", " ", "  ", "\n", "\t", "é", "日本", "0", "12", "!", "..", "🙂", "\xa0", "<|endoftext|>", "<|", "\x85", "don't", " we'll"]
    for _ in range(400):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        counts = [len(tk.encode(s[:k], add_special_tokens=False).ids) for k in range(len(s) + 1)]
        assert bpe.prefix_counts(s) == counts, s
        assert unpacked(bpe.prefix_steps(s), len(s)).tolist() == counts, s
    for s in ("-" * 300, "a" * 300, " " * 300 + "x" + "=" * 200):
        assert unpacked(bpe.prefix_steps(s), len(s)).tolist() == [len(tk.encode(s[:k], add_special_tokens=False).ids) for k in range(len(s) + 1)]
    assert unpacked(byte_bpe_module._packed(np.array([0, 300, 1])), 2).tolist() == [0, 300, 1]


def test_truncations(docs, plain):
    tk = Tokenizer.from_file(BYTE)
    for d, r in by_id(token_counts.truncations(docs.where("length(text) < 1000 OR text IS NULL"), BYTE, 7)).items():
        t = plain[d] or ""
        assert r["n_tokens"] == len(tk.encode(t[: r["n_chars"]], add_special_tokens=False).ids) <= 7
        assert r["n_chars"] == max(k for k in range(len(t) + 1) if len(tk.encode(t[:k], add_special_tokens=False).ids) <= 7)
        assert r["n_total"] == len(tk.encode(t, add_special_tokens=False).ids)


def test_codec(docs, none, plain):
    tk = Tokenizer.from_file(BYTE)
    got = by_id(bpe_codec.round_trip(docs, BYTE))
    for d, t in plain.items():
        ids = tk.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[d])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False)))
    back = by_id(bpe_codec.decode(bpe_codec.encode(docs, BYTE), BYTE))
    assert {d: r["text"] for d, r in back.items()} == {d: t or "" for d, t in plain.items()}
    assert bpe_codec.round_trip(none, BYTE).isEmpty()


def test_word_memo_is_bounded_and_exact():
    tk, enc, rng = Tokenizer.from_file(WORDS), WordEncoder(WORDS, cap=20), random.Random(1)
    assert enc.by_word
    some = [t or "" for t in texts()] + ["".join(rng.choice(["ab", "C", "é", "'s", ".", " ", "\n", "İ", "1", "\x1c", "ΟΔΟΣ"]) for _ in range(9)) for _ in range(500)]
    for _ in range(2):
        assert enc.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in tk.encode_batch(some, add_special_tokens=False)]


# -- 3

def pieces_of(plain):
    tk, out = Tokenizer.from_file(WORDS), {}
    for d, t in plain.items():
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            out[d, k // 4096] = (k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    return out


def check_packing(got, capacity):
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in at.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    return len(at)


def test_packing(docs, none, plain):
    got = packing.pack_documents(docs, WORDS).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces_of(plain) and len(got) == len(pieces_of(plain))
    assert check_packing(got, 4096) == math.ceil(sum(r["length"] for r in got) / 4096)
    assert packing.pack_documents(none, WORDS).isEmpty()


@pytest.mark.parametrize("lengths", [lambda r: r.randint(1, 4096), lambda r: r.choice([1365, 1366, 2048, 700]), lambda r: 4096, lambda r: 2049, lambda r: r.choice([1, 4095])])
def test_packing_over_blocks(spark, lengths):
    rng = random.Random(5)
    rows_ = [(k // 3, k % 3, 0, lengths(rng), k) for k in range(900)]
    got = packing.pack(spark.createDataFrame(rows_, packing.PIECE_SCHEMA), block_items=64).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(rows_)
    whole = packing.Packing(4096, [r[3] for r in rows_])
    whole.best_fit(sorted(range(900), key=lambda x: -rows_[x][3]))
    assert check_packing(got, 4096) <= len(whole.bins) * 1.02 + 1


def test_crossover_keeps_every_item():
    rng = random.Random(2)
    size = [rng.randint(1, 40) for _ in range(120)]
    folk, _, _ = packing.evolve(size, 100, [], 4, 0, 1)
    a, b = (packing.Packing.of(100, size, g) for g in folk[:2])
    child = packing.cross(rng, a, b, 0.5)
    assert sorted(x for c in child.bins for x in c) == list(range(120))
    assert child.fill == [sum(size[x] for x in c) for c in child.bins] and max(child.fill) <= 100


def test_crossover_decides():
    """Pieces that best fit in falling order packs badly: the generations find fewer bins than it, and
    than the population they began with."""
    rng = random.Random(3)
    for lengths, cap in ((lambda: rng.randint(1000, 2000), 4096), (lambda: rng.randint(250, 500), 1000)):
        size = [lengths() for _ in range(900)]
        falling = packing.Packing(cap, size)
        falling.best_fit(sorted(range(len(size)), key=lambda x: -size[x]))
        folk, before, crossed = packing.evolve(size, cap, [], 8, 12, 1)
        best = packing.Packing.of(cap, size, folk[0])
        assert max(best.fill) <= cap and sorted(x for b in best.bins for x in b) == list(range(900))
        assert crossed > 0 and len(best.bins) < before and len(best.bins) < len(falling.bins)


def test_packing_evolves_and_migrates(spark, sf_dir):
    """On the given documents the islands cross, and end at the fewest bins the tokens need, but for one."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces, report = Scratch(spark, "t").put(packing.token_pieces(df, WORDS), "p"), []
    got = packing.pack(pieces, block_items=100, report=report).collect()
    blocks, least, first, last, crossed = report[0]
    assert blocks > 1 and crossed > 0 and last <= first
    assert check_packing(got, 4096) <= math.ceil(sum(r["length"] for r in got) / 4096) + 1


def test_packing_equal_rows(spark):
    """Rows that are equal in all columns, ids missing, are still dealt over all blocks."""
    rows_ = [(None, 0, 0, 1, 5)] * 12_000 + [(k, 0, 0, 4000, 1) for k in range(20)]
    report = []
    got = packing.pack(spark.createDataFrame(rows_, packing.PIECE_SCHEMA).repartition(4), block_items=4500, report=report).collect()
    assert len(got) == 12_020 and report[0][0] == 3
    assert check_packing(got, 4096) <= 24  # 23 at least


# -- 4

def test_secret_base(docs, none, plain):
    import re

    got = by_id(secret_scan.secret_spans(docs))
    for d, t in plain.items():
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        found.sort()
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found)
        r = got[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(f[1] == k for f in found) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(r["spans"].split(","))
    assert got[17]["n_assign"] == 1 and got[17]["n_access"] == 1 and got[20]["n_access"] == 1
    assert secret_scan.secret_spans(none).isEmpty()


def test_inferred_formats(spark):
    """Keys of one format are labelled where a keyword names them, and found where none does."""
    rng = random.Random(9)
    key = lambda: "sk_" + "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(24))
    prose = lambda: " ".join("".join(rng.choice(["the", "and", "ing", "tion", "er"]) for _ in range(rng.randint(1, 6))) for _ in range(40))
    data = [(k, f"{prose()} token = {key()} {prose()}") for k in range(200)] + [(1000 + k, f"{prose()} {key()} {prose()}") for k in range(50)] + [(2000 + k, prose()) for k in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    formats = secret_scan.fit_formats(df)
    got = by_id(secret_scan.secret_spans(df, formats))
    text = dict(data)
    for d, r in got.items():
        marks = [s.split(":") for s in r["spans"].split(",") if s.startswith("format")]
        assert len(marks) == (1 if 1000 <= d < 2000 else 0)
        for _, a, b in marks:
            assert text[d][int(a) : int(b)].startswith("sk_")
    clean = by_id(secret_scan.redact(df, formats=formats))
    assert all("sk_" not in r["text"] for r in clean.values()) and all(clean[d]["text"] == t for d, t in data if d >= 2000)


def test_formats_of_a_rare_kind(spark):
    """40 labels among 60,000 documents are enough for an automaton, wherever they are."""
    rng = random.Random(10)
    key = lambda: "sk_" + "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(24))
    data = [(k, f"token = {key()}" if k % 1500 == 0 else "some internationalisation of words") for k in range(60_000)] + [(60_000, key())]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    formats = secret_scan.fit_formats(df)
    assert set(formats.automata) == {0}
    assert secret_scan.secret_spans(df, formats).where("doc_id = 60000").first()["spans"] == "format:0:27"
    clean = secret_scan.redact(df, formats=formats).where("text LIKE '%sk!_%' ESCAPE '!'")
    assert clean.isEmpty()
    assert math.exp(formats.ordinary["i"]) == pytest.approx(4 / 20, abs=0.001)


def test_ordinary_runs_overlap_no_span():
    rng = random.Random(12)
    bits = ["token=", "a" * 14, "AKIA" + "B" * 16, "0123456789abcdef", " ", "zz/zz+zzzzzzz", "x", "password: "]
    for _ in range(500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        held = secret_scan.base_spans(t)
        expected = [m[0] for m in secret_scan.CANDIDATE.finditer(t) if not any(x < m.end() and m.start() < y for x, _, y in held)]
        assert list(secret_scan.ordinary_runs(t, held)) == expected


def test_scores_by_hand():
    """60 keys K1 or K2: the probabilities of each path, of characters not seen, and of other lengths."""
    f = secret_scan.Formats({0: secret_scan.infer(["K1", "K2"] * 30)}, {"K": math.log(0.5), "1": math.log(0.25)}, math.log(0.01), 1.0)
    log = lambda *x: sum(map(math.log, x))
    assert f.score("K1") == pytest.approx((log(60 / 61, 30 / 62) - log(0.5, 0.25)) / 2)
    assert f.score("K7") == pytest.approx((log(60 / 61, 2 / 8 / 62) - log(0.5, 0.01)) / 2)
    assert f.score("L1") == pytest.approx((log(1 / 25 / 61, 30 / 62) - max(log(0.01, 0.25), log(0.01, 0.25, 0.01))) / 2)
    assert [f.score(s) for s in ("K", "K11", "k1", "KK", "")] == [-math.inf] * 5


def some_keys(rng):
    import string

    some = string.ascii_letters + string.digits
    pick = lambda n, v=some: "".join(rng.choice(v) for _ in range(n))
    return {
        "ghp": lambda: "ghp_" + pick(36), "sk": lambda: "sk_live_" + pick(24), "gk": lambda: "GKza" + pick(35, some + "-_"),
        "two": lambda: "xox-" + pick(rng.randint(10, 14), string.digits) + "-" + pick(24, string.ascii_lowercase + string.digits),
    }


def test_automata_are_distributions():
    """Over all strings the probabilities add up to one."""
    rng = random.Random(14)
    keys = [k() for k in some_keys(rng).values() for _ in range(100)]
    states = secret_scan.infer(keys)
    mass, total = np.eye(len(states))[0], 0.0
    step = np.zeros((len(states), len(states)))
    for i, (to, _) in enumerate(states):
        for j, p in to.values():
            step[i, j] += math.exp(p)
    ends = np.array([math.exp(p) for _, p in states])
    for _ in range(500):
        total += mass @ ends
        mass = mass @ step
    # what is missing runs into states that lead nowhere, or still goes on
    assert 0.9 < total + mass.sum() <= 1 + 1e-9
    assert all(abs(step[i].sum() + ends[i] - 1) < 1e-9 for i in range(len(states)) if ends[i] > 0 or states[i][0])


def test_planted_keys(sf_dir):
    """Keys of four formats that no keyword names: recall and precision in the given documents."""
    import pyarrow.parquet as pq

    rng = random.Random(15)
    prose = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    kinds = some_keys(rng)
    labelled = [k() for k in kinds.values() for _ in range(250)]
    chars = secret_scan.Counter("".join(r for t in prose for r in secret_scan.ordinary_runs(t, secret_scan.base_spans(t))))
    n = sum(chars.values())
    f = secret_scan.Formats({0: secret_scan.infer(labelled)}, {c: math.log(k / n) for c, k in chars.items()}, math.log(0.1 / n), 1.0)

    def found(t):
        return {t[a:z] for a, k, z in secret_scan.all_spans(t, secret_scan.base_spans(t), f.score, f.least) if k == 3}

    assert not any(map(found, prose))
    for k in kinds.values():
        keys = [k() for _ in range(300)]
        assert sum(found(f"as in {x}, see") == {x} for x in keys) >= 270
        assert sum(found(f"see https://a.b/url={x}&c") == {x} for x in keys) >= 270
        assert sum(bool(found(x[:-6])) or bool(found(x + "aB3x")) for x in keys) <= 30  # of another length


def test_length_and_separators():
    rng = random.Random(16)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(1000)]
    f = secret_scan.Formats({1: secret_scan.infer(keys[:900])}, {c: math.log(0.2) for c in "etaon"}, math.log(1e-4), 1.0)
    assert all(f.score(k) >= 1 for k in keys)
    assert {f.score(s) for s in ("AKIAX", keys[0][:-1], keys[0] + "A", keys[0] + "A" * 44)} == {-math.inf}
    t = f"a/{keys[901]}.b={keys[902]}/{keys[903]} {keys[904]}+x"
    spans = [t[a:z] for a, _, z in secret_scan.all_spans(t, [], f.score, 1.0)]
    assert spans == keys[901:905]
    assert secret_scan.all_spans(t, [(3, 1, 5)], f.score, 1.0)[1:] == secret_scan.all_spans(t, [], f.score, 1.0)[1:]  # overlaps a fixed span


def test_state_merging():
    states = secret_scan.infer(["ab" * k for k in range(1, 40)] * 20)
    assert len(states) <= 4  # a loop over a, b
    assert len(secret_scan.infer(["AKIA" + c * 4 for c in "XYZ"] * 100)) > 3


def test_redact_keeps_columns(docs):
    out = secret_scan.redact(docs)
    assert out.schema == docs.schema
    r = by_id(out)
    assert r[0]["text"] is None and "ABCDEFGHIJKLMNOP" not in r[17]["text"] and r[17]["n_chars"] == len(r[17]["text"])


# -- 5

@pytest.mark.parametrize("batch", [10_000, 2])
def test_exact_dedup(spark, docs, none, plain, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = by_id(exact_dedup.exact_dedup(docs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for d, t in plain.items():
        groups[squeeze(t)].append((-len(t or ""), d is None, d or 0, d))
    for k, g in groups.items():
        best = min(g)[3]
        for *_, d in g:
            assert tuple(got[d])[1:] == (best, len(g), d == best, hashlib.sha256(k.encode()).hexdigest())
    assert exact_dedup.exact_dedup(none).isEmpty()


def test_exact_dedup_hot_key(spark):
    """One text in most rows: it spans several splitters, and is still one group."""
    data = [(k, "same text" if k % 4 else f"own {k}") for k in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = by_id(exact_dedup.exact_dedup(df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {got[d]["keep_id"] for d, t in data if t == "same text"} == {1} and got[1]["group_size"] == 300
    assert sum(r["kept"] for r in got.values()) == 101


def test_exact_dedup_is_decided_by_neighbours(spark, monkeypatch):
    """Equal digests don't make texts equal; without the sort, equal texts stay apart."""
    data = [(k, f"text {k % 50}" + " " * (k % 3)) for k in range(300)] + [(k, "hot") for k in range(300, 500)] + [(None, "hot")] * 20
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)

    def answer():
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
        try:
            return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    groups = defaultdict(list)
    for d, t in data:
        groups[squeeze(t)].append((-len(t), d is None, d or 0, d))
    right = sorted(((d, min(g)[3], len(g), d == min(g)[3]) for g in groups.values() for *_, d in g), key=str)
    assert answer() == right
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "sha256", lambda _: hashlib.sha256(b""))
        assert answer() == right
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *a, **b: self)
    assert answer() != right


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "xy"), (2, "xy"), (None, "xy")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df)
    assert got.count() == 5 and {r["keep_id"] for r in got.collect()} == {1} and got.first()["group_size"] == 5
    left = keep.without_rows(df, exact_dedup.content_digest(F.col("text")), got.withColumnRenamed("text_sha256", "key"), "t").collect()
    assert [tuple(r) for r in left] == [(1, "x y")]


# -- 6

def test_simhash(docs, none, plain):
    assert simhash.fingerprints([t or "" for t in texts()]).tolist() == [fingerprint(t) for t in texts()]
    with_id = docs.where("doc_id IS NOT NULL")
    got = by_id(simhash.simhash_components(with_id))
    pairs = [(d, fingerprint(t)) for d, t in plain.items() if d is not None]
    assert {d: r["component_id"] for d, r in got.items()} == components(pairs)
    assert all(got[d]["fingerprint"] == f"{f:016x}" for d, f in pairs)
    assert simhash.simhash_components(docs).count() == len(plain) and simhash.simhash_components(none).isEmpty()


def test_simhash_hot_fingerprint(spark):
    """Copies in most rows, ids missing among them: joined apart from the others."""
    data = [(k if k % 7 else None, "one text that most rows hold" if k % 3 else f"another text {k // 6} of some words") for k in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    pairs = sorted({(d, fingerprint(t)) for d, t in data if d is not None})
    expected = components(pairs)
    got = simhash.simhash_components(df).collect()
    assert len(got) == 1200 and {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    kept = [r["doc_id"] for r in simhash.simhash_keepers(df).where("kept").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(expected.values()))


@pytest.mark.parametrize("groups", [8, 10])
def test_simhash_more_groups(spark, groups):
    rng = random.Random(18)
    points = set()
    for _ in range(40):
        x = rng.getrandbits(63)
        points |= {x ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 4))) for _ in range(8)}
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df, Scratch(spark, "t"), groups)).collect()}
    assert {p: roots.get(p, p) for p in points} == components([(p, p) for p in sorted(points)])


@pytest.mark.parametrize("cell", [2048, 6])
def test_simhash_links(spark, monkeypatch, cell):
    """Chains and clusters of fingerprints at one to four bits, in hot cells too."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(8)
    points = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            points.append(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(df, Scratch(spark, "t"))
    roots = {r["node"]: r["root"] for r in connected_components(found).collect()}
    expected = components(sorted(zip(signed, points)))
    assert {p: roots.get(p, p) for p in signed} == expected


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(300, 400)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)] + [(5, 5), (1, 0)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_that_do_not_settle(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long"), rounds=2)


# -- 8

@pytest.mark.parametrize("base", [5, 10, 20])
def test_substring_dedup(docs, none, plain, base):
    got = by_id(substring_dedup.substring_dedup(docs, base=base))
    expected = cut_repeats([(1 << 62 if d is None else d, t) for d, t in plain.items()])
    assert {1 << 62 if d is None else d: tuple(r)[1:] for d, r in got.items()} == expected
    assert substring_dedup.substring_dedup(none).isEmpty()


@pytest.mark.parametrize("batch", [10_000, 7])
def test_substring_dedup_random(spark, batch, monkeypatch):
    rng = random.Random(6)
    data = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for k in range(150)] + [(200 + k, " ".join(["hot"] * rng.randint(15, 40))) for k in range(60)]
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = by_id(substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(5), texts=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {d: tuple(r)[1:4] for d, r in got.items()} == cut_repeats(data)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.values())


def test_words_that_break_polynomial_hashes(spark):
    """Two words of 1,024 letters that every polynomial modulo 2**64 takes for equal are different words."""
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    rest = " ".join(f"w{k}" for k in range(30))
    data = [(1, f"{rest} {a} {rest}"), (2, f"x {rest[:60]} {b} {rest[:60]}"), (3, f"{rest.upper()} {b} {rest.upper()}"), (4, f"{a} {rest}")]
    got = by_id(substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")))
    assert {d: tuple(r)[1:] for d, r in got.items()} == cut_repeats(data)


def test_substring_repeated_and_missing_ids(spark):
    """Rows that share an id, or have none: none of them is earlier than another, whatever their texts."""
    rng = random.Random(19)
    say = lambda n: " ".join(str(rng.getrandbits(30)) for _ in range(n))
    p, q = say(25), say(25)
    data = [(5, p), (5, p), (5, f"{say(5)} {p}"), (6, f"{p} {say(4)}"), (None, p), (None, q), (None, q), (None, f"{q} {say(3)}"), (7, f"{q} {q}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == sorted([(5, 25, 0), (5, 25, 0), (5, 30, 0), (6, 29, 25), (0, 25, 25), (0, 25, 25), (0, 25, 25), (0, 28, 25), (7, 50, 25)])


def test_bad_levels(docs):
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, full=20, base=3)


# -- 9

def test_language_held_out(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.language_id(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs, none, plain):
    got = by_id(language_id.language_id(docs))
    for d, t in plain.items():
        letters = any(c.isalpha() for c in t or "")
        assert (got[d]["lang_pred"], got[d]["score"] > 0) == (("en", True) if letters else ("und", False)), d
        assert got[d]["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
    assert language_id.language_id(none).isEmpty()
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_backward():
    """Posteriors and pair counts against the sum over all label paths."""
    from itertools import product

    rng = np.random.default_rng(3)
    emit, moves = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    valid = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    post, both = language_id.posteriors(emit, valid, moves)
    pairs = np.zeros((3, 3))
    for c in range(2):
        n = int(valid[:, c].sum())
        total, by_word = 0.0, np.zeros((n, 3))
        own = np.zeros((3, 3))
        for path in product(range(3), repeat=n):
            w = math.exp(sum(emit[t, c, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                by_word[t, y] += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        assert np.allclose(post[:n, c], by_word / total)
        pairs += own / total
    assert np.allclose(language_id.pair_counts(both, valid, moves), pairs)


@pytest.mark.parametrize("steps", [1024, 3])
def test_whole_chains(monkeypatch, steps):
    """Chains of any lengths at once, in blocks of steps: the same posteriors as those of each chain alone."""
    monkeypatch.setattr(language_id, "STEPS", steps)
    rng = np.random.default_rng(4)
    emit, moves = rng.normal(size=(50, 3)), rng.normal(size=(3, 3))
    lens = sorted(rng.integers(1, 12, 9).tolist(), reverse=True)
    chains = [rng.integers(0, 50, n) for n in lens]
    widths = np.array([sum(n > t for n in lens) for t in range(lens[0])])
    flat = np.array([c[t] for t in range(lens[0]) for c in chains if len(c) > t])
    got = language_id.posterior_sums(flat, widths, np.exp(emit), moves)
    for c, sums in zip(chains, got):
        post, _ = language_id.posteriors(emit[c][:, None, :], np.ones((len(c), 1), bool), moves)
        assert np.allclose(sums, post.sum(axis=(0, 1)))


def test_words_of_texts():
    assert language_id.words_of("M² x½ a_b don't 12 é") == ["m", "x", "a", "b", "don", "t", "é"]
    assert language_id.words_of("a" * 100 + " b") == ["a" * 48, "a" * 48, "aaaa", "b"]
    assert language_id.words_of("12 ½ ² _") == []


def test_letters_beside_digits_and_long_words():
    rng = random.Random(20)
    say = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    a, b = ["the", "thing", "with", "that", "nothing"], ["le", "queeau", "mentoi", "elle", "deaux"]
    model = language_id.train([("en", say(a, 60)) for _ in range(40)] + [("fr", say(b, 60)) for _ in range(40)])
    tagger = language_id.Tagger(model)
    got = tagger.tag(["m²", "x½", "½", "the²", "x" * 50 + "withthatnothingthing" * 30, "x" * 50 + "queeaumentoielledeaux" * 30])
    assert [g[0] != "und" and g[1] > 0 for g in got] == [True, True, False, True, True, True]
    assert [g[0] for g in got[3:]] == ["en", "en", "fr"]
    # a long text is one chain: its score doesn't depend on where it would be cut, and both halves count
    assert tagger.tag([say(a, 3000) + " " + say(b, 2000)])[0] == ("en", pytest.approx(0.6, abs=0.01))


def test_lexicons_decide():
    """A word whose letters say nothing: only its language's lexicon does."""
    lexicon = language_id.lexicons([(0, ["zz"] * 5 + ["qq"] * 2), (1, ["qq"] * 9 + ["zz"])])
    assert lexicon == {"zz": ["#0"], "qq": ["#1"]}
    model = language_id.train([("en", "zz the " * 20)] * 5 + [("fr", "qq le " * 20)] * 5)
    weight = {f: model.weights[i] for f, i in model.index.items()}
    assert model.lexicon["zz"] == ["#0"] and weight["#0"][0] > weight["#0"][1] and weight["#1"][1] > weight["#1"][0]


def test_language_sample_has_every_language(spark):
    """More languages than one, one of them rare, ids that repeat: each is learned from, none from the held-out fold."""
    rng = random.Random(21)
    vocab = {x: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30)] for x in ("aa", "bb", "cc")}
    data = [(k % 2900, " ".join(rng.choice(vocab[x]) for _ in range(12)), x) for k in range(3000) for x in [("aa", "bb")[k % 2] if k % 100 else "cc"]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(df, per_lang=20, most_texts=90)
    assert model.langs == ["aa", "bb", "cc"]
    got = language_id.predict(df, model).join(df.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.9 * len(got)


def test_code_switch():
    rng = random.Random(1)
    a, b = ["the", "thing", "with", "that", "nothing"], ["le", "queeau", "mentoi", "elle", "deaux"]
    say = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    tagger = language_id.Tagger(language_id.train([("en", say(a, 60)) for _ in range(40)] + [("fr", say(b, 60)) for _ in range(40)]), cap=8)
    got = tagger.tag([say(a, 20), say(b, 20), say(a, 5) + " " + say(b, 30), "", "12 !"])
    assert [g[0] for g in got] == ["en", "fr", "fr", "und", "und"] and got[2][1] < got[1][1]


# -- 10

@pytest.mark.parametrize("seq_len", [64, 2048])
def test_token_files(spark, docs, none, plain, seq_len):
    tk = Tokenizer.from_file(WORDS)
    order = sorted(plain, key=lambda d: (d is not None, d or 0))
    ids = {d: tk.encode(plain[d] or "", add_special_tokens=False).ids + [1] for d in order}
    at, expected = 0, {}
    for d in order:
        expected[d] = (at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
        at += len(ids[d])
    files = token_files.write_token_files(docs, WORDS, Scratch(spark, "t").path("arrow"), seq_len)
    assert {d: tuple(r)[1:] for d, r in by_id(token_files.read_token_files(files)).items()} == expected
    stream = [x for d in order for x in ids[d]]
    for shard, _, n, start in files.shards.collect():
        seen, row = [], 0
        while len(seen) < n:
            seq, mask = token_files.sequence(files, shard, row)
            assert len(seq) == seq_len
            seen += seq[mask].tolist()
            row += 1
        assert seen == stream[start : start + n]
        with pytest.raises(IndexError):
            token_files.sequence(files, shard, row)
    assert token_files.token_files(none, WORDS).isEmpty()


def test_repeated_ids_stay(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (0, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in token_files.token_files(df, WORDS).collect()) == [(0, 0, 1), (1, 1, 2), (1, 3, 2), (1, 5, 2)]
    assert packing.pack_documents(df, WORDS).count() == 4
    assert SCHEMA


def test_repeated_ids_and_rows_everywhere(spark):
    """Ids that repeat, with equal and other texts, and missing ids: a row for each row, from its own text."""
    long = " ".join(f"word{k}" for k in range(60))
    data = [(1, long, "en"), (1, long, "en"), (1, "other text", "en"), (None, long, None), (None, long, None), (None, None, "fr"), (2, "", "fr")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    tk = Tokenizer.from_file(BYTE)
    n = {t: len(tk.encode(t or "", add_special_tokens=False).ids) for _, t, _ in data}
    key = lambda rows: sorted(rows, key=str)
    assert key((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(df, BYTE).collect()) == key((d, n[t]) for d, t, _ in data)
    assert key((r["doc_id"], r["n_tokens"]) for r in bpe_codec.round_trip(df, BYTE).collect()) == key((d, n[t]) for d, t, _ in data)
    words_ = quality.quality(df, df.select("doc_id")).collect()
    assert key((r["doc_id"], r["n_words"], r["base_failed"]) for r in words_) == key((d, len((t or "").split()), len((t or "").split()) < 50) for d, t, _ in data)
    assert key((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()) == key([(1, 1), (1, 1), (1, 1), (None, 1), (None, 1), (None, 2), (2, 2)])
    assert key((r["doc_id"], r["lang_pred"] == "und") for r in language_id.language_id(df).collect()) == key((d, not t) for d, t, _ in data)
    assert key((r["doc_id"], r["spans"]) for r in secret_scan.secret_spans(df).collect()) == key((d, "") for d, _, _ in data)
    assert packing.pack_documents(df, WORDS).count() == len(data)
