"""The pipeline's stages against brute force, and what they keep."""

import random

import corpus_pipeline
import duckdb
import pytest
from cases import components, fingerprint, squeeze
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meshloom.llm import quality
from meshloom.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, sf_dir, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        out.append(docs)
        f(spark, docs, sf_dir).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
    return [*out, docs]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.schema == stages[0].schema


def test_quality_stage(spark, stages, sf_dir):
    labels = table(spark, sf_dir, "labels")
    verdict = {r["doc_id"] for r in quality.quality(stages[0], quality.trusted_ids(labels)).where("kept").collect()}
    assert set(texts(stages[1])) == verdict
    junk = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(junk & verdict) <= 0.05 * len(junk)


def test_exact_stage(stages):
    best = {}
    for d, t in texts(stages[1]).items():
        k = squeeze(t)
        best[k] = min(best.get(k, (1, 0)), (-len(t), d))
    assert set(texts(stages[2])) == {d for _, d in best.values()}


def test_near_stage(stages):
    pairs = [(d, fingerprint(t)) for d, t in texts(stages[2]).items()]
    assert set(texts(stages[3])) == set(components(sorted(pairs)).values())


def by_row(rows_):
    return sorted(rows_, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_rows_are_decided_on_apart(spark, monkeypatch, small):
    """Ids that repeat with other texts, and rows without an id."""
    monkeypatch.setattr(corpus_pipeline.keep, "SMALL", small)
    rng = random.Random(6)
    say = lambda: " ".join(str(rng.getrandbits(40)) for _ in range(60))
    a, b, c, d, e = (say() for _ in range(5))
    near = lambda t: t.upper() + " "
    data = [(1, a), (1, b), (1, c), (2, c), (7, a), (7, d), (None, a), (None, e), (None, e), (None, e + " "), (3, d), (3, d)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in data], "doc_id long, text string, odd_key int").repartition(5)
    exact = corpus_pipeline.exact_duplicates(spark, df, "")
    assert exact.columns == df.columns
    assert by_row(tuple(r) for r in exact.collect()) == by_row((i, t, len(t)) for i, t in [(1, a), (1, b), (1, c), (3, d), (None, e + " ")])
    g = say()
    data = [(1, a), (1, b), (1, near(b)), (4, near(a)), (None, near(b) + "\n"), (None, g), (None, g), (None, near(g)), (5, c), (5, c)]
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, fp int").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"].lower().split()) for r in got.collect()) == sorted((i, t.split()) for i, t in [(1, a), (1, b), (0, g), (5, c)])


def test_secret_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    assert all("[SECRET]" in after[d] for d in before if before[d] != after[d])


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder whose labels trust no document: the base rules alone decide."""
    folder = f"file://{tmp_path_factory.mktemp('labels')}"
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_awkward_rows(spark, labelled):
    """Null ids and texts, equal rows, and columns named like the operators' own, through all stages."""
    rng = random.Random(23)
    say = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.getrandbits(30)) for _ in range(70))
    a, b, c, d = say(), say(), say(), say()
    secret = c + " password = AbCdEf123456789x"
    data = [(1, a), (1, a), (2, b), (2, secret), (None, a), (None, d), (None, None), (None, c + " more"), (4, ""), (5, "too short"), (6, b.upper())]
    columns = "doc_id long, text string, n_chars long, bucket int, fp long, key string, kept boolean, lang string, _row int"
    docs = spark.createDataFrame([(d, t, len(t or ""), 1, 2, "k", False, "x", 3) for d, t in data], columns).repartition(4)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, labelled)
        assert out.columns == docs.columns, name
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert left == sorted([(1, a), (2, b), (2, c + " [SECRET]"), (None, d)], key=str)  # c + " more" is three bits from the text with the secret
    assert {(r["bucket"], r["fp"], r["key"], r["kept"], r["_row"]) for r in out.collect()} == {(1, 2, "k", False, 3)}
    packed = corpus_pipeline.STAGES[-1][1](spark, out, labelled).collect()
    assert len(packed) == 4 and len({r["sequence_id"] for r in packed}) == 1


def test_stages_on_empty_tables(spark, none, labelled):
    out = none
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, labelled)
        assert out.columns == none.columns and out.isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, out, labelled).isEmpty()


def test_run(spark, stages, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.select(*key).exceptAll(stages[5].select(*key)).isEmpty() and got.count() == stages[5].count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())
