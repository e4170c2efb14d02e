"""Operators that SQL cannot express, and the stages of the pipeline, against plain Python, numpy, SQL on their inputs and the library."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import quality_classifier as C
from tallyforge.llm import quality_rules as R
from tallyforge.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", text) if w]


def statistics(text):
    w, c = words(text), len(text)
    count = lambda chars: sum(x in chars for x in text)
    share = lambda n, least: np.log((n + least * C.PRIOR) / (c + C.PRIOR) + least)
    space, n = count(SPACE), len(w)
    return [
        np.log1p(n), np.log1p(len(set(w))), np.log1p((c - space + C.PRIOR) / (n + C.PRIOR / 5)), share(count("#*$%&<>@^~=+_{}[]\\/"), 0.01), share(count("|"), 0.01), share(count("!"), 0.01),
        share(sum(x.isupper() for x in text), 0.05), share(count("0123456789"), 0.01), np.log1p(n / (count("\n") + 1)),
    ]


def discriminant(x, y):
    """Scores of rows by two Gaussians with the module's shrinkage, solved directly."""
    n = np.array([(y == k).sum() for k in (0, 1)])
    scatter = [(x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1)]
    d = x.shape[1]
    pooled = sum(scatter) / (n.sum() - 2) + C.FLOOR * np.eye(d)

    def density(z, k):
        own = scatter[k] / (n[k] - 1) + C.FLOOR * np.eye(d) if n[k] > d else pooled
        s = (1 - C.POOL) * own + C.POOL * pooled
        s = (1 - C.DIAGONAL) * s + C.DIAGONAL * np.diag(np.diag(s))
        away = z - x[y == k].mean(0)
        return np.log((n[k] + 1) / (n.sum() + 2)) - 0.5 * (np.linalg.slogdet(s)[1] + (away * np.linalg.solve(s, away.T).T).sum(1))

    return lambda z: 1 / (1 + np.exp(density(z, 0) - density(z, 1)))


def expected_scores(docs, labels):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = {i: statistics(t or "") for i, t in docs.items()}
    known = [(rows[i], q) for i, q in labels if not held(i) and i in rows]
    model = discriminant(np.array([r for r, _ in known]), np.array([q for _, q in known]))
    return dict(zip(rows, model(np.array(list(rows.values()))), strict=True))


def test_classifier_scores_are_those_of_two_gaussians(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = expected_scores(docs, labels)
    got = {r["doc_id"]: r["score"] for r in C.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_frequent_lines_go_and_depleted_documents_too(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "host", f"Share this page {i}\n{body} only{i} {'abc' * i}") for i in range(30)] + [(100, "host", "share\n" + "Share this page 7\n" * 40 + body[:20]), (101, None, f"Share this page 9\n{body}")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in R.cleaned(d).collect()}
    assert 100 not in got and got[101] == rows[-1][2]
    assert all(got[i] == t.split("\n", 1)[1] for i, s, t in rows if i < 30)


def test_a_line_of_many_documents_is_frequent_in_any_host(spark):
    rows = [(i, "big", f"text number {'x' * i}\n" + ("Boilerplate" if i < 150 else f"own line {'y' * i}")) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = R.frequent_lines(R.base_rules(d), line_share=0.9)
    assert found.count() == 1


def test_rest_of_jaccard_loses_no_similar_pair(spark):
    """The way for sets that chose too few segments, forced for all sets."""
    import random

    from tallyforge.llm.ngram_jaccard import by_shingles, nodes_and_hot
    from tallyforge.llm.shingles import shingle_sets, text_buffer

    import pyarrow as pa

    rng = random.Random(2)
    texts = []
    for _ in range(12):
        w = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)]
        texts += [" ".join(w), " ".join(w[:55] + ["z"] * 3), " ".join(w[5:])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = nodes_and_hot(d)[0]
    named = {r["doc_id"]: r["node"] for r in nodes.collect()}
    found = {(r["a"], r["b"]) for r in by_shingles(d, nodes, nodes.select("node"), 75, block=100).collect()}
    sets = [set(s.tolist()) for s in shingle_sets(*text_buffer(pa.array(texts)))]
    want = {tuple(sorted((named[i], named[j]))) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert want and want <= found


def sql(path, text, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return con.execute(f"SELECT {columns} FROM ({text})").fetchall()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output paths of each stage over a whole small table."""
    base = tmp_path_factory.mktemp("stages")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{base}/0")
    paths = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(f"{base}/{n}"), SF).write.parquet(f"{base}/{n + 1}")
        paths[name] = (f"{base}/{n}", f"{base}/{n + 1}")
    return paths


def ids(spark, path):
    return sorted(r["doc_id"] for r in spark.read.parquet(path).select("doc_id").collect())


def test_stage_of_the_classifier(spark, stages):
    before, after = stages["quality_classifier"]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(before).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert ids(spark, after) == sorted(i for i, s in expected_scores(docs, labels).items() if s >= C.THRESHOLD)


def test_stages_of_copies(spark, stages):
    before, after = stages["exact_dedup"]
    assert ids(spark, after) == sorted(i for (i,) in sql(before, ORACLE_SQL["op7_exact_dedup"] + " WHERE n = 1", "doc_id"))
    before, after = stages["ngram_jaccard"]
    assert ids(spark, after) == sorted(i for i, c in sql(before, ORACLE_SQL["op5_ngram_jaccard"], "doc_id, component_id") if i == c)


def test_stage_of_the_mix(spark, stages):
    before, after = stages["mixing"]
    want = sorted(i for i, size, taken in sql(before, ORACLE_SQL["op1_mixing"], "doc_id, size, taken") for _ in range(taken // size if size else 1))
    assert ids(spark, after) == want


def test_stage_of_tokens(spark, stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["bpe"]
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(before).collect()}
    for r in spark.read.parquet(after).collect():
        got = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(got) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, got)).encode()).hexdigest()


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    rows = [(i, f"some words of text number {i} and more of it", "en", "s", 1, 2.5, 3) for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node int"
    for n, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= (8 if data else 0), (n, name)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(data)
