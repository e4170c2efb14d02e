"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing column names, and empty tables."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm.bpe import digests
from tallyforge.llm.exact_dedup import exact_dedup, unique_documents
from tallyforge.llm.html_text import extract
from tallyforge.llm.line_dedup import dedup_lines
from tallyforge.llm.lm_mixing import score
from tallyforge.llm.mixing import mix, mixed_documents
from tallyforge.llm.ngram_jaccard import jaccard_join, one_of_each
from tallyforge.llm.quality_classifier import accepted, classify
from tallyforge.llm.quality_rules import cleaned, judge
from tallyforge.llm.token_file import round_trip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, row string, rid long, id long, line string, key string, size long, words string"
LONG = "word of a long text " * 20_000


def rows():
    own = [
        (1, "one two three four five six seven", "s1"), (2, "one two  three four five six\nseven", "s1"), (2, "one two three four five six seven", "s1"),
        (2, "one two three four five six seven", "s1"), (3, None, "s2"), (4, "", "s2"), (5, " \n\t ", None), (None, "no id at all here now", "s2"), (6, LONG, None),
        (7, "é" * 3 + " ünï", "s3"), (8, "!!! *** |||", None), (9, "A line of text that is long enough\nA line of text that is lonh enough\nx", "s1"),
    ]
    return [(i, t, None, s, None, 1, 2, "r", 3, 4, "l", "k", 5, "w") for i, t, s in own]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, docs):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (77, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
OPERATORS = {
    "mix": lambda s, d: mix(d), "lines": lambda s, d: dedup_lines(d), "rules": lambda s, d: judge(d), "classifier": lambda s, d: classify(d, labels(s, d)),
    "jaccard": lambda s, d: jaccard_join(d), "bpe": lambda s, d: digests(d, BYTES), "exact": lambda s, d: exact_dedup(d), "lm": lambda s, d: score(d),
    "tokens": lambda s, d: round_trip(d, WORDS),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_document(spark, docs, none, name):
    out = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows())
    assert OPERATORS[name](spark, none).count() == 0


@pytest.mark.parametrize("name", ["accepted", "unique", "near", "mixed"])
def test_stages_keep_columns(spark, docs, none, name):
    stage = {"accepted": lambda d: accepted(d, labels(spark, d)), "unique": unique_documents, "near": one_of_each, "mixed": mixed_documents}[name]
    assert stage(docs).columns == docs.columns
    stage(docs).count()
    assert stage(none).count() == 0


ODD_NAMES = ["_r1", "_kept", "_id", "_bad", "_key", "_lost", "a.b", "h 1", "other_3", "row", "Taken"]


@pytest.mark.parametrize("name", ["accepted", "unique", "near", "mixed", "cleaned"])
def test_stages_keep_columns_of_any_name(spark, docs, name):
    odd = docs.select("doc_id", "text", "lang", "source").withColumns({c: F.lit(i) for i, c in enumerate(ODD_NAMES)})
    stage = {"accepted": lambda d: accepted(d, labels(spark, d)), "unique": unique_documents, "near": one_of_each, "mixed": mixed_documents, "cleaned": cleaned}[name]
    out = stage(odd)
    assert out.columns == odd.columns
    for row in out.collect():
        assert list(row)[4:] == list(range(len(ODD_NAMES)))


def test_exact_groups(spark, docs):
    out = exact_dedup(docs).filter("text_sha256 = sha2('one two three four five six seven', 256)").collect()
    assert {(r["keep_id"], r["group_size"]) for r in out} == {(1, 4)}
    assert sorted((r["doc_id"], r["kept"]) for r in out) == [(1, True), (2, False), (2, False), (2, False)]
    empty = exact_dedup(docs).filter("text_sha256 = sha2('', 256)").collect()
    assert {(r["doc_id"], r["keep_id"]) for r in empty} == {(3, 3), (4, 3)}


def test_jaccard_links_equal_sets_only_with_words(spark, docs):
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join(docs).collect()}
    assert out[(2, 3)] == 1 and out[(3, 0)] == 3 and out[(4, 0)] == 4 and out[(None, 2)] is None


def test_line_dedup_finds_equal_and_near_lines(spark, docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_equal"], r["n_near"]) for r in dedup_lines(docs).filter("doc_id in (3, 4, 9)").collect()}
    assert got == {3: (0, 0, 0), 4: (0, 0, 0), 9: (3, 0, 1)}


def test_pages(spark):
    page = "<nav><a>x</a></nav><article><p>One &amp; two<br>three</p><aside>no</aside><p>End</article><footer>f</footer>"
    d = spark.createDataFrame([(1, None, page), (2, "u", None), (2, "u", ""), (None, None, "<p>" + "w " * 50)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in extract(d).collect())
    assert got == [(0, ("w " * 50).strip()), (1, "One & two three\nEnd"), (2, ""), (2, "")]
    assert extract(d.limit(0)).count() == 0


def test_mix_comes_near_targets(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int")), " ").alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    for r in mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r["taken"] - r["target"]) <= 7 and r["over"] <= 0


def test_lm_base_score_by_hand(spark):
    import math

    d = spark.createDataFrame([(i, "a b A" if i % 2 else "c") for i in range(20)], "doc_id long, text string")
    train = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = {"a": 0, "b": 0, "c": 0, None: len(train)}
    for i in train:
        for w in ("a b a" if i % 2 else "c").split():
            c[w] += 1
    n, v = sum(c.values()), sum(x > 0 for x in c.values())
    for r in score(d).collect():
        tokens = [*("a b a" if r["doc_id"] % 2 else "c").split(), None]
        assert r["n_tokens"] == len(tokens) and r["train_tokens"] == n and r["held_out"] == (r["doc_id"] not in train)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert r["score"] < 0


def test_pipeline_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard", "mixing", "bpe"]
