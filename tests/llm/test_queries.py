"""The registered queries over whole small tables: against SQL, the library, brute force or held-out labels."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert not differences(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= 0.95


def test_token_file_round_trip(spark):
    theirs, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op10_token_file"](spark, SF).collect()}
    for doc_id, text in sorted(documents(spark).items()):
        ids = np.array([*theirs.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got[doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_bpe_digests(spark):
    import hashlib

    theirs, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), documents(spark)
    for r in QUERIES["op6_bpe"](spark, SF).collect():
        ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pages_give_their_article(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_html_text"](spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|ul|li|div|section)\b[^>]*>", article)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


def test_pipeline_drops_junk_and_copies(spark):
    texts = documents(spark)
    kept = {r["doc_id"] for r in QUERIES["pipeline"](spark, SF).collect()}
    assert kept <= set(texts)
    squeezed = [" ".join(texts[i].split()) for i in kept]
    assert len(set(squeezed)) == len(squeezed)
