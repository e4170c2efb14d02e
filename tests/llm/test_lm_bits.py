"""bits_per_byte of every document."""

import math

import pytest

from tallyforge.llm.lm_mixing import score


def test_bits_per_byte_is_the_score_by_utf8_bytes(spark):
    texts = {1: "abc def abc", 2: "é ü", 3: "", 4: None, 5: "x" * 5000}
    d = spark.createDataFrame([*texts.items(), (6, "abc def")] + [(i, "abc def ghi") for i in range(10, 40)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in score(d).collect()}
    assert got[3]["bits_per_byte"] is None and got[4]["bits_per_byte"] is None
    for i in (1, 2, 5):
        assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] * math.log2(10) / len(texts[i].encode()), rel=1e-12)
