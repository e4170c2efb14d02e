"""The deduplicated texts of operator 2, against brute force over whole lines."""

from tallyforge.llm.line_dedup import dedup_lines, deduplicated


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(texts, threshold=2, min_chars=20, equal_chars=20):
    """texts: id -> text, one row an id."""
    lines = {i: [" ".join(x.split()) for x in t.split("\n")] for i, t in texts.items()}
    first = {}
    for i in sorted(lines):
        for x in lines[i]:
            if len(x) >= equal_chars:
                first.setdefault(x, i)
    order = sorted(first, key=lambda x: (first[x], x))
    order = [x for x in order if len(x) >= min_chars]
    near = {b for n, b in enumerate(order) if any(abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold for a in order[:n])}
    out, seen = {}, set()
    for i in sorted(texts):
        equal, close = [], []
        for n, x in enumerate(lines[i], 1):
            if x in near:
                close.append(n)
            elif len(x) >= equal_chars:
                if x in seen:
                    equal.append(n)
                seen.add(x)
        out[i] = ("\n".join(r for n, r in enumerate(texts[i].split("\n"), 1) if n not in {*equal, *close}), equal, close)
    return out


A, B, C = "the first line that is long enough", "another line, also of enough letters", "a third line with  inner   spaces in it"
TEXTS = {
    1: f"{A}\nshort\n{A}\n\n  {B}  \n",
    2: f"{B}\n{C}\n{A[:-1]}\nshort",
    3: f" {C}\t\n\n{C}",
    4: f"{A}\n{B}",
    5: "",
    6: f"x\n{B}!\n{B}!\nnothing like the others at all here",
}


def test_texts_without_dropped_lines(spark):
    d = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)
    want = brute(TEXTS, equal_chars=1)
    assert {r["doc_id"]: (r["text"], r["equal_lines"], r["near_lines"]) for r in deduplicated(d).collect()} == want
    assert want[4] == ("", [1, 2], []) and want[1][0] == f"{A}\nshort\n\n  {B}  \n"
    assert {r["doc_id"]: (r["n_equal"], r["n_near"]) for r in dedup_lines(d).collect()} == {i: (len(e), len(c)) for i, (_, e, c) in want.items()}


def test_lines_of_any_length(spark):
    import random

    rng = random.Random(5)
    texts = {i: "\n".join("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(9))) for _ in range(12)) for i in range(12)} | {50: "}\n}\nOf, edti oner.", 51: "}\nOf, edti oner.\nOf edti oner"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts, min_chars=3, equal_chars=1)
    got = {r["doc_id"]: (r["text"], r["equal_lines"], r["near_lines"]) for r in deduplicated(d, min_chars=3, equal_chars=1).collect()}
    assert got == want and want[51][1:] == ([1, 2], [3])


def test_registered_query_of_all_lines(spark, tmp_path):
    from tallyforge.llm.queries import QUERIES

    spark.createDataFrame([(1, "Of, edti oner."), (2, "Of, edti oner.\n}"), (3, "}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: (r["n_lines"], r["n_equal"], r["n_near"]) for r in QUERIES["op2_all_lines"](spark, str(tmp_path)).collect()} == {1: (1, 0, 0), 2: (2, 1, 0), 3: (1, 1, 0)}


def test_within_is_the_edit_distance_of_strings_of_any_length(spark):
    import random

    from pyspark.sql import functions as F

    from tallyforge.llm.line_dedup import shares_pieces, within

    rng = random.Random(9)
    pairs = [("", ""), ("", "ab"), ("", "abc"), ("abc", "abc"), ("a", "bc"), ("ab", "ba")]
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(30)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    pairs = [p for p in pairs if abs(len(p[0]) - len(p[1])) <= 2]
    d = spark.createDataFrame(pairs, "a string, b string")
    for r in d.select("a", "b", within(F.col("a"), F.col("b"), 2).alias("w"), shares_pieces(F.col("a"), F.col("b"), 2).alias("s")).collect():
        near = distance(r["a"], r["b"]) <= 2
        assert r["w"] == near and (r["s"] or not near)


def test_hot_segments_are_compared_in_blocks(spark, monkeypatch):
    from tallyforge.llm import line_dedup as L

    monkeypatch.setattr(L, "HOT", 4)
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    texts = {i: f"the same long beginning of all lines {word(12)}\nthe same long beginning of all lines {word(3)}aaaaaaaaa" for i in range(40)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts, equal_chars=1)
    assert {r["doc_id"]: (r["text"], r["equal_lines"], r["near_lines"]) for r in L.deduplicated(d).collect()} == want
    assert any(close for _, _, close in want.values())
