"""Quality rules with cross-document line frequency (operator 3), in DataFrame functions only.

Base rules look at each text alone. Then the lines of all texts are hashed after normalisation, and for every line and
host (source) the distinct documents that hold it are counted; lines in more documents than the host's limit are taken
as boilerplate, and a document of which too little would be left without them is rejected as depleted. Documents of one
host with the same text count once, so that exact copies alone do not make their own lines frequent.

Defined cases: null text counts as empty (no words: the base rule fails it); a null source is a host of its own;
repeated rows get a row each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, WORD, any_names, text_of, words_of, work_table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: A line is frequent in a host if more documents hold it than LINE_DOCS and than this share of the host's documents; in
#: any host, however large, if more than LINE_MOST hold it.
LINE_DOCS, LINE_SHARE, LINE_MOST = 10, 0.02, 100
#: A document is depleted if less than this share of its lines' characters is left.
LEAST_LEFT = 0.3
#: Up to so many different repeated windows a text's windows are looked up among them; beyond, they are sorted.
LOOKED_UP = 128


def normalised(line: Column) -> Column:
    """A line with white space squeezed and each run of digits as one 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, SPACE, " "), "[0-9]+", "0"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows that have words `w`: the words in windows that occur twice or more in the text."""
    n = F.size("w")
    hashed = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.withColumn("win", F.when(n >= WINDOW, F.slice(hashed, F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("win")) < F.size("win")
    rows = rows.withColumn("ordered", F.when(some, F.sort_array("win")))
    twice = F.array_distinct(F.filter("ordered", lambda v, i: v == F.get("ordered", i + 1)))
    rows = rows.withColumn("twice", F.when(F.col("ordered").isNotNull(), twice))
    looked = F.filter(F.transform("win", lambda v, i: F.when(F.array_contains("twice", v), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("pairs", F.when(F.size("twice") > LOOKED_UP, F.array_sort(F.transform("win", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    neighbour = F.filter(
        F.transform("pairs", lambda p, j: F.when((p["v"] == F.get("pairs", j + 1)["v"]) | ((j > 0) & (p["v"] == F.get("pairs", j - 1)["v"])), p["i"])),
        lambda i: i.isNotNull(),
    )
    at = F.when(F.col("twice").isNull(), F.array().cast("array<int>")).when(F.size("twice") > LOOKED_UP, neighbour).otherwise(looked)
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("win", "ordered", "twice", "pairs")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) -> rid, doc_id, source, the base counts, text_hash and lines (hash and characters)."""
    rows = docs.select("doc_id", "source", text_of().alias("t"))
    rows = rows.withColumn("w", words_of(F.col("t")))
    rows = with_repeats(rows)
    rows = rows.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    lines = F.transform("l", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.length(x).alias("c")))
    return rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "source",
        F.size("w").cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join("w", "")), F.lit(0)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.xxhash64("t", F.length("t")).alias("text_hash"), lines.alias("lines"),
    )


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(source, h) of the lines that more of a host's documents hold than its limit."""
    held = rows.select("source", "text_hash", F.explode(F.array_distinct("lines.h")).alias("h")).distinct()
    held = held.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > line_docs)
    hosts = rows.select("source", "text_hash").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
    hosts = hosts.select(F.col("source").alias("host"), "host_docs")
    over = held.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    limit = F.least(F.lit(float(max(line_docs, LINE_MOST))), F.col("host_docs") * line_share)
    return over.filter(F.col("n_docs") > limit).select(F.col("source").alias("host"), F.col("h").alias("line"))


def judge(
    docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT
) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, the base counts, base_failed, line_chars, frequent_chars, kept; a row each."""
    rows = work_table(base_rules(docs), "rules_rows")
    frequent = work_table(frequent_lines(rows, line_docs, line_share), "rules_lines")
    each = rows.select("rid", "source", F.explode("lines").alias("line_")).select("rid", "source", "line_.h", "line_.c")
    gone = each.join(frequent, F.col("source").eqNullSafe(F.col("host")) & (F.col("h") == F.col("line")), "left_semi")
    gone = gone.groupBy("rid").agg(F.sum("c").cast("long").alias("gone"))
    out = rows.join(gone, "rid", "left").withColumn("frequent_chars", F.coalesce("gone", F.lit(0)).cast("long"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("line_chars", total).withColumn("base_failed", failed)
    depleted = (F.col("line_chars") - F.col("frequent_chars")) < F.col("line_chars") * least_left
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "frequent_chars",
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def without_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """docs with the frequent lines (host, line) taken out of each text; the other columns stay."""
    rows = docs.withColumn("_rid", F.monotonically_increasing_id())
    rows = work_table(rows, "rules_texts")
    each = rows.select("_rid", "source", F.explode(F.array_distinct(F.transform(F.split(text_of(), "\n"), lambda x: F.xxhash64(normalised(x))))).alias("h"))
    bad = each.join(frequent, F.col("source").eqNullSafe(F.col("host")) & (F.col("h") == F.col("line")), "left_semi")
    bad = bad.groupBy("_rid").agg(F.collect_set("h").alias("_bad"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_bad", F.xxhash64(normalised(x)))), "\n")
    text = F.when(F.size("_bad") > 0, kept).otherwise(F.col("text"))
    return rows.join(bad, "_rid", "left").withColumn("text", text).drop("_rid", "_bad")


@any_names
def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns, without the frequent lines of their hosts.

    Rows are told apart by a hash of id, source and text; equal rows are judged alike.
    """
    rows = work_table(base_rules(docs), "rules_rows")
    frequent = work_table(frequent_lines(rows), "rules_lines")
    key = F.xxhash64("doc_id", "source", "text")
    lost = judge(docs.withColumn("doc_id", F.struct("doc_id", key.alias("k")))).filter("NOT kept").select(F.col("doc_id.k").alias("_lost")).distinct()
    kept = docs.withColumn("_key", key).join(work_table(lost, "rules_lost"), F.col("_key") == F.col("_lost"), "left_anti").drop("_key")
    return without_lines(kept, frequent)
