"""The registered queries of this subpackage: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from tallyforge.llm import packing
from tallyforge.llm.bpe import digests
from tallyforge.llm.centroids import cluster
from tallyforge.llm.common import table
from tallyforge.llm.exact_dedup import exact_dedup
from tallyforge.llm.hard_negatives import hard_negatives
from tallyforge.llm.html_text import extract
from tallyforge.llm.line_dedup import THRESHOLD, dedup_lines
from tallyforge.llm.lm_mixing import score
from tallyforge.llm.mixing import mix
from tallyforge.llm.ngram_jaccard import jaccard_join
from tallyforge.llm.quality_classifier import classify
from tallyforge.llm.quality_rules import judge
from tallyforge.llm.token_file import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op2_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_chars=THRESHOLD + 1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("weight")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op2_all_lines": op2_all_lines,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_html_text": op9_html_text,
    "op10_token_file": op10_token_file,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), h AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '#' || size::VARCHAR), 1, 15))::BIGINT AS h FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM h GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s
), v AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM w
), r AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
  FROM v WINDOW o AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (SELECT left_size / left_weight FROM r WHERE cap > weight * (left_size / left_weight) ORDER BY ratio, n LIMIT 1) AS level FROM r
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t
), lump AS (
  SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM h WHERE size > 0 GROUP BY source, h
), cut AS (
  SELECT lump.source, max(lump.h) FILTER (
    upto <= target - times * source_size
    OR (upto - lump.size <= target - times * source_size
        AND (target - times * source_size) - (upto - lump.size) > upto - (target - times * source_size))) AS threshold
  FROM lump JOIN g ON lump.source IS NOT DISTINCT FROM g.source GROUP BY lump.source
)
SELECT h.doc_id, h.size, g.source_size, g.target,
  (h.size * least(2, g.times + CASE WHEN h.h <= coalesce(cut.threshold, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source LEFT JOIN cut ON h.source IS NOT DISTINCT FROM cut.source
"""

ORACLE_SQL["op7_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS n
  FROM d
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM g
"""

ORACLE_SQL["op3_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS v
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), ln AS (
  SELECT rid, source, t, unnest(lines) AS raw FROM w
), norm AS (
  SELECT rid, source, t, raw, trim(regexp_replace(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line FROM ln
), host AS (
  SELECT source, count(DISTINCT t) AS host_docs FROM d GROUP BY source
), freq AS (
  SELECT n.source, n.line FROM norm n JOIN host ON n.source IS NOT DISTINCT FROM host.source
  GROUP BY n.source, n.line, host_docs HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > least(100, host_docs * 0.02::DOUBLE)
), chars AS (
  SELECT n.rid, sum(length(raw))::BIGINT AS line_chars, coalesce(sum(length(raw)) FILTER (freq.line IS NOT NULL), 0)::BIGINT AS frequent_chars
  FROM norm n LEFT JOIN freq ON n.source IS NOT DISTINCT FROM freq.source AND n.line = freq.line GROUP BY n.rid
), b AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(frequent_chars, 0)::BIGINT AS frequent_chars
  FROM w LEFT JOIN rep ON w.rid = rep.rid LEFT JOIN chars ON w.rid = chars.rid
)
SELECT * EXCLUDE (rid), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (line_chars - frequent_chars < line_chars * 0.3::DOUBLE) AS kept FROM b
"""

ORACLE_SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON w.doc_id = c.a
"""

ORACLE_SQL["op2_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), o AS (
  SELECT rid, doc_id, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS raw FROM d)
), e AS (
  SELECT rid, doc_id, line, count(*) AS times FROM o WHERE line <> '' GROUP BY rid, doc_id, line
), f AS (
  SELECT line, min(doc_id) AS first, length(line) AS n FROM e GROUP BY line
), near AS (
  SELECT DISTINCT b.line FROM f a JOIN f b ON a.n >= 20 AND b.n >= 20 AND a.n BETWEEN b.n - 2 AND b.n + 2 AND (a.first, a.line) < (b.first, b.line)
  WHERE abs(a.n - b.n) <= 2 AND levenshtein(a.line, b.line) <= 2
), g AS (
  SELECT e.rid, sum(CASE WHEN near.line IS NOT NULL THEN 0 ELSE times - (e.doc_id = f.first)::INT END)::BIGINT AS n_equal,
    sum(CASE WHEN near.line IS NOT NULL THEN times ELSE 0 END)::BIGINT AS n_near
  FROM e JOIN f ON e.line = f.line LEFT JOIN near ON e.line = near.line GROUP BY e.rid
)
SELECT doc_id, (CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END)::BIGINT AS n_lines,
  coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN g ON d.rid = g.rid
"""

ORACLE_SQL["op11_hard_negatives"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0
), p AS (
  SELECT row, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS n FROM s WHERE same
), g AS (
  SELECT s.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY s.row, p.n ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s ON p.row = s.row AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE p.n <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 10
"""

_ROUND = """
), a{n} AS (
  SELECT vec_id, row, q, c.k, row_number() OVER (PARTITION BY row ORDER BY list_inner_product(c, c) - 2 * list_inner_product(q, c), c.k) AS n,
    (list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c))::BIGINT AS distance
  FROM v, c{n} c QUALIFY n = 1
), s{n} AS (
  SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(q) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY k, i
), c{m} AS (
  SELECT c.k, coalesce(s.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM s{n} GROUP BY k) s ON c.k = s.k"""

ORACLE_SQL["op12_centroids"] = (
    """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1)::INT AS k, q AS c FROM v QUALIFY k < 40"""
    + "".join(_ROUND.format(n=n, m=n + 1) for n in range(6))
    + """
)
SELECT vec_id, a5.k AS cluster, distance, (sum(distance) OVER (PARTITION BY a5.k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c5.c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a5 JOIN c5 ON a5.k = c5.k
"""
)
