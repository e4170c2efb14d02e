"""Registered queries of the reference's operators over the shared tables, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.operators import aggregate as A
from tallyforge.operators import diff as D
from tallyforge.operators import graph as G
from tallyforge.operators import impact as I
from tallyforge.operators import quality as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries that SQL is too slow for; tests hold them against brute force.
WITHOUT_SQL: dict[str, Query] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        (QUERIES if sql else WITHOUT_SQL)[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Supplier to part statements stand for dependencies between files; the return flag is the kind of a statement.
STATEMENTS = "SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS kind FROM lineitem"


def statements(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source")
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")
    return t(spark, d, "lineitem").select(s, p, F.col("l_returnflag").alias("kind"))


# A cyclic graph: parts that follow one another in an order; every row of lineitem, whole part keys.
FOLLOWS = """g AS (
  SELECT DISTINCT source, target FROM (
    SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem
  ) WHERE target IS NOT NULL
)"""


def follows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"))
    return e.filter("target IS NOT NULL").distinct()


# Parts as files: counts of statements as measures.
FACTS = """facts AS (
  SELECT l_partkey AS part, count(*) AS cc, count(DISTINCT l_suppkey) AS deps, count(*) FILTER (l_returnflag = 'R') AS anys,
    count(*) FILTER (l_linestatus = 'F') AS hooks, sum(l_quantity)::BIGINT AS lines FROM lineitem GROUP BY l_partkey
)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.count(F.lit(1)).alias("cc"), F.countDistinct("l_suppkey").alias("deps"), F.count_if(F.col("l_returnflag") == "R").alias("anys"),
        F.count_if(F.col("l_linestatus") == "F").alias("hooks"), F.sum("l_quantity").cast("long").alias("lines"),
    )


SIZE_SQL = "CASE WHEN lines <= 100 THEN 'S' WHEN lines <= 300 THEN 'M' ELSE 'L' END"
CC_SQL = "CASE WHEN cc <= 6 THEN '1' WHEN cc <= 12 THEN '2' ELSE '3' END"
WEIGHT_SQL = "CASE code WHEN 'L3' THEN 18 WHEN 'M3' THEN 12 WHEN 'L2' THEN 10 WHEN 'S3' THEN 8 WHEN 'M2' THEN 6 WHEN 'L1' THEN 4 WHEN 'S2' THEN 3 ELSE 1 END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("code", E.cluster_code(E.size_band("lines"), E.complexity_band("cc")))
    return f.withColumn("score", E.hotspot_score("cc", "deps", "anys", "hooks", E.cluster_weight("code")))


SCORED = f"""{FACTS}, coded AS (SELECT *, {SIZE_SQL} || {CC_SQL} AS code FROM facts),
scored AS (SELECT *, 5 * cc + 2 * deps + 4 * anys + hooks + {WEIGHT_SQL} AS score FROM coded)"""


@register(f"WITH {SCORED} SELECT part, code, score::BIGINT AS score, CASE WHEN score >= 120 THEN 'Critical' WHEN score >= 80 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS severity FROM scored ORDER BY score DESC, part LIMIT 50")
def hotspot_topk_parts(spark, d):
    return D.top(scored(spark, d), "score", "part", 50).select("part", "code", F.col("score").cast("long").alias("score"), E.hotspot_severity("score").alias("severity"))


@register(f"WITH {SCORED}, m AS (SELECT a || b AS cluster FROM (SELECT unnest(['S','M','L']) AS a), (SELECT unnest(['1','2','3']) AS b)) SELECT cluster, count(part) AS n FROM m LEFT JOIN coded ON cluster = code GROUP BY cluster")
def doc_size_matrix(spark, d):
    return A.size_matrix(facts(spark, d), E.size_band("lines"), E.complexity_band("cc"))


@register("""SELECT lang, n, n / total AS share, avg_chars FROM (SELECT lang, count(*) AS n, avg(n_chars) AS avg_chars FROM documents GROUP BY lang), (SELECT count(*) AS total FROM documents)""")
def doc_type_distribution(spark, d):
    out = A.distribution(t(spark, d, "documents"), "lang", "n_chars")
    return out.withColumnRenamed("avg_n_chars", "avg_chars")


@register(f"""WITH {FACTS}, r AS (SELECT CASE WHEN cc <= 6 THEN 'low' WHEN cc <= 12 THEN 'medium' ELSE 'high' END AS a, CASE WHEN 4 * anys <= 0 THEN 'low' WHEN 4 * anys <= 4 THEN 'medium' ELSE 'high' END AS b,
  CASE WHEN s <= 8 THEN 'low' WHEN s <= 18 THEN 'medium' ELSE 'high' END AS c FROM (SELECT *, 2 * deps + hooks + CASE WHEN lines > 300 THEN 4 WHEN lines > 100 THEN 2 ELSE 0 END AS s FROM facts)),
u AS (SELECT 'complexity' AS axis, a AS v FROM r UNION ALL SELECT 'typeSafety', b FROM r UNION ALL SELECT 'structure', c FROM r)
SELECT axis, count(*) FILTER (v = 'low') AS low, count(*) FILTER (v = 'medium') AS medium, count(*) FILTER (v = 'high') AS high FROM u GROUP BY axis""")
def risk_breakdown_axes(spark, d):
    zero = F.lit(0)
    f = facts(spark, d)
    axes = {
        "complexity": E.complexity_risk("cc"),
        "typeSafety": E.type_safety_risk(E.type_safety_score("anys", zero, zero, zero, zero, zero, zero, zero, zero)),
        "structure": E.structure_risk(E.structure_score("deps", "hooks", "lines")),
    }
    return A.level_counts(f, axes)


@register(f"WITH {FACTS} SELECT part, CASE WHEN 4 * anys >= cc AND 4 * anys >= s AND anys > 0 THEN 'typeSafety' WHEN cc >= s THEN 'complexity' ELSE 'structure' END AS axis FROM (SELECT *, 2 * deps + hooks + CASE WHEN lines > 300 THEN 4 WHEN lines > 100 THEN 2 ELSE 0 END AS s FROM facts)")
def primary_axis(spark, d):
    return facts(spark, d).select("part", E.primary_axis(4 * F.col("anys"), "cc", E.structure_score("deps", "hooks", "lines")).alias("axis"))


@register(f"WITH {FACTS} SELECT part, concat_ws(',', CASE WHEN cc >= 35 THEN 'complexity-threshold-exceeded' END, CASE WHEN anys > 0 THEN 'explicit-any-usage' END, CASE WHEN deps > 20 THEN 'high-dependency-count' END) AS warnings FROM facts")
def warnings_array(spark, d):
    return facts(spark, d).select("part", F.array_join(E.file_warnings("cc", F.lit(35), "anys", "deps"), ",").alias("warnings"))


@register("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, avg(value) AS avg_value, count(*) FILTER (value > 50) AS n_with FROM events GROUP BY event_type")
def hook_usage_like(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.avg("value").alias("avg_value"), F.count_if(F.col("value") > 50).alias("n_with")
    )


@register(f"WITH s AS ({STATEMENTS}) SELECT source, target, count(*) AS weight, array_to_string(list_sort(list(DISTINCT kind)), ',') AS types FROM s GROUP BY source, target")
def edge_collapse(spark, d):
    return G.collapse_edges(statements(spark, d), "source", "target", "kind").select("source", "target", "weight", F.array_join("types", ",").alias("types"))


@register(f"""WITH s AS (SELECT DISTINCT source, target FROM ({STATEMENTS})), u AS (SELECT source AS id, 1 AS o, 0 AS i FROM s UNION ALL SELECT target, 0, 1 FROM s)
SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM u GROUP BY id ORDER BY in_degree + out_degree DESC, id LIMIT 100""")
def degree_topk(spark, d):
    out = G.degrees(statements(spark, d).select("source", "target").distinct())
    return out.orderBy((F.col("in_degree") + F.col("out_degree")).desc(), "id").limit(100)


REACH = f"WITH RECURSIVE {FOLLOWS}, r AS (SELECT source AS a, target AS b FROM g UNION SELECT r.a, g.target FROM r JOIN g ON r.b = g.source), n AS (SELECT source AS id FROM g UNION SELECT target FROM g)"
SCC = f"{REACH}, c AS (SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS component FROM n LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON r.a = q.b AND r.b = q.a) x ON n.id = x.a GROUP BY n.id)"


@register(f"{SCC} SELECT id, component FROM c")
def scc_components(spark, d):
    return G.strong_components(follows(spark, d))


@register(f"""WITH RECURSIVE {FOLLOWS}, u AS (SELECT source, target FROM g UNION SELECT target, source FROM g), r AS (SELECT source AS a, source AS b FROM u UNION SELECT r.a, u.target FROM r JOIN u ON r.b = u.source)
SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def wcc_components(spark, d):
    return G.weak_components(follows(spark, d))


@register(f"""{SCC} SELECT component, length, count(*) AS edge_count, CASE WHEN length >= 6 THEN 'critical' WHEN length >= 3 THEN 'high' ELSE 'medium' END AS severity
FROM g JOIN c x ON g.source = x.id JOIN (SELECT component AS k, count(*) AS length FROM c GROUP BY component) s ON x.component = s.k JOIN c y ON g.target = y.id AND x.component = y.component GROUP BY component, length""".replace("SELECT component, length", "SELECT x.component AS component, length").replace("GROUP BY component, length", "GROUP BY x.component, length"))
def cycle_report(spark, d):
    e = follows(spark, d)
    return G.cycles(e, G.strong_components(e))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"WITH {FOLLOWS}", "o AS (SELECT source, count(*) AS k FROM g GROUP BY source)", "n AS (SELECT id, coalesce(k, 0) AS k FROM (SELECT source AS id FROM g UNION SELECT target FROM g) LEFT JOIN o ON id = source)", "z AS (SELECT count(*)::DOUBLE AS n FROM n)"]
    parts.append("r0 AS MATERIALIZED (SELECT id, k, 1 / z.n AS r FROM n, z)")
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT x.id, x.k, 0.15::DOUBLE / z.n + 0.85::DOUBLE * (coalesce(c.got, 0) + s.sink / z.n) AS r FROM r{i} x
          LEFT JOIN (SELECT g.target, sum(y.r / y.k) AS got FROM g JOIN r{i} y ON g.source = y.id GROUP BY g.target) c ON x.id = c.target, z, (SELECT coalesce(sum(r), 0) AS sink FROM r{i} WHERE k = 0) s)""")
    return ",\n".join(parts) + f" SELECT id, round(r * 1e9)::BIGINT AS rank_e9 FROM r{rounds}"


@register(_pagerank_sql(8))
def pagerank(spark, d):
    return G.pagerank(follows(spark, d), 8, stop=None).select("id", F.round(F.col("page_rank") * 1e9).cast("long").alias("rank_e9"))


ACYCLIC = f"{FOLLOWS}, a AS (SELECT source, target FROM g WHERE source < target)"


@register(f"WITH RECURSIVE {ACYCLIC}, r AS (SELECT id, 0 AS layer FROM (SELECT source AS id FROM a UNION SELECT target FROM a) UNION SELECT a.target, r.layer + 1 FROM r JOIN a ON r.id = a.source) SELECT id, max(layer) AS layer FROM r GROUP BY id")
def topo_layers(spark, d):
    return G.topological_layers(follows(spark, d).filter("source < target"))


NEAR = f"""WITH {FOLLOWS}, u AS (SELECT source, target FROM g WHERE source <> target UNION SELECT target, source FROM g WHERE source <> target), k AS (SELECT DISTINCT source AS root FROM g),
h AS (SELECT root, root AS id, 0 AS dist FROM k UNION ALL SELECT root, u.target, 1 FROM k JOIN u ON root = u.source UNION ALL SELECT root, v.target, 2 FROM k JOIN u ON root = u.source JOIN u v ON u.target = v.source)"""


@register(f"{NEAR} SELECT root, id, min(dist) AS distance FROM h GROUP BY root, id")
def impact_two_hop(spark, d):
    e = G.cut(follows(spark, d), "follows")
    return G.neighbourhood(e, e.select(F.col("source").alias("id")).distinct())


@register(f"""{NEAR}, dist AS (SELECT id, min(dist) AS distance FROM h GROUP BY id), i AS (SELECT target AS id, count(*) AS k FROM g GROUP BY target), o AS (SELECT source AS id, count(*) AS k FROM g GROUP BY source)
SELECT dist.id, distance::BIGINT AS distance, (CASE WHEN distance = 0 THEN 100 ELSE 0 END + greatest(0, 50 - 12 * distance) + 5 * coalesce(i.k, 0) + 4 * coalesce(o.k, 0))::BIGINT AS score FROM dist LEFT JOIN i ON dist.id = i.id LEFT JOIN o ON dist.id = o.id""")
def impact_scores(spark, d):
    e = follows(spark, d)
    return G.impact_scores(e, e.select(F.col("source").alias("id")).distinct())


@register(f"""WITH RECURSIVE {FOLLOWS}, u AS (SELECT source, target FROM g WHERE source <> target UNION SELECT target, source FROM g WHERE source <> target), w AS (
  SELECT p_partkey AS id, 0 AS d FROM part WHERE p_size = 7 UNION SELECT u.target, d + 1 FROM w JOIN u ON w.id = u.source WHERE d < 3
) SELECT p_partkey AS path, coalesce(min(d), 99)::INT AS distance FROM part LEFT JOIN w ON p_partkey = w.id GROUP BY p_partkey""")
def change_distances(spark, d):
    parts = t(spark, d, "part")
    return I.distance_to(follows(spark, d), parts.filter("p_size = 7").select(F.col("p_partkey").alias("path")), parts.select(F.col("p_partkey").alias("path")), 3)


WEEK = "SELECT user_id, event_type, count(*) AS n FROM events WHERE {} GROUP BY user_id, event_type"


def _orders(spark, d, late: bool) -> DataFrame:
    o = t(spark, d, "orders")
    o = o.filter(F.col("o_orderdate") >= F.lit("1998-05-01").cast("timestamp_ntz")) if late else o.filter(F.col("o_orderdate") < F.lit("1998-05-01").cast("timestamp_ntz"))
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))


SNAP = """cur AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders WHERE o_orderdate >= '1998-05-01' GROUP BY 1),
base AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders WHERE o_orderdate < '1998-05-01' GROUP BY 1),
j AS (SELECT coalesce(cur.k, base.k) AS custkey, coalesce(cur.n, 0) - coalesce(base.n, 0) AS d_n_orders, coalesce(cur.f, 0) - coalesce(base.f, 0) AS d_n_final, CASE WHEN base.k IS NULL THEN 'added' WHEN cur.k IS NULL THEN 'removed' WHEN cur.n <> base.n OR cur.f <> base.f THEN 'changed' ELSE 'unchanged' END AS status FROM cur FULL OUTER JOIN base ON cur.k = base.k)"""


@register(f"WITH {SNAP} SELECT custkey, status, d_n_orders, d_n_final FROM j")
def snapshot_diff_customers(spark, d):
    return D.snapshot_diff(_orders(spark, d, True), _orders(spark, d, False), "custkey", ["n_orders", "n_final"])


@register(f"WITH {SNAP} SELECT count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'unchanged') AS n_unchanged FROM j")
def snapshot_diff_summary(spark, d):
    return D.status_counts(snapshot_diff_customers(spark, d))


@register(f"""WITH {SNAP}, a AS (SELECT k, n FROM cur ORDER BY n DESC, k LIMIT 20), b AS (SELECT k, n FROM base ORDER BY n DESC, k LIMIT 20)
SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'unchanged' END AS status, coalesce(a.n, 0) - coalesce(b.n, 0) AS score_delta FROM a FULL OUTER JOIN b ON a.k = b.k""")
def topk_diff(spark, d):
    return D.topk_diff(_orders(spark, d, True), _orders(spark, d, False), "custkey", "n_orders", 20)


def _half(spark, d, late: bool) -> DataFrame:
    e = t(spark, d, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    e = e.filter(F.col("ts") >= middle) if late else e.filter(F.col("ts") < middle)
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


HALVES = f"c AS ({WEEK.format("ts >= '2024-01-16'")}), b AS ({WEEK.format("ts < '2024-01-16'")})"


@register(f"""WITH {HALVES}, j AS (SELECT coalesce(c.user_id, b.user_id) AS user_id, coalesce(c.event_type, b.event_type) AS event_type, c.n AS x, b.n AS y FROM c FULL OUTER JOIN b ON c.user_id = b.user_id AND c.event_type = b.event_type)
SELECT user_id, event_type, CASE WHEN y IS NULL THEN event_type || '=+' || x WHEN x IS NULL THEN event_type || '=-' || y ELSE event_type || '=' || y || ' → ' || x END AS change FROM j WHERE x IS DISTINCT FROM y""")
def driver_kv_diff(spark, d):
    return D.keyed_difference(_half(spark, d, True), _half(spark, d, False), "user_id", "event_type", "n")


@register(f"""WITH {HALVES}, x AS (SELECT user_id, list_sort(list(event_type)) AS l FROM c GROUP BY user_id), y AS (SELECT user_id, list_sort(list(event_type)) AS l FROM b GROUP BY user_id)
SELECT coalesce(x.user_id, y.user_id) AS user_id, array_to_string(list_concat(list_transform(list_filter(coalesce(x.l, []), lambda v: NOT list_contains(coalesce(y.l, []), v)), lambda v: '+' || v),
  list_transform(list_filter(coalesce(y.l, []), lambda v: NOT list_contains(coalesce(x.l, []), v)), lambda v: '-' || v)), ',') AS difference FROM x FULL OUTER JOIN y ON x.user_id = y.user_id""")
def string_set_diff(spark, d):
    c = _half(spark, d, True).groupBy("user_id").agg(F.array_sort(F.collect_list("event_type")).alias("x"))
    b = _half(spark, d, False).groupBy(F.col("user_id").alias("u")).agg(F.array_sort(F.collect_list("event_type")).alias("y"))
    j = c.join(b, F.col("user_id") == F.col("u"), "full_outer")
    return j.select(F.coalesce("user_id", "u").alias("user_id"), F.array_join(D.list_difference(F.col("x"), F.col("y")), ",").alias("difference"))


@register("""WITH c AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'runtime' WHEN o_orderpriority LIKE '1%' THEN 'test' ELSE 'dev' END AS context, c_mktsegment AS name FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT context, name, count(*) AS n FROM c GROUP BY context, name) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, name) AS rank FROM n) WHERE rank <= 3""")
def external_context_topk(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    context = F.when(F.col("o_orderstatus") == "F", "runtime").when(F.col("o_orderpriority").startswith("1"), "test").otherwise("dev")
    return A.usage_by_context(j.select(context.alias("context"), F.col("c_mktsegment").alias("name")), "context", "name", 3)


@register("SELECT count(DISTINCT trim(p_brand)) AS n_packages FROM part WHERE trim(p_brand) <> ''")
def distinct_packages(spark, d):
    return t(spark, d, "part").filter(F.trim("p_brand") != "").agg(F.countDistinct(F.trim("p_brand")).alias("n_packages"))


@register("""SELECT lang, count(*) AS n_targets, count(*) FILTER (quality = 1) AS n_matched, sum(CASE WHEN quality = 1 THEN w ELSE 0 END) / sum(w) * 100.0::DOUBLE AS rate
FROM (SELECT lang, quality, CASE WHEN n_chars > 3000 THEN 3 WHEN n_chars > 1000 THEN 2 ELSE 1 END AS w FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang""")
def weighted_presence_rate(spark, d):
    j = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    w = F.when(F.col("n_chars") > 3000, 3).when(F.col("n_chars") > 1000, 2).otherwise(1)
    return A.weighted_rate(j, F.coalesce(F.col("quality") == 1, F.lit(False)), w, "lang")


@register("""SELECT doc_id, CASE WHEN l.id IS NOT NULL THEN 'runtime' WHEN s.id IS NOT NULL THEN 'static' ELSE 'none' END AS matched_by FROM documents
LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels) l ON doc_id = l.id LEFT JOIN (SELECT DISTINCT doc_id AS id FROM documents WHERE text LIKE '%License%') s ON doc_id = s.id""")
def evidence_priority_join(spark, d):
    docs = t(spark, d, "documents")
    static = docs.filter(F.col("text").contains("License")).select("doc_id")
    return A.evidence(docs.select("doc_id"), "doc_id", [("runtime", t(spark, d, "labels").select("doc_id")), ("static", static)])


@register("""SELECT doc_id, rule, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, FROM documents) x,
LATERAL (SELECT trim(raw) AS text, unnest(list_filter([CASE WHEN regexp_matches(raw, '[Ll]icense') THEN 'license' END, CASE WHEN regexp_matches(raw, '[a-z0-9._]+@[a-z0-9.]+') THEN 'email' END, CASE WHEN regexp_matches(raw, 'https?://') THEN 'url' END], lambda v: v IS NOT NULL)) AS rule)""")
def text_findings(spark, d):
    rules = {"license": "[Ll]icense", "email": "[a-z0-9._]+@[a-z0-9.]+", "url": "https?://"}
    return A.findings(t(spark, d, "documents"), "doc_id", "text", rules)


@register("SELECT event_type, count(*) AS n, count(*) FILTER (k >= 50) AS n_high, max(k) AS k_max FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY event_type")
def json_field_counts(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") >= 50).alias("n_high"), F.max("k").alias("k_max")
    )


@register("SELECT l_orderkey AS orderkey, max((l_quantity, l_linenumber)).l_quantity AS found, max((l_quantity, l_linenumber)).l_linenumber AS hit FROM lineitem GROUP BY l_orderkey".replace("max((l_quantity, l_linenumber)).l_quantity", "max(l_quantity)").replace("max((l_quantity, l_linenumber)).l_linenumber", "arg_max(l_linenumber, {'a': l_quantity, 'b': l_linenumber})"))
def record_parse(spark, d):
    best = F.max(F.struct("l_quantity", "l_linenumber")).alias("m")
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(best).select("orderkey", F.col("m.l_quantity").alias("found"), F.col("m.l_linenumber").alias("hit"))


@register("SELECT page_id, pos, target, n FROM (SELECT page_id, unnest(l) AS target, unnest(range(len(l))) AS pos, len(l) AS n FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1) AS l FROM pages))")
def href_dependency_extract(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)
    rows = t(spark, d, "pages").select("page_id", found.alias("l"))
    return rows.select("page_id", F.posexplode("l").alias("pos", "target"), F.size("l").alias("n")).withColumn("pos", F.col("pos").cast("long")).withColumn("n", F.col("n").cast("long"))


@register("SELECT p_brand AS brand, p_size AS peak, arg_min(p_partkey, p_partkey) AS at FROM part JOIN (SELECT p_brand AS b, max(p_size) AS m FROM part GROUP BY p_brand) ON p_brand = b AND p_size = m GROUP BY p_brand, p_size")
def peak_part(spark, d):
    return A.peak(t(spark, d, "part"), "p_brand", "p_size", "p_partkey").withColumnRenamed("p_brand", "brand")


@register("SELECT custkey, avg(p) AS top_mean FROM (SELECT o_custkey AS custkey, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS n FROM orders) WHERE n <= 3 GROUP BY custkey".replace("avg(p)", "round(avg(p), 4)"))
def score_breakdown(spark, d):
    out = A.top_mean(t(spark, d, "orders"), "o_custkey", "o_totalprice")
    return out.select(F.col("o_custkey").alias("custkey"), F.round("top_mean", 4).alias("top_mean"))


@register("""SELECT c.k AS custkey, CASE WHEN b.k IS NULL THEN 'new' WHEN c.n = b.n THEN 'reused' ELSE 'changed' END AS state FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= '1998-05-01' GROUP BY 1) c
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < '1998-05-01' GROUP BY 1) b ON c.k = b.k""")
def incremental_cache_hits(spark, d):
    return A.cache_hits(_orders(spark, d, True), _orders(spark, d, False), "custkey", ["n_orders"])


@register("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT c_custkey || ':' || md5(c_name) AS line FROM customer)")
def file_set_fingerprint(spark, d):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(":"), F.md5(F.col("c_name").cast("binary")))
    rows = t(spark, d, "customer").select(line.alias("line"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("fingerprint"))


@register("""WITH n AS (SELECT DISTINCT p_brand AS name FROM part) SELECT a.name AS unknown, arg_min(b.name, levenshtein(a.name, b.name)::VARCHAR || b.name) AS suggestion, min(levenshtein(a.name, b.name))::INT AS distance
FROM n a JOIN n b ON a.name <> b.name AND levenshtein(a.name, b.name) < 3 GROUP BY a.name""")
def levenshtein_suggest(spark, d):
    names = t(spark, d, "part").select(F.col("p_brand").alias("name"))
    return A.suggestions(names, names)


# One metric per event type and measure, with thresholds
METRICS = """m AS (SELECT event_type AS category, 'mean_value' AS id, avg(value) AS v FROM e GROUP BY 1 UNION ALL SELECT event_type, 'share_high', count(*) FILTER (value > 60) / count(*) * 100.0::DOUBLE FROM e GROUP BY 1 UNION ALL SELECT event_type, 'review', NULL FROM e GROUP BY 1),
q AS (SELECT category, category || '.' || id AS id, 'primary' AS aggregation, CASE WHEN v IS NULL THEN 'manual' ELSE 'automatic' END AS automation, CASE WHEN v IS NULL THEN '-' ELSE floor(v * 100 + 0.5)::BIGINT::VARCHAR END AS actual,
  CASE id WHEN 'mean_value' THEN '<= 4000' WHEN 'share_high' THEN '>= 3500' ELSE '-' END AS threshold,
  CASE WHEN v IS NULL THEN 'manual' WHEN id = 'mean_value' THEN CASE WHEN v <= 40 THEN 'pass' WHEN v <= 52 THEN 'warn' ELSE 'fail' END ELSE CASE WHEN v >= 35 THEN 'pass' WHEN v >= 20 THEN 'warn' ELSE 'fail' END END AS verdict FROM m)"""


def _metric_table(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.col("event_type").alias("category")).agg(F.avg("value").alias("mean_value"), E.ratio(F.count_if(F.col("value") > 60), F.count(F.lit(1)), 100.0).alias("share_high"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in (("mean_value", F.col("mean_value")), ("share_high", F.col("share_high")), ("review", F.lit(None).cast("double")))])
    r = g.select("category", F.explode(rows).alias("r")).select("category", "r.name", "r.v")
    verdict = F.when(F.col("name") == "mean_value", Q.verdict_at_most(F.col("v"), 40, 52)).otherwise(Q.verdict_at_least(F.col("v"), 35, 20))
    return r.select(
        "category", F.concat("category", F.lit("."), "name").alias("id"), F.lit("primary").alias("aggregation"), F.when(F.col("v").isNull(), "manual").otherwise("automatic").alias("automation"),
        F.when(F.col("v").isNull(), "-").otherwise(F.floor(F.col("v") * 100 + 0.5).cast("string")).alias("actual"),
        F.when(F.col("name") == "mean_value", "<= 4000").when(F.col("name") == "share_high", ">= 3500").otherwise("-").alias("threshold"), verdict.alias("verdict"),
    )


ALL_E = f"WITH e AS (SELECT * FROM events), {METRICS}"


@register(f"{ALL_E} SELECT category, id, aggregation, automation, actual, threshold, verdict FROM q")
def metric_verdicts(spark, d):
    return _metric_table(t(spark, d, "events"))


CATEGORY = """g AS (SELECT category, count(*) AS n_metrics, count(*) FILTER (verdict = 'fail') AS f, count(*) FILTER (verdict = 'warn') AS w, count(*) FILTER (verdict = 'pass') AS p, count(*) FILTER (verdict = 'manual') AS m FROM q GROUP BY category),
k AS (SELECT category, n_metrics, CASE WHEN f > 0 THEN 'fail' WHEN w > 0 THEN 'warn' WHEN f + w + p = 0 THEN CASE WHEN m > 0 THEN 'manual' ELSE 'not_applicable' END WHEN m > 0 THEN 'partial' ELSE 'pass' END AS verdict FROM g)"""


@register(f"{ALL_E}, {CATEGORY} SELECT category, verdict, n_metrics FROM k")
def category_verdicts(spark, d):
    return Q.category_verdicts(metric_verdicts(spark, d))


@register(f"""{ALL_E}, {CATEGORY}, c AS (SELECT count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'warn') AS n_warn, count(*) FILTER (verdict = 'fail') AS n_fail, count(*) FILTER (verdict = 'partial') AS n_partial, count(*) FILTER (verdict = 'manual') AS n_manual, count(*) FILTER (verdict = 'not_applicable') AS n_not_applicable FROM k)
SELECT CASE WHEN n_fail > 0 THEN 'fail' WHEN n_warn > 0 THEN 'warn' WHEN n_partial > 0 OR (n_pass > 0 AND n_manual > 0) THEN 'partial' WHEN n_pass > 0 THEN 'pass' WHEN n_manual > 0 THEN 'manual' ELSE 'not_applicable' END AS verdict, * FROM c""")
def overall_verdict(spark, d):
    return Q.overall_verdict(category_verdicts(spark, d))


def _quality_pair(spark, d):
    e = t(spark, d, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return _metric_table(e.filter(F.col("ts") >= middle)), _metric_table(e.filter(F.col("ts") < middle))


def _suffixed(name: str, where: str) -> str:
    return f"e{name} AS (SELECT * FROM events WHERE {where}), " + METRICS.replace("FROM e ", f"FROM e{name} ").replace("m AS", f"m{name} AS").replace("q AS", f"q{name} AS").replace("FROM m)", f"FROM m{name})")


RANK = "CASE {} WHEN 'pass' THEN 0 WHEN 'not_applicable' THEN 0 WHEN 'partial' THEN 1 WHEN 'manual' THEN 2 WHEN 'warn' THEN 3 ELSE 4 END"
TREND = f"""WITH {_suffixed("c", "ts >= '2024-01-16'")}, {_suffixed("b", "ts < '2024-01-16'")}, j AS (SELECT qc.category, qc.id, qc.verdict AS v, qb.verdict AS w, qc.automation AS a, qb.automation AS b, TRY_CAST(qc.actual AS DOUBLE) AS x, TRY_CAST(qb.actual AS DOUBLE) AS y, CASE WHEN qc.threshold LIKE '%>%' THEN true WHEN qc.threshold LIKE '%<%' THEN false END AS up,
  qc.actual IS DISTINCT FROM qb.actual OR qc.verdict <> qb.verdict AS moved FROM qc JOIN qb ON qc.id = qb.id),
r AS (SELECT category, id, CASE WHEN moved THEN 'changed' ELSE 'unchanged' END AS status, v AS cur_verdict, w AS base_verdict, a, b, CASE WHEN w <> 'manual' AND v = 'manual' THEN 'regressed' WHEN {RANK.format("v")} > {RANK.format("w")} THEN 'regressed' WHEN {RANK.format("v")} < {RANK.format("w")} THEN 'improved'
  WHEN v = w AND v IN ('warn', 'fail') AND x IS NOT NULL AND y IS NOT NULL AND up IS NOT NULL AND x <> y THEN CASE WHEN (x > y) = up THEN 'improved' ELSE 'regressed' END ELSE 'neutral' END AS trend FROM j)"""


@register(f"{TREND} SELECT category, id, status, trend, cur_verdict, base_verdict FROM r")
def quality_trend(spark, d):
    return Q.quality_diff(*_quality_pair(spark, d)).select("category", "id", "status", "trend", "cur_verdict", "base_verdict")


@register(f"{TREND} SELECT id, cur_verdict, base_verdict FROM r WHERE trend = 'regressed' AND cur_verdict <> base_verdict AND (a = 'automatic' OR (b = 'automatic' AND a = 'manual'))")
def gate_regressions(spark, d):
    return Q.blocking_regressions(Q.quality_diff(*_quality_pair(spark, d))).select("id", "cur_verdict", "base_verdict")


@register(f"""{TREND}, f AS (SELECT count(*) AS n_failing FROM qc WHERE automation = 'automatic' AND verdict = 'fail'), g AS (SELECT count(*) AS n_regressions FROM r WHERE trend = 'regressed' AND cur_verdict <> base_verdict AND a = 'automatic')
SELECT n_failing, n_regressions, CASE WHEN n_failing > 0 OR n_regressions > 0 THEN 2 ELSE 0 END AS exit_code FROM f, g""")
def gate_decision(spark, d):
    current, baseline = _quality_pair(spark, d)
    return Q.gate(current, Q.blocking_regressions(Q.quality_diff(current, baseline)))


@register("""SELECT n.id, greatest(coalesce(a.k, 0), coalesce(b.k, 0)) AS in_degree FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) n
LEFT JOIN (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS k FROM lineitem WHERE l_shipdate >= '1998-05-01' GROUP BY 1) a ON n.id = a.id LEFT JOIN (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS k FROM lineitem WHERE l_shipdate < '1998-05-01' GROUP BY 1) b ON n.id = b.id""")
def node_merge(spark, d):
    li, cut = t(spark, d, "lineitem"), F.lit("1998-05-01").cast("timestamp_ntz")

    def side(rows):
        return rows.groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"))

    return D.merge_nodes(side(li.filter(F.col("l_shipdate") >= cut)), side(li.filter(F.col("l_shipdate") < cut))).select("id", "in_degree")


@register("SELECT coalesce(c.s, b.s) AS source, coalesce(c.t, b.t) AS target, coalesce(c.w, b.w) AS weight FROM (SELECT l_suppkey AS s, l_partkey AS t, count(*) AS w FROM lineitem WHERE l_shipdate >= '1998-05-01' GROUP BY 1, 2) c FULL OUTER JOIN (SELECT l_suppkey AS s, l_partkey AS t, count(*) AS w FROM lineitem WHERE l_shipdate < '1998-05-01' GROUP BY 1, 2) b ON c.s = b.s AND c.t = b.t")
def edge_merge(spark, d):
    li, cut = t(spark, d, "lineitem"), F.lit("1998-05-01").cast("timestamp_ntz")

    def side(rows):
        return rows.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count(F.lit(1)).alias("weight"))

    return D.merge_edges(side(li.filter(F.col("l_shipdate") >= cut)), side(li.filter(F.col("l_shipdate") < cut)))


@register(f"WITH {SCORED} SELECT part, score::BIGINT AS score FROM scored WHERE cc > 12 AND part NOT IN (SELECT part FROM scored ORDER BY score DESC, part LIMIT 5)")
def antijoin_topk(spark, d):
    s = scored(spark, d)
    return s.filter("cc > 12").join(D.top(s, "score", "part", 5).select("part"), "part", "left_anti").select("part", F.col("score").cast("long").alias("score"))
