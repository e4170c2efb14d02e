"""Graphs by number with names: the same results as by name, and statements that are shuffled by number."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import graph as G
from tallyforge.plans import project as S

SF = "/root/testdata/sf0.001"


def named(c):
    return F.concat(F.lit("src/"), F.when(c % 5 == 0, F.concat(F.reverse(c.cast("string")), F.lit("/index.ts"))).otherwise(F.concat(F.lit("n"), F.reverse(c.cast("string")), F.lit(".ts"))))


def by_name(df, *columns):
    return df.withColumns({c: named(F.col(c)) for c in columns})


def test_results_by_number_are_those_by_name(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(120), rng.randrange(120), rng.choice(["import", "export"])) for _ in range(150)] + [(400, 401, "import"), (401, 400, "export"), (500, 500, "import")]
    e = spark.createDataFrame(rows, "source long, target long, type string")
    files = spark.createDataFrame([(n, ("Route", "Utils", "Form")[n % 3], n % 7) for n in range(600)], "path long, kind string, code_lines long")
    e_named, files_named = by_name(e, "source", "target"), by_name(files, "path")
    strong, strong_named = G.strong_components(e), G.strong_components(e_named)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(G.named_components(strong, named), strong_named)
    found = G.cut_candidates(e, strong, files, named)
    assert found.count() >= 3 and same(found, G.cut_candidates(e_named, strong_named, files_named))
    pairs = [x.select("source", "target").distinct() for x in (e, e_named)]
    assert same(G.top_degrees(G.degrees(pairs[0]), name=named), G.top_degrees(G.degrees(pairs[1])))


def test_statements_are_shuffled_by_number(spark):
    rows = S.dependencies(spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Window" in line and "lead" in line]
    assert exchange and all("lead(l_partkey" in line for line in exchange)
    n = S.statements(spark, SF).withColumns({"source": S.path_of(F.col("source")), "target": S.path_of(F.col("target"))}).select("source", "target", "type")
    kept = rows.filter("NOT is_external").select("source", "target", "type")
    assert n.exceptAll(kept).isEmpty() and kept.exceptAll(n).isEmpty()
