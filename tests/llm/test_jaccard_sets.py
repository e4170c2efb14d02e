"""Sets of the similarity join: shuffled only where rows are repeated, and then taken once."""

from pyspark.sql import functions as F

from tallyforge.llm import ngram_jaccard as J

TEXTS = [(i, f"one two three four five six seven {i // 2} nine ten eleven") for i in range(8)]


def written_sets(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes, _, _ = J.nodes_and_hot(docs)
    sets = J.node_sets(docs, nodes, nodes.select("node").distinct())
    return sets, J.work_table(sets, "test_sets")


def test_sets_are_not_shuffled_once_they_are_made(spark):
    sets, written = written_sets(spark, TEXTS)
    plan = sets._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan[: plan.index("MapInArrow")]
    assert J.each_once(written) is written and written.count() == 4


def test_repeated_rows_give_one_set(spark):
    _, written = written_sets(spark, TEXTS + TEXTS)
    assert written.count() == 8
    once = J.each_once(written)
    assert once.count() == 4 and once.select("node").distinct().count() == 4 and once.filter(F.length("s") == 0).isEmpty()
