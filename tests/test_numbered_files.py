"""Scores and changes of files by number: the same rows as by path, and nothing but numbers as keys."""

from pyspark.sql import functions as F

from tallyforge.operators import facts as A
from tallyforge.plans import project as S
from tallyforge.plans import quality_queries as Q
from tallyforge.plans.project_queries import snapshot

SF = "/root/testdata/sf0.001"


def test_scores_by_number_are_those_by_path(spark):
    plain = A.scored_files(S.files(spark, SF), *snapshot(spark, SF))
    numbered = S.named(A.scored_files(S.numbered_files(spark, SF), *snapshot(spark, SF, numbered=True)))
    assert numbered.count() == plain.count() > 0
    assert numbered.select(*plain.columns).exceptAll(plain).isEmpty()


def test_changes_and_reach_are_by_number(spark):
    edges, roots, pressures = Q.reach(spark, SF)
    for df, column in ((Q.changes(spark, SF), "path"), (edges, "source"), (edges, "target"), (roots, "path"), (pressures, "path")):
        assert df.schema[column].dataType.typeName() == "long"


def test_warnings_need_no_second_scoring(spark):
    side = Q._side(spark, SF, True)
    scans = [line for line in side._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan parquet" in line or "FileScan" in line]
    assert len(scans) <= 12 and not side.filter(F.col("warnings").isNull()).count()
