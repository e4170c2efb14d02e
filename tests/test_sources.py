from tallyforge.sources import artifacts as A
from tallyforge.sources.scan import source_files
from tallyforge.streaming.watch import watch


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_junit(spark):
    one = "<testsuites><testsuite tests='2'><testsuite tests='2'><testcase name='a'/><testcase name='b'><failure>x</failure></testcase></testsuite></testsuite></testsuites>"
    two = '<testsuite tests="4" failures="0" errors="0" skipped="1"></testsuite>'
    got = {r["path"]: (r["total"], r["failed"], r["skipped"], r["passed"]) for r in A.junit(files(spark, one, two, "no xml")).collect()}
    assert got == {"f0": (2, 1, 0, 1), "f1": (4, 0, 1, 3)}


def test_lcov_takes_the_best_record(spark):
    rec = "SF:{}\nLF:{}\nLH:{}\nend_of_record\n"
    rows = A.lcov(files(spark, rec.format("a", 10, 5) + rec.format("b", 4, 4), rec.format("a", 10, 5) + rec.format("b", 4, 2)))
    assert {tuple(r) for r in rows.collect()} == {("a", 10, 5), ("b", 4, 4)}
    assert tuple(A.coverage(rows).first())[:2] == (14, 9)


def test_audits(spark):
    npm = '{"metadata": {"vulnerabilities": {"low": 1, "moderate": 2, "high": 0, "critical": 3}}}'
    listed = '{"vulnerabilities": {"x": {"severity": "high"}, "y": {"severity": "medium"}}}'
    assert [tuple(r)[1:] for r in A.npm_audit(files(spark, npm, listed, "{")).orderBy("path").collect()] == [(1, 2, 0, 3), (0, 1, 1, 0)]
    assert tuple(A.trivy(files(spark, '{"Results": [{"Vulnerabilities": [{"Severity": "HIGH"}]}, {}]}')).first())[1:] == (0, 0, 1, 0)
    axe = '{"violations": [{"impact": "serious", "nodes": [{}, {}]}, {"impact": null, "nodes": []}], "incomplete": [{}]}'
    assert tuple(A.axe(files(spark, axe)).first())[1:] == (0, 2, 1, 0, 1)
    light = '{"categories": {"performance": {"score": 0.92}}, "audits": {"largest-contentful-paint": {"numericValue": 2200}, "interactive": {"numericValue": 3100}}}'
    assert tuple(A.lighthouse(files(spark, light)).first()) == (92.0, 2.2, 3.1)
    assert [r["breaking"] for r in A.openapi_breaking(files(spark, '{"breakingDifferences": []}', '{"summary": {"breakingChanges": 2}}')).orderBy("path").collect()] == [0, 2]


def test_scan_and_watch(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("﻿x\ny")
    (tmp_path / "src/b.css").write_text("x")
    (tmp_path / "gen.ts").write_text("x")
    got = source_files(spark, f"file:{tmp_path}", ["^gen"]).collect()
    assert [(r["path"], r["line_count"], r["content"]) for r in got] == [("src/a.ts", 2, "x\ny")]
    spark.createDataFrame([("src/a.ts",), ("src/a.ts",), ("node_modules/x.ts",), ("a.md",)], "path string").write.parquet(str(tmp_path / "log"))
    seen = []
    watch(spark.readStream.schema("path string").parquet(str(tmp_path / "log")), lambda paths, n: seen.append([r["path"] for r in paths.collect()]), str(tmp_path / "cp")).awaitTermination()
    assert seen == [["src/a.ts"]]
