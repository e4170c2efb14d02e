"""The walk of a folder tree and the readers of reports, against plain versions."""

import json
import os
import random

from tallyforge.sources import artifacts as A
from tallyforge.sources import evidence_files as D
from tallyforge.sources import scan as S
from tallyforge.sources import walk as W


def rows_of(spark, root, *args):
    return {(r["path"], r["reason"]) for r in W.walk(spark, f"file:{root}", *args).collect()}


def make(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")


def test_folders_that_are_left_out_are_not_listed(spark, tmp_path):
    make(tmp_path, "a.ts", "src/b.ts", "src/gen/deep/c.ts", "node_modules/x/y.js", ".storybook/main.js", "docs/d.md")
    frontier = spark.createDataFrame([("", None, None)], "path string, real string, origin string")
    seen = W._listed(frontier, str(tmp_path), ["^node_modules$", "(^|/)gen$"], None, W.BUDGET).filter("what = 'folder'")
    assert {r["path"] for r in seen.collect()} == {"", "src", ".storybook", "docs"}
    want = {("a.ts", None), ("src/b.ts", None), (".storybook/main.js", None), ("docs/d.md", None), ("src/gen", W.EXCLUDED), ("node_modules", W.EXCLUDED)}
    assert rows_of(spark, tmp_path, ["^node_modules$", "(^|/)gen$"]) == want
    assert rows_of(spark, tmp_path, [], frozenset(["docs"])) == {("a.ts", None), ("docs/d.md", None)}
    assert rows_of(spark, tmp_path / "none") == {("", "cannot be read: No such file or directory")}


def test_links_end(spark, tmp_path):
    root = tmp_path / "p"
    make(root, "a/f.ts", "a/g.ts", "b/h.ts")
    make(tmp_path, "out/k.ts", "out/in/l.ts")
    os.symlink(root, root / "a/up")  # back to a folder above
    os.symlink(root / "b", root / "a/to_b")  # listed as itself
    os.symlink(tmp_path / "out", root / "o1")  # outside: the first by path
    os.symlink(tmp_path / "out", root / "o2")
    os.symlink(tmp_path / "out/in", root / "a/inner")  # lies in what o1 leads to
    os.symlink(root / "a/f.ts", root / "f_again.ts")
    os.symlink(root / "a/f.ts", root / "g_again.ts")
    os.symlink(tmp_path / "nothing", root / "broken")
    os.symlink(tmp_path / "out", tmp_path / "out/in/self")  # a ring outside
    assert rows_of(spark, root) == {
        ("a/f.ts", None), ("a/g.ts", None), ("b/h.ts", None), ("o1/k.ts", None), ("o1/in/l.ts", None), ("f_again.ts", None),
        ("a/up", W.CYCLE), ("a/to_b", W.DUPLICATE), ("o2", W.DUPLICATE), ("a/inner", W.DUPLICATE), ("g_again.ts", W.DUPLICATE), ("o1/in/self", W.DUPLICATE),
    }


def test_many_folders_in_rounds(spark, tmp_path, monkeypatch):
    rng, folders = random.Random(3), [""]
    for i in range(150):
        folders.append(os.path.join(rng.choice(folders[-20:]), f"d{i}"))
    make(tmp_path, *[os.path.join(f, f"{i}.ts") for i, f in enumerate(folders)])
    monkeypatch.setattr(W, "BUDGET", 40)
    want = {(os.path.relpath(os.path.join(at, n), tmp_path), None) for at, _, names in os.walk(tmp_path) for n in names}
    assert rows_of(spark, tmp_path) == want and len(want) == 151


def test_contents_and_scan(spark, tmp_path):
    make(tmp_path, "a.ts", "b.ts")
    (tmp_path / "big.ts").write_text("y" * 100)
    listed = S.listing(spark, f"file:{tmp_path}", ["("], max_bytes=50)
    assert {(r["path"], r["reason"]) for r in listed.collect()} == {("a.ts", None), ("b.ts", None), ("big.ts", "File size exceeds 50 bytes")}
    rows = spark.createDataFrame([("a.ts", "k"), ("big.ts", "k"), ("gone.ts", "k")], "path string, kind string")
    assert [(r["path"], bytes(r["content"])) for r in W.contents(rows, f"file:{tmp_path}", 50).collect()] == [("a.ts", b"x")]


def test_a_large_coverage_file_is_read_in_parts(spark, tmp_path):
    rng = random.Random(5)
    records = [f"TN:\nSF:src/f{rng.randrange(900)}.ts\nDA:1,1\nLF:{rng.randrange(90)}\nLH:{rng.randrange(90)}\nend_of_record\n" for _ in range(20_000)]
    (tmp_path / "lcov.info").write_text("".join(records))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        parts = A.lcov_records(spark, f"file:{tmp_path}/lcov.info")
        assert parts.rdd.getNumPartitions() > 3
        assert sorted(A.lcov(parts).collect()) == sorted(A.lcov(A.texts(spark, f"file:{tmp_path}/lcov.info")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_reports_that_give_no_figures_are_named(spark):
    def wrong(kind, *texts):
        rows = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
        found = D.results(rows, kind).filter("warning IS NOT NULL") if kind in ("axe", "lighthouse") else A.warnings(rows, kind)
        return {r["path"]: r["warning"] for r in found.collect()}

    other, broken = "not a report of this kind", "not JSON"
    assert wrong("npm-audit", '{"vulnerabilities": {}}', '{"metadata": {"vulnerabilities": {"low": 1}}}', '{"advisories": {}}', "[]", "{") == {"f3": other, "f4": broken}
    assert wrong("trivy", '{"Results": []}', '{"Results": 3}', "") == {"f1": other, "f2": broken}
    assert wrong("junit", "<testsuite/>", "<html/>", None) == {"f1": other, "f2": other}
    assert wrong("openapi-diff", "{}", "}") == {"f1": broken}
    nested = json.dumps({"results": [{"violations": [{"impact": "serious", "nodes": [{}, {}]}]}, {"violations": []}]})
    assert wrong("axe", nested, "{}", "[", "[]") == {"f1": other, "f2": broken, "f3": other}
    found = D.results(spark.createDataFrame([("f", nested)], "path string, text string"), "axe")
    assert sorted(r["serious"] for r in A.axe(found).collect()) == [0, 2]
    assert wrong("lighthouse", '{"lhr": {"categories": {"a": 1}, "audits": {"b": 1}}}', "{}") == {"f1": other}


def test_evidence_that_the_driver_sees(spark):
    paths = ["coverage/lcov.info", "coverage/report/index.html", "reports/a/b/c/junit-x.xml", "reports/a/b/c/d/junit-x.xml", "docs/a.md", "docs/b.md", ".github/workflows/ci.yml", "src/audit.json", "README.md", "reports/x.md"]
    got = {r["path"] for r in D.evidence(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"coverage/lcov.info", "reports/a/b/c/junit-x.xml", "docs", ".github/workflows", "README.md"}
    for kind in D.PLACES:
        assert D.find(sorted(got), kind) == D.find(paths, kind)
