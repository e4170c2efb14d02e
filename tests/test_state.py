"""The second run of a project: what is read, parsed and resolved again, against a run that starts anew."""

import json
import os
import random

import pytest

from tallyforge.operators import graph as G
from tallyforge.operators import lookup as L
from tallyforge.plans import analyze as Z
from tallyforge.sources import config as C
from tallyforge.sources import state as T

FILES = {
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "lib/*"]}}}',
    "package.json": '{"name": "small"}',
    "src/a.ts": "import { b } from './b'\nimport c from '@/c'\nimport z from 'zod'\nexport const a = () => b ? c : z\n",
    "src/b.ts": "export const b = 1 // x\n",
    "src/c/index.ts": "export default 1\n",
    "src/d.ts": "import { gone } from './gone'\nexport { b as e } from './b'\nconst apiKey = 'api_key: \"k\"'\n",
    "src/e.ts": "export const quiet = 1\n",
}


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


@pytest.fixture
def project(tmp_path):
    put(tmp_path / "p", FILES)
    return f"file:{tmp_path}/p", tmp_path / "p"


def facts(a):
    deps = sorted((r["source"], r["module"], r["target"], r["is_external"], r["line"]) for r in a.dependencies.collect())
    scored = sorted(tuple(sorted(r.asDict(True).items(), key=str)) for r in a.scored.collect())
    return deps, [str(s) for s in scored], sorted((r["path"], r["patient"], [tuple(x) for x in r["secrets"]]) for r in a.sources.collect())


def work(stats):
    return stats["read"], stats["parsed"], stats["resolved"]


def test_only_changed_files_are_parsed(spark, project):
    root, folder = project
    assert work(Z.build(spark, root).stats) == (5, 5, 5)
    (state,) = (folder / ".tallyforge-cache").glob("state-*")
    before = sorted(os.listdir(state))
    again = Z.build(spark, root)
    assert work(again.stats) == (0, 0, 0) and again.stats["hits"] == 5 and sorted(os.listdir(state)) == before  # nothing is written
    os.utime(folder / "src/e.ts", (2_000_000_000, 2_000_000_000))
    assert work(Z.build(spark, root).stats) == (1, 0, 0)  # touched: opened, but not parsed
    put(folder, {"src/b.ts": "export const b = 2\nexport const f = () => 3\n"})
    changed = Z.build(spark, root)
    assert work(changed.stats) == (1, 1, 1)
    assert facts(changed) == facts(Z.build(spark, root, {"enableCache": False}))


def test_files_that_come_and_go_resolve_their_importers_again(spark, project):
    root, folder = project
    Z.build(spark, root)
    os.remove(folder / "src/b.ts")
    gone = Z.build(spark, root)
    assert work(gone.stats) == (0, 0, 2) and gone.stats["removed"] == 1  # a.ts and d.ts name it
    put(folder, {"src/c.ts": "export default 2\n"})
    come = Z.build(spark, root)
    assert work(come.stats) == (1, 1, 2)  # itself, and a.ts, which finds it before the folder
    assert ("src/a.ts", "@/c", "src/c.ts", False, 2) in facts(come)[0]
    put(folder, {"src/gone.tsx": "export const gone = 1\n"})
    assert facts(Z.build(spark, root)) == facts(Z.build(spark, root, {"enableCache": False}))


def test_reports_tell_what_was_reused(spark, project, tmp_path):
    root, folder = project
    out = f"file:{tmp_path}/out"
    report = lambda: json.loads((tmp_path / "out/analysis_report.json").read_text())
    Z.analyze(spark, root, out, {"outputFormats": ["json"]})
    assert report()["analysisCacheStats"] == {"hits": 0, "misses": 5} and report()["incrementalStats"]["affectedFiles"] == 5
    put(folder, {"src/b.ts": "export const b = 2\n"})
    Z.analyze(spark, root, out, {"outputFormats": ["json"]})
    assert report()["incrementalStats"] == {"reusedFiles": 4, "recomputedFiles": 1, "resolvedFiles": 1, "affectedFiles": 3}  # b.ts, and a.ts and d.ts that import it
    Z.graph(spark, root, out)
    order = [r["id"] for r in spark.read.parquet(f"{out}/analysis_graph_order").orderBy("position").collect()]
    assert set(order) == {"src/a.ts", "src/b.ts", "src/c/index.ts", "src/d.ts", "src/gone"} and order.index("src/a.ts") < order.index("src/b.ts")


def test_another_configuration_resolves_again_without_parsing(spark, project):
    root, folder = project
    Z.build(spark, root)
    put(folder, {"tsconfig.json": FILES["tsconfig.json"].replace("src/*", "other/*")})
    assert work(Z.build(spark, root).stats) == (0, 0, 5)
    put(folder, {"src/tsconfig.json": "{}"})
    later = Z.build(spark, root)
    assert work(later.stats) == (0, 0, 5) and ("src/a.ts", "@/c", "@/c", True, 2) in facts(later)[0]


def test_random_edits_give_what_a_new_run_gives(spark, project):
    root, folder = project
    rng = random.Random(5)
    names = [f"src/{x}" for x in ("a.ts", "b.ts", "c.ts", "c/index.ts", "c/d.tsx", "f/index.js", "f.d.ts")]
    for _ in range(2):
        for name in rng.sample(names, 3):
            path = folder / name
            if path.exists() and rng.random() < 0.4:
                path.unlink()
            else:
                put(folder, {name: "".join(f"import x{i} from '{rng.choice(['./a', './c', '../c', '@/c', '@/f', './d', 'react'])}'\n" for i in range(rng.randrange(4)))})
        assert facts(Z.build(spark, root)) == facts(Z.build(spark, root, {"enableCache": False}))


def test_broken_state_starts_anew(spark, project):
    root, folder = project
    Z.build(spark, root)
    (state,) = (folder / ".tallyforge-cache").glob("state-*")
    (state / "CURRENT").write_text("v-nothing")
    (state / ".CURRENT.crc").unlink(missing_ok=True)
    assert work(Z.build(spark, root).stats) == (5, 5, 5)
    assert work(Z.build(spark, root).stats) == (0, 0, 0)


def test_old_versions_go(spark, tmp_path):
    store = T.StateStore(spark, f"file:{tmp_path}/s")
    assert store.read("t") is None
    for n in range(4):
        store.write({"t": spark.range(n)})
        assert store.read("t")["t"].count() == n
    assert len([x for x in os.listdir(tmp_path / "s") if x.startswith("v-")]) == 2
    assert [x for x in os.listdir(tmp_path / "s") if not x.startswith((".", "v-"))] == ["CURRENT"]


def test_staleness_spreads_along_imports(spark):
    rng = random.Random(2)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(50)} | {(f"c{i}", f"c{i + 1}") for i in range(12)}
    start = {"n1", "n7", "c12"}
    want = {n: 0 for n in start}
    front, depth = start, 0
    while front:
        depth += 1
        front = {a for a, b in edges if b in front and a not in want}
        want.update(dict.fromkeys(front, depth))
    got = G.dependents(spark.createDataFrame(list(edges), "source string, target string"), spark.createDataFrame([(n,) for n in start], "id string"))
    assert {r["id"]: r["distance"] for r in got.collect()} == want


def test_nearest_configuration_is_that_of_a_walk_upwards(spark):
    rng = random.Random(1)
    parts = ["a", "b", "a.b", "c"]
    configs = ["tsconfig.json", "a/jsconfig.json", "a/tsconfig.app.json", "a/b/tsconfig.base.json", "a/b/tsconfig.z.json", "b/c/tsconfig.json", "b/c/jsconfig.json", "a.b/tsconfig.lib.json"]
    paths = ["/".join([*rng.choices(parts, k=rng.randrange(5)), f"f{i}.ts"]) for i in range(200)]
    for known in (configs, configs[1:]):
        got = L.nearest_places(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(c,) for c in known], "place string"))
        assert {r["path"]: r["place"] for r in got.collect()} == {p: C.nearest(known, p) for p in paths}


def test_longest_alias_wins(spark):
    aliases = {"@/*": ["src/*"], "@/ui/*": ["ui/*", "./kit/*"], "@/ui/*/x": ["x/*"], "exact": ["one.ts"], "~/": ["home/"], "*": ["any/*"], "ab*ba": ["in/*"]}

    def plain(name):
        for pattern, places in sorted(aliases.items(), key=lambda kv: (-len(kv[0].partition("*")[0]), kv[0])):
            if pattern.endswith("/"):
                pattern, places = pattern + "*", [p.rstrip("/") + "/*" for p in places]
            head, star, tail = pattern.partition("*")
            if (name.startswith(head) and name.endswith(tail) and len(name) >= len(head) + len(tail)) if star else name == pattern:
                inner = name[len(head) : len(name) - len(tail)]
                return [p.replace("*", inner, 1).removeprefix("./") for p in places]
        return None

    names = ["@/a", "@/ui/b", "@/ui/b/x", "@/ui/", "exact", "exacter", "~/q", "aba", "abba", "ab1ba", "", "@"]
    rows = spark.createDataFrame([(p, n) for n in names for p in ("t", "none")], "place string, specifier string")
    table = spark.createDataFrame([("t", k, v) for k, v in aliases.items()] + [("other", "exact", ["no"])], L.ALIASES)
    got = {r["specifier"]: r["bases"] for r in L.matched_aliases(rows, table).collect()}
    assert got == {n: plain(n) for n in names if plain(n) is not None}
