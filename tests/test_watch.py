"""Watching: one run after each burst of changes, and the comparison with a stored report."""

import time

from tallyforge.plans import analyze as Z
from tallyforge.streaming import watch as W


def put(folder, name, rows):
    part = folder / f".{name}"
    part.write_text("".join(f'{{"project": "{p}", "path": "{x}"}}\n' for p, x in rows))
    part.rename(folder / f"{name}.json")


def stream(spark, folder):
    return spark.readStream.schema("project string, path string").json(f"file:{folder}")


def wait(until, seconds):
    end = time.time() + seconds
    while not until() and time.time() < end:
        time.sleep(0.2)
    assert until()


def test_three_bursts_give_three_runs(spark, tmp_path):
    log, seen = tmp_path / "log", []
    log.mkdir()
    q = W.watch_bursts(stream(spark, log), lambda p, n: seen.append((p, n)), f"file:{tmp_path}/c", quiet=4000)
    try:
        for burst in range(3):
            for k in range(3):  # each change sets the timer anew
                put(log, f"b{burst}x{k}", [("p", f"src/a{k}.ts"), ("p", "node_modules/x.ts"), ("p", "README.md"), ("p", f"src/b{k}.tsx")])
                time.sleep(0.3)
            wait(lambda burst=burst: len(seen) == burst + 1, 60)
        assert seen == [("p", 6)] * 3 and q.exception() is None
    finally:
        q.stop()


def test_a_change_runs_the_comparison(spark, tmp_path):
    (tmp_path / "p/src").mkdir(parents=True)
    (tmp_path / "p/src/a.ts").write_text("export const a = 1\n")
    root, out, log = f"file:{tmp_path}/p", f"file:{tmp_path}/out", tmp_path / "log"
    log.mkdir()
    Z.analyze(spark, root, out, {"outputFormats": ["json"]})
    (tmp_path / "p/src/b.ts").write_text("import { a } from './a'\nexport const b = a\n")
    q = W.watch_diff(spark, stream(spark, log), {root: f"{out}/analysis_report"}, f"{out}2", f"file:{tmp_path}/c", {"outputFormats": ["json"]}, quiet=500)
    try:
        put(log, "one", [(root, "src/b.ts"), ("other", "src/b.ts")])
        wait(lambda: (tmp_path / "out2/analysis_diff.json").exists(), 240)
    finally:
        q.stop()
    assert {r["path"]: r["status"] for r in spark.read.parquet(f"{out}2/analysis_diff/files").collect()} == {"src/a.ts": "unchanged", "src/b.ts": "added"}
