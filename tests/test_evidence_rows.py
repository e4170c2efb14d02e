"""Evidence of tests over a hub that every test imports: rows of work tables, and reasons against brute force."""

import pytest

from tallyforge.operators import evidence as V


@pytest.fixture
def hub(spark):
    n = 40
    tests = [f"tests/t{i:02}.test.ts" for i in range(n)]
    sources = [f"src/features/s{i:02}.ts" for i in range(n)]
    middle = ["src/__fixtures__/one.ts", "src/__fixtures__/two.ts"]
    kinds = [(t, "Test") for t in tests] + [(s, "Feature") for s in sources] + [(m, "Fixture") for m in middle]
    edges = [(t, middle[0]) for t in tests] + [(middle[0], middle[1])] + [(middle[i % 2], s) for i, s in enumerate(sources[:-1])] + [(tests[3], sources[1]), (middle[1], tests[0])]
    deps = spark.createDataFrame([(a, b, False) for a, b in edges], "source string, target string, is_external boolean")
    coverage = spark.createDataFrame([(s, 10, i % 3) for i, s in enumerate(sources[:5])], "path string, line_found long, line_hit long")
    executed = spark.createDataFrame([(tests[3], "junit"), (tests[2], "playwright")], "path string, label string")
    args = [spark.createDataFrame(kinds, "path string, kind string"), spark.createDataFrame([(t,) for t in tests], "path string"), deps, coverage, executed]
    want = {}
    for i, s in enumerate(sources):
        depth = lambda t: 0 if (t, i) == (3, 1) else 1 + i % 2  # noqa: B023, E731
        named = sorted(f"import:{t} depth={depth(j)}" for j, t in enumerate(tests))
        ran = sorted([f"junit:{tests[3]} depth={depth(3)}", f"playwright:{tests[2]} depth={depth(2)}"])
        if i < 5:
            want[s] = [f"lcov:{i % 3}/10 ({i % 3 * 10}.0%)", ran[0], named[0]]
        else:
            want[s] = ran if i < n - 1 else ["no runtime or static evidence"]
    return args, want


def test_rows_follow_the_files(spark, hub, monkeypatch):
    args, want = hub
    rows, write = [], V.cut

    def counted(df, name):
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(V, "cut", counted)
    states = {r["path"]: (r["matched"], r["matched_by"]) for r in V.test_states(*args).collect()}
    assert max(rows) <= 200  # files and imports; pairs of tests and sources are 1,600
    assert states == {p: (r[0][5] != "0" if r[0].startswith("lcov") else r[0][0] != "n", "none" if r[0][0] == "n" else "runtime") for p, r in want.items()}
    few = spark.createDataFrame([(p,) for p in list(want)[:7]], "path string")
    assert {r["path"]: r["reasons"] for r in V.test_matches(*args, only=few).collect()} == dict(list(want.items())[:7])
    assert max(rows) <= 200


def test_reasons_of_all(spark, hub):
    args, want = hub
    assert {r["path"]: r["reasons"] for r in V.test_matches(*args).collect()} == want
    args[4] = args[4].limit(0)
    got = {r["path"]: r["reasons"] for r in V.test_matches(*args).collect()}
    assert len(got["src/features/s06.ts"]) == 40 and got["src/features/s06.ts"][3] == "import:tests/t03.test.ts depth=1"
