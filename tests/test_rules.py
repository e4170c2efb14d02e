import pytest
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.functions import paths as P
from tallyforge.functions import text as T
from tallyforge.operators import diff as D
from tallyforge.operators import quality as Q


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_bands_and_clusters(spark):
    code = E.cluster_code(E.size_band("l"), E.complexity_band("c"))
    assert values(spark, "l int, c int", [(40, 3), (180, 8), (420, 14)], code) == ["S1", "M2", "L3"]
    assert values(spark, "k string", [("L3",), ("M1",), ("S2",)], E.cluster_weight("k")) == [18, 1, 3]


KINDS = {
    ".storybook/main.js": "Config", ".storybook/components/SBMermaid.tsx": "Storybook Support", "src/features/chat/TextChat.tsx": "Feature", "src/features/user/schemas/user.schema.ts": "Schema",
    "src/contexts/chat/ChatTurnStore.tsx": "Context/State", "src/contexts/chat/useChatTurn.ts": "Hook", "src/bases/api/fetcher.ts": "API/Infrastructure",
    "src/components/forms/validations/common.ts": "Validation", "src/components/ui/sidebar.tsx": "UI component", "src/lib/utils.ts": "Utils", "src/components/index.ts": "Barrel",
    "vitest.shims.d.ts": "Type Support", "packages/mui-material/src/Button/Button.tsx": "UI component", "packages/mui-material/src/Slider/useSlider.ts": "Hook", "src/app/dashboard/page.tsx": "Route",
    "pages/home.tsx": "Route", "src/app.tsx": "Route", "app.tsx": "Route", "src/lib/error.ts": "Utils", "src/utils/app.ts": "Utils", "src/features/checkout/error.ts": "Feature",
    "src/models/user.ts": "Shared", "src/users.tsx": "Shared", "src/hooks/x.ts": "Hook", "src/useAuth.mts": "Hook", "src/layouts/Main.tsx": "Layout", "src/forms/LoginForm.tsx": "Form",
    "src/modules/a/b.ts": "Feature", "tsconfig.json": "Config", ".eslintrc.js": "Config", "src/features/chat/api/x.ts": "Feature", "src/a.test.ts": "Test", "tests/x.ts": "Test",
    "src/Card.stories.tsx": "Story", "src/__fixtures__/a.ts": "Fixture", "src\\lib\\x.ts": "Utils", "src/LoginForm.tsx": "Form", "src/components/LoginForm.tsx": "Form", "packages/core/src/theme/Colors/dark.ts": "UI component",
}


def test_file_kinds(spark):
    assert dict(zip(KINDS, values(spark, "p string", [(p,) for p in KINDS], P.file_kind("p")), strict=True)) == KINDS
    got = values(spark, "p string, c string, h boolean", [("src/x.tsx", "PageShell", True), ("src/x.tsx", "PageShell", False), ("src/x.tsx", "EditForm", False), ("src/x.tsx", None, None)], P.file_kind("p", "c", "h"))
    assert got == ["Layout", "Shared", "Form", "Shared"]


def test_paths_of_tests_and_sources(spark):
    rows = [("src/components/Button.test.tsx",), ("tests/features/OrderPage.spec.tsx",), ("e2e/checkout.spec.ts",), ("src/utils/format.ts",)]
    keys = values(spark, "p string", rows, P.tested_keys("p"))
    assert keys == [["src/components/button", "components/button"], ["features/orderpage", "src/features/orderpage"], ["checkout", "src/checkout"], ["src/utils/format", "utils/format"]]
    assert values(spark, "p string", rows, P.is_test_path("p")) == [True, True, True, False]
    assert values(spark, "p string", [("/r/p/src/a.ts",), ("/x/tests/a.ts",), ("./a.ts",)], P.project_path("p", "/r/p")) == ["src/a.ts", "a.ts", "a.ts"]
    features = [("src/features/chat/ui/A.tsx", "Feature"), ("src/features/chat.tsx", "Feature"), ("src/features/chat.test.tsx", "Test"), ("src/lib/a.ts", "Utils")]
    assert values(spark, "p string, k string", features, P.feature_label("p", "k")) == ["src/features/chat", "src/features/chat", None, None]
    names = [("src/a.tsx",), ("a.cjs",), ("a.css",)]
    assert values(spark, "p string", names, P.script_kind("p")) == ["TSX", "JS", "Unknown"]
    assert values(spark, "p string", [("tsconfig.json",), ("jsconfig.json",), ("tsconfig.app.json",), ("tsconfig.x.json",), ("tsconfig.base.json",)], P.config_rank("p")) == [0, 1, 2, 3, 4]


def test_texts(spark):
    cells = ['a,b', 'say "x"', "line\nbreak", "plain"]
    assert values(spark, "v string", [(c,) for c in cells], T.csv_cell("v")) == ['"a,b"', '"say ""x"""', '"line\nbreak"', "plain"]
    assert values(spark, "v string", [("a|b\r\nc",)], T.markdown_cell("v")) == ["a\\|b c"]
    assert values(spark, "v string", [("pass",), ("manual",), ("not_applicable",), (None,), ("odd",)], T.verdict_badge("v")) == ["○ PASS", "― MANUAL", "N/A", "なし", "odd"]
    assert values(spark, "v string", [("Hello, World 1!",), ("品質 レポート",)], T.heading_anchor("v")) == ["hello-world-1", "品質-レポート"]
    assert values(spark, "v string", [("UI/UX 品質 x",)], T.slug("v")) == ["ui-ux-品質-x"]
    assert values(spark, "v int", [(3,), (-2,), (0,)], T.signed("v")) == ["+3", "-2", "0"]
    assert values(spark, "v string", [("score 7.5 x",), ("12行目: y",)], T.evidence_score("v")) == [7.5, float("-inf")]


def test_audit_limits_and_own_components():
    from tallyforge.operators.audit import limits

    assert limits() == (12, 8, 40) and limits(10) == (10, 7, 40) and limits(1) == (1, 1, 40)


def test_purpose_findings(spark):
    from tallyforge.operators.audit import purpose_findings

    schema = "path string, kind string, code_lines int, complexity int, n_functions int, n_components int, n_hooks int"
    rows = [
        ("src/lib/a.tsx", "Utils", 1, 1, 0, 1, 0), ("src/schemas/a.ts", "Schema", 1, 1, 0, 0, 0), ("src/components/Card/index.tsx", "Barrel", 1, 1, 1, 1, 0), ("src/x/index.ts", "Barrel", 1, 1, 1, 0, 0),
        ("src/app/page.tsx", "Route", 1, 12, 1, 0, 0), ("src/big.ts", "Shared", 40, 1, 0, 0, 0), ("src/components/Button.tsx", "UI component", 1, 1, 0, 1, 0),
    ]
    deps = spark.createDataFrame(
        [("src/schemas/a.ts", "react", True, False, "react/jsx"), ("src/components/Button.tsx", "src/api/x.ts", False, True, "../api/x")], "source string, target string, is_external boolean, is_type_only boolean, module string"
    )
    components = spark.createDataFrame([("src/components/Card/index.tsx", "Card")], "path string, name string")
    got = {(r["path"], r["rule"]) for r in purpose_findings(spark.createDataFrame(rows, schema), components, deps).collect()}
    assert got == {
        ("src/lib/a.tsx", "component-in-non-ui-layer"), ("src/schemas/a.ts", "react-in-data-layer"), ("src/x/index.ts", "implementation-in-barrel"), ("src/app/page.tsx", "heavy-logic-in-route"),
        ("src/big.ts", "unclassified-shared-growth"),
    }


def test_suggestions(spark):
    from tallyforge.operators.aggregate import suggestions

    known = spark.createDataFrame([("output",), ("format",), ("prefix",)], "name string")
    unknown = spark.createDataFrame([("outptu",), ("formt",), ("nothing",)], "name string")
    assert {tuple(r) for r in suggestions(unknown, known).collect()} == {("outptu", "output", 2), ("formt", "format", 1)}


def test_driver_changes(spark):
    from tallyforge.operators.impact import driver_changes

    got = values(spark, "b array<string>, c array<string>", [(["a=1", "b=2", "c=3", "=x"], ["b=4", "d=5", "a=0", "a=1"])], driver_changes(F.col("b"), F.col("c")))
    assert got == [["b=2 → 4", "d=+5", "c=-3"]]


def test_metric_changes_and_gate_ids(spark):
    from tallyforge.operators import metrics as M

    facts = spark.createDataFrame([(2, 5.0)], "cycles long, escape_total double")
    now = M.build_metrics(facts)
    old = M.build_metrics(facts.withColumn("cycles", F.lit(0)))
    changed = {r["id"]: r["changes"] for r in M.metric_changes(now, old).filter(F.size("changes") > 0).collect()}
    assert changed == {i: ["verdict: pass -> fail", "actual: 0 -> 2"] for i in ("circular_dependencies", "dependency_cycle_count")}
    assert M.validate_gate(now, ["typo", " "], ["lcp", "x"]) == {"unknown_blocking": ["typo"], "unknown_monitoring": ["x"], "blocking_all_unknown": True}
    rows = now.orderBy("position").collect()
    assert [r["id"] for r in rows if r["category"] == "code"][2] == "eslint_violations" and len(rows) == len({r["id"] for r in rows})
    assert {r["verdict"] for r in rows if r["category"] == "performance"} == {"manual"}


@pytest.mark.parametrize(
    ("current", "baseline", "threshold", "want"),
    [
        (("fail", "110"), ("fail", "108"), "0", "regressed"), (("manual", "-"), ("pass", "80.0 %"), "100%", "regressed"), (("pass", "90.0 %"), ("pass", "95.0 %"), ">= 80%", "neutral"),
        (("warn", "2"), ("warn", "3"), "0", "improved"), ((None, None), ("pass", "1"), None, "neutral"), (("pass", "1"), ("warn", "1"), "0", "improved"),
    ],
)
def test_trends(spark, current, baseline, threshold, want):
    t = E.trend("cv", "bv", "ca", "ba", "t")
    assert values(spark, "cv string, ca string, bv string, ba string, t string", [(*current, *baseline, threshold)], t) == [want]


def test_list_difference_keeps_order_and_repeats(spark):
    got = values(spark, "c array<string>, b array<string>", [(["x", "y", "y"], ["z", "x"]), (None, ["a"])], D.list_difference(F.col("c"), F.col("b")))
    assert got == [["+y", "+y", "-z"], ["-a"]]


def test_self_diff_is_unchanged(spark):
    a = spark.createDataFrame([("f", 1, 6), ("g", 2, 3)], "path string, functions int, lines int")
    b = spark.createDataFrame([("f", 2, 9), ("h", 2, 3)], "path string, functions int, lines int")
    assert {r["status"] for r in D.snapshot_diff(a, a, "path", ["functions", "lines"]).collect()} == {"unchanged"}
    got = {r["path"]: (r["status"], r["d_functions"], r["d_lines"]) for r in D.snapshot_diff(b, a, "path", ["functions", "lines"]).collect()}
    assert got == {"f": ("changed", 1, 3), "g": ("removed", -2, -3), "h": ("added", 2, 3)}


def test_manual_evidence_and_failures(spark):
    m = spark.createDataFrame([("a", "manual", "manual"), ("b", "automatic", "pass")], "id string, automation string, verdict string")
    e = spark.createDataFrame([("a", 1, "warn"), ("a", 2, "pass"), ("b", 1, "fail")], "id string, seq int, verdict string")
    assert {r["id"]: r["verdict"] for r in Q.with_manual(m, e).collect()} == {"a": "pass", "b": "pass"}
    f = spark.createDataFrame([("b", 2, "later"), ("b", 1, "first")], "id string, seq int, reason string")
    assert {r["id"]: (r["verdict"], r["failure"]) for r in Q.with_failures(m, f).collect()} == {"a": ("manual", None), "b": ("manual", "first")}


def test_gate_blocks_regressions_but_not_monitored(spark):
    schema = "category string, id string, verdict string, actual string, threshold string, automation string, aggregation string"
    base = spark.createDataFrame([("c", i, "pass", "0", "0", "automatic", "primary") for i in "xy"], schema)
    cur = spark.createDataFrame([("c", i, "warn", "2", "0", "automatic", "primary") for i in "xy"], schema)
    d = Q.quality_diff(cur, base)
    assert [r["id"] for r in Q.blocking_regressions(d, monitoring=["x"]).collect()] == ["y"]
    assert Q.gate(cur, Q.blocking_regressions(d, blocking=["x"])).first()["exit_code"] == 2
