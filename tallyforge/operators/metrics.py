"""Quality metrics: verdicts built from one row of collected facts, and what a report shows of them.

A facts row has one column for each collected number; null means that its source was not found, and the metrics that
need it are manual. The metric table is (category, position, id, label, aggregation, actual, threshold, verdict,
automation, summary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.facts import fixed

# Categories in order, with their labels.
CATEGORIES = {
    "functional": "機能品質", "uiux": "UI/UX品質", "accessibility": "アクセシビリティ品質", "performance": "パフォーマンス品質", "code": "コード品質", "test": "テスト品質",
    "api": "API連携品質", "security": "セキュリティ品質", "i18n": "国際化（i18n）品質", "operations": "運用・保守性", "build": "ビルド・デプロイ品質", "dependencies": "依存関係・ライブラリ品質",
}
# Thresholds by profile.
PRESENCE = {"application": (80, 50), "library-repo": (60, 25)}
ZOD = {"application": (80, 50, 1), "library-repo": (50, 20, 10)}
TEXTS_WARN = {"application": 3, "library-repo": 25}
PACKAGES = {"application": (30, 60), "library-repo": (80, 160)}
# Metrics without an automatic source (category, id, label, threshold), in the order of a report.
MANUAL = {
    "functional": [
        ("requirements_traceability", "要件適合率", "100%"), ("happy_path_pass_rate", "正常系シナリオ通過率", "100%"), ("edge_case_coverage", "異常系・エッジケース網羅率", "100%"),
        ("residual_bug_count", "バグ残存数（Severity別）", "High=0"), ("logic_correctness", "ビジネスロジックの正当性", "100%"),
    ],
    "uiux": [("figma_delta", "デザイン一致率", ">= 98%"), ("breakpoint_layout", "レイアウト崩れ件数", "0"), ("flow_consistency", "操作フローの一貫性", "逸脱なし")],
    "accessibility": [
        ("aria_usage", "aria属性の適正利用率", "100%"), ("keyboard_completion", "キーボード操作完結率", "100%"), ("contrast_ratio", "コントラスト比適合率", "100%"),
        ("screen_reader", "スクリーンリーダー動作確認", "合格"),
    ],
    "performance": [("bundle_delta", "JSバンドルサイズ増分", "< +3%"), ("rerender_rate", "不要再レンダリング発生率", "0")],
    "code": [("eslint_violations", "ESLint違反数", "0")],
    "test": [("flaky_rate", "flaky test率", "0%")],
    "api": [("error_handling", "エラーハンドリング網羅率", "100%")],
    "security": [("csrf_protection", "CSRF対策", "有効"), ("auth_flow", "認証・認可フロー検証", "合格")],
    "i18n": [("translation_keys", "翻訳キー存在率", "100%"), ("pseudo_locale", "疑似ロケール対応", "合格"), ("formatting", "日付/数値フォーマット適正", "合格"), ("rtl", "RTL対応", "必要時合格")],
    "operations": [
        ("logging_design", "ログ出力設計", "定義済み"), ("error_tracking", "エラートラッキング", "定義済み"), ("feature_flags", "Feature Flag対応", "必要箇所で実装"),
        ("externalized_config", "設定の外部化", "定義済み"),
    ],
    "build": [("build_time", "ビルド時間", "基準内"), ("cache_efficiency", "キャッシュ効率", "基準内"), ("rollback", "rollback手順有無", "あり"), ("environment_diff", "環境差異の有無", "差異管理済み")],
    "dependencies": [("unused_dependencies", "不要依存の有無", "0"), ("license_compliance", "ライセンス適合性", "適合"), ("maintenance_health", "メンテナンス状態", "健全")],
}
#: Where a manual metric stands before automatic ones of its category; all others follow them.
PLACES = {"eslint_violations": 2, "error_handling": 1, "csrf_protection": 1, "auth_flow": 2}
NOT_COLLECTED = "証跡未収集"
# What to do about a metric.
ACTIONS = {
    "zod_adoption": "parse-at-the-boundary", "design_system_usage_rate": "wrap-shared-components", "bespoke_ui_file_count": "move-to-shared-components", "type_escape_count": "narrow-instead-of-any",
    "high_responsibility_components": "split-state-fetch-view", "hardcoded_jsx_text": "move-to-translation-keys", "matching_test_file_presence": "test-features-first", "msw_alignment": "define-handlers",
    "timeout_retry": "wrap-fetcher", "ci_presence": "add-workflow",
}
# Metrics that a failed collection phase leaves without evidence.
PHASES = {
    "browser-audits": ["wcag_aa", "lighthouse_performance", "lcp", "tti"], "test-artifacts": ["unit_pass_rate", "coverage_rate"], "ui-test-artifacts": ["storybook_pass_rate", "e2e_pass_rate"],
    "api-artifacts": ["openapi_contract", "timeout_retry", "msw_alignment"], "security-artifacts": ["dependency_vulnerabilities"], "dangerous-html": ["dangerous_html"], "i18n-text": ["hardcoded_jsx_text"],
    "secret-scan": ["secret_indicators"], "visual-consumers": ["design_system_usage_rate", "bespoke_ui_file_count"], "responsibility": ["high_responsibility_components"], "zod-adoption": ["zod_adoption"],
    "ci-detection": ["ci_presence"], "documentation": ["documentation_presence"], "dependency-summary": ["external_package_count"], "type-check": ["typescript_errors", "tsconfig_type_safety"],
    "test-presence": ["matching_test_file_presence", "route_test_file_presence", "feature_test_file_presence", "form_test_file_presence", "ui_test_file_presence"],
}
#: Facts that the metrics need; those that are missing from a facts row count as not collected.
FACTS = {
    "visual_total": "long", "visual_backed": "long", "bespoke": "long", "axe_critical": "long", "axe_serious": "long", "axe_total": "long", "lighthouse_files": "long", "lh_score": "double",
    "lh_lcp": "double", "lh_tti": "double", "type_errors": "long", "type_check_skipped": "boolean", "configs": "long", "strict_configs": "long", "fully_strict_configs": "long", "cycles": "long",
    "responsible": "long", "escape_total": "double", "escape_mean": "double", "escape_high": "long", "presence_targets": "long", "presence_rate": "double", "route_targets": "long",
    "route_rate": "double", "feature_targets": "long", "feature_rate": "double", "form_targets": "long", "form_rate": "double", "ui_targets": "long", "ui_rate": "double", "junit_total": "long",
    "junit_passed": "long", "junit_failed": "long", "junit_skipped": "long", "vitest": "boolean", "lcov_files": "long", "line_coverage": "double", "storybook_total": "long", "storybook_passed": "long",
    "storybook_failed": "long", "storybook_skipped": "long", "e2e_total": "long", "e2e_passed": "long", "e2e_failed": "long", "e2e_skipped": "long", "openapi_breaking": "long", "openapi_specs": "long",
    "api_files": "long", "msw_handlers": "long", "resilient_files": "long", "zod_files": "long", "zod_rate": "double", "dangerous_html": "long", "secrets": "long", "audit_text": "string",
    "audit_severe": "boolean", "product_texts": "long", "docs": "long", "ci": "boolean", "packages": "long",
}


def _n(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _decimal(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", fixed(x, digits))


def _steps(value: Column, good: float, fair: float, higher: bool = True) -> Column:
    inside = (lambda limit: value >= limit) if higher else (lambda limit: value <= limit)
    return F.when(inside(good), "pass").when(inside(fair), "warn").otherwise("fail")


def _metric(id_: str, label: str, actual: Column, threshold: str | Column, verdict: Column, aggregation: str = "primary", static: bool = False, derived_from: str = "") -> dict:
    return {"id": id_, "label": label, "actual": actual, "threshold": threshold, "verdict": verdict, "aggregation": aggregation, "summary": "静的解析による推定" if static else derived_from}


def _missing(known: Column, metric: dict) -> dict:
    """The metric where its source is known, else without evidence."""
    return metric | {"actual": F.when(known, metric["actual"]).otherwise(NOT_COLLECTED), "verdict": F.when(known, metric["verdict"]).otherwise("manual")}


def _pass_rate(id_: str, label: str, source: str, without: Column | None = None) -> dict:
    """The share of passed among executed tests; skipped ones are not executed."""
    total, passed, failed = F.col(f"{source}_total"), F.col(f"{source}_passed"), F.col(f"{source}_failed")
    executed = F.greatest(F.lit(0), total - F.coalesce(f"{source}_skipped", F.lit(0)))
    rate = passed / executed * 100
    actual = F.when(total == 0, "0件").when(executed == 0, "実行0件（全てスキップ）").otherwise(F.concat(_decimal(rate, 1), F.lit("%")))
    verdict = F.when((total == 0) | (executed == 0), "warn").when((failed == 0) & (rate == 100), "pass").otherwise("fail")
    out = _missing(total.isNotNull(), _metric(id_, label, actual, "100%", verdict))
    if without is not None:
        out["actual"] = F.when(total.isNull() & without, "Vitest検出 / 結果未収集").otherwise(out["actual"])
    return out


def _presence(id_: str, label: str, targets: str, rate: str, profile: str, aggregation: str) -> dict:
    good, fair = PRESENCE[profile]
    n, r = F.col(targets), F.col(rate)
    verdict = F.when(n == 0, "not_applicable").otherwise(_steps(r, good, fair))
    actual = F.when(n == 0, "対象ソースなし").otherwise(F.concat(_decimal(r, 1), F.lit("%")))
    return _missing(n.isNotNull(), _metric(id_, label, actual, f"PASS>={good}% / WARN>={fair}%", verdict, aggregation, static=True))


def definitions(profile: str = "application") -> dict[str, list[dict]]:
    """The metrics of each category over the columns of FACTS."""
    c = F.col
    none = F.lit("N/A")
    rate = F.when(c("visual_total") > 0, c("visual_backed") / c("visual_total") * 100).otherwise(0.0)
    axe = F.when((c("axe_critical") == 0) & (c("axe_serious") == 0), F.when(c("axe_total") == 0, "pass").otherwise("warn")).otherwise("fail")
    lighthouse = c("lighthouse_files") > 0

    def seconds(id_: str, label: str, column: str, good: float, fair: float) -> dict:
        v = c(column)
        verdict = F.when(v.isNull(), "warn").when(v < good, "pass").when(v < fair, "warn").otherwise("fail")
        return _missing(lighthouse, _metric(id_, label, F.when(v.isNull(), "算出不能").otherwise(F.concat(_decimal(v, 2), F.lit("s"))), f"< {good}s", verdict))

    def count(id_: str, label: str, column: str, verdict: Column, threshold: str = "0", **more) -> dict:
        return _missing(c(column).isNotNull(), _metric(id_, label, _n(column), threshold, verdict, **more))

    def zero(column: str) -> Column:
        return F.when(c(column) == 0, "pass").otherwise("fail")

    strict = F.when(c("strict_configs") == c("configs"), "pass").when(c("strict_configs") > 0, "warn").otherwise("fail")
    strict_text = F.concat(F.lit("full="), _n("fully_strict_configs"), F.lit("/"), _n("configs"), F.lit(", strict="), _n("strict_configs"), F.lit("/"), _n("configs"))
    escapes = F.when(c("escape_total") == 0, "pass").when((c("escape_high") == 0) & (c("escape_mean") <= 2), "warn").otherwise("fail")
    escape_text = F.when(c("escape_total") == 0, "0").otherwise(
        F.concat(_decimal(c("escape_total"), 1), F.lit(" (avg "), _decimal(c("escape_mean"), 2), F.lit(", high-risk "), _n("escape_high"), F.lit(")"))
    )
    errors = _metric("typescript_errors", "TypeScript型エラー数", _n("type_errors"), "0", F.when(F.coalesce("type_check_skipped", F.lit(False)), "manual").otherwise(zero("type_errors")))
    strictness = _metric("tsconfig_type_safety", "tsconfig型安全設定", F.when(c("configs").isNull(), "unknown").otherwise(strict_text), "strict=all configs", F.when(c("configs").isNull(), "manual").otherwise(strict))

    zod_good, zod_fair, zod_least = ZOD[profile]
    zod = F.when((c("zod_files") == 0) | (F.lit(profile == "library-repo") & (c("zod_files") < zod_least)), "not_applicable").otherwise(_steps(c("zod_rate"), zod_good, zod_fair))
    zod_text = F.when(c("zod_files") == 0, "対象API層なし").otherwise(F.concat(_decimal(c("zod_rate"), 1), F.lit("%")))
    zod_limit = f"PASS>={zod_good}% / WARN>={zod_fair}%" + (f" (files>={zod_least})" if profile == "library-repo" else "")
    specs = F.when(F.coalesce("openapi_specs", F.lit(0)) > 0, "specあり / diffなし").otherwise(NOT_COLLECTED)
    contract = _metric(
        "openapi_contract", "APIレスポンス整合性", F.when(c("openapi_breaking").isNull(), specs).otherwise(F.concat(F.lit("breaking="), _n("openapi_breaking"))), "breaking=0",
        F.when(c("openapi_breaking").isNull(), "manual").otherwise(zero("openapi_breaking")),
    )
    no_api = c("api_files") == 0

    def api_signal(id_: str, label: str, actual: Column, threshold: str, found: Column) -> dict:
        m = _metric(id_, label, F.when(no_api, "対象API層なし").otherwise(actual), F.when(no_api, none).otherwise(threshold), F.when(no_api, "not_applicable").otherwise(F.when(found > 0, "pass").otherwise("warn")))
        return _missing(c("api_files").isNotNull(), m)

    texts = TEXTS_WARN[profile]
    packages = PACKAGES[profile]
    return {
        "functional": [],
        "uiux": [
            _missing(c("visual_total").isNotNull(), _metric(
                "design_system_usage_rate", "デザインシステム準拠率（静的推定）", F.when(c("visual_total") == 0, "対象画面なし").otherwise(F.concat(_decimal(rate, 1), F.lit("%"))), ">= 80%",
                F.when(c("visual_total") == 0, "not_applicable").otherwise(_steps(rate, 80, 50)))),
            count("bespoke_ui_file_count", "独自UI実装ファイル件数（静的推定）", "bespoke", _steps(c("bespoke"), 0, 2, False)),
        ],
        "accessibility": [
            _missing(c("axe_total").isNotNull(), _metric(
                "wcag_aa", "WCAG 2.2 AA準拠率（axe推定）", F.concat(F.lit("critical="), _n("axe_critical"), F.lit(", serious="), _n("axe_serious"), F.lit(", total="), _n("axe_total")),
                F.when(c("axe_total").isNull(), "AA").otherwise("critical=0, serious=0"), axe)),
        ],
        "performance": [
            _missing(lighthouse, _metric("lighthouse_performance", "Lighthouse Performance", F.when(c("lh_score").isNull(), "算出不能").otherwise(_decimal(c("lh_score"), 1)), ">= 90",
                                         F.when(c("lh_score").isNull(), "warn").otherwise(_steps(c("lh_score"), 90, 75)))),
            seconds("lcp", "初期表示時間（LCP）", "lh_lcp", 2.5, 4), seconds("tti", "インタラクティブ時間（TTI）", "lh_tti", 3.5, 5),
        ],
        "code": [
            errors, strictness, count("circular_dependencies", "循環依存数", "cycles", zero("cycles")),
            count("high_responsibility_components", "高責務コンポーネント件数（静的推定）", "responsible", _steps(c("responsible"), 0, 2, False)),
            _missing(c("escape_total").isNotNull(), _metric("type_escape_count", "型の逃げ道スコア", escape_text, "0 / WARN avg<=2 & high-risk=0", escapes)),
        ],
        "test": [
            _presence("matching_test_file_presence", "対応テストファイル存在率（重み付き推定）", "presence_targets", "presence_rate", profile, "primary"),
            *[_presence(f"{b}_test_file_presence", f"{n}テスト対応率（重み付き推定）", f"{b}_targets", f"{b}_rate", profile, "derived") for b, n in (("route", "Route"), ("feature", "Feature"), ("form", "Form"), ("ui", "UI"))],
            _pass_rate("unit_pass_rate", "Unitテスト通過率", "junit", F.coalesce("vitest", F.lit(False))), _pass_rate("storybook_pass_rate", "Storybook Interactionテスト通過率", "storybook"),
            _pass_rate("e2e_pass_rate", "E2Eテスト通過率", "e2e"),
            _missing(c("lcov_files") > 0, _metric("coverage_rate", "テスト網羅率（LCOV line coverage）", F.when(c("line_coverage").isNull(), "算出不能").otherwise(F.concat(_decimal(c("line_coverage"), 1), F.lit("%"))), ">= 80%",
                                                  F.when(c("line_coverage").isNull(), "warn").when(c("line_coverage") >= 80, "pass").otherwise("fail"))),
        ],
        "api": [
            contract, api_signal("timeout_retry", "タイムアウト/リトライ設計有無", F.concat(_n("resilient_files"), F.lit("/"), _n("api_files"), F.lit(" files")), ">= 1 file", c("resilient_files")),
            api_signal("msw_alignment", "MSWとの整合性（採用シグナル）", F.concat(F.lit("handlers="), _n("msw_handlers")), ">= 1", c("msw_handlers")),
            _missing(c("zod_files").isNotNull(), _metric("zod_adoption", "データ型検証採用率（zod静的推定）", zod_text, zod_limit, zod)),
        ],
        "security": [
            count("dangerous_html", "dangerouslySetInnerHTML使用件数", "dangerous_html", zero("dangerous_html")),
            _missing(c("audit_text").isNotNull(), _metric("dependency_vulnerabilities", "依存ライブラリ脆弱性", c("audit_text"), F.when(c("audit_text").isNull(), "High=0").otherwise("critical=0, high=0"),
                                                          F.when(c("audit_severe"), "fail").otherwise("pass"))),
            count("secret_indicators", "機密情報露出シグナル件数", "secrets", zero("secrets"), static=True),
        ],
        "i18n": [count("hardcoded_jsx_text", "ハードコード製品文言件数（JSX）", "product_texts", _steps(c("product_texts"), 0, texts, False), f"0, WARN<={texts}")],
        "operations": [_missing(c("docs").isNotNull(), _metric("documentation_presence", "ドキュメント整備率シグナル", F.concat(_n("docs"), F.lit(" 件")), ">= 1", F.when(c("docs") > 0, "pass").otherwise("warn")))],
        "build": [_missing(c("ci").isNotNull(), _metric("ci_presence", "CI設定有無", F.when(c("ci"), "あり").otherwise("なし"), "あり", F.when(c("ci"), "pass").otherwise("warn")))],
        "dependencies": [
            count("external_package_count", "外部依存パッケージ数", "packages", _steps(c("packages"), *packages, False), f"<= {packages[0]} / WARN<={packages[1]}"),
            count("dependency_cycle_count", "循環依存件数（コード品質と同一事象）", "cycles", zero("cycles"), aggregation="derived"),
        ],
    }


def build_metrics(facts: DataFrame, profile: str = "application") -> DataFrame:
    """One row of facts -> the metric table."""
    known = dict(facts.dtypes)
    facts = facts.select(*[F.col(c).cast(t).alias(c) if c in known else F.lit(None).cast(t).alias(c) for c, t in FACTS.items()])
    rows = []
    for category, automatic in definitions(profile).items():
        listed = list(automatic)
        for i, label, limit in MANUAL[category]:
            listed.insert(PLACES.get(i, len(listed)), _metric(i, label, F.lit(NOT_COLLECTED), limit, F.lit("manual")))
        for m in listed:
            verdict, limit = m["verdict"], m["threshold"]
            rows.append(F.struct(
                F.lit(category).alias("category"), F.lit(len(rows)).alias("position"), F.lit(m["id"]).alias("id"), F.lit(m["label"]).alias("label"), F.lit(m["aggregation"]).alias("aggregation"),
                m["actual"].alias("actual"), (F.lit(limit) if isinstance(limit, str) else limit).alias("threshold"), verdict.alias("verdict"),
                F.when(verdict == "manual", "manual").otherwise("automatic").alias("automation"), F.lit(m["summary"]).alias("summary"),
            ))
    return facts.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def phase_failures(failures: DataFrame) -> DataFrame:
    """failures (phase, seq, reason) -> (id, seq, reason) of the metrics that each leaves without evidence."""
    pairs = F.create_map(*[x for p, ids in PHASES.items() for x in (F.lit(p), F.array(*map(F.lit, ids)))])
    return failures.select(F.explode(F.try_element_at(pairs, F.col("phase"))).alias("id"), "seq", "reason")


def warned_metric(source: Column | str, warning: Column | str) -> Column:
    """The metric that a warning about an unread artifact belongs to; source is browser, test, ui-test, api or security."""
    s, w = (F.col(x) if isinstance(x, str) else x for x in (source, warning))
    name = F.lower(F.substring_index(w, ":", 1))
    return (
        F.when(s == "browser", F.when(name.contains("lighthouse"), "lighthouse_performance").otherwise("wcag_aa"))
        .when(s == "test", F.when(name.contains("lcov"), "coverage_rate").otherwise("unit_pass_rate"))
        .when(s == "ui-test", F.when(name.contains("storybook"), "storybook_pass_rate").otherwise("e2e_pass_rate"))
        .when(s == "api", "openapi_contract").when(s == "security", "dependency_vulnerabilities")
    )


def with_warnings(metrics: DataFrame, warnings: DataFrame) -> DataFrame:
    """metrics with n_warnings and their texts; warnings (source, warning)."""
    w = warnings.select(warned_metric("source", "warning").alias("_id"), "warning").groupBy("_id").agg(F.count(F.lit(1)).alias("n_warnings"), F.array_sort(F.collect_list("warning")).alias("warnings"))
    out = metrics.join(F.broadcast(w), F.col("id") == F.col("_id"), "left").drop("_id")
    return out.withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0))).withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


# What a report shows


def evaluation(m: DataFrame) -> tuple[Column, Column, Column]:
    """How a metric was evaluated, on what evidence, and how sure it is; m has n_evidence."""
    static = F.concat("label", F.lit(" "), "summary").contains("静的")
    none, by_hand = F.col("verdict") == "not_applicable", F.col("automation") == "manual"
    given = F.col("n_evidence") > 0
    kind = F.when(none, "対象外").when(by_hand, F.when(given, "手動入力").otherwise("未収集")).when(static, "静的推定").otherwise("実測/集計")
    source = F.when(none, "対象外").when(by_hand, F.when(given, "手動/入力済み").otherwise("手動/未収集")).when(static, "自動/静的推定").otherwise("自動/実測")
    sure = F.when(none, "—").when(by_hand, "低").when(static, "中").otherwise("高")
    return kind, source, sure


AUTOMATABLE = r"(axe|lighthouse|lcov|junit|playwright|storybook|openapi|trivy|audit|eslint|json|xml|coverage|ビルド時間|キャッシュ効率|通過率|翻訳キー|bundle|取込|実行結果)"


def is_automatable() -> Column:
    """Whether a manual metric's texts name something that a tool reports."""
    return F.lower(F.concat_ws(" ", "label", "summary", "actual", "threshold")).rlike(AUTOMATABLE)


def action() -> Column:
    known = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.col("id")), F.when(F.col("automation") == "manual", "collect-evidence").otherwise("improve-main-targets"))


SEVERITY = {"fail": 0, "warn": 1, "partial": 2, "manual": 3, "pass": 4, "not_applicable": 5}


def _severity() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("verdict"))


def _category_label() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("category"))


def _top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _problem() -> Column:
    return F.col("verdict").isin("fail", "warn", "partial")


def priorities(metrics: DataFrame, limit: int = 8) -> DataFrame:
    """(rank, category, id, verdict): the metrics to work on: the primary problems of a category, or else its derived ones; worst first."""
    primary = F.col("aggregation") == "primary"
    has = F.max(F.when(primary & _problem(), 1).otherwise(0)).over(Window.partitionBy("category"))
    rows = metrics.withColumn("has", has).filter(_problem() & ((primary & (F.col("has") == 1)) | (~primary & (F.col("has") == 0))))
    order = [_severity(), F.when(primary, 0).otherwise(1), F.concat(_category_label(), F.lit(":"), F.col("label"))]
    return _top(rows, order, limit).select("rank", "category", "id", "verdict")


def blocking(metrics: DataFrame, limit: int = 3) -> DataFrame:
    """(rank, category, id): automatic primaries that fail, by name."""
    rows = metrics.filter("aggregation = 'primary' AND automation = 'automatic' AND verdict = 'fail'")
    return _top(rows, [F.concat(_category_label(), F.lit(":"), F.col("label"))], limit).select("rank", "category", "id")


def derived_insights(metrics: DataFrame, limit: int = 2) -> DataFrame:
    """(rank, id, verdict): derived problems, worst first, the feature tests before others, then the lowest numbers."""
    order = [_severity(), F.when(F.col("id") == "feature_test_file_presence", 0).otherwise(1), T.any_number("actual"), F.col("position")]
    return _top(metrics.filter((F.col("aggregation") == "derived") & _problem()), order, limit).select("rank", "id", "verdict")


def pending(metrics: DataFrame) -> DataFrame:
    """(category, n, ids): primaries that wait for manual evidence; and which categories have nothing else."""
    primary = metrics.filter("aggregation = 'primary'")
    manual = F.col("verdict") == "manual"
    ids = F.transform(F.array_sort(F.collect_list(F.when(manual, F.struct("position", "id")))), lambda s: s["id"])
    g = primary.groupBy("category").agg(F.count_if(manual).alias("n"), F.array_join(ids, ",").alias("ids"), F.bool_and(F.col("verdict").isin("manual", "not_applicable")).alias("manual_only"))
    return g.filter("n > 0")


def coverage(metrics: DataFrame) -> DataFrame:
    """One row: automatic primaries among all, and how many of the applicable ones pass, with and without static estimates."""
    p = metrics.filter("aggregation = 'primary'")
    auto = F.col("automation") == "automatic"
    live = auto & (F.col("verdict") != "not_applicable")
    measured = live & ~F.concat("label", F.lit(" "), "summary").contains("静的")
    sums = [F.count_if(auto).alias("automatic"), F.count(F.lit(1)).alias("total")]
    for name, rows in (("all", live), ("measured", measured)):
        sums += [F.count_if(rows).alias(f"{name}_n"), *[F.count_if(rows & (F.col("verdict") == v)).alias(f"{name}_{v}") for v in ("pass", "warn", "fail", "partial")]]
    one = p.agg(*sums)

    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(0.0)

    return one.withColumns({"coverage_rate": rate("automatic", "total"), "all_rate": rate("all_pass", "all_n"), "measured_rate": rate("measured_pass", "measured_n")})


def category_summaries(metrics: DataFrame) -> DataFrame:
    """Per category: automatic primaries, primaries by verdict, and derived metrics that fail or warn."""
    primary = F.col("aggregation") == "primary"
    counts = [F.count_if(primary & (F.col("verdict") == v)).alias(v) for v in ("fail", "warn", "partial", "manual")]
    return metrics.groupBy("category").agg(
        F.count_if(primary & (F.col("automation") == "automatic")).alias("automatic"), *counts, F.count_if(~primary).alias("derived"),
        F.count_if(~primary & (F.col("verdict") == "fail")).alias("derived_fail"), F.count_if(~primary & (F.col("verdict") == "warn")).alias("derived_warn"),
    )


def csv_lines(metrics: DataFrame) -> DataFrame:
    """(position, line): the metric table as CSV, every cell quoted."""
    cells = [_category_label(), "label", "id", "aggregation", "automation", "actual", "threshold", "verdict", "summary"]
    return metrics.select("position", T.csv_row(*cells, always=True).alias("line"))


def evidence_order(evidence: DataFrame) -> list[Column]:
    """Evidence (type, label, value, file) of files first, then by score, path, line and text."""
    text = F.concat_ws(" ", "label", "value")
    return [F.when(F.col("file").isNull(), 1).otherwise(0), T.evidence_score(text).desc(), F.coalesce("file", F.lit("")), T.evidence_line(text), F.concat("label", F.lit(": "), "value")]


def evidence_targets(evidence: DataFrame, limit: int = 3) -> DataFrame:
    """(id, targets, rest): the first distinct files of each metric's evidence (id, seq, type, label, value, file), and how many more."""
    w = Window.partitionBy("id").orderBy(*evidence_order(evidence), "seq")
    ranked = evidence.withColumn("r", F.row_number().over(w)).filter("file IS NOT NULL").groupBy("id", "file").agg(F.min("r").alias("r"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("r"))
    rows = ranked.withColumn("n", n)
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct("n", "file")))), lambda s: s["file"])
    return rows.groupBy("id").agg(F.array_join(shown, "、").alias("targets"), F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("rest"))


# Comparison and gate


def serialised(evidence: Column) -> Column:
    """Evidence (label, value, file) as texts by which two reports are compared."""
    def place(e: Column) -> Column:
        return F.when(e["file"].isNotNull() & (e["file"] != e["value"]), F.concat(F.lit(" ("), e["file"], F.lit(")"))).otherwise("")

    return F.transform(evidence, lambda e: F.concat(e["label"], F.lit(": "), e["value"], place(e)))


def metric_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(category, id, changes): what differs between two metric tables, as texts; summaries only as 'summary updated'."""
    names = ["verdict", "actual", "threshold", "automation", "aggregation"]
    side = lambda df, p: df.select(*[F.col(x).alias(f"{p}_{x}") for x in ("category", "id", "summary", *names)])
    j = side(current, "c").join(side(baseline, "b"), (F.col("c_category") == F.col("b_category")) & (F.col("c_id") == F.col("b_id")), "full_outer")
    none = F.lit("none")
    texts = [F.when(~F.col(f"c_{x}").eqNullSafe(F.col(f"b_{x}")), F.concat(F.lit(f"{x}: "), F.coalesce(f"b_{x}", none), F.lit(" -> "), F.coalesce(f"c_{x}", none))) for x in names]
    texts.append(F.when(~F.col("c_summary").eqNullSafe(F.col("b_summary")), F.lit("summary updated")))
    return j.select(F.coalesce("c_category", "b_category").alias("category"), F.coalesce("c_id", "b_id").alias("id"), F.array_compact(F.array(*texts)).alias("changes"))


def category_changes(diff: DataFrame, current: DataFrame, baseline: DataFrame) -> DataFrame:
    """quality_diff() and the verdicts (category, verdict) of both reports -> one row per category: status, verdicts and counts of metrics."""
    counts = diff.groupBy("category").agg(
        F.count_if(F.col("status") != "unchanged").alias("changed"), F.count_if(F.col("trend") == "improved").alias("improved"), F.count_if(F.col("trend") == "regressed").alias("regressed"),
        F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "removed").alias("removed"), F.count_if(F.col("status") == "unchanged").alias("unchanged"),
    )
    c = current.select(F.col("category").alias("cc"), F.col("verdict").alias("cur_verdict"))
    b = baseline.select(F.col("category").alias("bc"), F.col("verdict").alias("base_verdict"))
    j = c.join(b, F.col("cc") == F.col("bc"), "full_outer").withColumn("category", F.coalesce("cc", "bc")).join(counts, "category", "left").fillna(0)
    moved = (F.col("changed") > 0) | ~F.col("cur_verdict").eqNullSafe(F.col("base_verdict"))
    status = F.when(F.col("bc").isNull(), "added").when(F.col("cc").isNull(), "removed").when(moved, "changed").otherwise("unchanged")
    return j.select("category", status.alias("status"), "base_verdict", "cur_verdict", "changed", "improved", "regressed", "added", "removed", "unchanged")


def diff_summary(diff: DataFrame, categories: DataFrame) -> DataFrame:
    """One row over primary metrics: changed, improved, regressed (by hand and automatic), and changed categories."""
    p = diff.filter("aggregation = 'primary'")
    regressed = F.col("trend") == "regressed"
    one = p.agg(
        F.count_if(F.col("status") != "unchanged").alias("changed"), F.count_if(F.col("trend") == "improved").alias("improved"), F.count_if(regressed).alias("regressed"),
        F.count_if(regressed & (F.col("cur_automation") == "automatic")).alias("automatic_regressions"), F.count_if(regressed & (F.col("cur_automation") == "manual")).alias("manual_regressions"),
    )
    return one.crossJoin(categories.agg(F.count_if(F.col("status") != "unchanged").alias("changed_categories")))


def unknown_ids(metrics: DataFrame, ids: list[str]) -> list[str]:
    """Configured metric ids that no metric has, in order; blank ones do not count. Metric tables are as long as a report."""
    known = {r["id"] for r in metrics.select("id").distinct().collect()}
    return list(dict.fromkeys(i for i in ids if i.strip() and i not in known))


def validate_gate(metrics: DataFrame, blocking_ids: list[str], monitoring_ids: list[str]) -> dict:
    """Unknown blocking and monitoring ids, and whether all blocking ones are unknown, so that the gate would hold nothing."""
    unknown = unknown_ids(metrics, blocking_ids)
    given = [i for i in blocking_ids if i.strip()]
    return {"unknown_blocking": unknown, "unknown_monitoring": unknown_ids(metrics, monitoring_ids), "blocking_all_unknown": bool(given) and set(given) <= set(unknown)}
