"""Registered queries over the source project made of the shared tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import paths as P
from tallyforge.operators import facts as A
from tallyforge.plans import project as S
from tallyforge.plans.queries import register


def rounded(x: str, digits: int = 2) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def plain(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {rounded(x)}), '\\.?0+$', '')"


def _in(column: str, kinds: tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"


@register(f"WITH {S.FILES} SELECT path, kind FROM files")
def file_kinds(spark, d):
    return S.files(spark, d).select("path", "kind")


@register(f"""WITH {S.FILES} SELECT path, NOT {_in('kind', P.SOURCE_ONLY_WITHOUT)} AS in_scope, NOT {_in('kind', P.TARGETS_WITHOUT)} AS hotspot_target,
  NOT {_in('kind', P.TEST_TARGETS_WITHOUT)} AS test_target, NOT {_in('kind', P.TRAVERSAL_WITHOUT)} AS ends_walk,
  regexp_matches(lower(path), '{P.TEST_PATH}') OR regexp_matches(lower(path), '{P.TEST_NAME}') AS test_path,
  regexp_matches(path, '(^|/)index\\.(tsx?|jsx?)$') AS barrel, regexp_matches(lower(path), '(^|/)(api|infra|services?|clients?|repository|repositories|gateway)(/|$)') AS api_layer,
  CASE WHEN kind = 'UI component' OR lower(path) LIKE '%/components/ui/%' OR lower(path) LIKE '%/shared/ui/%' OR lower(path) LIKE '%/components/commons/%' THEN 'library' ELSE 'product' END AS text_scope
FROM files""")
def scope_flags(spark, d):
    return S.files(spark, d).select(
        "path", P.in_scope("kind").alias("in_scope"), P.is_hotspot_target("kind").alias("hotspot_target"), P.is_test_target("kind").alias("test_target"), P.ends_test_walk("kind").alias("ends_walk"),
        P.is_test_path("path").alias("test_path"), P.is_barrel("path").alias("barrel"), P.is_api_layer("path").alias("api_layer"), P.text_scope("path", "kind").alias("text_scope"),
    )


SEGMENT_SQL = "CASE WHEN lower(path) LIKE 'apps/%' THEN 'apps' WHEN lower(path) LIKE 'packages/%' THEN 'packages' WHEN lower(path) LIKE 'src/%' THEN 'src' ELSE 'other' END"
#: The feature of a path: its root folder's place in the path decides.
FEATURE_SQL = f"""labelled AS (
  SELECT *, {SEGMENT_SQL} AS segment, CASE WHEN pos = 0 OR pos >= len(parts) THEN NULL WHEN pos + 1 < len(parts) THEN array_to_string(parts[1:pos + 1], '/')
    WHEN NOT {_in('kind', P.SOURCE_ONLY_WITHOUT)} THEN array_to_string(parts[1:pos], '/') || '/' || regexp_replace(parts[len(parts)], '{P.SOURCE}', '') END AS feature
  FROM (SELECT *, coalesce(list_position(list_transform(parts, lambda x: regexp_full_match(lower(x), 'features?|modules?|domains?|scenes?|containers?')), true), 0) AS pos
    FROM (SELECT *, string_split(path, '/') AS parts FROM files))
)"""


@register(f"""WITH {S.FILES}, {FEATURE_SQL} SELECT path, segment, feature,
  CASE kind WHEN 'API/Infrastructure' THEN 1.4::DOUBLE WHEN 'Context/State' THEN 1.4 WHEN 'Hook' THEN 1.4 WHEN 'Schema' THEN 1.4 WHEN 'Validation' THEN 1.4 WHEN 'Type Support' THEN 1.4
    WHEN 'Route' THEN 1.2 WHEN 'Feature' THEN 1.2 WHEN 'Form' THEN 1.2 WHEN 'Layout' THEN 1.2 WHEN 'Barrel' THEN 0.8 ELSE 1.0 END AS escape_weight,
  CASE kind WHEN 'Route' THEN 'route' WHEN 'Form' THEN 'form' WHEN 'UI component' THEN 'ui' WHEN 'Layout' THEN 'ui' WHEN 'Shared' THEN 'ui' ELSE 'feature' END AS bucket,
  CASE WHEN path LIKE '%.tsx' THEN 'TSX' WHEN path LIKE '%.jsx' THEN 'JSX' WHEN path LIKE '%.mjs' THEN 'JS' ELSE 'TS' END AS script
FROM labelled""")
def path_labels(spark, d):
    return S.files(spark, d).select(
        "path", P.segment_id("path").alias("segment"), P.feature_label("path", "kind").alias("feature"), P.escape_weight("kind").alias("escape_weight"), P.test_bucket("kind").alias("bucket"),
        P.script_kind("path").alias("script"),
    )


#: Keys of sources and of what tests are for, as SQL: (path, key).
KEYS_SQL = f"""base_keys AS (
  SELECT path, kind, lower(regexp_replace(path, '{P.SOURCE}', '')) AS k FROM files
), source_keys AS (
  SELECT path, kind, unnest([k, CASE WHEN k LIKE 'src/%' THEN substr(k, 5) ELSE 'src/' || k END]) AS key FROM base_keys
), stripped AS (
  SELECT path, kind, regexp_replace(array_to_string(list_filter(string_split(k, '/'), lambda s: NOT list_contains(['__tests__','tests','test','e2e','playwright','cypress','.storybook'], s)), '/'), '{P.TEST_ENDING}', '') AS k FROM base_keys
), tested_keys AS (
  SELECT path, kind, unnest([k, CASE WHEN k LIKE 'src/%' THEN substr(k, 5) ELSE 'src/' || k END]) AS key FROM stripped
)"""


@register(f"""WITH {S.FILES}, {KEYS_SQL} SELECT path, string_agg(key, ' ' ORDER BY key) AS keys, (SELECT string_agg(key, ' ' ORDER BY key) FROM tested_keys t WHERE t.path = s.path) AS tested
FROM source_keys s GROUP BY path""")
def match_keys(spark, d):
    def text(keys):
        return F.array_join(F.array_sort(keys), " ")

    return S.files(spark, d).select("path", text(P.source_keys("path")).alias("keys"), text(P.tested_keys("path")).alias("tested"))


@register(f"""WITH {S.FILES}, {KEYS_SQL}, wanted AS (SELECT DISTINCT key FROM tested_keys WHERE kind = 'Test')
SELECT f.path, kind = 'Test' OR EXISTS (SELECT 1 FROM source_keys s JOIN wanted w ON s.key = w.key WHERE s.path = f.path) AS has_test FROM files f""")
def files_with_tests(spark, d):
    from tallyforge.operators.evidence import with_matching_test

    return with_matching_test(S.files(spark, d)).select("path", "has_test")


PRESSURE = "n_hooks / greatest(n_components, 1)"
#: Score breakdown of every file as SQL; needs functions, components and hooks with the suffix.
def breakdown_sql(s: str = "") -> str:
    return f"""fn{s} AS (
  SELECT path, count(*) AS n_functions, avg(cc) AS avg_fn, max(cc) AS peak_fn, max(nesting) AS peak_nesting, count(*) FILTER (cc >= 5 OR nesting >= 4) AS elevated,
    list_avg(list_sort(list(cc), 'DESC')[1:3]) AS top3_fn FROM functions{s} GROUP BY path
), co{s} AS (SELECT path, count(*) AS n_components, avg(render) AS avg_render, max(render) AS peak_render FROM components{s} GROUP BY path
), ho{s} AS (SELECT path, count(*) AS n_hooks FROM hooks{s} GROUP BY path
), gathered{s} AS (
  SELECT f.path, coalesce(n_functions, 0) AS n_functions, coalesce(n_components, 0) AS n_components, coalesce(n_hooks, 0) AS n_hooks, coalesce(avg_fn, 0) AS avg_fn, coalesce(peak_fn, 0) AS peak_fn,
    coalesce(top3_fn, 0) AS top3_fn, coalesce(avg_render, 0) AS avg_render, coalesce(peak_render, 0) AS peak_render, coalesce(peak_nesting, 0) AS peak_nesting, coalesce(elevated, 0) AS elevated
  FROM files f LEFT JOIN fn{s} USING (path) LEFT JOIN co{s} USING (path) LEFT JOIN ho{s} USING (path)
), weighed{s} AS (
  SELECT *, avg_fn * 0.3::DOUBLE + peak_fn * 0.4::DOUBLE + top3_fn * 0.2::DOUBLE + avg_render * 1.2::DOUBLE + peak_render * 0.8::DOUBLE + least(6, greatest(0, peak_nesting - 2)) * 0.7::DOUBLE
    + least(4.0::DOUBLE, {PRESSURE}) * 0.4::DOUBLE + least(3, elevated) * 1.1::DOUBLE AS raw FROM gathered{s}
), breakdown{s} AS (
  SELECT path, n_functions, n_components, n_hooks, {rounded('avg_fn')} AS avg_fn, peak_fn, {rounded('top3_fn')} AS top3_fn, {rounded('avg_render')} AS avg_render, peak_render,
    {rounded(PRESSURE)} AS hook_pressure, peak_nesting, elevated, {rounded('raw')} AS weighted_score,
    CASE WHEN n_functions + n_components + n_hooks = 0 THEN 0 ELSE greatest(1, floor({rounded('raw')} + 0.5)) END::BIGINT AS complexity FROM weighed{s}
)"""


def snapshot(spark, d, baseline=False, numbered=False):
    """The five fact tables of a snapshot."""
    return [f(spark, d, baseline, numbered) for f in (S.functions, S.components, S.hooks, S.dependencies, S.types)]


@register(f"WITH {S.FACTS}, {breakdown_sql()} SELECT * FROM breakdown")
def complexity_breakdown(spark, d):
    return S.named(A.breakdown(S.numbered_files(spark, d), *snapshot(spark, d, numbered=True)[:3]))


@register(f"WITH {S.FACTS} SELECT CASE WHEN cc <= 5 THEN 'low' WHEN cc <= 10 THEN 'medium' ELSE 'high' END AS risk, count(*) AS n, max(nesting) AS deepest FROM functions GROUP BY risk")
def function_risks(spark, d):
    return S.functions(spark, d).groupBy(A.function_risk("cc").alias("risk")).agg(F.count(F.lit(1)).alias("n"), F.max("nesting").alias("deepest"))


#: Everything known of each file as SQL.
SCORED_FILES = f"""{S.FACTS}, {breakdown_sql()}, dc AS (
  SELECT source AS path, count(*) AS n_dependencies, count(*) FILTER (is_external) AS n_external FROM dependencies GROUP BY source
), pk AS (
  SELECT path, name AS peak_name, cc AS peak_cc, start_line AS peak_line FROM functions QUALIFY row_number() OVER (PARTITION BY path ORDER BY cc DESC, start_line, name) = 1
), joined AS (
  SELECT f.path, kind, code_lines, total_lines, b.* EXCLUDE (path), coalesce(n_dependencies, 0) AS n_dependencies, coalesce(n_external, 0) AS n_external, coalesce(peak_cc, 0) AS peak_cc, peak_name, peak_line,
    coalesce(any_count, 0) AS any_count, coalesce(assertion, 0) AS assertion, coalesce(unsafe, 0) AS unsafe, coalesce(double, 0) AS double, coalesce(const, 0) AS const, coalesce(non_null, 0) AS non_null,
    coalesce(ts_ignore, 0) AS ts_ignore, coalesce(ts_expect, 0) AS ts_expect, coalesce(ts_nocheck, 0) AS ts_nocheck
  FROM files f JOIN breakdown b USING (path) LEFT JOIN dc USING (path) LEFT JOIN pk USING (path) LEFT JOIN types USING (path)
), scored AS (
  SELECT *, CASE WHEN code_lines <= 100 THEN 'S' WHEN code_lines <= 300 THEN 'M' ELSE 'L' END || CASE WHEN complexity <= 6 THEN '1' WHEN complexity <= 12 THEN '2' ELSE '3' END AS cluster,
    2 * n_dependencies + n_hooks + CASE WHEN code_lines > 300 THEN 4 WHEN code_lines > 100 THEN 2 ELSE 0 END AS structure,
    CASE WHEN {_in('kind', P.TARGETS_WITHOUT)} THEN 0 ELSE 4 * any_count + 4 * unsafe + 5 * double + greatest(0, assertion - unsafe - double - const) + 2 * non_null + 5 * ts_ignore + 4 * ts_expect + 20 * ts_nocheck END AS type_safety
  FROM joined
)"""
CLUSTER_WEIGHT = "CASE cluster WHEN 'L3' THEN 18 WHEN 'M3' THEN 12 WHEN 'L2' THEN 10 WHEN 'S3' THEN 8 WHEN 'M2' THEN 6 WHEN 'L1' THEN 4 WHEN 'S2' THEN 3 ELSE 1 END"
DRIVERS_SQL = f"""concat_ws(', ', 'weighted=' || {plain('weighted_score')}, CASE WHEN peak_cc > 0 THEN 'peakFn=' || peak_cc || ' (' || peak_name || ', line ' || peak_line || ')' END,
  CASE WHEN n_functions >= 2 THEN 'top3avg=' || {plain('top3_fn')} END, CASE WHEN peak_nesting > 0 THEN 'nesting=' || peak_nesting END, CASE WHEN peak_render > 0 THEN 'renderPeak=' || peak_render END,
  CASE WHEN hook_pressure > 0 THEN 'hookPressure=' || {plain('hook_pressure')} END, CASE WHEN elevated > 0 THEN 'elevatedFns=' || elevated END)"""


def hot_sql(scored: str, limit: int) -> str:
    return f"""SELECT path, (5 * complexity + 2 * n_dependencies + 4 * any_count + n_hooks + {CLUSTER_WEIGHT})::BIGINT AS score, cluster, complexity, n_dependencies, any_count,
  coalesce(nullif(concat_ws(', ', CASE WHEN complexity >= 12 THEN 'complexity>=12' END, CASE WHEN cluster LIKE '%3' THEN 'cluster=' || cluster END,
    CASE WHEN n_dependencies >= 5 THEN 'dependencies=' || n_dependencies END, CASE WHEN any_count > 0 THEN 'any=' || any_count END, CASE WHEN n_hooks >= 2 THEN 'hooks=' || n_hooks END), ''), 'cluster=' || cluster) AS reasons,
  {DRIVERS_SQL} AS drivers,
  CASE WHEN type_safety >= complexity AND type_safety >= structure AND type_safety > 0 THEN CASE WHEN any_count > 0 THEN 'remove-any' ELSE 'remove-assertions' END
    WHEN complexity >= structure THEN CASE WHEN peak_cc >= 8 THEN 'split-function:' || peak_name WHEN n_hooks >= 2 AND n_components > 0 THEN 'split-hooks' WHEN n_functions > 0 THEN 'split-functions' ELSE 'split-render' END
    WHEN n_dependencies >= 5 THEN 'cut-fan-out' WHEN n_components > 0 THEN 'extract-subcomponents' ELSE 'tidy-dependencies' END AS action
  FROM {scored} WHERE NOT {_in('kind', P.TARGETS_WITHOUT)} ORDER BY score DESC, path LIMIT {limit}"""


def scored(spark, d, baseline=False):
    return S.named(A.scored_files(S.numbered_files(spark, d), *snapshot(spark, d, baseline, numbered=True)))


@register(f"""WITH {SCORED_FILES}, h AS ({hot_sql('scored', 20)})
SELECT row_number() OVER (ORDER BY score DESC, path) AS rank, *, CASE WHEN score >= 120 THEN 'Critical' WHEN score >= 80 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS severity FROM h""")
def hot_spots(spark, d):
    out = A.hot_spots(scored(spark, d), 12, 20)
    return out.withColumns({c: F.array_join(c, ", ") for c in ("reasons", "drivers")})


@register(f"""WITH {SCORED_FILES} SELECT path, concat_ws(',', CASE WHEN complexity >= 12 THEN 'complexity-threshold-exceeded' END, CASE WHEN any_count > 0 THEN 'explicit-any-usage' END,
  CASE WHEN n_dependencies > 20 THEN 'high-dependency-count' END) AS warnings, {DRIVERS_SQL} AS drivers FROM scored""")
def file_warnings_and_drivers(spark, d):
    s = scored(spark, d)
    drivers = s.select("path", F.array_join(A.drivers(s), ", ").alias("drivers"))
    return A.file_warnings(s).select("path", F.array_join("warnings", ",").alias("warnings")).join(drivers, "path")


@register(f"""WITH {SCORED_FILES} SELECT sum(any_count)::BIGINT AS any_count, sum(assertion)::BIGINT AS assertion, sum(unsafe)::BIGINT AS unsafe, sum(double)::BIGINT AS double, sum(non_null)::BIGINT AS non_null,
  sum(ts_ignore)::BIGINT AS ts_ignore, sum(ts_expect)::BIGINT AS ts_expect, sum(ts_nocheck)::BIGINT AS ts_nocheck, sum(any_count + ts_ignore + ts_nocheck)::BIGINT AS critical_signals
FROM scored WHERE NOT {_in('kind', P.TARGETS_WITHOUT)}""")
def type_safety_totals(spark, d):
    return A.type_safety_totals(scored(spark, d))


@register(f"""WITH {SCORED_FILES}, s AS (SELECT path, type_safety AS score FROM scored WHERE type_safety > 0)
SELECT path, score, {rounded('score / (SELECT sum(score) FROM s) * 100', 1)} AS share FROM s ORDER BY score DESC, path LIMIT 10""")
def worst_type_safety(spark, d):
    return A.worst_type_safety(scored(spark, d))


@register(f"""WITH {SCORED_FILES}, r AS (
  SELECT 'complexity' AS axis, CASE WHEN complexity <= 6 THEN 'low' WHEN complexity <= 12 THEN 'medium' ELSE 'high' END AS v FROM scored UNION ALL
  SELECT 'structure', CASE WHEN structure <= 8 THEN 'low' WHEN structure <= 18 THEN 'medium' ELSE 'high' END FROM scored UNION ALL
  SELECT 'typeSafety', CASE WHEN type_safety <= 0 THEN 'low' WHEN type_safety <= 4 THEN 'medium' ELSE 'high' END FROM scored WHERE NOT {_in('kind', P.TARGETS_WITHOUT)}
) SELECT axis, count(*) FILTER (v = 'low') AS low, count(*) FILTER (v = 'medium') AS medium, count(*) FILTER (v = 'high') AS high FROM r GROUP BY axis""")
def risk_levels(spark, d):
    return A.risk_levels(scored(spark, d))


@register(f"""WITH {SCORED_FILES} SELECT count(*) AS files, sum(total_lines)::BIGINT AS total_lines, sum(n_functions)::BIGINT AS functions, sum(n_components)::BIGINT AS components,
  sum(n_dependencies)::BIGINT AS dependencies, sum(n_external)::BIGINT AS external, {rounded('avg(complexity)')} AS mean_complexity FROM scored""")
def project_totals(spark, d):
    return A.totals(scored(spark, d))


@register(f"""WITH {SCORED_FILES} SELECT kind, count(*) AS n, {rounded('count(*) / (SELECT count(*) FROM scored) * 100', 1)} AS share, {rounded('avg(complexity)')} AS mean_complexity, {rounded('avg(code_lines)')} AS mean_lines,
  CASE WHEN avg(complexity) >= 10 THEN CASE WHEN count(*) >= 5 THEN 'complex-wide' ELSE 'complex-local' END WHEN count(*) >= 10 THEN 'majority' ELSE 'local' END AS phrase FROM scored GROUP BY kind""")
def kind_distribution(spark, d):
    return A.kind_distribution(scored(spark, d))


@register(f"""WITH {S.FACTS}, x AS (
  SELECT CASE WHEN target LIKE '@storybook/%' OR target = 'storybook' THEN 'storybook' WHEN target IN ('vitest', 'jest') OR target LIKE '@testing-library/%' THEN 'test'
    WHEN kind IN ('Story', 'Storybook Support') OR lower(path) LIKE '.storybook/%' THEN 'storybook'
    WHEN kind IN ('Test', 'Type Support') OR regexp_matches(lower(path), '(^|/)(test|tests|__tests__)(/|$)') THEN 'test' WHEN kind = 'Config' THEN 'dev' ELSE 'runtime' END AS context, target AS package, count(*) AS n
  FROM dependencies JOIN files ON source = path WHERE is_external GROUP BY ALL
) SELECT * FROM (SELECT context, (sum(n) OVER (PARTITION BY context))::BIGINT AS total, package, n, row_number() OVER (PARTITION BY context ORDER BY n DESC, package) AS rank FROM x) WHERE rank <= 10""")
def external_groups(spark, d):
    return A.external_groups(S.files(spark, d), S.dependencies(spark, d))


@register(f"WITH {S.FACTS} SELECT count(*) AS components, {rounded('avg(jsx)', 1)} AS mean_jsx, count(*) FILTER (hook_count >= 2) AS hook_heavy FROM components")
def component_summary(spark, d):
    return A.component_summary(S.components(spark, d))


@register(f"WITH {S.FACTS} SELECT path, name, hook_count FROM components WHERE hook_count >= 2 ORDER BY hook_count DESC, path, start_line, name LIMIT 10")
def hook_heavy_components(spark, d):
    return A.hook_heavy(S.components(spark, d))


@register(f"""WITH {S.FACTS}, c AS (SELECT path, name, count(*) AS n FROM hooks GROUP BY path, name), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, name) AS r FROM c)
SELECT path, string_agg(CASE WHEN n > 1 THEN name || '×' || n ELSE name END, ', ' ORDER BY r) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ', +' || (count(*) - 5) ELSE '' END AS usage FROM r GROUP BY path""")
def hook_usage(spark, d):
    return A.hook_usage(S.hooks(spark, d))


@register(f"""WITH {S.FACTS} SELECT c.path, name, start_line, name || ': hooks=' || hook_count || ', jsx=' || jsx || ', render=' || render AS text FROM components c JOIN files f ON c.path = f.path
WHERE {_in('kind', P.RESPONSIBLE)} AND (hook_count >= 4 OR jsx >= 12 OR render >= 5)""")
def high_responsibility(spark, d):
    return A.high_responsibility(S.files(spark, d), S.components(spark, d))


#: Type-escape scores as SQL.
ESCAPES_SQL = f"""fan AS (SELECT target AS path, count(*) AS fan_in FROM dependencies WHERE NOT is_external GROUP BY target
), e0 AS (
  SELECT f.path, kind, coalesce(any_count, 0) AS any_count, coalesce(unsafe, 0) AS unsafe, coalesce(double, 0) AS double, coalesce(non_null, 0) AS non_null, coalesce(ts_ignore, 0) AS ts_ignore,
    coalesce(ts_expect, 0) AS ts_expect, coalesce(ts_nocheck, 0) AS ts_nocheck, greatest(0, coalesce(assertion - unsafe - double - const, 0)) AS bare, coalesce(fan_in, 0) AS fan_in
  FROM files f LEFT JOIN types USING (path) LEFT JOIN fan USING (path) WHERE NOT {_in('kind', P.SOURCE_ONLY_WITHOUT)}
), escapes AS (
  SELECT path, kind, {rounded('''(bare * 1.5::DOUBLE + any_count * 4 + unsafe * 4 + double * 5 + non_null * 2 + ts_ignore * 6 + ts_expect * 4 + ts_nocheck * 20)
    * CASE WHEN kind IN ('API/Infrastructure', 'Context/State', 'Hook', 'Schema', 'Validation', 'Type Support') THEN 1.4::DOUBLE WHEN kind IN ('Route', 'Feature', 'Form', 'Layout') THEN 1.2::DOUBLE WHEN kind = 'Barrel' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
    * (1 + least(1.5::DOUBLE, fan_in * 0.15::DOUBLE))''')} AS score,
    concat_ws(', ', CASE WHEN any_count > 0 THEN 'any=' || any_count END, CASE WHEN unsafe > 0 THEN 'unsafeAssertion=' || unsafe END, CASE WHEN double > 0 THEN 'doubleAssertion=' || double END,
      CASE WHEN non_null > 0 THEN 'nonNull=' || non_null END, CASE WHEN ts_ignore > 0 THEN 'tsIgnore=' || ts_ignore END, CASE WHEN ts_expect > 0 THEN 'tsExpectError=' || ts_expect END,
      CASE WHEN ts_nocheck > 0 THEN 'tsNoCheck=' || ts_nocheck END, CASE WHEN fan_in > 0 THEN 'fanIn=' || fan_in END) AS reasons FROM e0
)"""


@register(f"WITH {S.FACTS}, {ESCAPES_SQL} SELECT * FROM escapes")
def type_escapes(spark, d):
    return A.type_escapes(S.files(spark, d), S.types(spark, d), S.dependencies(spark, d)).withColumn("reasons", F.array_join("reasons", ", "))


@register(f"WITH {S.FACTS}, {ESCAPES_SQL} SELECT {rounded('sum(score)')} AS total_score, {rounded('avg(score)')} AS mean_score, count(*) FILTER (score >= 8) AS high_risk, count(*) AS files FROM escapes")
def type_escape_stats(spark, d):
    return A.type_escape_stats(A.type_escapes(S.files(spark, d), S.types(spark, d), S.dependencies(spark, d)))


#: Skipped files: a folder in front of each path, and a reason.
SKIPS = ["node_modules/", "dist/", "", "", ".next/", "storybook-static/assets/", "coverage/"]
REASONS = ["Excluded pattern match", "Excluded by analysis scope (source-only)", "File size exceeds 10485760 bytes"]


@register(f"""WITH {S.FILES}, s AS (
  SELECT part AS seq, ({S._list(SKIPS)})[1 + part % 7] || path AS path, ({S._list(REASONS)})[1 + (part // 7) % 3] AS reason FROM files
), c AS (
  SELECT *, CASE WHEN reason = 'Excluded pattern match' AND (regexp_matches(path, '(^|/)(node_modules|\\.next|\\.git|\\.venv)(/|$)') OR regexp_matches(path, '(^|/)storybook-static/assets(/|$)')) THEN 'expected'
    WHEN reason = 'Excluded pattern match' AND regexp_matches(path, '(^|/)(out|storybook-static|coverage|dist|build)(/|$)') THEN 'generated'
    WHEN reason LIKE 'Excluded by analysis scope%' THEN 'configured' ELSE 'unexpected' END AS class FROM s
), g AS (
  SELECT *, CASE WHEN class <> 'configured' THEN '' WHEN regexp_matches(path, '(^|/)\\.storybook(/|$)') THEN 'storybook'
    WHEN regexp_matches(path, '(^|/)__tests__(/|$)|(^|/)tests?(/|$)|\\.(test|spec)\\.[cm]?[jt]sx?$') THEN 'test' WHEN regexp_matches(path, '\\.stories\\.[cm]?[jt]sx?$|(^|/)(stories|storybook)(/|$)') THEN 'story'
    WHEN regexp_matches(path, '(^|/)(next|vite|vitest|jest)\\.config\\.|(^|/)tsconfig\\.json$') THEN 'config' ELSE 'other' END AS grp FROM c
) SELECT class, grp, count(*) AS n, array_to_string(list(path ORDER BY seq)[1:3], ', ') AS examples FROM g GROUP BY class, grp""")
def skip_groups(spark, d):
    f = S.files(spark, d)
    path = F.concat(S._pick(SKIPS, F.col("part") % 7), F.col("path"))
    return A.skip_groups(f.select(F.col("part").alias("seq"), path.alias("path"), S._pick(REASONS, F.floor(F.col("part") / 7) % 3).alias("reason")))
