"""Which sources tests cover: by coverage files, by tests that ran, and by imports and names of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import paths as P
from tallyforge.operators.graph import cut
from tallyforge.operators.spread import pairs, spread


def _keyed(df: DataFrame, keys: Column) -> DataFrame:
    return df.withColumn("key", F.explode(keys))


def with_matching_test(files: DataFrame, root: str | None = None) -> DataFrame:
    """files (path, kind) with has_test: tests themselves, and files that the path of a test names."""
    wanted = _keyed(files.filter("kind = 'Test'"), P.tested_keys("path", root)).select("key").distinct()
    found = _keyed(files.select("path"), P.source_keys("path", root)).join(wanted, "key", "left_semi").select(F.col("path").alias("_p")).distinct()
    return files.join(found, F.col("path") == F.col("_p"), "left").withColumn("has_test", (F.col("kind") == "Test") | F.col("_p").isNotNull()).drop("_p")


def _steps(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(source, target, through): distinct internal imports, and whether a walk goes on at the target."""
    return _through(files, dependencies.filter("NOT is_external").select("source", "target").distinct())


def _through(files: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = files.select(F.col("path").alias("target"), P.ends_test_walk("kind").alias("ends"))
    return edges.join(kinds, "target", "left").withColumn("through", F.coalesce(~F.col("ends"), F.lit(False))).select("source", "target", "through")


def linked_sources(tests: DataFrame, files: DataFrame, dependencies: DataFrame, max_depth: int = 3) -> DataFrame:
    """tests (path) -> (test, path, depth): the sources first met on the way along imports from each test.

    A walk goes on through tests, stories, fixtures, configurations and type support, at most max_depth steps after the
    first import, and ends at any other file. Files that are not in files end it too, as nothing is known of their imports.
    Only imports of tests and of files that a walk goes through are kept.
    """
    left = files.filter(~P.ends_test_walk("kind")).select("path").union(tests.select("path")).distinct()
    inner = dependencies.filter("NOT is_external").select("source", "target").join(cut(left, "walk_files").withColumnRenamed("path", "source"), "source", "left_semi")
    return _linked(tests, _through(files, inner), max_depth)


def _linked(tests: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    met, names = spread(tests.select(F.col("path").alias("start")), steps, max_depth)
    return pairs(met.filter("NOT through"), names).select(F.col("start").alias("test"), F.col("target").alias("path"), "depth")


def _linked_back(sources: DataFrame, tests: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    """sources (path), that end walks -> the rows of _linked() for them, walked backwards: for few sources and many tests."""
    own = tests.select(F.col("path").alias("source"), F.lit(True).alias("is_test")).distinct()
    on = steps.filter("through").select(F.col("target").alias("source"), "through").distinct()
    back = steps.select("source", "target").join(own, "source", "left").join(on, "source", "left").filter("is_test OR through")
    back = cut(back.fillna(False, ["is_test", "through"]), "back_edges")
    front = sources.select("path", F.col("path").alias("at")).distinct()
    seen, out = None, None
    for depth in range(max_depth + 1):
        met = front.join(back, front["at"] == back["target"]).select("path", "source", "is_test", "through").distinct()
        if seen is not None:
            met = met.join(seen, ["path", "source"], "left_anti")
        met = cut(met, "walk")
        ends = met.filter("is_test").select(F.col("source").alias("test"), "path", F.lit(depth).alias("depth"))
        out = ends if out is None else out.unionByName(ends)
        visited = met.select("path", "source")
        seen = visited if seen is None else seen.unionByName(visited)
        front = met.filter("through").select("path", F.col("source").alias("at"))
    return out


def _least_links(starts: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    """starts (at, named, ran) -> (met, named, ran): for each source on a walk the least value of any start, with its depth, as structs (v, depth).

    A null value starts nothing. All starts are walked at once: a file is left again only with a smaller value than before,
    so rows follow the files and not pairs of tests and files.
    """
    front, best, out = starts, None, None
    less = lambda c: F.col(c).isNotNull() & (F.col(f"b_{c}").isNull() | (F.col(c) < F.col(f"b_{c}")))
    for depth in range(max_depth + 1):
        met = front.join(steps, front["at"] == steps["source"]).groupBy("target").agg(F.min("named").alias("named"), F.min("ran").alias("ran"), F.bool_or("through").alias("through"))
        if best is not None:
            before = best.groupBy("target").agg(F.min("named").alias("b_named"), F.min("ran").alias("b_ran"))
            met = met.join(before, "target", "left")
            met = met.filter(less("named") | less("ran")).select("target", F.when(less("named"), F.col("named")).alias("named"), F.when(less("ran"), F.col("ran")).alias("ran"), "through")
        met = cut(met, "walk")
        best = met if best is None else best.unionByName(met)
        at = met.withColumn("depth", F.lit(depth))
        out = at if out is None else out.unionByName(at)
        front = met.filter("through").select(F.col("target").alias("at"), "named", "ran")
    least = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), "depth"))).alias(c)
    return out.filter("NOT through").groupBy(F.col("target").alias("met")).agg(least("named"), least("ran"))


def _named(tests: DataFrame, linked: DataFrame, same: DataFrame, by_path: DataFrame, label: Column, path_label: Column) -> DataFrame:
    """(path, reason) of the files that tests (test, label) cover by their own path and by their imports."""
    own = by_path.join(tests, "test").select("path", F.concat(path_label, F.lit(":"), F.col("test")).alias("reason"))
    text = F.concat(label, F.lit(":"), F.col("test"), F.lit(" depth="), F.col("depth").cast("string"))
    return own.unionByName(linked.join(tests, "test").join(same, "met").select("path", text.alias("reason")))


def _evidence(tests: DataFrame, coverage: DataFrame, executed: DataFrame, targets: DataFrame, root: str | None):
    """(keys of targets, targets that a test's path names, covered targets, tests that ran with their label)."""
    keys = cut(_keyed(targets.select("path"), P.source_keys("path", root)).select("path", "key"), "target_keys")
    by_path = cut(_keyed(tests.select(F.col("path").alias("test")), P.tested_keys("test", root)).join(keys, "key").select("test", "path").distinct(), "named_files")
    lines = _keyed(coverage, P.source_keys("path", root)).groupBy("key").agg(F.max(F.struct("path", "line_found", "line_hit")).alias("c"))
    covered = keys.join(lines, "key").groupBy("path").agg(F.min(F.struct((F.col("key") != P.match_path("path", root)).alias("other"), "c")).alias("m"))
    covered = cut(covered.select("path", F.col("m.c.line_found").alias("found"), F.col("m.c.line_hit").alias("hit")), "covered")
    known = _keyed(tests, P.source_keys("path", root)).select("key", F.col("path").alias("known"))
    ran = cut(_keyed(executed, P.source_keys("path", root)).join(known, "key").select(F.col("known").alias("test"), "label").distinct(), "ran")
    return keys, by_path, covered, ran


def _same_files(met: DataFrame, keys: DataFrame, root: str | None) -> DataFrame:
    """met (met) -> (met, path): the targets that share a key with a file on a walk."""
    return _keyed(met, P.source_keys("met", root)).join(keys, "key").select("met", "path").distinct()


def _verdicts(min_coverage: float) -> tuple[Column, Column, Column]:
    """(matched, matched_by, share of lines) over found, hit, by_run and by_name."""
    by_lines, run, name = F.col("found").isNotNull(), F.coalesce("by_run", F.lit(False)), F.coalesce("by_name", F.lit(False))
    share = F.when(F.col("found") > 0, F.col("hit") / F.col("found") * 100)
    matched = F.when(by_lines, (F.col("hit") > 0) & (F.coalesce(share, F.lit(0.0)) >= min_coverage)).otherwise(run | name)
    return matched, F.when(by_lines | run, "runtime").when(name, "static").otherwise("none"), share


def test_states(
    files: DataFrame, tests: DataFrame, dependencies: DataFrame, coverage: DataFrame, executed: DataFrame, min_coverage: float = 0.0, max_depth: int = 3, root: str | None = None
) -> DataFrame:
    """(path, bucket, weight, matched, matched_by): test_matches() without the reasons.

    Whether any test reaches a file is walked for all tests at once, so rows follow files and imports, not pairs.
    """
    targets = cut(files.filter(P.is_test_target("kind")), "targets")
    keys, by_path, covered, ran = _evidence(tests, coverage, executed, targets, root)
    runs = ran.select("test").distinct().withColumn("ran", F.lit(""))
    starts = tests.select(F.col("path").alias("test")).distinct().join(runs, "test", "left")
    steps = cut(_steps(files, dependencies), "walk_edges")
    links = cut(_least_links(starts.select(F.col("test").alias("at"), F.lit("").alias("named"), "ran"), steps, max_depth), "links")
    met = _same_files(links.select("met"), keys, root).join(links.select("met", F.col("ran").isNotNull().alias("by_run")), "met").select("path", "by_run")
    own = by_path.join(runs, "test", "left").select("path", F.col("ran").isNotNull().alias("by_run"))
    known = met.unionByName(own).groupBy("path").agg(F.bool_or("by_run").alias("by_run")).withColumn("by_name", F.lit(True))
    matched, by, _ = _verdicts(min_coverage)
    j = targets.join(covered, "path", "left").join(known, "path", "left")
    return j.select("path", P.test_bucket("kind").alias("bucket"), P.test_weight("kind").alias("weight"), matched.alias("matched"), by.alias("matched_by"))


def test_matches(
    files: DataFrame, tests: DataFrame, dependencies: DataFrame, coverage: DataFrame, executed: DataFrame, min_coverage: float = 0.0, max_depth: int = 3, root: str | None = None, only: DataFrame | None = None
) -> DataFrame:
    """(path, bucket, weight, matched, matched_by, reasons) of every file that tests should cover.

    files (path, kind); tests (path): files that hold tests; coverage (path, line_found, line_hit); executed (path,
    label): tests that ran, as reported; only (path): a few files to answer for. Coverage decides first (covered if a line
    was hit and enough of them), then tests that ran, then all tests. Of several coverage rows for a key the last path
    counts; reasons are in order. Pairs of tests and files are made only where their reasons are shown: from tests that ran
    to files without coverage, and backwards from files that no run reaches; the first reason of a covered file is found
    for all tests at once.
    """
    targets = files.filter(P.is_test_target("kind"))
    targets = cut(targets if only is None else targets.join(only.select("path"), "path", "left_semi"), "targets")
    keys, by_path, covered, ran = _evidence(tests, coverage, executed, targets, root)
    steps = cut(_steps(files, dependencies), "walk_edges")
    every = tests.select("path").distinct()
    first = ran.groupBy("test").agg(F.min(F.concat("label", F.lit(":"), F.col("test"), F.lit(" depth="))).alias("ran"))
    starts = every.select(F.col("path").alias("test")).join(first, "test", "left")
    named = F.concat(F.lit("import:"), F.col("test"), F.lit(" depth="))
    links = cut(_least_links(starts.select(F.col("test").alias("at"), named.alias("named"), "ran"), steps, max_depth), "links")
    same = cut(_same_files(links.select("met"), keys, root), "same_files")

    text = lambda c: F.concat(F.col(f"{c}.v"), F.col(f"{c}.depth").cast("string")).alias(c)
    by_link = same.join(links.select("met", text("named"), text("ran")), "met").select("path", "named", "ran")
    own = by_path.join(ran.groupBy("test").agg(F.min(F.concat("label", F.lit("-path:"), F.col("test"))).alias("ran")), "test", "left")
    own = own.select("path", F.concat(F.lit("path:"), F.col("test")).alias("named"), "ran")
    known = cut(by_link.unionByName(own).groupBy("path").agg(F.min("named").alias("first_named"), F.min("ran").alias("first_ran")), "first_reasons")

    open_ = known.join(covered, "path", "left_anti")
    run_over = cut(open_.filter("first_ran IS NOT NULL").select("path"), "run_over")
    rest = cut(open_.filter("first_ran IS NULL").select("path"), "rest")

    def back(of: DataFrame, starts: DataFrame) -> DataFrame:
        ends = same.join(of, "path", "left_semi").select(F.col("met").alias("path")).distinct()
        return _linked_back(ends, starts, steps, max_depth).withColumnRenamed("path", "met")

    def listed(of: DataFrame, linked: DataFrame, labels: DataFrame, label: Column, path_label: Column, name: str) -> DataFrame:
        reasons = _named(labels, linked, same.join(of, "path", "left_semi"), by_path.join(of, "path", "left_semi"), label, path_label)
        return reasons.groupBy("path").agg(F.array_sort(F.collect_set("reason")).alias(name))

    runners = ran.select(F.col("test").alias("path")).distinct()
    run_links = _linked(runners, steps, max_depth).withColumnRenamed("path", "met") if only is None else back(run_over, runners)
    runtime = listed(run_over, run_links, ran, F.col("label"), F.concat(F.col("label"), F.lit("-path")), "run_reasons")
    static = listed(rest, back(rest, every), every.select(F.col("path").alias("test")), F.lit("import"), F.lit("path"), "named_reasons")

    j = targets.join(covered, "path", "left").join(known, "path", "left").join(runtime, "path", "left").join(static, "path", "left")
    j = j.withColumn("by_run", F.col("first_ran").isNotNull()).withColumn("by_name", F.col("first_named").isNotNull())
    matched, by, share = _verdicts(min_coverage)
    lines = F.format_string("lcov:%d/%d", "hit", "found")
    lines = F.when(share.isNotNull(), F.concat(lines, F.format_string(" (%.1f%%)", F.floor(share * 10 + 0.5) / 10))).otherwise(lines)
    if min_coverage > 0:
        lines = F.concat(lines, F.lit(f" min={min_coverage:.1f}%"))
    none = F.array(F.lit("no runtime or static evidence"))
    reasons = F.when(F.col("found").isNotNull(), F.array_compact(F.array(lines, "first_ran", "first_named"))).otherwise(F.coalesce("run_reasons", "named_reasons", none))
    return j.select("path", P.test_bucket("kind").alias("bucket"), P.test_weight("kind").alias("weight"), matched.alias("matched"), by.alias("matched_by"), reasons.alias("reasons"))


def evidence_label(matched: Column | str, by: Column | str, reason: Column | str) -> Column:
    """What kind of evidence a match's first reason is."""
    m, b, r = (F.col(x) if isinstance(x, str) else x for x in (matched, by, reason))
    return (
        F.when(~m, F.when(b == "runtime", "runtime-test-gap").otherwise("test-gap"))
        .when(r.startswith("lcov:"), "lcov-covered")
        .when(r.rlike("^(junit|playwright)(-path)?:"), "runtime-test-link")
        .otherwise("test-link")
    )


def presence(matches: DataFrame, *by: str) -> DataFrame:
    """Matches summed up: targets, matched, their weights, the weighted rate in percent, and the matches by kind of evidence."""
    m, run = F.col("matched"), F.col("matched_by")
    g = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(m).alias("matched"), F.sum("weight").cast("double").alias("weighted_target"), F.sum(F.when(m, F.col("weight")).otherwise(0)).cast("double").alias("weighted_matched"),
        F.count_if(m & (run == "runtime")).alias("runtime_matched"), F.count_if(m & (run == "static")).alias("static_matched"),
        F.count_if(~m & (run == "runtime")).alias("runtime_unmatched"), F.count_if(run == "none").alias("no_evidence"),
    )
    rate = F.when(F.col("weighted_target") > 0, F.col("weighted_matched") / F.col("weighted_target") * 100).otherwise(0.0)
    return g.withColumn("rate", rate)


#: The examples that a report shows: (group, which, how many, what goes before weight and path).
_EXAMPLES = [("matched", "matched", 8, "CASE WHEN matched_by = 'runtime' THEN 0 ELSE 1 END"), ("runtime-gap", "NOT matched AND matched_by = 'runtime'", 4, None), ("no-evidence", "matched_by = 'none'", 4, None)]


def _picked(matches: DataFrame, when: str, limit: int, first: str | None) -> DataFrame:
    return matches.filter(when).orderBy(*([F.expr(first)] if first else []), F.desc("weight"), "path").limit(limit)


def example_paths(states: DataFrame) -> DataFrame:
    """(path) of the files that evidence_examples() shows, from test_states()."""
    picks = [_picked(states, *how).select("path") for _, *how in _EXAMPLES]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


def evidence_examples(matches: DataFrame) -> DataFrame:
    """(group, position, path, label, reason): the examples a report shows: 8 matched (runtime first), 4 runtime gaps, 4 without evidence, two reasons each."""
    out = None
    for name, *how in _EXAMPLES:
        top = _picked(matches, *how).withColumn("group", F.lit(name))
        reasons = top.select("group", "path", "matched", "matched_by", F.col("reasons")[0].alias("lead"), F.posexplode(F.slice("reasons", 1, 2)).alias("position", "reason"))
        rows = reasons.select("group", "position", "path", evidence_label("matched", "matched_by", "lead").alias("label"), "reason")
        out = rows if out is None else out.unionByName(rows)
    return out
