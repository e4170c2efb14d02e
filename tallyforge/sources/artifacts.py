"""Readers of test and audit artifacts: each gives a small DataFrame; malformed input gives no rows rather than an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in either quote style, or null."""
    found = F.regexp_extract(tag, rf"""(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    other = F.regexp_extract(tag, rf"""(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
    return F.when(found != "", found).when(other != "", other)


def junit(files: DataFrame) -> DataFrame:
    """(path, text) -> (path, total, passed, failed, skipped); suite attributes count only where a file has no test cases."""
    body = F.regexp_replace(F.col("text"), r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<system-(out|err)>.*?</system-(out|err)>", "")
    rows = files.filter(F.col("text").contains("<testsuite")).select("path", body.alias("x"))
    case = r"""(?s)(<testcase\b(?:"[^"]*"|'[^']*'|[^>"'])*?/>|<testcase\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?</testcase>)"""
    rows = rows.select("path", "x", F.regexp_extract_all("x", F.lit(case), 1).alias("cases"))
    failed = F.size(F.filter("cases", lambda c: c.rlike(r"<(failure|error)\b")))
    skipped = F.size(F.filter("cases", lambda c: ~c.rlike(r"<(failure|error)\b") & c.rlike(r"<skipped\b")))
    suite = F.regexp_extract_all("x", F.lit(r"(<testsuite\b[^>]*>)"), 1)

    def total(name: str) -> Column:
        return F.aggregate(F.transform(suite, lambda s: F.coalesce(_attribute(s, name).try_cast("int"), F.lit(0))), F.lit(0), lambda a, b: a + b)

    none = F.size("cases") == 0
    out = rows.select(
        "path", F.when(none, total("tests")).otherwise(F.size("cases")).alias("total"),
        F.when(none, total("failures") + total("errors")).otherwise(failed).alias("failed"), F.when(none, total("skipped")).otherwise(skipped).alias("skipped"),
    )
    return out.withColumn("passed", F.greatest(F.lit(0), F.col("total") - F.col("failed") - F.col("skipped")))


def lcov_records(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text), one row for each record: large files are split at record ends, so that many tasks read one."""
    return spark.read.text(list(paths), lineSep="end_of_record").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lcov(files: DataFrame) -> DataFrame:
    """(path, text), whole files or records -> (file, lines_found, lines_hit); of several records of a file the one with most lines found, then hit."""
    record = files.select(F.explode(F.split("text", "end_of_record")).alias("r"))

    def field(name: str) -> Column:
        return F.regexp_extract("r", rf"(?m)^{name}:(.*)$", 1)

    parsed = record.select(F.trim(field("SF")).alias("file"), F.trim(field("LF")).try_cast("int").alias("lf"), F.trim(field("LH")).try_cast("int").alias("lh")).filter("file != ''")
    best = parsed.groupBy("file").agg(F.max(F.struct(F.coalesce("lf", F.lit(0)).alias("lf"), F.coalesce("lh", F.lit(0)).alias("lh"))).alias("m"))
    return best.select("file", F.col("m.lf").alias("lines_found"), F.col("m.lh").alias("lines_hit"))


def coverage(records: DataFrame) -> DataFrame:
    """lcov() rows -> one row with the sums and the percentage, null without lines."""
    sums = records.agg(F.coalesce(F.sum("lines_found"), F.lit(0)).alias("lines_found"), F.coalesce(F.sum("lines_hit"), F.lit(0)).alias("lines_hit"))
    return sums.withColumn("percent", F.when(F.col("lines_found") > 0, F.col("lines_hit") / F.col("lines_found") * 100))


#: What the JSON of a report has at its top; one of the places is enough.
SHAPES = {"npm-audit": {"vulnerabilities": "map<string, variant>", "metadata.vulnerabilities": "map<string, variant>", "advisories": "map<string, variant>"}, "trivy": {"Results": "array<variant>"}}


def warnings(files: DataFrame, kind: str) -> DataFrame:
    """(path, text) -> (path, kind, warning) for files that give no figures: those that are no JSON, and those of another shape."""
    if kind == "junit":
        wrong = F.when(~F.coalesce(F.col("text").contains("<testsuite"), F.lit(False)), "not a report of this kind")
    else:
        parsed = F.try_parse_json("text")
        places = [F.try_variant_get(parsed, f"$.{place}", shape).isNotNull() for place, shape in SHAPES.get(kind, {}).items()]
        fits = F.lit(True) if not places else F.array_max(F.array(*places))
        wrong = F.when(parsed.isNull(), "not JSON").when(~fits, "not a report of this kind")
    return files.select("path", F.lit(kind).alias("kind"), wrong.alias("warning")).filter("warning IS NOT NULL")


SEVERITIES = ("low", "moderate", "high", "critical")


def npm_audit(files: DataFrame) -> DataFrame:
    """(path, text) -> (path, low, moderate, high, critical): the stated numbers, else a count over the vulnerabilities."""
    schema = "metadata struct<vulnerabilities: map<string, int>>, vulnerabilities map<string, struct<severity: string>>"
    rows = files.select("path", F.from_json("text", schema).alias("j")).filter("j is not null and (j.metadata.vulnerabilities is not null or j.vulnerabilities is not null)")
    stated, each = F.col("j.metadata.vulnerabilities"), F.map_values("j.vulnerabilities")

    def count(level: str) -> Column:
        names = ("moderate", "medium") if level == "moderate" else (level,)
        counted = F.size(F.filter(each, lambda v: v["severity"].isin(*names)))
        return F.when(stated.isNotNull(), F.coalesce(F.try_element_at(stated, F.lit(level)), F.lit(0))).otherwise(F.coalesce(counted, F.lit(0)))

    return rows.select("path", *[count(s).alias(s) for s in SEVERITIES])


def trivy(files: DataFrame) -> DataFrame:
    """(path, text) -> (path, low, moderate, high, critical)."""
    schema = "Results array<struct<Vulnerabilities: array<struct<Severity: string>>>>"
    rows = files.select("path", F.from_json("text", schema).alias("j")).filter("j.Results is not null")
    levels = F.transform(F.flatten(F.transform("j.Results", lambda r: F.coalesce(r["Vulnerabilities"], F.array().cast("array<struct<Severity:string>>")))), lambda v: F.lower(v["Severity"]))

    def count(level: str) -> Column:
        names = ("moderate", "medium") if level == "moderate" else (level,)
        return F.size(F.filter(levels, lambda v: v.isin(*names)))

    return rows.select("path", *[count(s).alias(s) for s in SEVERITIES])


def axe(files: DataFrame) -> DataFrame:
    """(path, text) -> (path, critical, serious, moderate, minor, incomplete); a violation weighs as many nodes as it has, one at least."""
    schema = "violations array<struct<impact: string, nodes: array<string>>>, incomplete array<string>"
    rows = files.select("path", F.from_json("text", schema).alias("j")).filter("j.violations is not null")
    known = ("critical", "serious", "moderate", "minor")

    def weight(level: str) -> Column:
        own = F.filter("j.violations", lambda v: F.when(v["impact"].isin(*known), v["impact"]).otherwise("moderate") == level)
        return F.aggregate(own, F.lit(0), lambda a, v: a + F.greatest(F.lit(1), F.coalesce(F.size(v["nodes"]), F.lit(0))))

    return rows.select("path", *[weight(k).alias(k) for k in known], F.greatest(F.lit(0), F.coalesce(F.size("j.incomplete"), F.lit(0))).alias("incomplete"))


def lighthouse(files: DataFrame) -> DataFrame:
    """(path, text) -> one row with the worst figures over all reports: score, lcp_s, tti_s; missing ones are skipped."""
    schema = 'categories struct<performance: struct<score: double>>, audits struct<`largest-contentful-paint`: struct<numericValue: double>, interactive: struct<numericValue: double>>'
    rows = files.select(F.from_json("text", schema).alias("j")).filter("j.categories is not null")
    return rows.agg(
        F.min(F.col("j.categories.performance.score") * 100).alias("score"), F.max(F.col("j.audits.`largest-contentful-paint`.numericValue") / 1000).alias("lcp_s"),
        F.max(F.col("j.audits.interactive.numericValue") / 1000).alias("tti_s"),
    )


def openapi_breaking(files: DataFrame) -> DataFrame:
    """(path, text) -> (path, breaking): the first of the known places that says something; 0 where none does."""
    schema = "breakingDifferences array<string>, breakingChanges array<string>, summary struct<breakingChanges: int>, changes struct<breaking: array<string>>, breakingDifferencesFound boolean"
    j = F.from_json("text", schema)
    rows = files.select("path", j.alias("j")).filter("j is not null")
    some = [F.when(F.col(c).isNotNull(), F.size(c)) for c in ("j.breakingDifferences", "j.breakingChanges")]
    rest = [F.col("j.summary.breakingChanges"), F.when(F.col("j.changes.breaking").isNotNull(), F.size("j.changes.breaking")), F.col("j.breakingDifferencesFound").cast("int")]
    return rows.select("path", F.coalesce(*some, *rest, F.lit(0)).alias("breaking"))
