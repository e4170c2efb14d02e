"""Column expressions that format values for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and labels of verdicts.
MARKS = {"pass": "○", "partial": "◐", "warn": "△", "fail": "×", "manual": "―"}
LABELS = {"pass": "PASS", "partial": "PARTIAL", "warn": "WARN", "fail": "FAIL", "manual": "MANUAL", "not_applicable": "N/A"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _of(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def verdict_mark(verdict: Column | str) -> Column:
    return F.coalesce(_of(_c(verdict), MARKS), F.lit(""))


def verdict_label(verdict: Column | str) -> Column:
    """A verdict in capitals; unknown ones as they are, none as 'なし'."""
    v = _c(verdict)
    return F.when(v.isNull(), "なし").otherwise(F.coalesce(_of(v, LABELS), v))


def verdict_badge(verdict: Column | str) -> Column:
    return F.trim(F.concat(verdict_mark(verdict), F.lit(" "), verdict_label(verdict)))


def signed(value: Column | str, digits: int = 0) -> Column:
    """A number with a plus sign if it is above 0."""
    v = _c(value)
    text = F.format_string(f"%.{digits}f", v.cast("double")) if digits else v.cast("string")
    return F.concat(F.when(v > 0, "+").otherwise(""), text)


def csv_cell(value: Column | str, always: bool = False) -> Column:
    """A cell in quotes where it has a comma, a quote or a line break, or always; quotes are doubled."""
    v = F.coalesce(_c(value).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(v.rlike('[,"\\n\\r]'), quoted).otherwise(v)


def csv_row(*values: Column | str, always: bool = False) -> Column:
    return F.concat_ws(",", *[csv_cell(v, always) for v in values])


def markdown_cell(value: Column | str) -> Column:
    """A table cell of Markdown: bars escaped, line breaks as spaces."""
    return F.replace(F.regexp_replace(_c(value), r"\r\n|\r|\n", " "), F.lit("|"), F.lit("\\|"))


def html_text(value: Column | str) -> Column:
    out = _c(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def script_json(value: Column | str) -> Column:
    """JSON that can stand in a script element."""
    return F.replace(_c(value), F.lit("<"), F.lit("\\u003c"))


def heading_anchor(title: Column | str) -> Column:
    """The anchor of a Markdown heading: letters, digits and hyphens of any script."""
    kept = F.regexp_replace(F.lower(_c(title)), r"[^\p{L}\p{N}\s-]", "")
    return F.regexp_replace(F.trim(kept), r"\s+", "-")


def slug(value: Column | str) -> Column:
    """ASCII letters, digits, kana and kanji, anything else as one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(value)), r"[^a-z0-9぀-ヿ㐀-鿿]+", "-"), r"^-+|-+$", "")


def any_number(value: Column | str) -> Column:
    """The first number anywhere in a text, or infinity."""
    return F.coalesce(F.regexp_extract(_c(value), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(float("inf")))


def evidence_score(text: Column | str) -> Column:
    """The number after 'score' in an evidence's label and value, or minus infinity."""
    return F.coalesce(F.regexp_extract(_c(text), r"(?i)score\s+([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(float("-inf")))


def evidence_line(text: Column | str) -> Column:
    """The line number in an evidence's text (before 行目), or the largest number."""
    return F.coalesce(F.regexp_extract(_c(text), r"([0-9]+)行目", 1).try_cast("long"), F.lit(2**53 - 1))
