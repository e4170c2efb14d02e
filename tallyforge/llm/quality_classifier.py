"""Quality classifier: regularised quadratic discriminant over document statistics (operator 4).

Every text is described by a few transformed counts. For each class the mean and covariance of these are found over all
labelled training rows by one aggregation; the covariance is shrunk towards the pooled one and towards its diagonal, and
its Cholesky factor is computed and inverted once. The score is the logistic of the difference of the two Gaussian log
densities, each a squared Mahalanobis length: the squared length of the shifted statistics times the cached inverse.

Defined cases: null text counts as empty; an empty text has defined statistics and so a score; labels that are null or
without document are ignored, repeated labels count again; a class without labels takes the pooled mean, and without
any labels every score is 0.5; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import any_names, crc_mod, text_of, words_of, work_table

FEATURES = ["words", "distinct", "word_length", "symbols", "bars", "bangs", "capitals", "digits", "line_length"]
#: Weight of the pooled covariance, and of the diagonal, in a class's covariance; least variance of a statistic.
POOL, DIAGONAL, FLOOR = 0.1, 0.05, 0.01
#: Characters of usual text that are added to each text, so that shares of very short texts stay near the usual ones.
PRIOR = 40.0
THRESHOLD = 0.3


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs (doc_id, text) -> `row`, a struct of the columns named in keep, and the transformed statistics of each whole text."""
    text, words = F.col("_t"), F.col("_w")
    rows = docs.select(F.struct(*keep).alias("row"), text_of().alias("_t"))
    rows = rows.withColumn("_w", words_of(text)).select(
        "row",
        F.size(words).cast("double").alias("n"),
        F.size(F.array_distinct(words)).cast("double").alias("d"),
        F.length(text).cast("double").alias("c"),
        _count(text, r"[\x20\x09-\x0D]+").cast("double").alias("space"),
        _count(text, r"[#*$%&<>@^~=+_{}\[\]\\/]+").cast("double").alias("sym"),
        _count(text, r"\|+").cast("double").alias("bar"),
        _count(text, r"!+").cast("double").alias("bang"),
        _count(text, r"\p{Lu}+").cast("double").alias("up"),
        _count(text, r"[0-9]+").cast("double").alias("digit"),
        (_count(text, r"\n+") + 1).cast("double").alias("lines"),
    )

    def share(c: str, least: float) -> Column:
        return F.log((F.col(c) + least * PRIOR) / (F.col("c") + PRIOR) + least)

    values = {
        "words": F.log1p("n"),
        "distinct": F.log1p("d"),
        "word_length": F.log1p((F.col("c") - F.col("space") + PRIOR) / (F.col("n") + PRIOR / 5)),
        "symbols": share("sym", 0.01),
        "bars": share("bar", 0.01),
        "bangs": share("bang", 0.01),
        "capitals": share("up", 0.05),
        "digits": share("digit", 0.01),
        "line_length": F.log1p(F.col("n") / F.col("lines")),
    }
    return rows.select("row", *[values[k].alias(k) for k in FEATURES])


@dataclass
class Discriminant:
    """Per class the mean, the inverse of the Cholesky factor of the covariance, its log determinant and the prior."""

    means: np.ndarray
    inverses: np.ndarray
    logdets: np.ndarray
    log_priors: np.ndarray

    def score(self) -> Column:
        """Probability of class 1 as a column over FEATURES."""
        density = []
        for k in (0, 1):
            shifted = [F.col(f) - float(m) for f, m in zip(FEATURES, self.means[k], strict=True)]
            total = F.lit(float(self.log_priors[k] - 0.5 * self.logdets[k]))
            for i, row in enumerate(self.inverses[k]):
                part = sum((shifted[j] * float(row[j]) for j in range(1, i + 1)), shifted[0] * float(row[0]))
                total = total - part * part * 0.5
            density.append(total)
        return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), density[0] - density[1]))))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on rows (y 0 or 1, FEATURES): one aggregation of moments per class, then small matrices on the driver."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    n, means, scatter = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in labelled.filter("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        k, n[r["y"]] = r["y"], r["n"]
        means[k] = [r[f"s{i}"] / n[k] for i in range(d)]
        for i, j in pairs:
            scatter[k, i, j] = scatter[k, j, i] = r[f"p{i}_{j}"] - n[k] * means[k, i] * means[k, j]
    pooled = scatter.sum(0) / max(1.0, n.sum() - 2) + FLOOR * np.eye(d)
    middle = (n[:, None] * means).sum(0) / max(1.0, n.sum())
    inverses, logdets = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        means[k] = means[k] if n[k] else middle
        own = scatter[k] / max(1.0, n[k] - 1) + FLOOR * np.eye(d) if n[k] > d else pooled
        mixed = (1 - POOL) * own + POOL * pooled
        mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed))
        factor = np.linalg.cholesky(mixed)
        inverses[k], logdets[k] = np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()
    return Discriminant(means, inverses, logdets, np.log((n + 1) / (n.sum() + 2)))


def _known(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: not those of documents whose crc32 of the id as text is 0 modulo 5."""
    return labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")).filter(crc_mod(F.col("id"), 5) != 0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted, one row for each row of docs."""
    rows = work_table(statistics(docs, ["doc_id"]).select("row.doc_id", *FEATURES), "quality_statistics")
    score = fit(rows.join(_known(labels), F.col("doc_id") == F.col("id"))).score()
    return rows.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")
    )


@any_names
def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; statistics and score are computed in the scan."""
    learnt = docs.select("doc_id", "text").join(_known(labels), F.col("doc_id") == F.col("id")).select("y", "text")
    model = fit(statistics(learnt, ["y"]).select("row.y", *FEATURES))
    return statistics(docs, docs.columns).filter(model.score() >= THRESHOLD).select("row.*")
