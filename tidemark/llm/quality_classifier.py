"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Fitting needs only counts, sums and sums of products per class, which Spark adds up over all labelled rows; the driver
sees two small matrices however large the corpus is. Class covariances are shrunk towards the pooled one and towards
its diagonal; a score is the logistic of the difference of the two log densities, with Mahalanobis terms from Cholesky
factors that are computed once.

Edge cases: a null or empty text has all counts zero and gets a score like any other; labels other than 0 and 1, or
for unknown documents, take no part; a document labelled twice counts twice; without labels of both classes every score is 0.5;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats
from .common import bounded_batches, stored

#: Transformed statistics, as SQL over textstats.FIELDS. Ratios are in logs of smoothed counts, so that they look normal.
FEATURES: tuple[str, ...] = (
    "ln(1 + n_words)",
    "ln((word_chars + 1.0) / (n_words + 1.0))",
    "ln((n_symbols + 0.5) / (n_words + 1.0))",
    "ln((n_dup_lines + 0.5) / (n_lines + 1.0))",
    "ln((n_repeat_words + 1.0) / (n_words + 1.0))",
    "ln((n_same_next + 0.5) / (n_words + 1.0))",
    "ln((n_distinct + 1.0) / (n_words + 1.0)) / ln(2 + n_words)",
    "ln((n_upper + 1.0) / (n_letters + 2.0))",
    "ln((n_exclaim + 0.5) / (n_words + 1.0))",
    "ln((n_digits + 0.5) / (word_chars + 1.0))",
    "ln((n_stops + 0.5) / (n_words + 1.0))",
    "ln((n_lines + 1.0) / (n_words + 2.0))",
    "ln((n_high + 0.5) / (word_chars + 1.0))",
)
D = len(FEATURES)


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse Cholesky factor of the shrunk covariance, half its log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    half_logdet: np.ndarray


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), textstats.stats(F.col(text_col).cast("binary")).alias("m"))
    return rows.select("doc_id", "m.*").select("doc_id", F.array(*[F.expr(f"CAST({x} AS DOUBLE)") for x in FEATURES]).alias("x"))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 on division by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(rows: DataFrame, shrink: float = 0.1, diagonal: float = 0.1, floor: float = 1e-3) -> Model | None:
    """rows: x array<double>, y 0 or 1. None if a class is missing. At most 2 * (1 + D + D * D) numbers reach the driver."""

    def sums(batches):
        n, s, q = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
                for k in range(2):
                    z = x[y == k]
                    n[k] += len(z)
                    s[k] += z.sum(0)
                    q[k] += z.T @ z
        flat = np.concatenate([n[:, None], s, q.reshape(2, -1)], 1)
        yield pd.DataFrame({"y": np.repeat([0, 1], flat.shape[1]), "k": np.tile(np.arange(flat.shape[1]), 2), "v": flat.ravel()})

    parts = rows.where(F.col("y").isin(0, 1)).select("x", "y").mapInPandas(sums, "y int, k int, v double")
    flat = np.zeros((2, 1 + D + D * D))
    for y, k, v in parts.groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        flat[y, k] = v
    n, s, q = flat[:, 0], flat[:, 1 : 1 + D], flat[:, 1 + D :].reshape(2, D, D)
    if (n < 1).any():
        return None
    mean = s / n[:, None]
    scatter = q - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    out = []
    for k in range(2):
        cov = (1 - shrink) * scatter[k] / n[k] + shrink * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(pooled)) + floor * np.eye(D)
        low = np.linalg.cholesky(cov)
        out.append((np.linalg.inv(low), np.log(np.diag(low)).sum()))
    return Model(np.log(n / n.sum()), mean, np.stack([f for f, _ in out]), np.array([h for _, h in out]))


def score_column(model: Model | None, x: str = "x"):
    """The score of a vector column, as SQL: one pass over the texts in Python is enough."""
    if model is None:
        return F.lit(0.5)

    def log_density(k: int, v):
        rows = [F.struct(F.array(*map(F.lit, row)).alias("row"), F.lit(-shift).alias("shift")) for row, shift in zip(model.factor[k].tolist(), (model.factor[k] @ model.mean[k]).tolist(), strict=True)]
        z = F.transform(F.array(*rows), lambda r: F.aggregate(F.zip_with(r["row"], v, lambda a, b: a * b), r["shift"], lambda s, y: s + y))
        return F.lit(float(model.prior[k] - model.half_logdet[k])) - 0.5 * F.aggregate(z, F.lit(0.0), lambda s, y: s + y * y)

    def score(v):
        return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log_density(0, v) - log_density(1, v)))))

    return F.transform(F.array(F.col(x)), score)[0]  # the vector as a variable, so that it is computed once however the plan is collapsed


def labelled(feats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Training rows: everything that isn't held out and has a label."""
    return feats.where(~held_out() & F.col("doc_id").isNotNull()).join(labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("int").alias("y")), "doc_id")


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    feats = stored(features(docs, id_col, text_col), "features")  # read twice: to fit, then to score
    model = fit(labelled(feats, labels, label_col))
    out = feats.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept_documents(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, threshold: float = 0.5, label_col: str = "quality", text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least ``threshold``, all columns unchanged; scored in place, without a join.

    Fitted on the labelled rows of ``train`` that aren't held out, or of docs: where an earlier filter has already
    taken one class away, what is left can't be fitted on, so the documents before that filter should be given.
    """
    m = textstats.stats(F.col(text_col).cast("binary")).alias("m")
    some = bounded_batches(docs if train is None else train).where(~held_out()).select(F.col("doc_id").cast("long").alias("__id"), F.col(text_col).alias(text_col))
    some = some.join(labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__y").isin(0, 1)), "__id")
    x = F.array(*[F.expr(f"CAST({f} AS DOUBLE)") for f in FEATURES]).alias("x")
    model = fit(some.select(m, F.col("__y").alias("y")).select("m.*", "y").select(x, "y"))
    held = docs.select(F.struct("*").alias("row"), m).select("row", "m.*").select("row", x)
    return held.where(score_column(model) >= threshold).select("row.*")
