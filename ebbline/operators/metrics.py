"""Quality of scores: ROC AUC, log-loss, R2.  Inputs are a 0/1 label and a probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-15


def _score_bucket(p: Column) -> Column:
    """Coarse order of scores in [0, 1]: at most 196,608 buckets, finer near both ends.

    Scaling by a power of two is exact, so a larger score never falls into a lower bucket.
    """
    edge, fine, coarse = 2.0 ** -8, 2.0 ** 24, 2.0 ** 16
    return (
        F.when(p < edge, F.floor(p * fine))
        .when(p > 1 - edge, F.floor((p - (1 - edge)) * fine) + 131_072)
        .otherwise(F.floor(p * coarse) + 65_536)
    )


def score_metrics(scored: DataFrame, label: str, p: str, group: str | None = None, copies: str | None = None) -> DataFrame:
    """auc (ties counted half), logloss, r2 and n: one row, or one per group.

    ``copies`` names the number of rows that a row stands for.

    Rows are first combined per distinct score, which is all the metrics need, so the scores
    are computed once.  The number of negatives below a score is the count in lower buckets
    plus the running count in its own bucket: no task orders all scores.
    """
    by = [group] if group else []
    times = F.col(copies) if copies else F.lit(1)
    per_score = (
        scored.filter(F.col(label).isNotNull() & F.col(p).isNotNull())
        .groupBy(*by, F.col(p).cast("double").alias("_p"))
        .agg(*[F.sum(F.when(F.col(label) == y, times).otherwise(0)).cast("bigint").alias(c) for y, c in ((1, "_pos"), (0, "_neg"))])
        .withColumn("_b", _score_bucket(F.col("_p")))
    )
    lower = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        per_score.groupBy(*by, "_b").agg(F.sum("_neg").alias("_n"))
        .select(*by, "_b", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"))
    )
    within = Window.partitionBy(*by, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    clipped = f"greatest({CLIP}D, least(_p, 1 - {CLIP}D))"
    return (
        per_score.withColumn("_seen", F.coalesce(F.sum("_neg").over(within), F.lit(0)))
        .join(buckets, [*by, "_b"])
        .groupBy(*by)
        .agg(
            F.expr("sum(_pos * (_lower + _seen + _neg * 0.5D)) AS _below"),
            F.expr(f"sum(-(_pos * ln({clipped}) + _neg * ln(1 - {clipped}))) AS _loss"),
            F.expr("sum(_pos * (1 - _p) * (1 - _p) + _neg * _p * _p) AS _error"),
            F.expr("double(sum(_pos)) AS _p1"),
            F.expr("double(sum(_neg)) AS _p0"),
        )
        .selectExpr(
            *by,
            "try_divide(_below, _p1 * _p0) AS auc",
            "try_divide(_loss, _p1 + _p0) AS logloss",
            "1 - try_divide(_error * (_p1 + _p0), _p1 * _p0) AS r2",
            "bigint(_p1 + _p0) AS n",
        )
    )


def roc_auc(scored: DataFrame, label: str, p: str, group: str | None = None) -> DataFrame:
    by = [group] if group else []
    return score_metrics(scored, label, p, group).select(*by, "auc")


def log_loss(label: Column, p: Column) -> Column:
    """Aggregate: mean negative log-likelihood with p clipped away from 0 and 1."""
    q = F.greatest(F.lit(CLIP), F.least(p, F.lit(1 - CLIP)))
    return F.avg(-(label * F.log(q) + (1 - label) * F.log(1 - q)))


def r_squared(label: Column, p: Column) -> Column:
    """Aggregate: share of the label's variance explained by p; NULL for a constant label."""
    return 1 - F.try_divide(
        F.avg((label - p) * (label - p)), F.var_pop(F.when(p.isNotNull(), label))
    )
