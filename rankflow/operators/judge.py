"""Judge scores: means, bias correction, extremes, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_score() -> Column:
    return (F.col("personalization") + F.col("explanation")) / 2


def judge_means(scores: DataFrame) -> DataFrame:
    """(mean_p, mean_e, mean_combined, n_scored, n_failed) of a score table."""
    p, e = F.avg("personalization"), F.avg("explanation")
    return scores.agg(
        p.alias("mean_p"), e.alias("mean_e"), ((p + e) / 2).alias("mean_combined"),
        F.count("personalization").alias("n_scored"),
        F.count_if(F.col("personalization").isNull()).alias("n_failed"))


def bias_corrected(scores: DataFrame, known_mean: float) -> DataFrame:
    """Scores with proxy_avg, corrected_avg and bias_factor.

    The factor brings the mean score to a known mean; corrected scores stop at 5.
    Without any score, or with a mean of 0, the factor is 1 and no average is given.
    """
    proxy = judge_means(scores).select("mean_combined").scalar()
    usable = F.coalesce(proxy != 0, F.lit(False))
    factor = F.when(usable, F.lit(float(known_mean)) / proxy).otherwise(1.0)
    rows = scores.withColumn("bias_factor", factor).withColumn("_usable", usable)
    avg = F.when(F.col("_usable"), mean_score())
    return (rows.withColumn("proxy_avg", avg)
            .withColumn("corrected_avg", F.when(
                avg.isNotNull(), F.least(F.lit(5.0), avg * F.col("bias_factor"))))
            .drop("_usable"))


def extremes(scores: DataFrame, n: int = 20, by: str = "proxy_avg") -> DataFrame:
    """The ``n`` worst and the ``n`` best scored sessions, with ``side`` and ``place``.

    Both sides are listed in ascending order of the score.
    """
    scored = scores.filter(F.col("personalization").isNotNull())
    worst = scored.orderBy(F.asc(by), F.asc("session_id")).limit(n).withColumn("side", F.lit("worst"))
    best = scored.orderBy(F.desc(by), F.desc("session_id")).limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def compared(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Sessions that both tables scored, with both means and the drop from the other."""
    a = primary.filter(F.col("personalization").isNotNull()).select(
        "session_id", mean_score().alias("primary_avg"))
    b = other.filter(F.col("personalization").isNotNull()).select(
        "session_id", mean_score().alias("other_avg"))
    return a.join(b, "session_id").withColumn("drop", F.col("other_avg") - F.col("primary_avg"))


def largest_drops(primary: DataFrame, other: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` sessions in which the primary table falls behind most."""
    return (compared(primary, other).filter(F.col("drop") > 0)
            .orderBy(F.desc("drop"), F.asc("session_id")).limit(n))


def comparison(primary: DataFrame, other: DataFrame) -> DataFrame:
    """(delta, n_worse): difference of the overall means, sessions that got worse."""
    mean_a = judge_means(primary).select("mean_combined").scalar()
    mean_b = judge_means(other).select("mean_combined").scalar()
    return compared(primary, other).agg(
        F.count_if(F.col("drop") > 0).alias("n_worse")).select(
            (mean_a - mean_b).alias("delta"), "n_worse")
