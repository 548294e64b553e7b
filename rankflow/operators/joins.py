"""Lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def splits_skew(df: DataFrame) -> bool:
    """Whether the running session divides crowded join partitions by itself."""
    conf = df.sparkSession.conf
    return all(conf.get(key) == "true" for key in (
        "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"))


def lookup(facts: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner",
           salt_by: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """Join ``facts`` to a table that is unique on ``on``.

    The keyed side is broadcast only where the optimizer finds it within the
    broadcast limit. Otherwise the fact rows of a crowded key are divided among
    tasks: at run time by adaptive execution, or, in a session without it, by a
    hash of ``salt_by``, with each keyed row repeated once per salt.
    """
    salt_cols = salt_by or [c for c in facts.columns if c not in on]
    if splits_skew(facts) or not salt_cols:
        return facts.join(keyed, on, how)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salts)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
