"""Scans of datasets that are stored as named splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYOUT = "{root}/split={split}"


def available_splits(spark: SparkSession, root: str, layout: str = LAYOUT) -> list[str]:
    """Names of the splits that exist below ``root`` (a listing, no data is read)."""
    jvm = spark.sparkContext._jvm
    head, tail = layout.format(root=root, split="\0").split("\0")
    pattern = jvm.org.apache.hadoop.fs.Path(head + "*" + tail)
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tail = tail.rstrip("*")
    prefix = head.rsplit("/", 1)[1]
    names = []
    for status in fs.globStatus(pattern) or []:
        name = status.getPath().getName() if "/" not in tail else (
            status.getPath().getParent().getName())
        name = name[len(prefix):]
        cut = name.find(tail) if tail and "/" not in tail else -1
        names.append(name[:cut] if cut >= 0 else name)
    return sorted(set(names))


def read_splits(spark: SparkSession, root: str, splits: Sequence[str] | None = None, *,
                skip_missing: bool = False, layout: str = LAYOUT,
                fmt: str = "parquet", schema=None) -> DataFrame:
    """Concatenate splits, later ones last (``split_no`` keeps the order).

    ``splits=None`` reads all of them. A missing split is an error unless
    ``skip_missing`` is set.
    """
    present = available_splits(spark, root, layout)
    wanted = list(present if splits is None else splits)
    missing = [s for s in wanted if s not in present]
    if missing and not skip_missing:
        raise ValueError(f"splits not found below {root}: {missing}")
    wanted = [s for s in wanted if s in present]
    if not wanted:
        raise ValueError(f"no split to read below {root}")
    parts = []
    for no, split in enumerate(wanted):
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        part = reader.load(layout.format(root=root, split=split))
        parts.append(part.withColumn("split_no", F.lit(no)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_preferred(spark: SparkSession, root: str, prefer: str | None = "train", *,
                   layout: str = LAYOUT, fmt: str = "parquet") -> DataFrame:
    """One split: the preferred one if it exists, else the first."""
    present = available_splits(spark, root, layout)
    if not present:
        raise ValueError(f"no split to read below {root}")
    split = prefer if prefer in present else present[0]
    return read_splits(spark, root, [split], layout=layout, fmt=fmt)


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last one by ``order`` (as in a keyed overwrite).

    The rank filter is cut down to one row per key within each task before the
    shuffle, so a key with very many copies stays cheap.
    """
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))
