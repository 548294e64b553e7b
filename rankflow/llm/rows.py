"""Numbered rows: a table of documents written once, so that rows can be told apart and found again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.session import materialize

#: Column of the row number; a column of ``docs`` with this name is kept under its place instead.
ROW = "_row"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with columns renamed by position (``c0``, ``c1``, ...) and a number per row, in the shared folder.

    The numbers are drawn when the table is written, so a lost executor cannot change them later.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return materialize(plain.withColumn(ROW, F.monotonically_increasing_id()), name)


def renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, under their names, from a table with columns by position."""
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
