"""Carrying a table's other columns through an operator, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and one more, lw_row, that holds the others; none can clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*(others or [F.lit(0).alias("none")])).alias("lw_row"))


def unpack(rows: DataFrame, docs: DataFrame, names: tuple[str, ...], **new: Column) -> DataFrame:
    """rows with the columns of docs again, in their order; new ones in place of some."""
    return rows.select(*(new.get(c, F.col(c) if c in names else F.col("lw_row").getField(c)).alias(c) for c in docs.columns))
