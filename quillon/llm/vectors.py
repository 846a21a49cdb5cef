"""Vectors packed in blocks of rows, for the operators that search or join them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import named


def usable(embedding: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~odd, F.lit(False))


def one_per_id(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double>) of the usable rows; an id that repeats counts once, with its smallest vector."""
    v = named(vec_col).cast("array<double>")
    return rows.select(named(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
