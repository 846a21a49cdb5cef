"""Relational operators that Spark's DataFrame API does not have under one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.compat import distinct_on, groups_frame, qualify, recursive_distinct

__all__ = ["distinct_on", "groups_frame", "nway_join", "qualify", "recursive_distinct", "safe_broadcast", "salted_join"]


def nway_join(first: DataFrame, *steps: tuple[DataFrame, Column | list[str] | str, str]) -> DataFrame:
    """A chain of joins (frame, condition, kind) in one call; Catalyst reorders the inner ones."""
    for df, on, how in steps:
        first = first.join(df, on, how)
    return first


def safe_broadcast(df: DataFrame, most_bytes: int) -> DataFrame:
    """A broadcast hint if the optimiser's size estimate is within ``most_bytes``; else the frame as it is, to be shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


def salted_join(large: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over ``salts`` tasks: rows of ``large`` get a salt, those of ``small`` all of them.

    The result is that of large.join(small, on, how) for inner and left joins; a left row meets one
    salt of each match only.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot be salted on this side")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in large.columns if c != on] or [F.lit(0)]), F.lit(salts))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("__salt", F.col("__salt").cast("long"))
    return large.withColumn("__salt", salt).join(spread, [on, "__salt"], how).drop("__salt")
