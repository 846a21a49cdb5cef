"""Streaming over sorted groups, and dealing the members of a large group to pairs of chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal_to_pairs(members: DataFrame, group: str, member: Column, chunks: Column) -> DataFrame:
    """Each row once for every pair of chunks (i <= j) of its group that its own chunk is in.

    A group of one chunk stays one pair, so small groups are not copied. A large group's work is
    dealt to many tasks, each of which holds two chunks at most. Adds i, j and c (the row's chunk).
    """
    rows = members.withColumn("__k", chunks).withColumn("c", F.pmod(F.xxhash64(member), F.col("__k")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__k").cast("int") - 1)))
    rows = rows.withColumn("i", F.least("c", "__o")).withColumn("j", F.greatest("c", "__o")).drop("__k", "__o")
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "c")


def groups(batches, keys: tuple[int, ...]):
    """Tables of the runs of equal keys (integer columns) in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        starts = np.flatnonzero(new)
        at = 0
        for s in starts:
            if s > at:
                held.append(batch.slice(at, s - at))
            yield pa.Table.from_batches(held)
            held, at = [], s
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


class Labels:
    """Components of the members of one task, by relabelling arrays."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def merge(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == max(x, y)] = min(x, y)
        return True
