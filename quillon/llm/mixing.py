"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import WORD, Scratch, named

#: Most copies of a document in a mix, and the most a target may exceed its source.
MAX_REPEATS = 3
#: Bits of the seeded order, and the most that one refinement step resolves.
ORDER_BITS, STEP_BITS = 60, 12


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: dict, weights: dict, total: float, limit: int = MAX_REPEATS) -> dict:
    """Targets that share ``total`` by weight, none above ``limit`` times its source's size.

    What a capped source cannot take is shared again among the others by weight, until none is above.
    """
    targets, open_ = {}, dict(weights)
    while open_:
        left, mass = total - sum(targets.values()), sum(open_.values())
        over = [s for s in open_ if left * open_[s] / mass > limit * sizes[s]]
        if not over:
            return targets | {s: left * w / mass for s, w in open_.items()}
        for s in over:
            targets[s] = float(limit * sizes[s])
            del open_[s]
    return targets


def min_cost_flow(capacity: dict, members: dict, quota: dict, limit: int = MAX_REPEATS) -> dict:
    """Tokens that each pattern gives each of its sources: {(pattern, source): tokens}.

    The k-th repetition of a pattern's tokens costs k, so repetition is spread evenly before any
    document is repeated more (convex costs). Successive shortest paths over integer tokens: the
    graph has a node for each pattern and source, never for a document.
    """
    patterns, sources = sorted(capacity, key=str), sorted(quota, key=str)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(len(node) + 2)]
    to, cap, cost = [], [], []

    def link(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y), cap.append(z), cost.append(v)
        return len(to) - 2

    for p in patterns:
        for k in range(1, limit + 1):
            link(0, node["p", p], capacity[p], k)
    given = {(p, s): link(node["p", p], node["s", s], limit * capacity[p], 0) for p in patterns for s in members[p] if s in quota}
    for s in sources:
        link(node["s", s], 1, int(round(quota[s])), 0)
    height = [0] * len(graph)
    while True:
        far, via = {0: 0}, {}
        heap = [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if cap[e] and (n := d + cost[e] + height[a] - height[to[e]]) < far.get(to[e], 1 << 62):
                    far[to[e]], via[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if 1 not in far:
            return {k: cap[e + 1] for k, e in given.items() if cap[e + 1]}
        for v in range(len(graph)):
            height[v] += far.get(v, far[1])
        path, v = [], 1
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def cut_points(rows: DataFrame, quota: dict) -> list[tuple[int, int, int]]:
    """(pattern, base, cut): every row of a pattern is taken ``base`` times, and once more if u < cut.

    ``rows`` is (pattern int, size long, u long of 60 bits). base is floor(quota / tokens); the rest
    of the quota is met from the front of the seeded order u. The cut is found by histogram
    refinement: each step sums sizes in the cells of the one interval that holds the cut, so no task
    ever sorts or holds a source's rows, however large the source is. A step's cells of all patterns
    together are some 2^20 at most, or two a pattern.
    """
    totals = {r["pattern"]: r["tokens"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("tokens")).collect()}
    base = {p: (int(quota.get(p, 0) // t) if t else 0) for p, t in totals.items()}
    rest = {p: float(quota.get(p, 0)) - base[p] * t for p, t in totals.items()}
    cut = dict.fromkeys(totals, 0)
    bits = max(1, min(STEP_BITS, 20 - len(totals).bit_length()))
    shift = ORDER_BITS
    while shift:
        above, shift = shift, max(0, shift - bits)
        heads = rows.sparkSession.createDataFrame([(p, c >> above) for p, c in cut.items()], "pattern int, head long")
        inside = rows.join(heads, "pattern").where(F.shiftrightunsigned("u", above) == F.col("head"))
        cells: dict = {}
        for r in inside.groupBy("pattern", F.shiftrightunsigned("u", shift).alias("cell")).agg(F.sum("size").alias("tokens")).collect():
            cells.setdefault(r["pattern"], []).append((r["cell"], r["tokens"]))
        for p, found in cells.items():
            found.sort()
            for cell, tokens in found:
                cut[p] = cell << shift
                if tokens > rest[p] or cell == found[-1][0]:
                    if not shift and rest[p] >= tokens / 2 > 0:
                        cut[p] = (cell + 1) << shift
                    break
                rest[p] -= tokens
    return [(p, base[p], cut[p]) for p in totals]


def default_weights(sources: list) -> dict:
    """Weights 5, 2, 1, repeating, over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}


def _numbered(rows: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """``rows``, which repeat their ``__u``, with one of its own for each: the hash of the old one and a number.

    Rows of one ``__u`` are counted within what one task wrote, then those counts are added up, so
    no task meets all rows of a large group.
    """
    rows = scratch.save(rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__task", F.shiftright("__at", 33))
    parts = rows.groupBy("__u", "__task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__u").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__u", "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__u", "__task").orderBy("__at")) + F.col("__before")
    return rows.join(parts, ["__u", "__task"]).withColumn("__n", number).withColumn("__u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__u", "__n"), 64 - ORDER_BITS)).drop("__at", "__task", "__before", "__n")


def mix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, seed: int = 17, text: bool = True) -> DataFrame:
    """``docs`` plus ``__size``, ``__source_size``, ``__target``, ``__taken``, ``__copies``.

    ``source_col`` holds a source or an array of sources (a document in several); null is a source
    of its own, and an empty array counts as null. ``weights`` default to 5, 2, 1 repeating.
    Documents are first added up by membership pattern; the driver then sees one row a pattern
    (their number is that of distinct source sets, not of documents) and routes tokens to quotas.
    Order within a pattern is a hash of seed, id and text, so reruns agree; rows alike in id and text
    are numbered, and the number takes part in the hash, so the cut may fall between them. Documents
    without words have size 0 and are taken 0 words. No row is taken more than 3 times. Input columns
    called like an added one are replaced. Without ``text`` that column is left out, and texts are
    read only once.
    """
    added = ("__size", "__source_size", "__target", "__taken", "__copies")
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    back = {c: n for c, n in zip(inner, docs.columns, strict=True)}
    at = {v: k for k, v in back.items()}
    rows = docs.toDF(*inner)
    src = F.col(at[source_col])
    member = F.when(src.isNull() | (F.size(src) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(src.cast("array<string>")))) if many else F.array(src.cast("string"))
    # "+" and "-" make null sources equal in the key.
    mark = lambda c: F.transform(c, lambda x: F.coalesce(F.concat(F.lit("+"), x), F.lit("-")))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(at[id_col]), F.col(at[text_col]).cast("string")), 64 - ORDER_BITS)
    rows = rows.withColumn("__size", words(F.col(at[text_col]).cast("string"))).withColumn("__k", mark(member)).withColumn("__u", u)
    if not text:
        del back[at[text_col]]
        rows = rows.drop(at[text_col])
    slim = scratch.save(rows if not text else rows.select("__k", "__size", "__u"))
    rows = rows if text else slim
    alike = scratch.save(slim.groupBy("__u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__u"))
    own = _numbered(rows.join(alike, "__u", "left_semi"), scratch, seed)
    rows = rows.join(alike, "__u", "left_anti").unionByName(own)
    slim = slim.join(alike, "__u", "left_anti").select("__k", "__size", "__u").unionAll(own.select("__k", "__size", "__u"))
    sums = slim.groupBy("__k").agg(F.sum("__size").alias("tokens")).collect()
    spark = docs.sparkSession
    sums = sorted(sums, key=lambda r: [(s[0] == "-", s) for s in r["__k"]])
    members = {i: tuple(None if s == "-" else s[1:] for s in r["__k"]) for i, r in enumerate(sums)}
    capacity = {i: int(r["tokens"] or 0) for i, r in enumerate(sums)}
    size_of: dict = {}
    for i, m in members.items():
        for s in m:
            size_of[s] = size_of.get(s, 0) + capacity[i]
    weights = weights or default_weights(list(size_of))
    weights = {s: w for s, w in weights.items() if s in size_of and w > 0}
    target = water_fill(size_of, weights, float(sum(capacity.values())))
    quota: dict = {}
    for (p, _), tokens in min_cost_flow(capacity, members, target).items():
        quota[p] = quota.get(p, 0) + tokens
    # One row a membership pattern; Spark broadcasts them while they are small.
    facts = [(i, list(r["__k"]), float(sum(target.get(s, 0.0) for s in members[i])), sum(size_of[s] for s in members[i])) for i, r in enumerate(sums)]
    facts = spark.createDataFrame(facts, "pattern int, __k array<string>, __target double, __source_size long")
    slim = slim.join(facts.select("__k", "pattern"), "__k").select("pattern", F.col("__size").alias("size"), F.col("__u").alias("u"))
    cuts = spark.createDataFrame(cut_points(slim, quota), "pattern int, base int, cut long")
    rows = rows.join(facts, "__k").join(cuts, "pattern")
    copies = F.col("base") + F.when((F.col("__u") < F.col("cut")) & (F.col("base") < MAX_REPEATS), 1).otherwise(0)
    return rows.select(*[F.col(c).alias(n) for c, n in back.items() if n not in added], "__size", "__source_size", "__target", (copies * F.col("__size")).alias("__taken"), copies.alias("__copies"))


def mix_report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    out = mix(docs.select("doc_id", "text", "source"), scratch, text=False)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed_rows(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    out = mix(docs, scratch, **options)
    return out.where("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[named(c) for c in docs.columns])
