"""Exact top-k search: exhaustive term-at-a-time accumulation in blocks, partition selection, merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch
from quillon.llm.vectors import one_per_id

#: Rows of a query block and of a candidate block; a task holds one score array of their product.
QUERY_BLOCK, BLOCK = 256, 4096
#: Rows of a group of queries and of a part of the candidates, at most.
GROUP = 16_384
SCALE = 1024


def _pack(size: int, grouped: bool = False):
    """Blocks of at most ``size`` rows: their ids, and (row, term, weight) of non-zero weights by term.

    Grouped rows are sorted by their group, the last column, and no block holds two groups; others are group 0.
    """

    def packed(ids, lists, g):
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = np.flatnonzero(flat)
        keep = keep[np.argsort(term[keep], kind="stable")]
        made = (ids.astype("<i8"), row[keep].astype("<i4"), term[keep].astype("<i4"), flat[keep].astype("<i8"))
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in made)], names=["g", "ids", "rows", "terms", "weights"])

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            group = batch.column(2).to_numpy() if grouped else np.zeros(len(ids), np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for lo in range(a, b, size):
                    hi = min(b, lo + size)
                    yield packed(ids[lo:hi], lists.slice(lo, hi - lo), int(group[lo]))

    return run


def _postings(rows: bytes, terms: bytes, weights: bytes):
    r, t, w = (np.frombuffer(x, d) for x, d in ((rows, "<i4"), (terms, "<i4"), (weights, "<i8")))
    cut = np.flatnonzero(np.diff(t)) + 1
    lows = np.concatenate(([0], cut)) if len(t) else np.zeros(0, int)
    highs = np.concatenate((cut, [len(t)])) if len(t) else lows
    return {int(t[a]): (r[a:b], w[a:b]) for a, b in zip(lows, highs, strict=True)}


def scores(queries: dict, n_queries: int, candidates: dict, n_candidates: int) -> np.ndarray:
    """Dense integer scores: term by term, each query's weight times the term's postings is added in."""
    out = np.zeros((n_queries, n_candidates), np.int64)
    for term, (q, qw) in queries.items():
        if term not in candidates:
            continue
        c, cw = candidates[term]
        if len(c) == n_candidates:  # postings of every candidate, in order
            for i, w in zip(q.tolist(), qw.tolist(), strict=True):
                out[i] += cw * w
        else:
            for i, w in zip(q.tolist(), qw.tolist(), strict=True):
                out[i, c] += cw * w
    return out


def best(row: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids: partition first, then sort what reaches the k-th."""
    allowed = np.flatnonzero(ids != own)
    s = row[allowed]
    if len(s) > k:
        floor = np.partition(s, len(s) - k)[len(s) - k]
        pick = np.flatnonzero(s >= floor)
        allowed, s = allowed[pick], s[pick]
    return allowed[np.lexsort((ids[allowed], -s))[:k]]


def _merge(held: tuple, found: tuple, k: int) -> tuple:
    """The k best of two lists of (score, id), best first."""
    scores_, ids = (np.concatenate(x) for x in zip(held, found, strict=True))
    order = np.lexsort((ids, -scores_))[:k]
    return scores_[order], ids[order]


def _search(k: int):
    """Cells (g, part), sorted: a group's query blocks come first and are held, a part's candidate blocks stream past them."""

    def run(batches):
        key, asked, held = None, [], []

        def done():
            for (ids, _), lists in zip(asked, held, strict=True):
                for q, (s, v) in zip(ids.tolist(), lists, strict=True):
                    if len(v):
                        yield np.full(len(v), q), v, s

        def out():
            cols = list(zip(*done(), strict=True)) or [[np.zeros(0, np.int64)]] * 3
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                g, part, candidates = (batch.column(i)[r].as_py() for i in range(3))
                ids, rows, terms, weights = (batch.column(i)[r].as_buffer() for i in range(3, 7))
                ids, postings = np.frombuffer(ids, "<i8"), _postings(rows, terms, weights)
                if (g, part) != key:
                    if key is not None:
                        yield out()
                    key, asked, held = (g, part), [], []
                if not candidates:
                    asked.append((ids, postings))
                    held.append([(np.zeros(0, np.int64),) * 2] * len(ids))
                    continue
                for n, (qids, mine) in enumerate(asked):
                    table = scores(mine, len(qids), postings, len(ids))
                    for i, q in enumerate(qids):
                        at = best(table[i], ids, q, k)
                        held[n][i] = _merge(held[n][i], (table[i, at], ids[at]), k)
        if key is not None:
            yield out()

    return run


def top_k(rows: DataFrame, is_query, scratch: Scratch, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows.

    ``is_query`` is a condition on the column ``id``. Components become floor(1024 * x); a shorter
    vector counts as padded with zeros. Candidates and queries are packed in blocks as postings by
    term. Queries are dealt to groups of some 16,384 and candidate blocks to parts of as many rows
    (less in small tables, so that all cores work): every part meets every group once, in a task
    that holds the group, streams the part, keeps one dense score array of a query block by a
    candidate block, and returns k rows a query. A window merges them. Nothing is broadcast or
    collected but two counts.

    Rows with a null id, or a vector that is null, empty or holds null or non-finite components,
    take no part; an id that repeats counts once, with its smallest vector. Ties go to the smaller
    id. Scores must fit 64 bits: components of 2^21 and more, with which a product of two weights
    could pass 2^62, raise an error.
    """
    vectors = scratch.save(one_per_id(rows, id_col, vec_col))
    asked = vectors.where(is_query)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(is_query) if isinstance(is_query, str) else is_query, 1)).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.size("v")).alias("d")).first()
    if not size["q"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if (SCALE * size["most"] + 1) ** 2 * size["d"] >= 2.0**63:
        raise ValueError("components are too large for integer scores of 64 bits")
    groups = -(-size["q"] // GROUP)
    parts = max(1, -(-size["n"] // min(GROUP, max(BLOCK, size["n"] // 16))))
    layout = "ids binary, rows binary, terms binary, weights binary"
    questions = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(groups, "g").sortWithinPartitions("g")
    questions = scratch.save(questions.select("id", "v", "g").mapInArrow(_pack(QUERY_BLOCK, True), f"g int, {layout}"))
    blocks = vectors.select("id", "v").mapInArrow(_pack(BLOCK), f"g int, {layout}").withColumn("part", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(parts)).cast("int"))
    blocks = scratch.save(blocks)
    columns = ["ids", "rows", "terms", "weights"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ask = questions.withColumn("part", spread(parts)).select("g", "part", F.lit(0).alias("kind"), *columns)
    answer = blocks.withColumn("g", spread(groups)).select("g", "part", F.lit(1).alias("kind"), *columns)
    dealt = ask.unionAll(answer).repartition(max(1, min(2 * groups * parts, 20_000)), "g", "part").sortWithinPartitions("g", "part", "kind")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
