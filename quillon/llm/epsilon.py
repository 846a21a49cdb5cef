"""Embedding near-dedup by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, named
from quillon.llm.components import connected_components
from quillon.llm.vectors import usable

COSINE = 0.95
#: Leading principal dimensions of the grid, and the columns of the subspace iteration that finds them.
LEADING, SUBSPACE = 12, 24
#: Rows of a leaf and of a block, and bytes of a block.
LEAF, BLOCK, BLOCK_BYTES = 128, 1024, 2 << 20
#: Rows of a group of blocks, at least and at most, and its bytes; a task holds one group and a block more.
GROUP_LEAST, GROUP_MOST, GROUP_BYTES = 4096, 65_536, 32 << 20
#: Children of an interval of groups.
FAN = 32
#: Slack for rounding in the distance bounds.
SLACK = 1e-6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their largest component is near 1: exact, and norms neither vanish nor overflow."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _matrix(lists, d: int) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)


def _power(basis: np.ndarray):
    """Each task's sum of x (x' basis) over its unit vectors x, as a row for each component."""

    def run(batches):
        total = np.zeros(basis.shape)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                x = scaled(_matrix(batch.column(0).slice(lo, 2048), len(basis)))
                x /= _norms(x)[:, None]
                total += x.T @ (x @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "y"])

    return run


def principal(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthonormal axes (d, LEADING at most) near the leading principal directions of the unit vectors.

    Two rounds of subspace iteration; the driver sees d x 24 sums. Any orthonormal axes give right
    results, these prune best.
    """
    basis = np.linalg.qr(np.random.default_rng(9).standard_normal((d, min(SUBSPACE, d))))[0]
    for _ in range(2):
        sums = vectors.select("v").mapInArrow(_power(basis), "i int, y array<double>").select("i", F.posexplode("y").alias("k", "y")).groupBy("i", "k").agg(F.sum("y").alias("y")).collect()
        image = np.zeros(basis.shape)
        for r in sums:
            image[r["i"], r["k"]] = r["y"]
        inner = basis.T @ image
        last, basis = basis, np.linalg.qr(image)[0] if np.isfinite(image).all() and np.abs(image).max() > 0 else basis
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return last @ turn[:, np.argsort(-values)[: min(LEADING, d)]]


def coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Principal coordinates of unit rows, and the length of what they leave: distances between these bound those of the rows."""
    p = x @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))
    return np.hstack([p, rest[:, None]])


def _place(axes: np.ndarray, eps: float):
    """The grid cell of each row, a byte for each dimension, most important first."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = scaled(_matrix(part.column(1), len(axes)))
                cells = np.floor((x / _norms(x)[:, None]) @ axes / eps)
                key = np.clip(cells + 128, 0, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k.tobytes() for k in key], pa.binary())], names=[*part.schema.names, "cell"])

    return run


class Block:
    """A run of rows of the grid order, ready to be joined: unit rows in single precision and boxes of leaves."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, x: np.ndarray, axes: np.ndarray):
        self.nodes, self.weights, self.x = nodes, weights, x
        rows = scaled(x)
        rows /= _norms(rows)[:, None]
        self.unit = rows.astype(np.float32)
        p = coordinates(rows, axes)
        cut = np.arange(0, len(p), LEAF)
        self.low, self.high = np.minimum.reduceat(p, cut, axis=0), np.maximum.reduceat(p, cut, axis=0)


_LAYOUT = "start long, n long, nodes binary, weights binary, x binary"


def _pack(axes: np.ndarray, size: int, kind: str):
    """Runs of ``size`` rows of the grid order, with the box of their coordinates."""
    names = [f"{side}{k}" for side in "lh" for k in range(axes.shape[1] + 1)]

    def run(batches):
        held: list = []
        rows = start = 0

        def made(part):
            nonlocal start
            x = _matrix(part.column(1).combine_chunks(), len(axes))
            block = Block(part.column(0).to_numpy(), part.column(2).to_numpy(), x, axes)
            cols = [pa.array([start], pa.int64()), pa.array([len(x)], pa.int64()), *(pa.array([b], pa.binary()) for b in (block.nodes.astype("<i8").tobytes(), block.weights.astype("<i8").tobytes(), x.astype(kind).tobytes()))]
            start += len(x)
            box = np.concatenate((block.low.min(0), block.high.max(0)))
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([v]) for v in box)], names=["start", "n", "nodes", "weights", "x", *names])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                t = pa.Table.from_batches(held)
                yield made(t.slice(0, size))
                rest = t.slice(size)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield made(pa.Table.from_batches(held))

    return run


def gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Least squared distance between boxes (last axis: dimensions)."""
    g = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return (g * g).sum(-1)


def join_blocks(a: Block, b: Block, cosine: float):
    """(i, j) arrays of the links between two blocks, or within one (i < j).

    Pairs of leaves whose boxes are farther apart than the cosine allows are skipped. The others are
    multiplied in single precision; products within its error of the bound are decided in double.
    """
    near = gap(a.low[:, None], a.high[:, None], b.low[None], b.high[None]) <= 2 - 2 * cosine + SLACK
    if a is b:
        near &= np.tri(len(near), dtype=bool).T
    error = (a.unit.shape[1] + 8) * 2.0**-23
    at = np.arange(0, len(b.unit), LEAF)
    for rows, leaves in _runs(near):
        lo, hi = rows[0] * LEAF, min(len(a.unit), (rows[-1] + 1) * LEAF)
        cols = slice(0, None) if len(leaves) == len(at) else np.concatenate([np.arange(at[k], min(at[k] + LEAF, len(b.unit))) for k in leaves])
        dots = a.unit[lo:hi] @ b.unit[cols].T
        hit = np.flatnonzero(dots >= np.float32(cosine - error))
        if not len(hit):
            continue
        i, j = np.divmod(hit, dots.shape[1])
        sure = dots.ravel()[hit] >= np.float32(cosine + error)
        i, j = i + lo, j if isinstance(cols, slice) else cols[j]
        if a is b:
            below = i < j
            i, j, sure = i[below], j[below], sure[below]
        for k in range(0, len(i), 8192):
            p, q, ok = i[k : k + 8192], j[k : k + 8192], sure[k : k + 8192].copy()
            open_ = np.flatnonzero(~ok)
            ok[open_] = cosines(a.x[p[open_]], b.x[q[open_]]) >= cosine
            if ok.any():
                yield p[ok], q[ok]


def _runs(near: np.ndarray):
    """(leaves of a, leaves of b): neighbours of a that meet the same leaves are taken together."""
    start = 0
    for k in range(1, len(near) + 1):
        if k == len(near) or (near[k] != near[start]).any():
            if near[start].any():
                yield np.arange(start, k), np.flatnonzero(near[start])
            start = k


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    if not len(x):
        return np.zeros(0)
    x, y = scaled(x), scaled(y)
    return np.einsum("ij,ij->i", x, y) / (_norms(x) * _norms(y))


def absorb(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of components after the links (i, j): each row's is the smallest row it is connected with."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != (further := labels[labels])).any():
            labels = further


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


class Cell:
    """What a pair of groups has found: counts of linked vectors, and components as stars."""

    def __init__(self):
        self.held: list[tuple[int, Block]] = []
        self.nodes, self.counts, self.labels = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, block: Block) -> int:
        at = len(self.nodes)
        self.nodes = np.concatenate((self.nodes, block.nodes))
        self.counts = np.concatenate((self.counts, np.zeros(len(block.nodes), np.int64)))
        self.labels = np.concatenate((self.labels, np.arange(at, len(self.nodes))))
        return at

    def join(self, at: int, a: Block, to: int, b: Block, cosine: float) -> None:
        for i, j in join_blocks(a, b, cosine):
            self.counts[at : at + len(a.nodes)] += np.bincount(i, b.weights[j], len(a.nodes)).astype(np.int64)
            self.counts[to : to + len(b.nodes)] += np.bincount(j, a.weights[i], len(b.nodes)).astype(np.int64)
            self.labels = absorb(self.labels, i + at, j + to)

    def links(self) -> pa.RecordBatch:
        leaf, found = np.flatnonzero(self.labels != np.arange(len(self.labels))), np.flatnonzero(self.counts)
        ends = np.concatenate((self.nodes[self.labels[leaf]], np.zeros(len(found), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((self.nodes[leaf], self.nodes[found]))), pa.array(ends, mask=np.arange(len(ends)) >= len(leaf)), pa.array(np.concatenate((np.zeros(len(leaf), np.int64), self.counts[found])))], schema=_LINKS)


def _join(axes: np.ndarray, cosine: float, kind: str):
    """Pairs of groups, sorted, as their blocks in order: the first group is held, the second streams past it."""

    def run(batches):
        key, cell = None, Cell()
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, g = (batch.column(k)[r].as_py() for k in range(3))
                if (a, b) != key:
                    if key is not None:
                        yield cell.links()
                    key, cell = (a, b), Cell()
                nodes, weights, x = (np.frombuffer(batch.column(k)[r].as_buffer(), t) for k, t in ((4, "<i8"), (5, "<i8"), (6, kind)))
                block = Block(nodes, weights, x.reshape(len(nodes), -1), axes)
                at = cell.add(block)
                if g == a:
                    cell.held.append((at, block))
                if g == b:
                    for to, other in cell.held:
                        cell.join(to, other, at, block, cosine)
        if key is not None:
            yield cell.links()

    return run


def _gap(dims: int) -> Column:
    """The squared distance of the boxes of two joined rows, whose columns begin with a_ and b_."""
    side = lambda k: F.greatest(F.lit(0.0), F.col(f"a_l{k}") - F.col(f"b_h{k}"), F.col(f"b_l{k}") - F.col(f"a_h{k}"))
    return sum((side(k) * side(k) for k in range(dims)), F.lit(0.0))


def interval_pairs(boxes: DataFrame, n: int, dims: int, bound: float, scratch: Scratch) -> DataFrame:
    """(a, b) with a <= b: pairs of the intervals 0 to n - 1 whose boxes are near, found from the root of a tree of them.

    ``boxes`` is (g, l0.., h0..). An interval of a level holds 32 of the next. A pair of intervals
    that is too far apart drops out with all pairs below it.
    """
    ends = [f"{side}{k}" for side in "lh" for k in range(dims)]
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    pairs = scratch.sparkframe([(0, 0)], "a long, b long")
    for level in range(len(sizes) - 2, -1, -1):
        here = boxes.withColumn("id", F.floor(F.col("g") / FAN**level)).groupBy("id").agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in ends])
        here = here.withColumn("up", F.floor(F.col("id") / FAN))
        a, b = (here.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "up", *ends)]) for side in "ab")
        pairs = pairs.join(a, F.col("a") == F.col("a_up")).join(b, F.col("b") == F.col("b_up")).where("a_id <= b_id").where(_gap(dims) <= bound).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs


def near_vectors(rows: DataFrame, scratch: Scratch, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors become one class with a weight first, so a group of copies is never paired up.
    Classes are sorted by the cells, eps wide, of their leading principal coordinates; eps is the
    distance of unit vectors at the cosine. The sequence is cut into blocks, and these into groups
    of a fixed number of bytes, with boxes of the coordinates and of the length that they leave.
    Pairs of groups that may hold a link are found by going down a tree of intervals, in joins of
    boxes. A task gets the blocks of both groups of a pair once, holds the first group and streams
    the second; blocks that are near by their leaves' boxes are multiplied. It returns counts and
    stars of components, never the links. Smaller tables have smaller groups, so that all cores
    work; the results do not depend on it.

    Vectors of different lengths link with nothing of another length. Rows whose vector is null,
    empty, zero, or holds null or non-finite components link with nothing. Rows without an id take
    no part: n_links 0, component_id null, kept. Rows that repeat an id are vectors of their own,
    linked by their vectors only.
    """
    spark = rows.sparkSession
    v = named(vec_col)
    narrow = rows.select(v.alias("v")).schema["v"].dataType.simpleString() == "array<float>"
    v = v if narrow else v.cast("array<double>")
    every = scratch.save(rows.select(named(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("ok", F.col("vec_id").isNotNull() & usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))))
    classes = every.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()))  # a number of its own, fixed once written
    links = spark.createDataFrame([], "a long, b long, n long")
    for row in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        links = links.unionAll(_links_of(classes.where(F.size("v") == row["d"]).select("node", "v", "w"), row["d"], row["count"], cosine, "<f4" if narrow else "<f8", scratch))
    links = scratch.save(links)
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = connected_components(links.where("b is not null").select("a", "b"), scratch)
    label = found.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("label"))
    found = found.join(label, "component").select("node", "label")
    facts = classes.join(counts, "node", "left").join(found, "node", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("label", "rep").alias("component"))
    # The hash makes both sides be dealt anew for the join, so the rows of a frequent vector may be split over tasks.
    hashed = F.xxhash64("v")
    linked = every.where("ok").withColumn("k", hashed).join(facts.withColumn("k", hashed), ["k", "v"]).select("vec_id", "n", "component")
    alone = every.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    out = linked.unionAll(alone).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links_of(classes: DataFrame, d: int, n: int, cosine: float, kind: str, scratch: Scratch) -> DataFrame:
    width, eps = d * int(kind[-1]), float(np.sqrt(2 - 2 * cosine))
    size = max(1, min(BLOCK, BLOCK_BYTES // width))
    group = max(size, min(GROUP_MOST, GROUP_BYTES // width, max(GROUP_LEAST, n // 5)))
    axes = principal(classes, d)
    dims = axes.shape[1] + 1
    ends = [f"{side}{k}" for side in "lh" for k in range(dims)]
    element = "float" if kind == "<f4" else "double"
    placed = scratch.save(classes.mapInArrow(_place(axes, eps), f"node long, v array<{element}>, w long, cell binary"))
    ordered = placed.repartitionByRange(max(1, -(-n // (4 * size))), "cell", "node").sortWithinPartitions("cell", "node")
    packed = ordered.mapInArrow(_pack(axes, size, kind), f"{_LAYOUT}, {', '.join(f'{c} double' for c in ends)}")
    packed = scratch.save(packed.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    # One number for each task that packed: where its rows begin in the whole order.
    before, offsets = 0, []
    for r in packed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    blocks = packed.join(scratch.sparkframe(offsets, "part long, before long"), "part").withColumn("start", F.col("start") + F.col("before"))
    blocks = scratch.save(blocks.withColumn("g", F.floor(F.col("start") / group)).drop("part", "before"))
    bound = 2 - 2 * cosine + SLACK
    pairs = scratch.save(interval_pairs(blocks.select("g", *ends), -(-n // group), dims, bound, scratch))
    sent = pairs.select("a", "b", F.col("a").alias("g")).unionAll(pairs.where("a <> b").select("a", "b", F.col("b").alias("g")))
    sent = sent.join(blocks.select("g", "start", "nodes", "weights", "x"), "g").select("a", "b", "g", "start", "nodes", "weights", "x")
    dealt = sent.repartition(max(1, min(2 * pairs.count(), 20_000)), "a", "b").sortWithinPartitions("a", "b", "start")
    return dealt.mapInArrow(_join(axes, cosine, kind), "a long, b long, n long")
