"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every 200-byte string is named by its minimizer, the 64-byte string in it with the least hash, so
strings that are equal meet under one name. Runs of strings under one name leave as one segment;
equal segments are added up before anything is sorted. Segments that share a name are sorted, their
transform's intervals are expanded backwards breadth first, which finds common-prefix values in
rising order, and the expansion stops at 200: what has no value by then starts a repeated string.
A name with too many different segments to be sorted at once is refined: its segments are texts
again, whose strings are named by longer anchors, at last by all their 200 bytes.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, named
from quillon.llm.minhash import _mix

LENGTH = 200
#: Bytes of the strings that name a 200-byte string, for all names, then for those found too large, and then for
#: those of them that still are. With the last every name has one segment.
ANCHORS = (64, 128, LENGTH)
#: Bytes that are sorted at once, and those of a name beyond which it is refined.
BATCH, CHUNK = 2 << 20, 1 << 20
END = 255  # never a byte of UTF-8
_POSITION = np.uint64((1 << 23) - 1)

_rng = np.random.default_rng(31)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchor_hashes(data: np.ndarray, anchor: int = ANCHORS[0]) -> np.ndarray:
    """Hash of the ``anchor`` bytes from each position, by doubling; the last two halves overlap if need be."""
    h, size, k = _BYTE[data], 1, 0
    while size < anchor:
        more = min(size, anchor - size)
        h = h[:-more] * _STEP[k] + h[more:]
        h ^= h >> np.uint64(29)
        size, k = size + more, k + 1
    return _mix(h)


def minimizer_runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHORS[0]):
    """(first, count, name): runs of ``length``-byte strings of ``data`` under one minimizer.

    ``bounds`` are the documents' ends; no string crosses one. ``first`` is a run's first start.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data) - length + 1
    if n < 1:
        return none
    keys = anchor_hashes(data, anchor)
    least = (keys & ~_POSITION) | np.arange(len(keys), dtype=np.uint64)
    width, size = length - anchor + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n], least[width - size : width - size + n])
    at = (least[:n] & _POSITION).astype(np.int64)
    inside = np.ones(n, bool)
    for e in bounds[:-1]:
        inside[max(0, e - length + 1) : e] = False
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(starts)
    if not len(first):
        return none
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | starts[1:]
    return first, np.flatnonzero(stops) + 1 - first, keys[at[first]]


_RUN_KINDS = "fp long, h long, dk long, a int, m int"


#: Bytes hashed at once; a longer text is taken in pieces that overlap by a string less a byte.
PIECE = 1 << 22


def _pieces(texts, keys):
    """(bytes, ends, keys, offsets) of groups of texts, or pieces of long ones, of at most PIECE bytes."""
    held, ends, ids, offsets, size = [], [], [], [], 0
    for text, key in zip(texts, keys, strict=True):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield b"".join(held), np.array(ends), np.array(ids, np.int64), np.array(offsets)
                held, ends, ids, offsets, size = [], [], [], [], 0
            size += len(part)
            held.append(part), ends.append(size), ids.append(key), offsets.append(at)
    if held:
        yield b"".join(held), np.array(ends), np.array(ids, np.int64), np.array(offsets)


def _runs(anchor: int):
    def run(batches):
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary()).to_pylist()
            for joined, ends, ids, offsets in _pieces(raw, batch.column(0).to_pylist()):
                first, count, name = minimizer_runs(np.frombuffer(joined, np.uint8), ends, anchor=anchor)
                if not len(first):
                    continue
                view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
                h = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)], np.uint64)
                doc = np.searchsorted(ends, first, "right")
                start = first - np.concatenate(([0], ends[:-1]))[doc] + offsets[doc]
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["fp", "h", "dk", "a", "m"])

    return run


def _repeated_names(batches):
    """Rows whose name has several rows in this range, or is the range's first or last name.

    One row is held back, as the next batch may continue its name; all else is whole-batch masks.
    """
    first = before = None
    tail = None  # the last row so far, if nothing of its name has been passed on
    for batch in batches:
        name = batch.column(0).to_numpy()
        if not len(name):
            continue
        if first is None:
            first = name[0]
        same = name[1:] == name[:-1]
        keep = name == first
        keep[1:] |= same
        keep[:-1] |= same
        if before == name[0]:
            keep[0] = True
            if tail is not None:
                yield tail
        tail = None
        if not keep[-1]:
            tail = batch.slice(len(name) - 1)
        before = name[-1]
        yield batch.filter(pa.array(keep))
    if tail is not None:
        yield tail


# The transform ------------------------------------------------------------------------------


#: Bytes of the first sort key, of 9 bits each.
FRONT = 7


def bounded_order(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes or more, and the common-prefix values below FRONT.

    A suffix's first seven bytes are its first key; then only groups that are still tied are sorted
    again, by the ranks of what follows, over a prefix that doubles.
    """
    n = len(text)
    padded = np.zeros(n + FRONT, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(FRONT):
        key = (key << np.uint64(9)) | padded[k : n + k]
    order = np.argsort(key).astype(np.int32)  # ties are sorted below
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    value = np.full(n + 1, -1, np.int32)
    value[0] = value[n] = 0
    differ = key[1:] ^ key[:-1]
    same = sum((differ < np.uint64(1 << (9 * (FRONT - k)))).astype(np.int32) for k in range(1, FRONT))
    value[1:n] = np.where(head[1:], same, -1)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    done = FRONT
    while done < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        sub = order[slots]
        pair = (rank[sub] << 32) | (rank[np.minimum(sub + done, n)] + 1)
        by = np.argsort(pair)
        order[slots], pair = sub[by], pair[by]
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[slots] = new
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        done *= 2
    return order, value


def prefix_values(text: np.ndarray, order: np.ndarray, value: np.ndarray, stop: int = LENGTH) -> np.ndarray:
    """Common-prefix value of each suffix with the one before it in ``order``, or -1 if it is ``stop`` or more.

    Interval expansion: the interval of a string w gives, for every byte c before one of its
    suffixes, the interval of cw; the value behind that interval's end is |w| unless a shorter
    string set it. Intervals are taken breadth first, by length, and not expanded past ``stop``.
    ``value`` holds the values below FRONT; the expansion starts from the intervals of FRONT bytes.
    """
    n = len(text)
    bwt = text[order - 1]  # the text is taken as a circle, whose last byte ends a segment
    step = np.empty(n, np.int32)
    step[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    heads = np.flatnonzero(value[:n] >= 0)
    high = np.append(heads[1:], n) - 1
    low = heads[value[high + 1] == FRONT - 1]
    high = high[value[high + 1] == FRONT - 1]
    value = value.copy()
    for length in range(FRONT, stop):
        if not len(low):
            break
        one = low == high
        starts = [step[low[one]]]
        ends = [starts[0]]
        wide = np.flatnonzero(~one)
        if len(wide):
            size = high[wide] - low[wide] + 1
            at = np.arange(size.sum()) + np.repeat(low[wide] - (np.cumsum(size) - size), size)
            mark = np.repeat(np.arange(len(wide)) << 8, size) | bwt[at].astype(np.int64)
            sort = np.argsort(mark << 32 | at)  # by interval and byte, in order of place
            mark, to = mark[sort], step[at[sort]]
            new = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
            starts.append(to[new])
            ends.append(to[np.append(new[1:], len(to)) - 1])
        low, high = np.concatenate(starts), np.concatenate(ends)
        fresh = value[high + 1] < 0
        low, high = low[fresh], high[fresh]
        value[high + 1] = length
    return value


def repeated_starts(segments: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its ``length``-byte strings also start elsewhere (among segments, or in a copy)."""
    text = np.frombuffer(b"".join(s + bytes([END]) for s in segments), np.uint8)
    order, value = bounded_order(text, length)
    value = prefix_values(text, order, value, length)
    far = (value < 0) | (value >= length)
    twin = far[:-1] | far[1:]
    hit = np.empty(len(text), bool)
    hit[order] = twin
    out, at = [], 0
    for s, c in zip(segments, counts, strict=True):
        m = len(s) - length + 1
        out.append(np.ones(m, bool) if c > 1 else hit[at : at + m])
        at += len(s) + 1
    return out


def _ranges(flags: np.ndarray) -> list[int]:
    """[start, stop, start, stop, ...] of the runs of true."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge).tolist()


def _sorted_together(t: pa.Table):
    flags = repeated_starts(t.column("seg").to_pylist(), t.column("n").to_numpy())
    found = [_ranges(f) for f in flags]
    keep = pa.array([bool(x) for x in found])
    none = pa.nulls(len(found))
    out = pa.table({"fp": t.column("fp"), "h": t.column("h"), "at": pa.array(found, pa.list_(pa.int32())), "n": none.cast(pa.int64()), "seg": none.cast(pa.binary())})
    yield from out.filter(keep).combine_chunks().to_batches()


def _expand(batches):
    """Of segments sorted by name: the repeated starts of each. Whole names are sorted together, a batch of bytes at a time.

    Segments of large names pass as they are, to be refined.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        large = batch.column("large")
        if large.true_count:
            on = batch.filter(large)
            yield pa.RecordBatch.from_arrays([on.column("fp"), on.column("h"), pa.nulls(on.num_rows, pa.list_(pa.int32())), on.column("n"), on.column("seg")], names=["fp", "h", "at", "n", "seg"])
            batch = batch.filter(pc.invert(large))
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            size += int(np.diff(_ends(part)).sum())
            held.append(part)
            if size < BATCH:
                continue
            t = pa.Table.from_batches(held)
            names = t.column("fp").to_numpy()
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1
            if not len(cut):
                continue
            yield from _sorted_together(t.slice(0, int(cut[-1])))
            rest = t.slice(int(cut[-1]))
            held = rest.to_batches()
            size = sum(int(np.diff(_ends(x)).sum()) for x in held)
    if held:
        yield from _sorted_together(pa.Table.from_batches(held))


def _ends(part: pa.RecordBatch) -> np.ndarray:
    """Offsets of the segments' bytes."""
    seg = part.column("seg")
    return np.frombuffer(seg.buffers()[1], np.int32, len(seg) + 1, 4 * seg.offset)


def _cut(batches):
    """Segments out of texts: each text comes with the flat list of what is wanted of it."""
    for batch in batches:
        raw = batch.column(0).cast(pa.large_binary())
        for i, wants in enumerate(batch.column(1).to_pylist()):
            text = raw[i].as_py()
            out = [(w["fp"], w["h"], w["n"], w["large"], text[w["a"] : w["a"] + w["m"] + LENGTH - 1]) for w in wants]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.binary())], names=["fp", "h", "n", "large", "seg"])


def _remove(batches):
    for batch in batches:
        raw, spans = batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()
        cols: list[list] = [[], [], [], []]
        for text, cuts in zip(raw, spans, strict=True):
            text = text or b""
            kept, at, gone, runs = [], 0, 0, 0
            end = -1
            for s in sorted((c["s"], c["e"]) for c in cuts or ()):
                if s[0] > end:
                    kept.append(text[at : s[0]])
                    runs += 1
                    gone += s[1] - s[0]
                    at = end = s[1]
                elif s[1] > end:
                    gone += s[1] - end
                    at = end = s[1]
            kept.append(text[at:])
            for c, v in zip(cols, (len(text), gone, runs, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _sweep(spark) -> None:
    """Lets Spark delete the shuffle files of stages that no table needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(dk, spans) of every document with a repeated 200-byte string; spans are (s, e) in bytes, e exclusive.

    ``dk`` is xxhash64 of id and text. Names and hashes are range-partitioned with the document as
    the last key, so a name that a third of all documents hold spreads over many ranges; a range
    keeps its first and last name whole whatever their count, so none is lost at a border. Equal
    segments are counted on the map side and one text of each is sorted. Names with more than CHUNK
    bytes of different segments are refined, so no task sorts a larger one.
    """
    text = named(text_col).cast("string")
    rows = docs.select(F.xxhash64(named(id_col), text).alias("dk"), text.alias("text"))
    return _spans(rows, scratch, ANCHORS)


def _spans(texts: DataFrame, scratch: Scratch, anchors: tuple[int, ...]) -> DataFrame:
    """repeated_spans() of texts (dk, text as string or binary), named by the first of ``anchors``."""
    spark = texts.sparkSession
    rows = texts.where(F.octet_length("text") >= LENGTH)
    runs = scratch.save(rows.mapInArrow(_runs(anchors[0]), _RUN_KINDS))
    alike = scratch.save(runs.repartitionByRange("fp", "h", "dk").sortWithinPartitions("fp", "h").mapInArrow(_repeated_names, _RUN_KINDS))
    scratch.free(runs)
    _sweep(spark)
    segments = alike.groupBy("fp", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("dk", "a", "m")).alias("one"))
    segments = scratch.save(segments.select("fp", "h", "n", "one.dk", "one.a", "one.m"))
    names = segments.groupBy("fp").agg(F.sum(F.col("m") + LENGTH).alias("size"), F.sum("n").alias("rows")).where("rows > 1")
    names = scratch.save(names.select("fp", (F.col("size") > (CHUNK if len(anchors) > 1 else 1 << 62)).alias("large")))
    wants = segments.join(names, "fp").select("dk", F.struct("fp", "h", "n", "a", "m", "large").alias("w")).groupBy("dk").agg(F.collect_list("w").alias("wants"))
    cut = rows.join(wants, "dk").select("text", "wants").mapInArrow(_cut, "fp long, h long, n long, large boolean, seg binary")
    # Small names meet whole; the segments of a large one go anywhere.
    dealt = cut.repartition("fp", F.when(F.col("large"), F.col("h")).otherwise(F.lit(0))).sortWithinPartitions("fp")
    told = scratch.save(dealt.mapInArrow(_expand, "fp long, h long, at array<int>, n long, seg binary"))
    found = told.where("seg is null").select("fp", "h", "at")
    if not names.where("large").isEmpty():
        found = found.unionByName(_refined(told.where("seg is not null").select("fp", "h", "n", "seg"), scratch, anchors[1:]))
    _sweep(spark)
    places = alike.select("fp", "h", "dk", "a").join(found, ["fp", "h"])
    pair = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda k: F.struct((F.col("a") + F.element_at("at", k + 1)).alias("s"), (F.col("a") + F.element_at("at", k + 2) + (LENGTH - 1)).alias("e")))
    return scratch.save(places.select("dk", F.explode(pair).alias("span")).groupBy("dk").agg(F.collect_list("span").alias("spans")))


def _refined(cut: DataFrame, scratch: Scratch, anchors: tuple[int, ...]) -> DataFrame:
    """(fp, h, at) of segments of large names, whose strings are named anew by longer anchors.

    Equal strings lie under one name here as well, so what repeats is found among these segments. A
    segment that stands in several places repeats whole.
    """
    own = cut.withColumn("dk", F.xxhash64("fp", "h"))
    spans = _spans(own.select("dk", F.col("seg").alias("text")), scratch, anchors)
    ranges = F.flatten(F.transform("spans", lambda x: F.array(x["s"], x["e"] - (LENGTH - 1))))
    whole = F.array(F.lit(0), F.octet_length("seg") - (LENGTH - 1))
    return own.join(spans, "dk", "left").select("fp", "h", F.when(F.col("n") > 1, whole).otherwise(ranges).alias("at")).where("at is not null")


def suffix_digests(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a 200-byte string that covers it also starts anywhere else, in the same document
    or another; strings are judged on the input. Null texts are empty; rows alike in id and text
    repeat each other; rows without an id take part as any other.
    """
    spans = repeated_spans(docs, scratch)
    _sweep(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("dk"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.join(spans, "dk", "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
