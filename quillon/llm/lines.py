"""Line dedup: range-partitioned line hashes, streamed in order, answered as keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, Scratch, keyed, lean, row_slices

#: Keys shorter than this many code points never lose a line.
MIN_KEY = 10

_LINES = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _hash_lines(batches, min_key: int):
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        texts = batch.column(2).cast(pa.large_binary())
        for lo, hi in row_slices([len(x.as_buffer() or b"") if x.is_valid else 0 for x in texts]):
            docs, tkeys, places, totals, halves = [], [], [], [], []
            for i in range(lo, hi):
                lines = (texts[i].as_py() or b"").split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip(SPACE).lower()
                    if len(key) < min_key or len(key) < 4 * min_key and len(key.decode("utf-8", "replace")) < min_key:
                        continue
                    halves.append(xxhash.xxh3_128_digest(key))
                    docs.append(i)
                    places.append(pos)
                    totals.append(len(lines))
            if not docs:
                continue
            pair = np.frombuffer(b"".join(halves), dtype="<i8").reshape(-1, 2)
            at = pa.array(docs, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(places, pa.int32()), pa.array(totals, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=_LINES)


_EVENTS = pa.schema([("kind", pa.int32()), *_LINES])
_DROP, _EDGE, _TAIL = 0, 1, 2


def _stream_first(batches):
    """Rows of one range, sorted by key, document and position, in one pass with constant state.

    Rows of the range's first key may continue the range before, so they leave as _EDGE rows; the
    last key's smallest document leaves as one _TAIL row; every other decision is final here.
    """
    first_key = last = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        doc, _, _, _, h1, h2 = cols
        if not len(doc):
            continue
        if first_key is None:
            first_key = (h1[0], h2[0])
            last = (h1[0], h2[0], doc[0])
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != last[:2]
        group = np.cumsum(new) - (1 if new[0] else 0)
        heads = np.flatnonzero(new)
        owner = np.concatenate(([] if new[0] else [last[2]], doc[heads])).astype(np.int64)
        mine = owner[group]
        edge = (h1 == first_key[0]) & (h2 == first_key[1])
        kind = np.where(edge, _EDGE, np.where(doc != mine, _DROP, -1)).astype(np.int32)
        last = (h1[-1], h2[-1], mine[-1])
        keep = np.flatnonzero(kind >= 0)
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep]), *(pa.array(c[keep]) for c in cols)], schema=_EVENTS)
    if first_key is not None and last[:2] != first_key:
        yield pa.RecordBatch.from_arrays([pa.array([_TAIL], pa.int32()), pa.array([last[2]], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], schema=_EVENTS)


def _pack(batches):
    for batch in batches:
        bitmaps = []
        for total, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            bits = np.ones(total, np.uint8)
            bits[np.asarray(gone, np.int64)] = 0
            bitmaps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(set(g)) for g in batch.column(3).to_pylist()], pa.int32()), pa.array(bitmaps, pa.binary())], names=["doc_id", "tkey", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, tkey, n_lines, n_dropped, keep_bitmap) of every document that loses a line.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least
    ``min_key`` code points that two documents hold keep their lines only in the smallest doc_id
    (all of them there). Only 128-bit key hashes are shuffled, never text. The range partitioning
    is by (hash, document), so a key with a third of all lines spreads over many ranges; ranges
    that share a key are reconciled by one small row each.

    Rows without a doc_id take no part and lose nothing; a null or empty text is one empty line;
    rows that repeat a doc_id count as one document. ``keep_bitmap`` is zlib over one bit a line,
    first line in the highest bit, 1 for a line that stays.
    """
    rows = keyed(docs, id_col, text_col).where("doc_id is not null").select("doc_id", "tkey", "text")
    hashed = scratch.save(rows.mapInArrow(lean(lambda it, m=min_key: _hash_lines(it, m)), "doc_id long, tkey long, pos int, n_lines int, h1 long, h2 long"))
    ordered = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    events = scratch.save(ordered.mapInArrow(_stream_first, "kind int, doc_id long, tkey long, pos int, n_lines int, h1 long, h2 long"))
    scratch.free(hashed)
    edge = events.where(F.col("kind") == _EDGE)
    owners = events.where(F.col("kind") != _DROP).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
    # Two rows a range at most, so the owners are small whatever the input; the hot key's rows stay where they are.
    late = edge.join(F.broadcast(owners), ["h1", "h2"]).where("doc_id <> owner").select("doc_id", "tkey", "n_lines", "pos")
    gone = events.where(F.col("kind") == _DROP).select("doc_id", "tkey", "n_lines", "pos").unionAll(late)
    lists = gone.groupBy("doc_id", "tkey", "n_lines").agg(F.collect_list("pos").alias("gone"))
    return lists.mapInArrow(_pack, "doc_id long, tkey long, n_lines int, n_dropped int, keep_bitmap binary")


def _kept(text: bytes | None, bitmap: bytes | None) -> tuple[bytes, int]:
    text = text or b""
    if bitmap is None:
        return text, text.count(b"\n") + 1
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return b"\n".join([x for x, b in zip(lines, bits, strict=True) if b]), len(lines)


def _digests(batches):
    for batch in batches:
        out = [(n, g or 0, hashlib.sha256(k).hexdigest()) for (k, n), g in ((_kept(t, b), g) for t, b, g in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _texts(batches):
    for batch in batches:
        names = batch.schema.names
        text, bitmap = batch.column(names.index("__text")).cast(pa.large_binary()).to_pylist(), batch.column(names.index("__bitmap")).to_pylist()
        kept = [t if b is None else _kept(t, b)[0] for t, b in zip(text, bitmap, strict=True)]
        out = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([out if n == "__text" else batch.column(i) for i, n in enumerate(names) if n != "__bitmap"], names=[n for n in names if n != "__bitmap"])


def with_bitmaps(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    maps = keep_bitmaps(docs, scratch, id_col, text_col, min_key)
    return keyed(docs, id_col, text_col).join(maps.drop("n_lines"), ["doc_id", "tkey"], "left")


def line_digests(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row, from the keep bitmaps."""
    rows = with_bitmaps(docs, scratch).select("doc_id", "text", "keep_bitmap", "n_dropped")
    return rows.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with its other columns as they are and every text cut down to its kept lines.

    A null text stays null. The bitmap is joined to the rows by document and applied where the
    text is; rows without a bitmap pass unchanged.
    """
    maps = keep_bitmaps(docs, scratch, id_col, text_col, min_key)
    maps = maps.select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"), F.col("keep_bitmap").alias("__bitmap"))
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    at, text = inner[names.index(id_col)], inner[names.index(text_col)]
    rows = rows.join(maps, (rows[at].cast("long") == maps["__id"]) & (F.xxhash64(rows[text].cast("string")) == maps["__tkey"]), "left").drop("__id", "__tkey").withColumn(text, F.col(text).cast("string")).withColumnRenamed(text, "__text")
    kinds = rows.drop("__bitmap").schema
    return rows.mapInArrow(_texts, kinds).select(*[F.col("__text" if c == text else c).alias(n) for c, n in zip(inner, names, strict=True)])
