"""MinHash near-dedup: universal hash minima, banding, signature and full-set verification, star components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import Labels, deal_to_pairs, groups
from quillon.llm.common import Scratch, keyed, lean, row_slices
from quillon.llm.components import connected_components

SHINGLE = 5
#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: 40 bands of 5 minima. Two sets of similarity 0.75 share no band with probability 2e-5.
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Pairs with fewer equal minima are not verified; 0.75 gives 150 on average, with deviation 6.1.
SCREEN = 122
#: Members of a chunk of a band's bucket, and bytes of a chunk of sets.
BUCKET_CHUNK, SET_CHUNK = 256, 2 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(0, 2**62)) * 4 + 3)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)[:, None]
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)[:, None]
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _rng.integers(0, 2**64, BANDS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LIMIT = 1 << 16
_UP, _DOWN = _powers(_BASE, _LIMIT), _powers(_BASE_INVERSE, _LIMIT)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of UTF-8 bytes; A-Z lower-cased, ASCII white space between words."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _IS_SPACE[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    out = np.empty(len(starts), np.uint64)
    at = 0
    values = _BYTE[_LOWER[data]]
    while at < len(starts):  # windows of at most _LIMIT bytes, cut between words
        lo = starts[at]
        to = int(np.searchsorted(ends, lo + _LIMIT, "right"))
        if to <= at:  # a word longer than a window
            out[at] = np.uint64(xxhash.xxh64_intdigest(_LOWER[data[lo : ends[at]]].tobytes()))
            at += 1
            continue
        hi = ends[to - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[lo:hi] * _UP[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = _mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
        at = to
    return out, starts


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    if n < SHINGLE:
        return _mix((words * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        total = total + words[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(_mix(total + np.uint64(SHINGLE)))


def text_set(text: bytes | None) -> np.ndarray:
    return shingle_set(word_hashes(np.frombuffer(text or b"", np.uint8))[0])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set: (a * x + b mod 2^64) >> 32 of 32-bit x, a universal family.

    The shift keeps the order, so it is done once, behind the minimum.
    """
    x = shingles >> np.uint64(32)
    out, room = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64), np.empty((HASHES, min(len(x), 512)), np.uint64)
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        now = np.multiply(_A, part, out=room[:, : len(part)])
        now += _B
        np.minimum(out, now.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signature(low: np.ndarray) -> np.ndarray:
    """A byte of each minimum that depends on all of its bits."""
    return (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, of its minima and its number."""
    return _mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1, dtype=np.uint64) + _BAND_SALT)


def _split(batch, column: int):
    """Slices of a batch with the word hashes of each of their texts, hashed together."""
    texts = batch.column(column).cast(pa.large_binary())
    raw = texts.to_pylist()
    for lo, hi in row_slices([len(t or b"") for t in raw], 1 << 20):
        joined = b" ".join(t or b"" for t in raw[lo:hi])
        hashes, starts = word_hashes(np.frombuffer(joined, np.uint8))
        ends = np.cumsum([len(t or b"") + 1 for t in raw[lo:hi]])
        yield lo, hi, np.split(hashes, np.searchsorted(starts, ends[:-1]))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sign(batches):
    for batch in batches:
        for lo, hi, words in _split(batch, 2):
            n, keys, bands, sigs = [], [], [], []
            for w in words:
                s = shingle_set(w)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    low = minima(s)
                    bands.append(band_keys(low).view(np.int64))
                    sigs.append(signature(low).tobytes())
                else:
                    bands.append(None), sigs.append(None)
            key = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=_SIGNED)


def equal_minima(sigs: np.ndarray, i: int, start: int, stop: int) -> np.ndarray:
    return (sigs[start:stop] == sigs[i]).sum(1)


def _screen(batches):
    """Links of equal signatures in a bucket's chunk pair: a spanning forest of the pairs that pass the screen."""
    a, b = [], []
    for t in groups(batches, (0, 1, 2)):
        c, node = t.column(3).to_numpy(), t.column(4).to_numpy()
        sigs = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(len(node), HASHES)
        apart = int(np.searchsorted(c, c[-1])) if c[0] != c[-1] else 0
        labels = Labels(len(node))
        for i in range(apart or len(node) - 1):
            start = apart or i + 1
            hits = start + np.flatnonzero(equal_minima(sigs, i, start, len(node)) >= SCREEN)
            for k in hits[labels.of[hits] != labels.of[i]]:
                if labels.merge(i, int(k)):
                    a.append(node[i]), b.append(node[k])
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if not small or 100 * small < THRESHOLD * large:
        return False
    both = overlap(x, y)
    return 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def spanning_links(sets: list[np.ndarray], apart: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``apart``, of those across that position.

    Pairs are taken by falling signature agreement, so most are known to be connected before their
    turn and are skipped; every other pair that passes the screen is confirmed on the full sets.
    """
    sigs = np.stack([signature(minima(s)) for s in sets])
    sizes, n = np.array([len(s) for s in sets]), len(sets)
    left, right, score = [], [], []
    for i in range(apart or n - 1):
        start = apart or i + 1
        same = equal_minima(sigs, i, start, n)
        other = sizes[start:]
        hits = np.flatnonzero((same >= SCREEN) & (100 * np.minimum(other, sizes[i]) >= THRESHOLD * np.maximum(other, sizes[i])))
        left.append(np.full(len(hits), i)), right.append(hits + start), score.append(same[hits])
    if not left:
        return []
    left, right, score = np.concatenate(left), np.concatenate(right), np.concatenate(score)
    labels, out = Labels(n), []
    for level in np.unique(score)[::-1]:
        at = np.flatnonzero(score == level)
        at = at[labels.of[left[at]] != labels.of[right[at]]]
        for i, k in zip(left[at].tolist(), right[at].tolist(), strict=True):
            if labels.of[i] != labels.of[k] and linked(sets[i], sets[k]):
                labels.merge(i, k)
                out.append((i, k))
    return out


def _verify(batches):
    a, b = [], []
    for t in groups(batches, (0, 1, 2)):
        c, node = t.column(3).to_numpy(), t.column(4).to_numpy()
        if len(node) > 1:
            sets = [np.frombuffer(x, np.uint64) for x in t.column(5).to_pylist()]
            for i, k in spanning_links(sets, int(np.searchsorted(c, c[-1])) if c[0] != c[-1] else 0):
                a.append(node[i]), b.append(node[k])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(batches):
    for batch in batches:
        for lo, hi, words in _split(batch, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array([shingle_set(w).tobytes() for w in words], pa.binary())], names=["cluster", "node", "chunks", "shingles"])


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``: see ``near_duplicate_rows``."""
    return near_duplicate_rows(docs, scratch, id_col, text_col).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicate_rows(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, stays) of every row of ``docs``.

    1. Each text gives its distinct 5-word shingles, their 200 minima and 40 band keys. Equal sets
       become one class, held by its smallest (doc_id, tkey), so groups of copies shrink before
       anything else (pre-aggregated on the map side).
    2. Classes meet in the buckets of their bands. Buckets with the same members are looked at
       once. A bucket's signatures are compared in pairs of chunks of 256, which give a spanning
       forest of the pairs that agree in at least 122 minima: links grow with members, not pairs.
    3. Star components of these give clusters. Only clustered texts are read again; their full sets
       are compared exactly in chunk pairs, which give a spanning forest of confirmed links.
    4. Star components of confirmed links, by alternating large-star and small-star, are the result.

    Every pair that shares a band and passes the screen is either confirmed on full sets or already
    connected through confirmed links, so the components equal those of all such links. Null and
    empty texts have no shingles and link with nothing. Rows without doc_id take no part: their
    component_id is null and they are kept. Rows that share a doc_id are documents of their own,
    linked by their texts only; ``component_id`` is the smallest doc_id of the linked rows.

    ``tkey`` is the hash of the text that tells rows of one doc_id apart. ``stays`` marks the rows
    of one (doc_id, tkey) of each component, the smallest; rows that link with nothing stay.
    """
    rows = keyed(docs, id_col, text_col).select("doc_id", "tkey", "text")
    signed = scratch.save(rows.mapInArrow(lean(_sign), "doc_id long, tkey long, n long, k1 long, k2 long, bands array<long>, sig binary"))
    known = signed.where("doc_id is not null and n > 0")
    classes = known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tkey")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()))  # a number of its own, fixed once written
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("node")
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(7))).alias("y")).where("m > 1")
    buckets = scratch.save(buckets.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "m"))
    members = spread.join(buckets, "bucket").join(classes.select("node", "sig"), "node")
    dealt = deal_to_pairs(members, "bucket", F.col("node"), F.ceil(F.col("m") / BUCKET_CHUNK)).select("bucket", "i", "j", "c", "node", "sig")
    alike = scratch.save(dealt.mapInArrow(_screen, "a long, b long"))
    clusters = scratch.save(connected_components(alike, scratch).withColumnRenamed("component", "cluster"))
    weights = clusters.join(classes.select("node", "n"), "node").groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8 + 64) / SET_CHUNK).alias("chunks"))
    # The text of one row of each class only; its other rows hold the same set.
    wanted = clusters.join(weights, "cluster").join(classes.select("node", "one.*"), "node")
    texts = rows.join(wanted, ["doc_id", "tkey"]).select("cluster", "node", "text", "chunks").dropDuplicates(["node"])
    sets = texts.mapInArrow(lean(_sets), "cluster long, node long, chunks long, shingles binary")
    pairs = deal_to_pairs(sets, "cluster", F.col("node"), F.col("chunks")).select("cluster", "i", "j", "c", "node", "shingles")
    links = scratch.save(pairs.mapInArrow(lean(_verify), "a long, b long"))
    found = connected_components(links, scratch)
    first = found.join(classes.select("node", "one"), "node").groupBy("component").agg(F.min("one").alias("first"))
    ids = classes.select("k1", "k2", "node", "one").join(found.join(first, "component").select("node", "first"), "node", "left").select("k1", "k2", F.coalesce("first", "one").alias("first"))
    linked = signed.where("doc_id is not null and n > 0").select("doc_id", "tkey", "n", "k1", "k2").join(ids, ["k1", "k2"])
    linked = linked.select("doc_id", "tkey", "n", F.col("first.doc_id").alias("component_id"), ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey"))).alias("stays"))
    alone = signed.where("doc_id is null or n = 0").select("doc_id", "tkey", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionAll(alone).withColumnRenamed("n", "n_shingles")
