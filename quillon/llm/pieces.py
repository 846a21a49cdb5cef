"""SentencePiece encoding and decoding: best-scoring segmentation by a max-plus parallel scan.

A text is encoded by the pieces with the highest sum of scores (the Viterbi rule of SentencePiece's
unigram models). Among equal scores a node is reached by the piece that starts first; scores lie on a
grid of 2^-31 of the largest, so sums over a chunk are exact and this rule gives the same ids however a text is cut. Giant texts
are cut at fixed offsets. A chunk's transfer matrix holds the best score from every way of entering
it to every way of leaving it, where a way is how far the piece that crosses the border reaches.
Max-plus products of these matrices are associative: they are combined by doubling, which gives each
chunk the scores of its ways in. From these each chunk tells, for every way out, the way in that the
rule takes; such maps are combined too, and then chunks are backtraced apart.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, lean, row_slices

#: Characters of a chunk; longer texts are giant.
CHUNK = 1 << 15
SPACE = "▁"
#: Penalty of an unknown character below the lowest score, as in SentencePiece.
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers in each of two generations (some 25 MB): what is used again moves to
#: the younger one, the older one is forgotten. Results do not depend on it.
CACHE_UNITS = 60_000
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
LOW = -np.inf


def unit_pattern(pieces) -> re.Pattern | None:
    """A pattern that splits a text where no piece can reach across, or None if spaces may end up inside pieces.

    Characters that are in no piece of several stand alone. If no piece goes on from a letter to
    something else, a unit is spaces, then signs, then letters; else spaces, then what follows.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return None
    joined = {c for p in pieces if len(p) > 1 for c in p} | {SPACE}
    letters = {c for c in joined if c.isalpha()}
    signs = joined - letters - {SPACE}
    kind = lambda cs: "".join(map(re.escape, sorted(cs)))
    if not letters or not signs or any(a in letters and b not in letters for p in pieces for a, b in zip(p, p[1:], strict=False)):
        return re.compile(f"[^{kind(joined)}]|{SPACE}*[{kind(joined - {SPACE})}]*") if joined - {SPACE} else re.compile(f"[^{SPACE}]|{SPACE}+")
    return re.compile(f"[^{kind(joined)}]|{SPACE}*[{kind(signs)}]*[{kind(letters)}]*")


@dataclass
class Pieces:
    """A vocabulary: piece -> (score, id), and what decoding needs."""

    scores: dict[str, tuple[float, int]]
    text: list[str]
    byte_of: dict[int, int]
    unknown: int
    dummy_prefix: bool
    longest: int
    unknown_score: float
    unit: re.Pattern | None
    trie: dict[str, tuple] = field(repr=False)
    plain: list[str] = field(repr=False)
    broken: np.ndarray = field(repr=False)
    cache: dict = field(default_factory=dict, repr=False)
    older: dict = field(default_factory=dict, repr=False)

    @functools.cached_property
    def byte_ids(self) -> list[int] | None:
        if len(self.byte_of) != 256:
            return None
        ids = [0] * 256
        for i, b in self.byte_of.items():
            ids[b] = i
        return ids


def build_trie(scores: dict[str, tuple[float, int]]) -> dict[str, tuple]:
    """First characters -> (next characters, score or None, id); nodes without next characters share one empty dict."""
    none: dict = {}
    reach: dict[str, set] = {"": set()}
    for p in scores:
        for k in range(1, len(p) + 1):
            reach.setdefault(p[: k - 1], set()).add(p[k - 1])
    nodes: dict[str, tuple] = {}
    for p in sorted({p[:k] for p in scores for k in range(1, len(p) + 1)}, key=len, reverse=True):
        nexts = {c: nodes.pop(p + c) for c in reach[p]} if p in reach else none
        nodes[p] = (nexts, *scores.get(p, (None, -1)))
    return nodes


@functools.lru_cache(maxsize=1)
def parse_model(model: bytes) -> Pieces:
    """Pieces of a serialised SentencePiece model. Only the identity normalizer is supported."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only the identity normalizer that keeps white space is supported")
    scores, byte_of, unknown = {}, {}, 0
    normal = [p.score for p in m.pieces if p.type == NORMAL]
    top = max(normal, default=0.0)
    grid = 2.0 ** (31 - math.ceil(math.log2(max([1.0, *map(abs, normal)]))))
    snap = lambda x: round(x * grid) / grid
    for i, p in enumerate(m.pieces):
        if p.type == NORMAL:
            scores[p.piece] = (snap(p.score), i)
        elif p.type == USER:
            scores[p.piece] = (snap(len(p.piece) * top - 0.1), i)
        elif p.type == BYTE:
            byte_of[i] = int(p.piece[3:5], 16)
        elif p.type == UNKNOWN:
            unknown = i
    text = [p.piece for p in m.pieces]
    plain = [chr(byte_of[i]) if byte_of.get(i, 128) < 128 else t.replace(SPACE, " ") for i, t in enumerate(text)]
    broken = np.array([byte_of.get(i, 0) > 127 for i in range(len(text))])
    return Pieces(scores, text, byte_of, unknown, m.normalizer_spec.add_dummy_prefix, max(map(len, scores), default=1), snap(min(normal, default=0.0) - UNKNOWN_PENALTY), unit_pattern(scores), build_trie(scores), plain, broken)


def read_model(path: str) -> bytes:
    """The model file, read once on the driver and shipped with the tasks (some hundred KB)."""
    with open(path, "rb") as f:
        return f.read()


def normalize(text: str, v: Pieces) -> str:
    return SPACE * (v.dummy_prefix and text != "") + text.replace(" ", SPACE)


def edges_from(s: str, a: int, v: Pieces):
    """(end, score, id) of every piece that starts at ``a``; an unknown character if none of length 1.

    The search ends where no piece goes on.
    """
    single, nexts, e = False, v.trie, a
    for c in s[a : a + v.longest]:
        node = nexts.get(c)
        if node is None:
            break
        nexts, w, i = node
        e += 1
        if w is not None:
            single |= e == a + 1
            yield e, w, i
    if not single:
        yield a + 1, v.unknown_score, -1


def viterbi(s: str, entries, stop: int, v: Pieces) -> tuple[list, list]:
    """Best scores of every node, over edges that start before ``stop``, and back pointers.

    ``entries``: scores of the first nodes, where paths may enter. A node keeps the edge that starts
    first among equal ones, and its entry before any edge, since what enters started before.
    """
    best, back = [LOW] * (len(s) + 1), [None] * (len(s) + 1)
    best[: len(entries)] = [float(x) for x in entries[: len(s) + 1]]
    for a in range(stop):
        at = best[a]
        if at == LOW:
            continue
        for e, w, i in edges_from(s, a, v):
            if at + w > best[e]:
                best[e], back[e] = at + w, (a, i)
    return best, back


def _unknown_ids(c: str, v: Pieces) -> list[int]:
    """The ids of a character that no piece holds: its bytes, or the unknown piece."""
    return [v.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if v.byte_ids else [v.unknown]


def _ids_back(s: str, end: int, back: list, v: Pieces) -> tuple[int, list[int]]:
    """(node where the path that ends at ``end`` enters, its ids)."""
    out, at = [], end
    while back[at] is not None:
        a, i = back[at]
        out.extend([i] if i >= 0 else _unknown_ids(s[a:at], v)[::-1])
        at = a
    return at, out[::-1]


def _unit(u: str, v: Pieces) -> bytes:
    """Ids of a unit, as little-endian 32-bit numbers; remembered, since words repeat.

    The rule of viterbi(), in one loop.
    """
    found = v.older.get(u)
    if found is not None:
        v.cache[u] = found
        return found
    n, trie, unknown = len(u), v.trie, v.unknown_score
    best, back, ids = [LOW] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for a in range(n):
        at, nexts, e, single = best[a], trie, a, False
        for c in u[a:] if a else u:
            node = nexts.get(c)
            if node is None:
                break
            nexts, w, i = node
            e += 1
            if w is not None:
                if e == a + 1:
                    single = True
                w += at
                if w > best[e]:
                    best[e], back[e], ids[e] = w, a, i
        if not single and at + unknown > best[a + 1]:
            best[a + 1], back[a + 1], ids[a + 1] = at + unknown, a, -1
    path, at = [], n
    while at:
        i = ids[at]
        if i >= 0:
            path.append(i)
        else:
            path.extend(_unknown_ids(u[back[at]], v)[::-1])
        at = back[at]
    found = array("i", path[::-1]).tobytes()
    if n < 32:
        if len(v.cache) >= CACHE_UNITS:
            v.older, v.cache = v.cache, {}
        v.cache[u] = found
    return found


def encode_whole(s: str, v: Pieces) -> np.ndarray:
    """Ids of a normalised text in one piece. Units that no piece crosses are encoded apart."""
    if v.unit is None:
        return np.array(_ids_back(s, len(s), viterbi(s, [0.0], len(s), v)[1], v)[1], np.int32)
    out = []
    get = v.cache.get
    for u in v.unit.findall(s):
        if u:
            found = get(u)
            if found is None:
                found = _unit(u, v)
                get = v.cache.get
            out.append(found)
    return np.frombuffer(b"".join(out), "<i4")


def middle(s: str, size: int, v: Pieces) -> tuple[int, int] | None:
    """First and last unit end of a chunk that every path visits and no way in lies behind, if there are any."""
    if v.unit is None or size < v.longest:
        return None
    first = last = None
    for m in v.unit.finditer(s):
        if m.end() > size:
            break
        if m.end() > m.start() and m.end() >= v.longest - 1:
            first = m.end() if first is None else first
            last = m.end()
    return None if first is None else (first, last)


def transfer(s: str, size: int, v: Pieces, cuts: tuple[int, int] | None) -> np.ndarray:
    """The matrix of a chunk: ``size`` characters of ``s``, whose rest is what pieces may reach into.

    Entry [i, j]: best score of a path from node i to node size + j whose edges start before
    ``size``. Between ``cuts``, nodes that every path visits, all ways share one best path: its ids
    are known at once, and its score, the same in every entry, is left out.
    """
    L = v.longest
    out = np.full((L, L), LOW)
    if cuts:
        c, d = cuts
        front = [LOW] * (c + 1)
        front[c] = 0.0
        for a in range(c - 1, -1, -1):
            front[a] = max((w + front[e] for e, w, _ in edges_from(s, a, v) if e <= c), default=LOW)
        back, _ = viterbi(s[d:], [0.0], size - d, v)
        tail = [back[size - d + j] if size + j <= len(s) else LOW for j in range(L)]
        return np.array(front[:L])[:, None] + np.array(tail)[None, :]
    best = np.full((len(s) + L + 1, L), LOW)
    for i in range(L):
        best[i, i] = 0.0
    for a in range(size):
        for e, w, _ in edges_from(s, a, v):
            np.maximum(best[e], best[a] + w, out=best[e])
    for j in range(L):
        out[:, j] = best[size + j] if size + j <= len(s) else LOW
    return out


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacked matrices, the associative step of the scan."""
    out = np.full(a.shape[:-1] + b.shape[-1:], LOW)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., k, None, :], out=out)
    return out


def ways_in(matrices: np.ndarray) -> np.ndarray:
    """For each chunk, the best score of every way into it: an inclusive scan of (n, L, L) matrices by doubling."""
    n, L = matrices.shape[:2]
    scan, step = matrices.copy(), 1
    while step < n:
        scan[step:] = maxplus(scan[:-step], scan[step:])
        # Only differences count; this keeps left-out scores and exact sums small.
        top = scan.max(axis=(1, 2), keepdims=True)
        scan -= np.where(np.isfinite(top), top, 0.0)
        step *= 2
    out = np.full((n, L), LOW)
    out[0, 0] = 0.0
    out[1:] = scan[:-1, 0]
    return out


def entries_of(s: str, size: int, cuts: tuple[int, int] | None, into: np.ndarray, v: Pieces) -> list[int]:
    """For every way out of a chunk, the way in of the path that the rule takes."""
    L = v.longest
    if cuts:
        return [_ids_back(s, cuts[0], viterbi(s[: cuts[0]], into, cuts[0], v)[1], v)[0]] * L
    best, back = viterbi(s, into, size, v)
    return [_ids_back(s, size + j, back, v)[0] if size + j <= len(s) and best[size + j] > LOW else 0 for j in range(L)]


def ways_out(maps: np.ndarray) -> np.ndarray:
    """The way out of each chunk: the maps (n, L) from way out to way in, combined from the text's end."""
    out = np.zeros(len(maps), np.int64)
    for k in range(len(maps) - 1, 0, -1):
        out[k - 1] = maps[k, out[k]]
    return out


def backtrace(s: str, size: int, cuts: tuple[int, int] | None, inner: np.ndarray | None, into: np.ndarray, leave: int, v: Pieces) -> list[int]:
    """Ids of a chunk, given the scores of its ways in and where its path leaves; ``inner``: the ids between its cuts."""
    end = size + leave
    if not cuts:
        return _ids_back(s, end, viterbi(s, into, size, v)[1], v)[1]
    c, d = cuts
    _, head = _ids_back(s[:c], c, viterbi(s[:c], into, c, v)[1], v)
    tail = s[d:end]
    _, rest = _ids_back(tail, len(tail), viterbi(tail, [0.0], min(len(tail), size - d), v)[1], v)
    return head + inner.tolist() + rest


def decode_ids(ids: np.ndarray, v: Pieces) -> str:
    """Text of ids: pieces joined, runs of byte pieces read as UTF-8 (broken ones as U+FFFD), prefix space dropped."""
    if not v.broken[ids].any():  # bytes of ASCII stand for themselves
        out = "".join([v.plain[i] for i in ids.tolist()])
    else:
        parts, run = [], bytearray()
        for i in ids.tolist():
            if i in v.byte_of:
                run.append(v.byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(v.plain[i])
        out = "".join(parts) + run.decode("utf-8", "replace")
    return out[1:] if v.dummy_prefix and out.startswith(" ") else out


_MATRIX = "row string, pos int, size int, front int, last int, head string, tail string, inner array<int>, matrix binary"


def _chunks(at: int, chunk: int, v_of):
    """Giant texts as chunks, with the reach of a piece behind each."""

    def run(batches):
        v = v_of()
        for batch in batches:
            texts = batch.column(at)
            for i in range(batch.num_rows):
                s = normalize(texts[i].as_py() or "", v)
                starts = range(0, max(1, len(s)), chunk)
                for lo in range(0, len(starts), 64):
                    part = starts[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(part)), pa.array(range(lo, lo + len(part)), pa.int32()), pa.array([min(chunk, len(s) - a) for a in part], pa.int32()), pa.array([s[a : a + chunk + v.longest - 1] for a in part], pa.string())], names=["row", "pos", "size", "part"])

    return run


def _matrices(model: bytes):
    """Chunks with their matrix, and what is left to trace: all of the text, or what lies before and behind the cuts."""

    def run(batches):
        v = parse_model(model)
        for batch in batches:
            for row, pos, size, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                cuts = middle(s, size, v)
                c, d = cuts or (-1, -1)
                inner = encode_whole(s[c:d], v) if cuts else None
                made = [row], [pos], [size], [c], [d], [s[:c] if cuts else s], [s[d:] if cuts else ""], [inner], [transfer(s, size, v, cuts).astype("<f8").tobytes()]
                kinds = pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=_MATRIX.replace(",", "").split()[::2])

    return run


def _scan(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    flat = np.stack([np.frombuffer(m, "<f8") for m in table.column("matrix").to_pylist()])
    n = int(round(flat.shape[1] ** 0.5))
    into = ways_in(flat.reshape(-1, n, n))
    return pa.table({"row": table.column("row"), "pos": table.column("pos"), "into": pa.array([x.astype("<f8").tobytes() for x in into], pa.binary())})


def _leave(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    out = ways_out(np.array(table.column("ways").to_pylist(), np.int64))
    return pa.table({"row": table.column("row"), "pos": table.column("pos"), "leave": pa.array(out, pa.int32())})


def _cuts_of(front: int, last: int) -> tuple[int, int] | None:
    return (front, last) if front >= 0 else None


def _entries(model: bytes):
    def run(batches):
        v = parse_model(model)
        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = [entries_of(head, size, _cuts_of(front, last), np.frombuffer(into, "<f8"), v) for _, _, size, front, last, head, into in zip(*c, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["row", "pos", "ways"])

    return run


def _trace(model: bytes):
    def run(batches):
        v = parse_model(model)
        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = []
            for _, _, size, front, last, head, tail, inner, into, leave in zip(*c, strict=True):
                cuts = _cuts_of(front, last)
                # Cut chunks hold no middle text: its place is kept, so that nodes have their numbers.
                s = head + "\0" * (last - front) + tail if cuts else head
                out.append(np.asarray(backtrace(s, size, cuts, None if inner is None else np.asarray(inner, np.int32), np.frombuffer(into, "<f8"), leave, v), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["row", "pos", "ids"])

    return run


def encode(docs: DataFrame, model: bytes, scratch: Scratch, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, finish=None) -> DataFrame:
    """``docs`` with its columns and ``ids``, an array of piece ids (replaced if there is one already).

    ``finish``: (function, schema) over the encoded batches, whose last column is ids; run where they
    were encoded, so that ids need not pass through the JVM. The result is then the function's.

    Rows within one chunk are encoded where they are, without a shuffle. Only giant texts are cut;
    their chunks are scored on any executor, scanned a text at a time (2 KB a chunk), backtraced on
    any executor and joined to their rows by content. Ids do not depend on ``chunk``. Null and empty
    texts have no ids.
    """
    names = [n for n in docs.columns if n != ids_col]
    inner = [f"__c{i}" for i in range(len(names))]
    rows = docs.select(*[F.col("`" + n.replace("`", "``") + "`").alias(c) for n, c in zip(names, inner, strict=True)])
    text = inner[names.index(text_col)]
    giant = F.length(F.col(text).cast("string")) >= chunk
    small = rows.where(~F.coalesce(giant, F.lit(False)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in small.schema.fields)
    at = inner.index(text)

    def whole(batches):
        v = parse_model(model)
        for batch in batches:
            texts = batch.column(at)
            for lo, hi in row_slices([len(x.as_buffer() or b"") if x.is_valid else 0 for x in texts], 2 << 20):
                ids = [encode_whole(normalize(str(t.as_py() or ""), v), v) for t in texts.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)), pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "__ids"])
        v.cache, v.older = {}, {}  # what a task remembers goes with it

    done = small.mapInArrow(lean(whole), f"{fields}, __ids array<int>") if finish is None else small.mapInArrow(lean(lambda batches: finish[0](whole(batches))), finish[1])
    # Giant rows are named by their content, so that a task run again names them alike; rows alike share their ids.
    large = rows.where(giant).withColumn("__row", F.sha2(F.col(text).cast("string"), 256))
    texts = large.select("__row", F.col(text).cast("string").alias("t")).groupBy("__row").agg(F.first("t").alias("t"))
    cut = texts.mapInArrow(_chunks(1, max(chunk - 1, 1), lambda: parse_model(model)), "row string, pos int, size int, part string").repartition("row", "pos")
    chunks = scratch.save(cut.mapInArrow(lean(_matrices(model)), _MATRIX))
    into = scratch.save(chunks.select("row", "pos", "matrix").groupBy("row").applyInArrow(_scan, "row string, pos int, into binary"))
    told = chunks.join(into, ["row", "pos"])
    maps = told.select("row", "pos", "size", "front", "last", "head", "into").mapInArrow(_entries(model), "row string, pos int, ways array<int>")
    ways = maps.groupBy("row").applyInArrow(_leave, "row string, pos int, leave int")
    traced = told.join(ways, ["row", "pos"]).select("row", "pos", "size", "front", "last", "head", "tail", "inner", "into", "leave").mapInArrow(_trace(model), "row string, pos int, ids array<int>")
    joined = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("__ids"))
    big = large.join(joined, large["__row"] == joined["row"]).select(*inner, "__ids")
    if finish is not None:
        return done.unionByName(big.mapInArrow(*finish))
    return done.unionByName(big).select(*[F.col(c).alias(n) for c, n in zip(inner, names, strict=True)], F.col("__ids").alias(ids_col))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded``, the text of its ids; null ids give null."""
    kinds = ", ".join(f"__d{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields))
    at = rows.columns.index(ids_col)

    def run(batches):
        v = parse_model(model)
        for batch in batches:
            texts = [None if x is None else decode_ids(np.array(x, np.int64), v) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "__text"])

    out = rows.toDF(*[f"__d{i}" for i in range(len(rows.columns))]).mapInArrow(run, f"{kinds}, __text string")
    return out.select(*[F.col(f"__d{i}").alias(n) for i, n in enumerate(rows.columns) if n != out_col], F.col("__text").alias(out_col))


def piece_digests(docs: DataFrame, model: bytes, scratch: Scratch) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip): digest of little-endian 32-bit ids; does decoding give the text back?

    It does not where a text holds U+2581, which a vocabulary reads as a space.
    """

    def run(batches):
        import hashlib

        v = parse_model(model)
        for batch in batches:
            flat = np.asarray(batch.column(2).values.to_numpy(zero_copy_only=False), "<i4")
            cuts = batch.column(2).offsets.to_numpy()
            for lo in range(0, batch.num_rows, 512):
                each = [flat[a:b] for a, b in zip(cuts[lo : lo + 512].tolist(), cuts[lo + 1 : lo + 513].tolist(), strict=False)]
                texts = [t or "" for t in batch.column(1).slice(lo, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), pa.array([len(x) for x in each], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in each]), pa.array([decode_ids(x, v) == t for x, t in zip(each, texts, strict=True)])], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return encode(docs.select("doc_id", "text"), model, scratch, finish=(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean"))
