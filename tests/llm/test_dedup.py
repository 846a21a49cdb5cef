import random

import numpy as np
import pytest
from tests.llm import brute

from quillon.llm import epsilon, lines, minhash, suffixes, topk
from quillon.llm.common import Scratch
from quillon.llm.components import connected_components

DOC = "doc_id long, text string, extra string, n_lines long, component_id long, dk long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOC)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [words(rng, rng.randint(30, 200)) for _ in range(12)]
    docs = [edited(rng, rng.choice(base), rng.randint(0, 9)) for _ in range(90)]
    docs += base[:3] * 2 + ["", None, "   \n ", "one", "one two", "One TWO", "same line here\nsame line here\nother line here", "  SAME line here \nshort\nshort"]
    docs += [base[0] + "\n" + base[1], base[1] + "\n" + base[0] + "\n\n", "é" * 9, "É" * 10 + "\n" + "é" * 10, "a" * 5000, "ab " * 2000]
    return list(enumerate(docs))


def test_minhash_equals_all_pairs(spark, corpus):
    got = minhash.near_duplicates(frame(spark, corpus), Scratch(spark, "t")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(corpus)


def test_minhash_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")]
    got = sorted(minhash.near_duplicates(frame(spark, rows), Scratch(spark, "t")).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None] == [(3, 3, True), (3, 3, True), (9, 3, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash.near_duplicates(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_minhash_chunk_pairs(spark, corpus, monkeypatch):
    """Groups that are dealt to many chunk pairs give the same components."""
    monkeypatch.setattr(minhash, "BUCKET_CHUNK", 3)
    monkeypatch.setattr(minhash, "SET_CHUNK", 4000)
    got = minhash.near_duplicates(frame(spark, corpus), Scratch(spark, "t")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(corpus)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**64, 100, dtype=np.uint64)))
    same = (minhash.minima(np.unique(a)) == minhash.minima(np.unique(b))).mean()
    assert abs(same - 0.6) < 0.15


def test_word_hashes_long_words_and_windows():
    text = ("x" * 70_000 + " " + "abc def " * 20_000).encode()
    h, starts = minhash.word_hashes(np.frombuffer(text, np.uint8))
    assert len(h) == 40_001 and len(set(h.tolist())) == 3 and starts[1] == 70_001


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (None, 3)] + [(300 + i, 301 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    real = {(a, b) for a, b in edges if a is not None and a != b}
    want = brute.components({x for e in real for x in e}, lambda a, b: (a, b) in real or (b, a) in real)
    assert got == want


def test_line_dedup(spark, corpus):
    got = [tuple(r) for r in lines.line_digests(frame(spark, corpus), Scratch(spark, "t")).collect()]
    assert sorted(got) == sorted(brute.lines(corpus))
    kept = lines.dedup_lines(frame(spark, corpus), Scratch(spark, "t"))
    assert kept.columns == [f.split(" ")[0] for f in DOC.split(", ")] and kept.count() == len(corpus)


def test_line_dedup_odd_rows(spark):
    line = "a line that is long enough"
    rows = [(None, line), (7, line), (7, line), (2, line + "\nmore"), (2, line)]
    got = sorted(((r.doc_id, r.n_dropped) for r in lines.line_digests(frame(spark, rows), Scratch(spark, "t")).collect()), key=str)
    assert got == [(2, 0), (2, 0), (7, 1), (7, 1), (None, 0)]
    assert lines.line_digests(frame(spark, []), Scratch(spark, "t")).count() == 0
    assert lines.dedup_lines(frame(spark, [(1, None)]), Scratch(spark, "t")).first().text is None


def test_line_dedup_hot_key_over_ranges(spark):
    """A line in every document is split over ranges and still owned once."""
    docs = [(i, f"the same line everywhere\nline number {i} of this text") for i in range(400)]
    got = lines.line_digests(frame(spark, docs).repartition(8), Scratch(spark, "t"))
    assert [r.n_dropped for r in got.orderBy("doc_id").collect()] == [0] + [1] * 399


def test_suffix_dedup(spark):
    rng = random.Random(3)
    p = [words(rng, 60) for _ in range(4)]
    docs = [words(rng, 20) + " " + rng.choice(p)[rng.randrange(40) :] + " " + words(rng, 15) for _ in range(25)] + [p[0], p[0], "é" * 300, "x" + "é" * 150, "ab" * 400, None, "", "short", words(rng, 50)]
    docs = list(enumerate(docs))
    got = [tuple(r) for r in suffixes.suffix_digests(frame(spark, docs), Scratch(spark, "t")).collect()]
    assert sorted(got) == sorted(brute.suffixes(docs))
    assert suffixes.suffix_digests(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_suffix_dedup_repeated_rows_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    monkeypatch.setattr(suffixes, "CHUNK", 900)
    rng = random.Random(8)
    long = words(rng, 900)
    docs = [(1, long), (2, words(rng, 30) + long[1500:2900]), (4, words(rng, 80)), (4, words(rng, 80))]
    got = [tuple(r) for r in suffixes.suffix_digests(frame(spark, docs), Scratch(spark, "t")).collect()]
    assert sorted(got) == sorted(brute.suffixes(docs))
    same = suffixes.suffix_digests(frame(spark, [(5, long), (5, long), (None, long[:300])]), Scratch(spark, "t")).collect()
    assert {(r.n_bytes, r.n_removed) for r in same} == {(len(long), len(long)), (300, 300)}


def test_suffix_dedup_pairs_of_one_name_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 900)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, twice = word(120), word(230)
    docs = [(i, word(rng.randint(150, 220)) + passage + word(rng.randint(150, 220))) for i in range(40)] + [(40, word(90) + twice), (41, twice + word(70))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [tuple(r) for r in suffixes.suffix_digests(frame(spark, docs), Scratch(spark, "t")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == sorted(brute.suffixes(docs)) and sum(r[2] > 0 for r in got) == 2


@pytest.mark.parametrize("common", [120, 180, 199, 260])
def test_suffix_dedup_refines_large_names(spark, monkeypatch, common):
    """A passage in many different surroundings, copies among them: names are refined to longer anchors, at last to whole strings."""
    monkeypatch.setattr(suffixes, "CHUNK", 900)
    made = []
    refined = suffixes._refined
    monkeypatch.setattr(suffixes, "_refined", lambda cut, scratch, anchors: made.append(anchors) or refined(cut, scratch, anchors))
    rng = random.Random(common)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(n))
    passage = word(common)
    docs = [word(rng.randint(150, 220)) + passage + word(rng.randint(150, 220)) for _ in range(30)]
    docs += [docs[0][100:], docs[1][:-90], docs[2], docs[2], passage * 3, None, ""]
    docs = list(enumerate(docs))
    got = [tuple(r) for r in suffixes.suffix_digests(frame(spark, docs), Scratch(spark, "t")).collect()]
    assert sorted(got) == sorted(brute.suffixes(docs))
    assert made and made[0] == (128, 200) and (common < 128 or made[-1] == (200,))


@pytest.mark.parametrize("anchor", [64, 100, 128, 200])
def test_anchor_hashes_depend_on_the_anchor_alone(anchor):
    rng = np.random.default_rng(anchor)
    one = rng.integers(97, 123, anchor).astype(np.uint8)
    other = one.copy()
    other[rng.integers(anchor)] ^= 1
    front, back = (rng.integers(97, 123, 30).astype(np.uint8) for _ in range(2))
    at = lambda x: suffixes.anchor_hashes(np.concatenate((front, x, back)), anchor)
    assert len(at(one)) == 61 and at(one)[30] == suffixes.anchor_hashes(one, anchor)[0] != at(other)[30]


@pytest.mark.parametrize("length", [5, 9, 20, 40])
def test_interval_expansion(length):
    rng = np.random.default_rng(length)
    for _ in range(20):
        segs = [bytes(rng.integers(97, 99, rng.integers(length, 90)).astype(np.uint8)) for _ in range(6)]
        segs.append(segs[0][2:-1] if len(segs[0]) > length + 3 else segs[0])
        got = suffixes.repeated_starts(segs, np.ones(len(segs)), length)
        seen = [s[i : i + length] for s in segs for i in range(len(s) - length + 1)]
        for s, g in zip(segs, got):
            assert g.tolist() == [seen.count(s[i : i + length]) > 1 for i in range(len(s) - length + 1)]


def vectors(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(8, d))
    out = [(int(i), (base[i % 8] + rng.normal(size=d) * rng.choice([0.02, 0.2, 1.0])).tolist()) for i in range(n)]
    out += [(n + i, out[i][1]) for i in range(5)] + [(n + 5, None), (n + 6, [0.0] * d), (n + 7, [1.0, None] + [0.0] * (d - 2)), (n + 8, [float("nan")] * d), (n + 9, [float("inf")] + [0.0] * (d - 1)), (n + 10, []), (n + 11, [1.0, 2.0])]
    return out


VEC = "vec_id long, embedding array<double>, label int, rank int"


def test_embedding_near_dedup(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], VEC)
    got = {r.vec_id: (r.n_links, r.component_id) for r in epsilon.near_vectors(df, Scratch(spark, "t")).collect()}
    assert got == brute.near_vectors(rows)
    for name, value in {"BLOCK": 17, "LEAF": 8, "GROUP_LEAST": 20, "GROUP_MOST": 40, "FAN": 2}.items():
        monkeypatch.setattr(epsilon, name, value)
    got = {r.vec_id: (r.n_links, r.component_id) for r in epsilon.near_vectors(df, Scratch(spark, "t")).collect()}
    assert got == brute.near_vectors(rows)


def test_embedding_near_dedup_empty(spark):
    assert epsilon.near_vectors(spark.createDataFrame([], VEC), Scratch(spark, "t")).count() == 0
    odd = epsilon.near_vectors(spark.createDataFrame([(None, [1.0], 0, 0), (1, None, 0, 0)], VEC), Scratch(spark, "t")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in odd) == [("1", 0, True), ("None", 0, True)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_near_dedup_norms_and_repeats(spark, kind):
    """Tiny and huge vectors are compared by direction; rows of one id are linked by their vectors only."""
    small, large = (1e-40, 1e37) if kind == "float" else (1e-200, 1e200)
    rows = [(9, [small] * 4), (2, [1.0, 1.0, 1.0, 1.01]), (5, [large] * 4), (7, [1.0, -1.0, 0.0, 0.0]), (7, [1.0, 1.0, 1.0, 1.0]), (8, [-1.0] * 4), (3, [small, 0.0, 0.0, large])]
    out = epsilon.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), Scratch(spark, "t")).collect()
    assert sorted(tuple(r) for r in out) == [(2, 3, 2, True), (3, 0, 3, True), (5, 3, 2, False), (7, 0, 7, True), (7, 3, 2, False), (8, 0, 8, True), (9, 3, 2, False)]


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_interval_pairs_lose_none(spark, monkeypatch, fan):
    monkeypatch.setattr(epsilon, "FAN", fan)
    rng = np.random.default_rng(2)
    x = np.sort(rng.normal(size=(23, 3)), axis=0)
    low, high = x - 0.05, x + 0.05
    boxes = spark.createDataFrame([(g, *map(float, low[g]), *map(float, high[g])) for g in range(23)], "g long, " + ", ".join(f"{c}{k} double" for c in "lh" for k in range(3)))
    got = sorted(tuple(r) for r in epsilon.interval_pairs(boxes, 23, 3, 0.09, Scratch(spark, "t")).collect())
    assert got == [(i, j) for i in range(23) for j in range(i, 23) if epsilon.gap(low[i], high[i], low[j], high[j]) <= 0.09]


def test_top_k(spark, monkeypatch):
    rows = [(i, v) for i, v in vectors(1, 300) if v is None or len(v) in (0, 16)] + [(1000 + i, [0.5] * 16) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows] + [(None, [1.0] * 16, 0, 0)], VEC)
    want = brute.top_k(rows)
    assert [tuple(r) for r in topk.top_k(df, "id % 100 = 0", Scratch(spark, "t")).orderBy("query_id", "rank").collect()] == want
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "GROUP", 60)
    assert [tuple(r) for r in topk.top_k(df, "id % 100 = 0", Scratch(spark, "t")).orderBy("query_id", "rank").collect()] == want
    assert topk.top_k(df.limit(0), "id % 100 = 0", Scratch(spark, "t")).count() == 0
    monkeypatch.setattr(topk, "GROUP", 2)  # several groups of queries
    assert [tuple(r) for r in topk.top_k(df, "id % 100 = 0", Scratch(spark, "t")).orderBy("query_id", "rank").collect()] == want
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(100, [1e16], 0, 0)], VEC), "id % 100 = 0", Scratch(spark, "t"))


def test_minhash_rows_that_share_an_id(spark):
    """Rows of one id are documents of their own; of rows alike in id and text one stays."""
    a, b = "one two three four five six seven", "red green blue black white grey pink"
    df = spark.createDataFrame([(5, a), (3, b), (5, b), (5, b), (3, b), (7, ""), (7, None), (None, a)], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df, Scratch(spark, "t")).collect() if r.doc_id is not None)
    assert got == [(3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (5, 3, 5, True), (7, 0, 7, True), (7, 0, 7, True)]
    stay = [(r.doc_id, r.component_id) for r in minhash.near_duplicate_rows(df, Scratch(spark, "t")).where("stays and n_shingles > 0").collect()]
    assert sorted(stay, key=str) == [(3, 3), (3, 3), (5, 5), (None, None)]


def test_pipeline_stage_loses_no_unique_text(spark):
    import corpus_pipeline as cp

    a, b = "one two three four five six seven", "red green blue black white grey pink"
    rows = [(5, a), (3, b), (5, b), (3, b), (7, ""), (7, None), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tkey string")
    out = cp.drop_near_copies(spark, df, "")
    assert out.columns == list(cp.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(5, a), (3, b), (7, ""), (7, None), (None, a)], key=str)
    assert cp.drop_near_copies(spark, df.limit(0), "").count() == 0
