import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import chat, mixing, pieces, pii, toxicity
from quillon.llm.common import Scratch
from quillon.llm.queries import PIECES_MODEL

# Mixing -----------------------------------------------------------------------------------------


def test_water_fill_shares_everything():
    t = mixing.water_fill({"a": 100, "b": 10, "c": 1000}, {"a": 5, "b": 2, "c": 1}, 1110)
    assert t["b"] == 30 and t["a"] == 300 and abs(sum(t.values()) - 1110) < 1e-6


def test_min_cost_flow_repeats_evenly():
    """A pattern in both sources serves the one that needs it; repetition is spread, not piled up."""
    flow = mixing.min_cost_flow({0: 100, 1: 100, 2: 100}, {0: ("a",), 1: ("b",), 2: ("a", "b")}, {"a": 150, "b": 150})
    taken = {p: sum(v for (q, _), v in flow.items() if q == p) for p in range(3)}
    assert taken == {0: 100, 1: 100, 2: 100}
    flow = mixing.min_cost_flow({0: 10, 1: 10}, {0: ("a",), 1: ("a", "b")}, {"a": 30, "b": 10})
    assert sum(v for (p, s), v in flow.items() if s == "b") == 10 and max(sum(v for (p, _), v in flow.items() if p == q) for q in (0, 1)) == 20


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), f"s{min(i % 7, 3)}" if i % 11 else None, 5, 7) for i in range(600)] + [(700, None, "s1", 0, 0), (701, "", "s2", 0, 0), (None, "a b", "s0", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, pattern int")
    out = mixing.mix(df, Scratch(spark, "t")).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() >= {"size", "pattern"}
    taken, target = {}, {}
    for r in out:
        assert 0 <= r["__taken"] <= 3 * r["__size"]
        taken[r.source] = taken.get(r.source, 0) + r["__taken"]
        target[r.source] = r["__target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 60, s
    again = {(r.doc_id, r.text): r["__taken"] for r in mixing.mix(df.repartition(7), Scratch(spark, "t")).collect()}
    assert again == {(r.doc_id, r.text): r["__taken"] for r in out}
    rows_out = mixing.mixed_rows(df, Scratch(spark, "t"))
    assert rows_out.columns == df.columns and rows_out.count() == sum(r["__copies"] for r in out)
    assert mixing.mix(df.limit(0), Scratch(spark, "t")).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(i, "a b c d", ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else []) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), Scratch(spark, "t"), weights={"x": 1, "y": 1, None: 2}).collect()
    assert abs(sum(r["__taken"] for r in out) - 1200) <= 20


# SentencePiece ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    """The public vocabulary; scores beyond 32-bit precision are moved, so that the library can be compared."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(pieces.read_model(PIECES_MODEL))
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1 and p.score < -1e8:
            p.score = -40_000
    return m.SerializeToString()


TEXTS = ["", "a", " ", "  two  spaces ", "Hello world", "tab\tnew\nline", "日本語のテキスト 🙂", "the quick brown fox", "x" * 50, "▁", "Ünïcödé ß", "no_space" * 20]


def test_encode_equals_library(model):
    import sentencepiece

    lib, v = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.parse_model(model)
    rng = random.Random(0)
    score = lambda ids: sum(v.scores.get(v.text[i], (0.0, 0))[0] for i in ids)
    for t in TEXTS + [" ".join("".join(rng.choice("etaoin shrdlu") for _ in range(6)) for _ in range(8)) for _ in range(50)]:
        got, want = pieces.encode_whole(pieces.normalize(t, v), v).tolist(), lib.encode(t)
        assert got == want or score(got) == score(want), t
        assert pieces.decode_ids(np.array(got, np.int64), v) == t.replace("▁", " ")


def in_chunks(s, size, v):
    parts = [(s[a : a + size + v.longest - 1], min(size, len(s) - a)) for a in range(0, len(s), size)]
    cuts = [pieces.middle(x, n, v) for x, n in parts]
    into = pieces.ways_in(np.stack([pieces.transfer(x, n, v, c) for (x, n), c in zip(parts, cuts)]))
    leave = pieces.ways_out(np.array([pieces.entries_of(x, n, c, i, v) for (x, n), c, i in zip(parts, cuts, into)]))
    inner = [pieces.encode_whole(x[c[0] : c[1]], v) if c else None for (x, _), c in zip(parts, cuts)]
    return [k for (x, n), c, m, i, j in zip(parts, cuts, inner, into, leave) for k in pieces.backtrace(x, n, c, m, i, j, v)]


@pytest.mark.parametrize("size", [1, 3, 17, 64])
def test_chunks_of_any_size_give_the_same_ids(model, size):
    v = pieces.parse_model(model)
    for t in [*TEXTS, "thequickbrownfoxjumpsoverthelazydog" * 4, "one two  three\n\nfour", "aaaa" * 30, "x1y22z333 " * 9]:
        s = pieces.normalize(t, v)
        if s:
            ids = in_chunks(s, size, v)
            assert ids == pieces.encode_whole(s, v).tolist() and pieces.decode_ids(np.array(ids), v) == t.replace("▁", " ")


def tied(units: bool):
    """A vocabulary in which many segmentations have the same score."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.remove_extra_whitespaces = False
    for text, score, kind in [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.0, 1), ("aa", -2.0, 1), ("ab", -2.0, 1), ("ba", -2.0, 1), ("aab", -3.0, 1), ("▁", -1.0, 1), ("▁a", -2.0, 1)] + ([] if units else [("a▁b", -3.0, 1)]):
        p = m.pieces.add()
        p.piece, p.score, p.type = text, score, kind
    return pieces.parse_model(m.SerializeToString())


@pytest.mark.parametrize("units", [True, False])
def test_ties_fall_alike_however_a_text_is_cut(units):
    v = tied(units)
    assert (v.unit is not None) == units
    rng = random.Random(3)
    for _ in range(60):
        s = pieces.normalize("".join(rng.choice("aab  c") for _ in range(rng.randint(1, 70))), v)
        want = pieces.encode_whole(s, v).tolist()
        for size in (1, 2, 5, 16):
            assert in_chunks(s, size, v) == want, (s, size)


def test_maxplus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 50, (5, 5)).astype(float) for _ in range(3))
    assert (pieces.maxplus(pieces.maxplus(a, b), c) == pieces.maxplus(a, pieces.maxplus(b, c))).all()


def test_encode_rows(spark, model):
    texts = [*TEXTS, None, "giant text with words " * 400, "giant" * 2000]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, pos string")
    out = pieces.encode(df, model, Scratch(spark, "t"), chunk=500)
    assert out.columns == ["doc_id", "text", "pos", "ids"]
    rows = pieces.decode(out, model).collect()
    assert len(rows) == len(texts) and all(r.decoded == (r.text or "").replace("▁", " ") for r in rows)
    v = pieces.parse_model(model)
    for r in rows:
        assert r.ids == pieces.encode_whole(pieces.normalize(r.text or "", v), v).tolist()
    assert pieces.encode(df.limit(0), model, Scratch(spark, "t")).count() == 0
    told = {r.doc_id: r.round_trip for r in pieces.piece_digests(df, model, Scratch(spark, "t")).collect()}
    assert all(told[i] == ("▁" not in (t or "")) for i, t in enumerate(texts))


# Mixing ------------------------------------------------------------------------------------------


def test_mix_cuts_between_rows_that_are_alike(spark):
    """Rows alike in id and text are numbered, so a source of one repeated row still comes near its target."""
    alike = [(1, "one two", "a", "x")] * 1000 + [(i, "three four five", "b", "x") for i in range(2, 602)] + [(None, None, "c", None), (9000, "", None, "y")]
    df = spark.createDataFrame(alike, "doc_id long, text string, source string, __size string").repartition(7)
    out = mixing.mix_report(df, Scratch(spark, "t")).collect()
    assert len(out) == len(alike)
    for source, rows in {"a": [r for r in out if r.doc_id == 1], "b": [r for r in out if (r.doc_id or 0) > 1 and r.size]}.items():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 3, source
    again = mixing.mix_report(df.repartition(3), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mixed_rows(df, Scratch(spark, "t")).columns == df.columns
    assert mixing.mix_report(df.limit(0), Scratch(spark, "t")).count() == 0


# Personal data -----------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"\D", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_spans(spark):
    rng = random.Random(5)
    texts = ["a@b.c", "é🙂 a@b.c_d@e.f x", "a@b.c@d.e", "1.2.3.4.5.6.7.8 and 256.1.1.1 01.2.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111111111111111 4111111111111111", "+1 (555) 123-4567 +12 +1234567890", None, "", "no data", "x" * 40_000 + "@", "9" * 20_000, "mail me at joe@x.org, or 10.0.0.1!"]
    texts += ["".join(rng.choice("ab1234 .-@+()5") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "z", 4) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip int")
    got = {r.doc_id: r for r in pii.span_digests(df).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(",")), t
    assert pii.span_digests(df.limit(0)).count() == 0


def test_pii_added_spans_and_redaction(spark):
    texts = ["write to john (at) example (dot) com today", "call 555-123-4567 now", "the total is 1234567 items", "order 1234567890123456 shipped"]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [len(r.base) for r in rows] == [0] * 4 and [len(r.spans) > 0 for r in rows] == [True, True, False, False]
    red = pii.redact(spark.createDataFrame([(1, "mail joe@x.org or 10.0.0.1"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert red[0].text == "mail [email] or [ip]" and red[1].text is None


def test_pii_models_hold_out():
    for kind, m in pii.models().items():
        made = list(pii._examples(kind, 999, 2000))
        x, y = np.array([pii._text_features(s, b, a, kind) for s, b, a, _ in made]), np.array([g for *_, g in made])
        hit = m.logit(x) >= m.threshold
        assert y[hit].mean() > 0.95 and hit[y].mean() > 0.5, kind


def test_pii_feature_columns_equal_python(spark):
    spans = ["4111-1111 11111111", "+1 (2) 3", "john [at] x [dot] com", "1.2.3.4"]
    df = spark.createDataFrame([(s, "call me $", "") for s in spans], "m string, before string, after string")
    from pyspark.sql import functions as F

    for kind in pii.KINDS:
        cols = pii.features(F.struct("m", "before", "after"), kind)
        got = [tuple(r) for r in df.select(*cols.values()).collect()]
        assert got == [tuple(pii._text_features(s, "call me $", "", kind)) for s in spans]


# Chat ----------------------------------------------------------------------------------------------


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", "yo <|im_end|>", "x"), (1, 3, "ann", None, "x"), (2, None, None, "q", "x"), (None, 1, "ann", "lost", "x"), (3, 0, "system", "alone", "x"), (4, 1, "a", "z", "x"), (4, 1, "a", "z", "x"), (4, 1, "a", "é🙂", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, speaker string")
    got = {(r.conv_id, r.speaker): r for r in chat.render(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (4, "a")}
    a = got[(1, "ann")]
    assert a.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [a.text[s.start : s.end] for s in a["mask"]] == ["hi", ""]
    assert [got[(4, "a")].text[s.start : s.end] for s in got[(4, "a")]["mask"]] == ["z", "z", "é🙂"]
    assert [got[(1, "bob")].text[s.start : s.end] for s in got[(1, "bob")]["mask"]] == ["yo < |im_end|>"]
    assert chat.chat_digests(df.limit(0)).count() == 0


# Toxicity ------------------------------------------------------------------------------------------


def tox_data(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zzgrr", "qqbad", "xxfoul"]))
        docs.append((i, " ".join(w), "x", True))
        labels.append((i, 0 if i % 9 == 0 else 1, int(toxic)))
    return docs, labels


def test_toxicity_chain_on_held_out(spark):
    docs, labels = tox_data(900, 1)
    d = spark.createDataFrame([*docs, (9001, None, "x", False), (9002, "", "x", False), (9003, "w " * 100_000, "x", False)], "doc_id long, text string, extra string, rejected boolean")
    lab = spark.createDataFrame([r for r in labels if r[0] < 600] + [(None, 1, 1), (1, None, 0), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, lab, {"junk": "quality = 0", "toxic": "toxic = 1"})
    assert [m.name for m in chain] == ["junk", "toxic"] and len(chain[1].weights) == 2 * len(chain[1].words) + toxicity.N_SHAPE + 1
    out = {r.doc_id: r for r in toxicity.score(d, chain, "toxic").collect()}
    held = [r for r in labels if r[0] >= 600]
    assert sum(out[i].rejected == bool(t) for i, _, t in held) / len(held) > 0.98
    assert not out[9001].rejected and not out[9002].rejected and not out[9003].rejected


@pytest.mark.parametrize("text", ["Abbb" * 2000, "bbbA" * 2000, "a" * 3999 + "B", "a" * 100_001 + "ÀÉ🅐ж" * 30 + "a" * 50_000, "Ab\n" * 7, ""])
def test_toxicity_upper_share_reads_whole_texts(text):
    assert toxicity.shape_features(text, [])[3] == sum(map(str.isupper, text)) / max(1, len(text))


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    chain = toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"toxic": "toxic = 1"})
    assert not toxicity.score(d, chain, "toxic").first().rejected and toxicity.score(d.limit(0), chain, "toxic").count() == 0


def test_pii_offsets_of_many_matches(spark):
    """Offsets are right beyond one block of sums, and a text of very many matches does not take long."""
    import time

    text = " ".join(f"user{i}@host{i % 7}.example.org é" for i in range(1000))
    out = pii.find_spans(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, base string")).collect()[0]
    assert [(s.s, s.e) for s in out.base if s.k == 0] == [m.span() for m in re.finditer(PLAIN["email"], text)]
    began = time.time()
    many = spark.createDataFrame([(1, "a@b.cd " * 100_000)], "doc_id long, text string")
    assert pii.span_digests(many).collect()[0].n_email == 100_000 and time.time() - began < 60


def test_pii_proposals_equal_python(spark):
    """The plan proposes what the Python generators propose: overlapping cuts, with their context, in texts of any kind."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = ["call 2024-01-15 555-123-4567", "12 555-123-4567 555-987-6543.", "é🙂 3 4111.1111.1111.1111 x", "(555) 123-4567", "5551234567", "a (at) b (dot) com. Then c @ d.e", "10[.]0[.]0[.]1.", "", "1 " * 300]
    texts += ["".join(rng.choice(["12", "3", "4567", " ", "-", ".", "(", ")", "+", "at", "[at]", "[.]", "x", "é", "@"]) for _ in range(40)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", *[pii._proposals(F.col("text"), k).alias(k) for k in pii.KINDS]).collect()
    some = 0
    for r in rows:
        for kind in pii.KINDS:
            want = [(at, span, before, after) for at, span, before, after in pii.proposals_of(texts[r.doc_id], kind)] if re.search(pii.PROPOSE_NEEDS[kind], texts[r.doc_id]) else []
            assert [(c.s, c.m, c.before, c.after) for c in r[kind]] == want, (kind, texts[r.doc_id])
            assert all(c.e - c.s == len(c.m) for c in r[kind])
            some += len(want)
    assert some > 500


def test_pii_best_cut_of_numbers_that_run_together(spark):
    """Numbers next to a span do not hide it, and no other cut of the same digits is taken with it."""
    cases = [("please call 2024-01-15 555-123-4567 today", ["555-123-4567"]), ("please call 12 555-123-4567 today", ["555-123-4567"]), ("call 555-123-4567 555-987-6543 today", ["555-123-4567", "555-987-6543"]), ("visa card 3 4111.1111.1111.1111 today", ["4111.1111.1111.1111"]), ("on 2024-01-15 12 of 34 came", [])]
    out = {r.doc_id: r.spans for r in pii.find_spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    for i, (text, want) in enumerate(cases):
        found = {text[s.s : s.e] for s in out[i]}
        assert all(a.e <= b.s or a.k != b.k for a, b in zip(out[i], out[i][1:]))
        assert found >= set(want) and (want or not found), (text, found)
