"""The queries and the pipeline over a whole small table, against plain versions."""

import collections

import numpy as np
import pytest
from tests.llm import brute

import corpus_pipeline as cp
from quillon.llm import pieces
from quillon.llm.queries import ORACLES, PIECES_MODEL, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_minhash_query(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op1_minhash_near_dedup"](spark, sf).collect()}
    assert got == brute.near_duplicates(docs)


def test_suffix_query(spark, sf, docs):
    assert sorted(tuple(r) for r in QUERIES["op8_suffix_dedup"](spark, sf).collect()) == sorted(brute.suffixes(docs))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_query_has_rows_of_its_table(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op3_mix_sources", "op4_sentencepiece", "op6_pii", "op10_toxicity"):
        assert QUERIES[name](spark, sf).count() == n


def test_pipeline_stages(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    kept = cp.drop_toxic(spark, source, sf)
    assert kept.columns == list(cp.COLUMNS) and source.count() - len(toxic) * 2 - 10 <= kept.count() < source.count()
    stage2 = cp.drop_lines(spark, kept, sf)
    want = {i: d for i, _, d, _ in brute.lines([(r.doc_id, r.text) for r in kept.collect()])}
    before = {r.doc_id: r.text for r in kept.collect()}
    for r in stage2.collect():
        assert before[r.doc_id].count("\n") + 1 - want[r.doc_id] == (r.text.count("\n") + 1 if r.text or want[r.doc_id] <= before[r.doc_id].count("\n") else 0) and r.n_chars == len(r.text)
    rows2 = [(r.doc_id, r.text) for r in stage2.collect()]
    stage3 = cp.drop_near_copies(spark, stage2, sf)
    assert sorted(r.doc_id for r in stage3.collect()) == sorted(i for i, (_, _, k) in brute.near_duplicates(rows2).items() if k)
    stage4 = cp.mix_sources(spark, stage3, sf)
    times = collections.Counter(r.doc_id for r in stage4.collect())
    assert stage4.columns == list(cp.COLUMNS) and max(times.values()) <= 3 and set(times) <= {r.doc_id for r in stage3.collect()}
    v, texts = pieces.parse_model(pieces.read_model(PIECES_MODEL)), {r.doc_id: r.text for r in stage4.collect()}
    for r in cp.encode_pieces(spark, stage4, sf).collect():
        assert pieces.decode_ids(np.array(r.ids, np.int64), v) == texts[r.doc_id].replace("▁", " ") and r.n_tokens == len(r.ids)


def test_pipeline_run(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "minhash", "mixing", "sentencepiece"]
    a, b = (sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, sf).collect()) for _ in range(2))
    assert a == b and a


def test_native_operators_run_no_python(spark, sf):
    import re

    for name in ("op6_pii", "op7_chat_format"):
        assert not re.search("Python|Pandas|Arrow", QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()), name


def test_mixing_query_against_plain_version(spark, sf):
    """Sizes, sources' sizes and targets as plain Python has them; what is taken meets the targets to a document."""
    import re

    docs = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = collections.Counter()
    for n, s in docs.values():
        total[s] += n
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(total.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= full
    rows = QUERIES["op3_mix_sources"](spark, sf).collect()
    assert {r.doc_id: (r.size, r.source_size) for r in rows} == {i: (n, total[s]) for i, (n, s) in docs.items()}
    taken, most = collections.Counter(), collections.Counter()
    for r in rows:
        n, s = docs[r.doc_id]
        assert abs(r.target - target[s]) <= 1e-6 * max(1, target[s]) and r.taken in (0, n, 2 * n, 3 * n)
        taken[s] += r.taken
        most[s] = max(most[s], n)
    assert all(abs(taken[s] - target[s]) <= most[s] + 1 for s in order), (taken, target)


def test_pii_query_against_plain_version(spark, sf, docs):
    """Base spans and counts as plain regular expressions have them, in every whole text; added spans are proposals, and overlap none of their kind."""
    import hashlib

    from quillon.llm import pii
    from tests.llm.test_text import base

    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, sf).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, text in docs:
        want, r = base(text), got[i]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), i
        plain, spans = [x for x in want.split(",") if x], [x for x in r.spans.split(",") if x]
        added = [x.split(":") for x in sorted(set(spans) - set(plain))]
        assert set(plain) <= set(spans) and {k: sum(x.startswith(k) for x in plain) for k in pii.KINDS} == {k: r[f"n_{k}"] for k in pii.KINDS}
        for k, s, e in added:
            assert any(at == int(s) and at + len(span) == int(e) for at, span, _, _ in pii.proposals_of(text, k)), (i, k, s, e)
            assert not any(k == k2 and (s, e) != (s2, e2) and int(s) < int(e2) and int(s2) < int(e) for k2, s2, e2 in (x.split(":") for x in spans))


def test_toxicity_query_against_plain_rerun(spark, sf, docs):
    """Every document's probabilities and verdict are those of the chain applied to its text alone, in plain Python."""
    from quillon.llm import toxicity
    from quillon.llm.queries import CATEGORIES

    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chain = toxicity.train(table, spark.read.parquet(f"{sf}/labels.parquet"), CATEGORIES)
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, text in docs:
        tokens = toxicity._tokens(text or "")
        bag, shape, before = toxicity._bag(tokens), np.array([toxicity.shape_features(text or "", tokens)]), np.zeros((1, 0))
        for m in chain:
            p = 1 / (1 + np.exp(-m.logits(shape, [bag], before)))
            before = np.hstack([before, p[:, None]])
            assert abs(got[i][f"p_{m.name}"] - p[0]) < 2e-6, (i, m.name)
        assert got[i].rejected == bool(tokens and before[0, -1] >= chain[-1].threshold), i


def test_pieces_query_against_plain_version(spark, sf, docs):
    """Every document's ids are those of a plain search for the best path over its whole text, and decode to it."""
    import hashlib

    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(pieces.read_model(PIECES_MODEL))
    normal = {p.piece: (int(p.score), i) for i, p in enumerate(m.pieces) if p.type == 1}
    assert all(p.score == int(p.score) for p in m.pieces if p.type == 1) and not any(p.type == 4 for p in m.pieces)
    byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
    unknown = min(s for s, _ in normal.values()) - 10
    got = {r.doc_id: r for r in QUERIES["op4_sentencepiece"](spark, sf).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, text in docs:
        ids = brute.best_pieces(text or "", normal, unknown, byte_ids)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()), i
        assert got[i].round_trip == ("▁" not in (text or "")), i
