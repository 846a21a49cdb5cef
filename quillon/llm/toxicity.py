"""Toxicity by classifier chains: each category's model also sees the earlier categories' probabilities."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, keyed, lean, named, row_slices

#: At most so many labelled rows are fitted, the first in a seeded order of their ids.
MAX_TRAINING_ROWS = 5000
#: Words and word beginnings kept as features of a category, best first by their score.
MAX_WORDS = 150
#: Lengths of the word beginnings that count as features beside whole words.
STEMS = (2, 3, 4, 5, 6)
FOLDS = 5
TOKEN = re.compile(r"\w+")
#: Words remembered by a scoring task before it forgets them all; results do not depend on it.
CACHE_WORDS = 100_000
#: Rows and bytes of text scored at a time.
SCORE_ROWS, SCORE_BYTES = 256, 4 << 20
#: Shape features of a text, whatever its words.
N_SHAPE = 6


def _tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _keys(word: str) -> list[str]:
    """Feature names of a word: itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def _bag(tokens: list[str]) -> dict[str, int]:
    bag: dict[str, int] = {}
    for w in tokens:
        for k in _keys(w):
            bag[k] = bag.get(k, 0) + 1
    return bag


@lru_cache(maxsize=1)
def _upper_codes() -> np.ndarray:
    """For each code point, whether it is upper case."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def upper_count(text: str) -> int:
    """Upper-case characters of the whole text."""
    return int(np.count_nonzero(_upper_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]))


def shape_features(text: str, tokens: list[str]) -> list[float]:
    n = max(1, len(text))
    lines = text.split("\n")
    return [
        np.log1p(len(tokens)),
        len(tokens) and len(set(tokens)) / len(tokens),
        sum(map(text.count, "!#$%&*|{}<>=")) / n,
        upper_count(text) / n,
        1 - len(set(lines)) / len(lines),
        len(tokens) and sum(map(len, tokens)) / len(tokens) / 10,
    ]


@dataclass
class Link:
    """One category's linear model: words and shape, then the earlier categories' probabilities."""

    name: str
    words: dict[str, int]
    weights: np.ndarray
    bias: float
    threshold: float
    #: Range of each shape feature in training; a text beyond it counts as at its end.
    low: np.ndarray
    high: np.ndarray

    def logits(self, shape: np.ndarray, bags: list[dict[str, int]], earlier: np.ndarray) -> np.ndarray:
        return _design(_counts(self.words, bags), shape, earlier, self.low, self.high) @ self.weights + self.bias


class Bags:
    """Feature counts of the training texts in three flat arrays; features of fewer than ``least`` texts are left out."""

    def __init__(self, token_lists, least: int = 5):
        names: dict[str, int] = {}
        ids, counts, sizes = [], [], []
        for tokens in token_lists:
            bag = _bag(tokens)
            ids.append(np.array([names.setdefault(k, len(names)) for k in bag], np.int32))
            counts.append(np.fromiter(bag.values(), np.int32, len(bag)))
            sizes.append(len(bag))
        row, col, n = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([*counts, np.zeros(0, np.int32)])
        held = np.bincount(col, minlength=len(names)) >= least
        self.names = [k for k, h in zip(names, held, strict=True) if h]
        keep = held[col]
        self.row, self.col, self.n, self.rows = row[keep], (np.cumsum(held) - 1)[col[keep]], n[keep], len(sizes)

    def presence(self, where: np.ndarray) -> np.ndarray:
        """In how many of the texts ``where`` each feature is."""
        return np.bincount(self.col, weights=where[self.row].astype(float), minlength=len(self.names))

    def counts(self, words: dict[str, int]) -> np.ndarray:
        place = np.full(len(self.names), -1)
        for j, name in enumerate(self.names):
            place[j] = words.get(name, -1)
        at = place[self.col] if len(self.names) else np.zeros(0, int)
        out = np.zeros((self.rows, len(words)))
        out[self.row[at >= 0], at[at >= 0]] = self.n[at >= 0]
        return out


def _counts(words: dict[str, int], bags: list[dict[str, int]]) -> np.ndarray:
    out = np.zeros((len(bags), len(words)))
    for i, bag in enumerate(bags):
        for w, c in bag.items():
            j = words.get(w)
            if j is not None:
                out[i, j] = c
    return out


def _design(counts: np.ndarray, shape: np.ndarray, earlier: np.ndarray, low=None, high=None) -> np.ndarray:
    """Columns: log counts of the feature words, their counts over the root of the text's length, shape, earlier."""
    return np.hstack([np.log1p(counts), counts / np.sqrt(np.exp(shape[:, :1]) + 20), shape if low is None else np.clip(shape, low, high), earlier])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pick_words(bags: Bags, y: np.ndarray, inside: np.ndarray) -> dict[str, int]:
    """Words that tell the classes apart: smoothed log odds of presence over its standard error."""
    up, down = bags.presence(inside & (y > 0)), bags.presence(inside & (y == 0))
    p, n = max(1, int(y[inside].sum())), max(1, int(inside.sum() - y[inside].sum()))
    odds = np.log((up + 0.5) / (p - up + 0.5)) - np.log((down + 0.5) / (n - down + 0.5))
    z = np.abs(odds / np.sqrt(1 / (up + 0.5) + 1 / (down + 0.5)))
    good = np.flatnonzero((up + down >= 5) & (z > 3))
    order = sorted(good.tolist(), key=lambda j: (-round(float(z[j]), 9), bags.names[j]))
    return {bags.names[j]: i for i, j in enumerate(order[:MAX_WORDS])}


def _fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities; midway to the next lower one, at least 1/2."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return max(0.5, float((p[order[k]] + low) / 2))


def fit_chain(texts: list[str], labels: dict[str, np.ndarray], folds: np.ndarray) -> list[Link]:
    """A chain over ``labels`` in their order.

    A later model is trained on the earlier categories' out-of-fold probabilities, which look like
    what it meets on new texts; thresholds come from out-of-fold probabilities as well. Words are
    picked within each fold's training part. A category of one class gets a constant model.
    """
    shape = np.array([shape_features(t, _tokens(t)) for t in texts]).reshape(len(texts), N_SHAPE)
    bags = Bags(map(_tokens, texts))
    low, high = (shape.min(0), shape.max(0)) if len(texts) else (np.zeros(N_SHAPE), np.zeros(N_SHAPE))
    chain, earlier = [], np.zeros((len(texts), 0))
    for name, y in labels.items():
        y = np.asarray(y, float)
        if len(y) == 0 or y.min() == y.max():
            p = float(y[0]) if len(y) else 0.0
            chain.append(Link(name, {}, np.zeros(N_SHAPE + earlier.shape[1]), 30.0 if p else -30.0, 0.5, low, high))
            earlier = np.hstack([earlier, np.full((len(texts), 1), p)])
            continue
        held = np.full(len(y), y.mean())
        for k in range(FOLDS):
            out = folds == k
            if out.all() or not out.any() or y[~out].min() == y[~out].max():
                continue
            x = _design(bags.counts(_pick_words(bags, y, ~out)), shape, earlier)
            w, b = _fit_linear(x[~out], y[~out])
            held[out] = _sigmoid(x[out] @ w + b)
        words = _pick_words(bags, y, np.ones(len(y), bool))
        w, b = _fit_linear(_design(bags.counts(words), shape, earlier), y)
        chain.append(Link(name, words, w, b, _threshold(held, y), low, high))
        earlier = np.hstack([earlier, held[:, None]])
    return chain


def score_texts(texts: list[str | None], chain: list[Link], cache: dict | None = None) -> np.ndarray:
    """Probability of each category, one row a text; null counts as empty."""
    vocabulary = set().union(*(m.words for m in chain)) if chain else set()
    cache = {} if cache is None else cache
    bags, shape = [], []
    for t in texts:
        tokens = _tokens(t or "")
        bag: dict[str, int] = {}
        for w in tokens:
            found = cache.get(w)
            if found is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                found = cache[w] = tuple(k for k in _keys(w) if k in vocabulary)
            for k in found:
                bag[k] = bag.get(k, 0) + 1
        bags.append(bag)
        shape.append(shape_features(t or "", tokens))
    shape, out = np.array(shape).reshape(len(texts), N_SHAPE), np.zeros((len(texts), 0))
    for m in chain:
        out = np.hstack([out, _sigmoid(m.logits(shape, bags, out))[:, None]])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS, seed: int = 5) -> list[Link]:
    """Fit a chain on at most ``max_rows`` labelled documents (a bound, and the only sample taken).

    ``categories``: name -> SQL condition over the columns of ``labels``; their order is the chain's.
    Rows of ``labels`` without an id, or with a null condition, are left out; an id that repeats
    counts once. The sample is the first ids of a seeded hash order.
    """
    marks = labels.where(named(id_col).isNotNull()).select(named(id_col).cast("long").alias("doc_id"), *[F.expr(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    marks = marks.dropna().groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    order = F.xxhash64(F.lit(seed), "doc_id")
    texts = keyed(docs, id_col, text_col).where("text is not null").select("doc_id", "text")
    held = texts.join(marks.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct()
    chosen = marks.join(held, "doc_id").orderBy(order, "doc_id").limit(max_rows)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *[f"y{i}" for i in range(len(categories))]).agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("text")), F.lit(FOLDS))).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit_chain([r["text"] for r in rows], {c: np.array([r[f"y{i}"] for r in rows]) for i, c in enumerate(categories)}, np.array([r["fold"] for r in rows], int))


def _scorer(chain: list[Link], judged: int):
    def run(batches):
        cache: dict = {}
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_pylist()
            cuts = [(lo, min(lo + SCORE_ROWS, b)) for a, b in row_slices(sizes, SCORE_BYTES) for lo in range(a, b, SCORE_ROWS)]
            for lo, hi in cuts:
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                p = score_texts(texts, chain, cache)
                flag = (p[:, judged] >= chain[judged].threshold) & np.array([bool(t and TOKEN.search(t)) for t in texts], bool)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(np.round(p[:, i], 6)) for i in range(len(chain))), pa.array(flag)], names=[*batch.schema.names[:-1], *(f"__p{i}" for i in range(len(chain))), "__flag"])

    return run


def score(docs: DataFrame, chain: list[Link], judged: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``p_<category>`` for each category, and ``rejected``.

    Whole texts are scored, row by row, without a shuffle; the model holds a few hundred words.
    Null texts are scored as empty; a text without words is never
    rejected. Extra columns pass through; one called like a result
    is replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [m.name for m in chain]
    outs = [f"p_{n}" for n in names] + ["rejected"]
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    text = inner[docs.columns.index(text_col)]
    rows = rows.select(*inner, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"__p{i} double" for i in range(len(names))] + ["__flag boolean"])
    done = rows.mapInArrow(lean(_scorer(chain, names.index(judged))), kinds)
    return done.select(*[F.col(c).alias(n) for c, n in zip(inner, docs.columns, strict=True) if n not in outs], *[F.col(f"__p{i}").alias(o) for i, o in enumerate(outs[:-1])], F.col("__flag").alias("rejected"))
