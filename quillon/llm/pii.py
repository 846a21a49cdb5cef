"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

Only DataFrame functions touch the corpus. The trees are fitted on the driver, on what the generators
propose in made-up texts, and reach the plan as a constant.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import named

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that a match is looked for at the start of a run only and nothing
#: is tried twice; the matches are those of the plain patterns, leftmost and non-overlapping.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

#: Where a proposal may start. A place where a base email starts needs none.
START = {
    "email": r"(?<![A-Za-z0-9._%+-])(?![A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-])",
    "ip": r"(?<![0-9])",
    "card": r"(?<![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])",
}
#: High-recall generators, the widest of each kind first: every place where that one matches is a start, and
#: all generators propose a span from it, so proposals overlap. They take written-out, broken-up and unmarked
#: forms, and where numbers run together there is a proposal for each cut at a group of digits.
PROPOSE = {
    "email": [
        r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+){1,5}",
        r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}+){1,5}",
    ],
    "ip": [r"[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}+){3}(?![0-9])"],
    "card": [
        r"[0-9](?:[ .\-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])",
        r"[0-9]{4}(?:[ .\-]{0,2}[0-9]{4}){3}(?![0-9A-Za-z])",
        r"[0-9]{4}[ .\-]{0,2}[0-9]{6}[ .\-]{0,2}[0-9]{5}(?![0-9A-Za-z])",
    ],
    "phone": [
        r"[+(]{0,2}[0-9](?:[ ().\-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])",
        r"[(]?[0-9]{3}[)]?[ .\-]{0,2}[0-9]{3}[ .\-]{0,2}[0-9]{4}(?![0-9A-Za-z])",
        r"\+[0-9]{1,3}[ .\-]{0,2}[(]?[0-9]{2,4}[)]?[ .\-]{0,2}[0-9]{3,4}[ .\-]{0,2}[0-9]{3,4}(?![0-9A-Za-z])",
    ],
}
PROPOSE_NEEDS = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9](?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]", "card": r"[0-9](?:[ .\-]{0,2}[0-9]){6}", "phone": r"[0-9](?:[ ().\-]{0,3}[0-9]){6}"}
#: Characters from a start that hold every proposal and what stands after it.
WINDOW = {"email": 512, "ip": 72, "card": 72, "phone": 72}

#: Words before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach|address|correo|schreib)",
    "ip": r"(?i)(\bip\b|host|server|addr|ping|login|gateway)",
    "card": r"(?i)(card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|dial|ring|whatsapp|sms|anruf|ligne)",
}
BEFORE, AFTER = 24, 8
#: A number that goes on before or after a span.
MORE_BEFORE, MORE_AFTER = r"[0-9][ ().-]{0,3}$", r"^[ ().-]{0,3}[0-9]"
FEATURES = ("length", "digits", "groups", "separators", "longest", "luhn", "plus", "paren", "spelled", "context", "octets", "money", "first", "head", "last", "more_before", "more_after", "balance", "blanks", "tail", "loose")


def _text_features(span: str, before: str, after: str, kind: str) -> list[float]:
    """The features of ``features`` for one Python string, for fitting."""
    digits = re.sub(r"[^0-9]", "", span)
    runs = re.findall(r"[0-9]+", span)
    return [
        len(span), len(digits), len(runs), len(re.sub(r"[A-Za-z0-9]", "", span)), max(map(len, runs), default=0), float(luhn(digits)),
        float(span.startswith("+") or before.endswith("+")), float("(" in span), float(bool(re.search(r"[\[(](?:at|dot|\.)[\])]", span))),
        float(bool(re.search(CONTEXT[kind], before))), float(len(runs) >= 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs[:4])),
        float(bool(re.search(r"[$€£=#]\s?$", before))), float(digits[:1] or 0),
        len(runs[0]) if runs else 0, len(runs[-1]) if runs else 0,
        float(bool(re.search(MORE_BEFORE, before))), float(bool(re.search(MORE_AFTER, after))), span.count("(") - span.count(")"),
        span.count(" "), len(re.search(r"[A-Za-z]*\Z", span)[0]), float(". " in span),
    ]


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return bool(digits) and total % 10 == 0


def luhn_ok(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return (digits != "") & (total % 10 == 0)


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def features(c: Column, kind: str) -> dict[str, Column]:
    """Format and context features of a candidate struct (m, before, after)."""
    span, before = c["m"], c["before"]
    digits = F.regexp_replace(span, "[^0-9]", "")
    runs = F.filter(F.split(span, "[^0-9]+"), lambda r: r != "")
    flag = lambda x: x.cast("double")
    return {
        "length": F.length(span).cast("double"),
        "digits": F.length(digits).cast("double"),
        "groups": F.size(runs).cast("double"),
        "separators": _count(span, "[A-Za-z0-9]"),
        "longest": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"),
        "luhn": flag(luhn_ok(digits)),
        "plus": flag(F.startswith(span, F.lit("+")) | F.endswith(before, F.lit("+"))),
        "paren": flag(F.contains(span, F.lit("("))),
        "spelled": flag(span.rlike(r"[\[(](?:at|dot|\.)[\])]")),
        "context": flag(before.rlike(CONTEXT[kind])),
        "octets": flag((F.size(runs) >= 4) & F.forall(F.slice(runs, 1, 4), lambda r: (F.length(r) <= 3) & (F.coalesce(r.try_cast("int"), F.lit(999)) <= 255))),
        "money": flag(before.rlike(r"[$€£=#]\s?$")),
        "first": F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(0.0)),
        "head": F.coalesce(F.length(F.get(runs, F.lit(0))), F.lit(0)).cast("double"),
        "last": F.coalesce(F.length(F.get(runs, F.size(runs) - 1)), F.lit(0)).cast("double"),
        "more_before": flag(before.rlike(MORE_BEFORE)),
        "more_after": flag(c["after"].rlike(MORE_AFTER)),
        "balance": _count(span, "[^(]") - _count(span, "[^)]"),
        "blanks": _count(span, "[^ ]"),
        "tail": F.length(F.regexp_extract(span, r"[A-Za-z]*\z", 0)).cast("double"),
        "loose": flag(F.contains(span, F.lit(". "))),
    }


# Fitting ------------------------------------------------------------------------------------


def _digits(rng, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng, n: int = 16, valid: bool = True) -> str:
    while True:
        d = str(rng.randrange(2, 7)) + _digits(rng, n - 1)
        if luhn(d) == valid:
            return d


def _grouped(d: str, sizes, sep: str) -> str:
    out, at = [], 0
    for s in sizes:
        out.append(d[at : at + s])
        at += s
    return sep.join(x for x in [*out, d[at:]] if x)


def _word(rng) -> str:
    return "".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randrange(2, 8)))


def _date(rng) -> str:
    y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
    return rng.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}-{d}-{y}"])


def _personal(kind: str, rng, hinted: bool) -> tuple[str, bool]:
    """A span, and whether it speaks for itself or by its context."""
    if kind == "card":
        d = _card(rng, rng.choice([13, 15, 16, 16, 16, 19]))
        span = _grouped(d, [4, 6] if len(d) == 15 else [4, 4, 4], rng.choice(["", " ", "-", ".", "  "]))
        return span, hinted or "." not in span
    if kind == "phone":
        d = _digits(rng, 10)
        span = rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"+{rng.randrange(1, 99)} {d[:3]} {d[3:6]} {d[6:]}"])
        return span, hinted or span[0] in "(+"
    if kind == "ip":
        return rng.choice([".", "[.]", "(.)", "[dot]"]).join(str(rng.randrange(256)) for _ in range(4)), True
    at, dot = (" @ ", ".") if rng.random() < 0.2 else (rng.choice([" [at] ", " (at) ", "[at]", "(at)"]), rng.choice([".", " [dot] ", "[dot]", " (dot) "]))
    return f"{_word(rng)}{at}{_word(rng)}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}", True


def _harmless(kind: str, rng) -> str:
    """A span of like form that is no personal data."""
    if kind == "card":
        d = _digits(rng, rng.randrange(13, 20)) if rng.random() < 0.3 else _card(rng, rng.choice([13, 15, 16, 19]), rng.random() < 0.08)
        return _grouped(d, [4, 4, 4], rng.choice(["", " ", "-", ".", "  "]))
    if kind == "phone":
        return rng.choice([_digits(rng, rng.randrange(7, 16)), _date(rng), f"{_date(rng)} {rng.randrange(24)}.{_digits(rng, 2)}", " ".join(_digits(rng, rng.randrange(1, 5)) for _ in range(5)), f"{_digits(rng, 3)}.{_digits(rng, 2)}.{_digits(rng, 3)}.{_digits(rng, 2)}", f"{_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 4)}"])
    if kind == "ip":
        octets = [str(rng.randrange(256)) for _ in range(4)]
        octets[rng.randrange(4)] = str(rng.randrange(256, 999))
        return rng.choice([".", "[.]", "(.)", "[dot]"]).join(octets)
    at = rng.choice([" [at] ", " (at) ", "[at]", "(at)", " @ "])
    return f"{_word(rng)}{at}{_digits(rng, rng.randrange(1, 3))}.{_digits(rng, 1)}"


def _made_text(kind: str, rng) -> tuple[str, set[tuple[int, int]]]:
    """A text with one or two spans of a kind or with harmless ones, numbers close by, and the places of what is personal data."""
    says = {"email": ["mail ", "contact ", "write to "], "ip": ["ip ", "server ", "host "], "card": ["card ", "visa ", "pay with "], "phone": ["tel ", "call ", "phone: "]}[kind]
    plain = ["the ", "and ", "of ", "no ", "id ", "ref ", "total ", "= ", "# ", "$ "]
    good = rng.random() < 0.6
    hinted = rng.random() < (0.7 if good else 0.15)
    text, places = f"{_word(rng)} {_word(rng)} " + rng.choice(says if hinted else plain), set()
    near = kind in ("card", "phone")
    if near and rng.random() < 0.4:
        text += rng.choice([f"{_date(rng)} ", f"{rng.randrange(1, 100)} ", f"{rng.randrange(1, 10)} ", f"{_digits(rng, rng.randrange(2, 6))} "])
    wrapped = rng.random() < 0.1
    text += "(" if wrapped else ""
    for again in range(1 + (rng.random() < 0.2)):
        text += rng.choice([" ", " ", ", "]) if again else ""
        span, speaks = _personal(kind, rng, hinted) if good else (_harmless(kind, rng), False)
        if speaks:
            places.add((len(text), len(text) + len(span)))
        text += span
    text += ")" if wrapped else ""
    if near and rng.random() < 0.25:
        text += rng.choice([f" {rng.randrange(1, 100)}", f" {_date(rng)}", f", {_date(rng)}"])
    return text + rng.choice([" ", " ", ". ", ", "]) + f"{_word(rng)} {_word(rng)}", places


def proposals_of(text: str, kind: str):
    """(start, span, before, after) of every proposal for one Python string, as ``_proposals`` makes them."""
    t = " " + text
    for m in re.finditer(f"{START[kind]}(?={PROPOSE[kind][0]})", t):
        at = m.start()
        window = t[at : at + WINDOW[kind]]
        for span in dict.fromkeys(x[0] for g in PROPOSE[kind] if (x := re.match(g, window))):
            yield at - 1, span, t[max(0, at - BEFORE) : at], window[len(span) : len(span) + AFTER]


def _examples(kind: str, seed: int, n: int):
    """``n`` labelled proposals (span, before, after, is personal data) of one kind: all that the generators propose in
    texts from a seeded generator; right is only the whole of a span, so wrong cuts are among the others."""
    rng = random.Random(seed)
    left = n
    while left:
        text, places = _made_text(kind, rng)
        for at, span, before, after in list(proposals_of(text, kind))[:left]:
            left -= 1
            yield span, before, after, (at, at + len(span)) in places


@dataclass(frozen=True)
class Boosted:
    """Depth-2 trees: (feature, cut, (feature, cut, left, right) below, the same above), and a threshold on the sum."""

    trees: tuple
    bias: float
    threshold: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, cut, low, high in self.trees:
            up = x[:, f] > cut
            for mask, (g, c, a, b) in ((~up, low), (up, high)):
                out[mask] += np.where(x[mask, g] > c, b, a)
        return out

    def column(self, values: Column) -> Column:
        """The sum over an array of features: one pass over the trees, which stand in the plan as a constant array."""
        leaf = lambda side, t: f"'{side}', named_struct('f', {t[0] + 1}, 'cut', {t[1]!r}D, 'low', {t[2]!r}D, 'high', {t[3]!r}D)"
        trees = F.expr("array(" + ", ".join(f"named_struct('f', {f + 1}, 'cut', {float(cut)!r}D, {leaf('low', low)}, {leaf('high', high)})" for f, cut, low, high in self.trees) + ")")
        value = lambda t: F.when(F.element_at(values, t["f"]) > t["cut"], t["high"]).otherwise(t["low"])
        return F.aggregate(trees, F.lit(self.bias), lambda total, t: total + _let(value(t), value))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float]:
    best = (0, np.inf, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, G, H = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gain = G[cut] ** 2 / (H[cut] + 1) + (G[-1] - G[cut]) ** 2 / (H[-1] - H[cut] + 1) - G[-1] ** 2 / (H[-1] + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[2] + 1e-12:
                best = (f, float((v[cut[k]] + v[cut[k] + 1]) / 2), float(gain[k]))
    return best


def fit_boosted(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, rounds: int = 40, rate: float = 0.4, precision: float = 0.99) -> Boosted:
    """Gradient boosting on the logistic loss; the threshold is the lowest with ``precision`` on held-out rows."""
    bias = float(np.log(y.mean() / (1 - y.mean())))
    trees: list = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-Boosted(tuple(trees), bias, 0.0).logit(x)))
        g, h = y - p, p * (1 - p)
        f, cut, _gain = _best_split(x, g, h)
        sides = []
        for mask in (x[:, f] <= cut, x[:, f] > cut):
            k, c, _gain = _best_split(x[mask], g[mask], h[mask]) if mask.any() else (0, np.inf, 0.0)
            up = mask & (x[:, k] > c)
            down = mask & ~up
            sides.append((k, float(min(c, 1e9)), *(round(float(rate * g[m].sum() / (h[m].sum() + 1)), 6) for m in (down, up))))
        trees.append((f, min(cut, 1e9), *sides))
    model = Boosted(tuple(trees), bias, 0.0)
    s = model.logit(held_x)
    order = np.argsort(-s, kind="stable")
    rate_of = np.cumsum(held_y[order]) / np.arange(1, len(s) + 1)
    good = np.flatnonzero(rate_of >= precision)
    last = int(good[-1]) if len(good) else -1
    return Boosted(model.trees, bias, max(0.0, float(s[order[last]])) if last >= 0 else float("inf"))


@lru_cache(maxsize=8)
def models(seed: int = 11, rows: int = 3000) -> dict[str, Boosted]:
    """A boosted model of each kind, fitted on ``rows`` proposals of made-up texts and calibrated on as many others."""
    out = {}
    for i, kind in enumerate(KINDS):
        sets = []
        for part in (0, 1):
            made = list(_examples(kind, seed * 100 + i * 10 + part, rows))
            sets += [np.array([_text_features(s, b, a, kind) for s, b, a, _ in made]), np.array([g for *_, g in made], float)]
        out[kind] = fit_boosted(*sets)
    return out


# Spans --------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it, also within its lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


#: Matches whose lengths are added up as one block.
_SUM_BLOCK = 64


def _sums_before(lengths: Column) -> Column:
    """For each number of an array, the sum of those before it: within its block, and of the blocks before that."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _SUM_BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK))))
    heads = lambda sums: F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b)))
    return _let(_let(blocks, heads), lambda head: F.transform(lengths, lambda _, i: F.element_at(head, F.floor(i / _SUM_BLOCK).cast("int") + 1) + _total(F.slice(lengths, F.floor(i / _SUM_BLOCK).cast("int") * _SUM_BLOCK + 1, i % _SUM_BLOCK))))


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (m, before, after, s, e): matches with their offsets in code points.

    The pieces between matches and the matches alternate, so offsets are running sums of lengths,
    which are taken block by block: no array is copied for each match.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    cells = _let(F.struct(found.alias("f"), between.alias("b")), lambda x: F.zip_with(x["f"], F.slice(x["b"], F.lit(1), F.size(x["f"])), lambda m, p: F.struct(m.alias("m"), F.right(p, F.lit(BEFORE)).alias("before"), F.length(p).alias("gap"), F.length(m).alias("n"))))
    placed = lambda cs, starts: F.zip_with(cs, starts, lambda c, at: F.struct(c["m"].alias("m"), c["before"].alias("before"), (at + c["gap"]).alias("s"), (at + c["gap"] + c["n"]).alias("e")))
    nothing = F.array().cast("array<struct<m:string,before:string,s:int,e:int>>")
    spans = _let(cells, lambda cs: F.when(F.size(cs) == 0, nothing).otherwise(_let(F.transform(cs, lambda c: c["gap"] + c["n"]), lambda lengths: placed(cs, _sums_before(lengths)))))
    return F.when(text.rlike(needs), spans).otherwise(nothing)


def _proposals(text: Column, kind: str) -> Column:
    """Array of (m, before, after, s, e): what every generator proposes from every start, in order of start.

    Starts are matches of no width, at which the text is split, so that offsets are running sums of the
    pieces' lengths; a blank before the text keeps the first start from standing at its very front.
    """
    t = F.concat(F.lit(" "), text)
    start = f"{START[kind]}(?={PROPOSE[kind][0]})"
    found, between = F.regexp_extract_all(t, F.lit(rf"{start}(?=([\s\S]{{0,{WINDOW[kind]}}}))"), 1), F.split(t, start, -1)
    cells = _let(F.struct(found.alias("f"), between.alias("b")), lambda x: F.zip_with(x["f"], F.slice(x["b"], F.lit(1), F.size(x["f"])), lambda w, p: F.struct(w.alias("w"), F.right(p, F.lit(BEFORE)).alias("tail"), F.length(p).alias("gap"))))
    nothing = F.array().cast("array<struct<m:string,before:string,after:string,s:int,e:int>>")
    # A piece has a character at least, so the last BEFORE pieces hold all of what is looked at before a start.
    before = lambda tails, i: F.right(F.array_join(F.slice(tails, F.greatest(i - (BEFORE - 2), F.lit(1)), F.least(i + 1, F.lit(BEFORE))), ""), F.lit(BEFORE))
    spans = lambda w: F.filter(F.array_distinct(F.array(*[F.regexp_extract(w, f"^(?:{g})", 0) for g in PROPOSE[kind]])), lambda m: m != "")
    placed = lambda c: F.transform(spans(c["w"]), lambda m: F.struct(m.alias("m"), c["before"].alias("before"), F.substring(c["w"], F.length(m) + 1, F.lit(AFTER)).alias("after"), c["s"].alias("s"), (c["s"] + F.length(m)).alias("e")))
    starts = lambda cs, x: F.transform(cs, lambda c, i: F.struct(c["w"].alias("w"), before(x["tails"], i).alias("before"), (F.element_at(x["sums"], i + 1) + c["gap"] - 1).alias("s")))
    sums = lambda cs: _let(F.transform(cs, lambda c: c["gap"]), lambda gaps: F.struct(F.transform(cs, lambda c: c["tail"]).alias("tails"), _sums_before(gaps).alias("sums")))
    out = _let(cells, lambda cs: F.when(F.size(cs) == 0, nothing).otherwise(_let(sums(cs), lambda x: F.flatten(F.transform(starts(cs, x), placed)))))
    return F.when(text.rlike(PROPOSE_NEEDS[kind]), out).otherwise(nothing)


def _digit_count(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0)) <= 255)
    if kind == "card":
        return luhn_ok(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "phone":
        return _digit_count(m).between(10, 15)
    return F.lit(True)


def _checks(kind: str):
    return lambda c: _valid(kind, c["m"])


def _scored(kind: str, i: int, model: Boosted):
    """A proposal as (s, k, e, p), p its score; features are computed once for all trees."""
    score = lambda c: _let(F.array(*features(c, kind).values()), model.column)
    return lambda c: F.struct(c["s"].alias("s"), F.lit(i).alias("k"), c["e"].alias("e"), score(c).alias("p"))


def _above(threshold: float):
    return lambda c: c["p"] >= threshold


def _meets(c: Column):
    return lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])


def _beats(c: Column):
    """Whether another proposal takes the place of c: it meets c and scores more or, of equal score, is longer or comes first."""
    rank = lambda x: F.struct(x["p"], x["e"] - x["s"], -x["s"])
    return lambda b: _meets(c)(b) & (rank(b) > rank(c))


def _best(spans: Column) -> Column:
    """Those of an array of (s, k, e, p), by start, that no other beats."""
    beaten = lambda blocks: lambda c: F.exists(blocks, lambda x: _meets(c)(x) & F.exists(x["spans"], _beats(c)))
    return _let(spans, lambda all_: _let(_blocks(all_, "s:int,k:int,e:int,p:double"), lambda blocks: F.filter(all_, lambda c: ~beaten(blocks)(c))))


def _is_kind(i: int):
    return lambda s: s["k"] == i


def _spans(cells: Column, rank: int) -> Column:
    return F.transform(cells, lambda c: F.struct(c["s"].alias("s"), F.lit(rank).alias("k"), c["e"].alias("e")))


#: Spans that are passed over together where nothing of them is near.
_SPAN_BLOCK = 256


def _blocks(spans: Column, fields: str = "s:int,k:int,e:int") -> Column:
    """Sorted spans in blocks with the stretch that each covers, so that a look for overlaps need not go through all."""
    part = lambda b: F.slice(spans, b * _SPAN_BLOCK + 1, F.lit(_SPAN_BLOCK))
    whole = lambda p: F.struct(F.element_at(p, 1)["s"].alias("s"), F.array_max(F.transform(p, lambda x: x["e"])).alias("e"), p.alias("spans"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _SPAN_BLOCK).cast("int")), lambda b: _let(part(b), whole))
    return F.when(F.size(spans) > 0, blocks).otherwise(F.array().cast(f"array<struct<s:int,e:int,spans:array<struct<{fields}>>>>"))


def find_spans(docs: DataFrame, text_col: str = "text", seed: int = 11) -> DataFrame:
    """``docs`` plus ``base`` and ``spans``: arrays of (s, k, e), k numbering email, ip, card, phone.

    ``base``: matches of the base patterns that pass their checks. ``spans``: these and every
    proposal that the boosted trees score above their threshold, that overlaps no base span, and
    that no overlapping proposal of its kind beats by its score.
    Sorted by start, then kind, then end; offsets in code points, end exclusive. A null text is
    empty and has none. Row by row, without a shuffle.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__t", text)
    t = F.col("__t")
    for i, kind in enumerate(KINDS):
        rows = rows.withColumn(f"__b{i}", _spans(F.filter(_matches(t, BASE[kind], NEEDS[kind]), _checks(kind)), i))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.col(f"__b{i}") for i in range(len(KINDS))])))
    rows = rows.withColumn("__near", _blocks(F.col("base")))
    trees = models(seed)
    for i, kind in enumerate(KINDS):
        clear = lambda c: ~F.exists(F.col("__near"), lambda x: _meets(c)(x) & F.exists(x["spans"], _meets(c)))
        fresh = F.filter(F.transform(F.filter(_proposals(t, kind), clear), _scored(kind, i, trees[kind])), _above(trees[kind].threshold))
        rows = rows.withColumn(f"__p{i}", _spans(_best(fresh), i))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", *[F.col(f"__p{i}") for i in range(len(KINDS))])))
    return rows.select(*[named(c) for c in docs.columns if c not in ("base", "spans")], "base", "spans")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["s"].cast("string"), s["e"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    rows = find_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by [kind]; spans that overlap are replaced as one, by the first's kind."""
    rows = find_spans(docs, text_col)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    step = lambda acc, s: F.when(s["s"] >= acc["at"], F.struct(s["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["s"] - acc["at"]), F.element_at(names, s["k"] + 1)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["e"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(named(text_col).isNotNull(), done)).drop("base", "spans")
