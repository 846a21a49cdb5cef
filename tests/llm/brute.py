"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def near_duplicates(docs):
    sets = {i: shingles(t) for i, t in docs}
    comp = components(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def lines(docs, least=10):
    held = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(k := key(x)) >= least and len(held[k]) > 1 and min(held[k]) != i)]
        out.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def suffixes(docs, n=200):
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = collections.Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = 1
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def near_vectors(rows, least=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    link = lambda a, b: len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= least
    comp = components(good, link)
    return {i: (sum(link(i, j) for j in good if j != i) if i in good else 0, comp.get(i, i)) for i, _ in rows}


def top_k(rows, k=10):
    good = {i: np.floor(np.array(v, float) * 1024).astype(np.int64) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all()}
    out = []
    for q in sorted(i for i in good if i % 100 == 0):
        scored = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def best_pieces(text, pieces, unknown, byte_ids):
    """Ids of the segmentation with the highest sum of scores; of equal ones each place is reached by the piece that starts first.

    ``pieces``: text -> (score, id), with whole scores. Characters without a piece cost ``unknown`` and give their UTF-8 bytes' ids.
    """
    s = ("▁" + text if text else "").replace(" ", "▁")
    longest = max(map(len, pieces))
    best, way = [0] + [None] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for a in range(max(0, end - longest), end):
            found = pieces.get(s[a:end])
            if found is None and end - a == 1:
                found = (unknown, None)
            if found is not None and (best[end] is None or best[a] + found[0] > best[end]):
                best[end], way[end] = best[a] + found[0], (a, found[1])
    ids, at = [], len(s)
    while at:
        a, i = way[at]
        ids += [i] if i is not None else [byte_ids[b] for b in s[a:at].encode()][::-1]
        at = a
    return ids[::-1]
