"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np


class Groups:
    """Union of ids, named by the least."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def of(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        a, b = self.of(x), self.of(y)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def near_copies(docs):
    """{doc_id: (size of set, component)}"""
    sets = {i: shingles(t) for i, t in docs}
    g = Groups(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                g.join(a, b)
    return {i: (len(sets[i]), g.of(i)) for i in ids}


def repeats(docs, length):
    """{doc_id: (bytes, removed, spans, digest of what is kept)}"""
    raw = {i: (t or "").encode() for i, t in docs}
    places = defaultdict(list)
    for i, t in raw.items():
        for p in range(len(t) - length + 1):
            places[t[p:p + length]].append((i, p))
    hit = {i: np.zeros(len(t) + 1, int) for i, t in raw.items()}
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                hit[i][p] += 1
                hit[i][p + length] -= 1
    out = {}
    for i, t in raw.items():
        gone = np.cumsum(hit[i])[:len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[same + 1:] == b[same + 1:] if len(a) == len(b) else a[same:] == b[same + 1:]


def later_lines(docs, least):
    """{doc_id: text without lines that an earlier line is within one edit of}"""
    seen: list[str] = []
    out = {}
    for i, text in sorted(docs):
        if text is None:
            out[i] = None
            continue
        kept = []
        for raw in text.split("\n"):
            line = raw.strip(" ")
            if len(line) < least:
                kept.append(raw)
            else:
                if not any(one_edit(line, s) for s in seen):
                    kept.append(raw)
                seen.append(line)
        out[i] = "\n".join(kept)
    return out


def linked_vectors(rows, bound):
    """{vec_id: (links, component)}"""
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    g = Groups([i for i, _ in rows])
    links = dict.fromkeys((i for i, _ in rows), 0)
    good = [(i, np.array(v, float)) for i, v in rows if sound(v)]
    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= bound:
                links[i] += 1
                links[j] += 1
                g.join(i, j)
    return {i: (links[i], g.of(i)) for i in links}


def first_compatible(items, capacity, per_source):
    """Best fit by looking at every bin: (bin, place) for each (size, source, cluster)."""
    bins = []
    out = []
    for size, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins)
                if capacity - sum(x[0] for x in b) >= size and all(x[2] != cluster for x in b)
                and sum(x[1] == source for x in b) < per_source]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((size, source, cluster))
    return out
