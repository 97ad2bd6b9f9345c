"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

* The kernel compares a word (with its ends marked) and a landmark string by the
  subsequences of three letters, of any script, they share.  A subsequence may skip one
  character at each step and counts less the longer it is, so `id-iot` and `i.d.i.o.t`
  still resemble `idiot`; single letters in a row are also read as one word.
* A sentence is described by its best kernel value against each landmark, mapped by
  Nystroem's method, K(Z,Z)^(-1/2) k(s, Z).  Values under ``FLOOR`` count as nothing, in
  training as in scoring.
* The machine learns from sentences.  Labels belong to documents, so a sentence is
  negative if its document is, and positive if its document is and it holds one of the
  strings that tell the classes apart; other sentences of positive documents are left out.
* A document's score is the calibrated decision of its worst sentence.

Landmarks are all words, word beginnings and phrases of two or three words of the training
texts that are more frequent in positive documents than chance explains.  A phrase counts by
the least kernel value of its words.  The model is fitted on the driver on a bounded sample
(``max_positive``, ``max_negative`` documents, smallest hashes first); fitting takes a few
matrices of landmarks by landmarks, the model only some entries a landmark.  Every whole
text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY, MAX_STEP, FLOOR = 0.8, 2, 0.5
BREAK = "\x00"  # a token of its own where a line ends
# A landmark is in so many positive documents; chance is ruled out by a likelihood ratio far
# beyond it among a million strings, or by a share of chance strings among those that pass.
LEAST, STRIKING, BY_CHANCE = 5, 12.0, 0.01
CACHE_WORDS = 300_000  # words whose kernel values a task remembers; a speed matter only

# Look-alikes read as letters.  Letters and marks of every script stand for
# themselves; three code points of 21 bits make one code.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
OTHER, EDGE, BITS = 1, 2, 21
LETTERS_END = 0x40000  # Unicode has no letters or marks beyond, but for invisible selectors


def _code_table() -> np.ndarray:
    table = np.full(LETTERS_END + 1, OTHER, dtype=np.int64)
    for point in range(LETTERS_END):
        if category(chr(point))[0] in "LM":
            table[point] = point
    for c, letter in LOOKALIKES.items():
        table[ord(c)] = ord(letter)
    return table


def _alphabets() -> np.ndarray:
    """A bit each for Latin, Greek, Cyrillic and all other letters; marks go with any."""
    table = np.zeros(LETTERS_END + 1, dtype=np.int8)
    for bit, spans in ((1, ((0x41, 0x250), (0x1E00, 0x1F00))), (2, ((0x370, 0x400), (0x1F00, 0x2000))),
                       (4, ((0x400, 0x530),)), (8, ((0x530, 0x1E00), (0x2000, LETTERS_END)))):
        for a, b in spans:
            table[a:b] = bit
    return table


CODES, ALPHABETS = _code_table(), _alphabets()
STEPS = [(a, b) for a in range(1, MAX_STEP + 1) for b in range(1, MAX_STEP + 1)]
# Taken off both ends of a word.
EDGES = ("".join(map(chr, range(33, 48))) + ":;<=>?@[]^_`{|}~\\"
         "¡¿«»‹›„“”‚‘’…–—·،؛؟۔।॥、。！？，．：；・「」『』（）《》〈〉【】")
ENDS = frozenset(".!?|؟۔।॥。！？．")  # end a sentence
# Scripts that put no space between words: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u3096\u3099-\u309f"
                       "\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
                       "\U00020000-\U0003ffff]+")
_SPELT = re.compile(r"(?<!\S)(?:\w[\W_]? ){2,}\w(?!\S)")


def _grams(run: re.Match) -> str:
    """A run of letters without spaces as its letters and all strings of two and three."""
    r = run.group()
    return " ".join(["", *(r[k:k + n] for n in (1, 2, 3) for k in range(len(r) - n + 1)), ""])


def _apart(words: list[str]) -> list[str]:
    """Words of scripts without spaces taken apart; if mixed with others also kept."""
    out = []
    for w in words:
        if not _UNSPACED.search(w):
            out.append(w)
        else:
            out += _UNSPACED.sub(_grams, w).split()
            if not _UNSPACED.fullmatch(w.strip(EDGES)):
                out.append(w)
    return out


def tokens(text: str) -> list[str]:
    """Lower-cased words; a break token for each line end; spelt-out words joined too.

    Where a script has no spaces, every string of up to three letters is a word.
    """
    text = text.lower()
    spelt = [re.sub(r"[\W_]", "", m) for m in _SPELT.findall(text)]
    words = text.replace("\n", f" {BREAK} ").split()
    for w in spelt:
        words += [BREAK, w]
    return words if text.isascii() or not _UNSPACED.search(text) else _apart(words)


def _occurrences(words: list[str], open_end: bool = False) -> tuple[np.ndarray, ...]:
    """Word number, subsequence code and weight of every subsequence of each word."""
    cleaned = [w.strip(EDGES) for w in words]
    joined = "".join(f"\x01{w}\x02" for w in cleaned)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = CODES[np.minimum(points, len(CODES) - 1)]
    alphabet = ALPHABETS[codes]
    ends = points <= 2
    codes[ends] = EDGE
    if open_end:  # a word beginning has no end mark
        codes[points == 2] = 0
    sizes = np.fromiter((len(w) + 2 for w in cleaned), np.int64, len(cleaned))
    owner = np.repeat(np.arange(len(words)), sizes)
    parts = []
    for a, b in STEPS:
        reach = a + b
        if len(codes) <= reach:
            continue
        at = np.flatnonzero(owner[:-reach] == owner[reach:])
        x, y, z = codes[at], codes[at + a], codes[at + reach]
        # A Cyrillic letter between Latin ones is a disguise, skipped like a sign.
        mixed = alphabet[at] | alphabet[at + a] | alphabet[at + reach]
        good = (x > OTHER) & (y > OTHER) & (z > OTHER) & (mixed & (mixed - 1) == 0)
        at = at[good]
        parts.append((owner[at], ((x << 2 * BITS) + (y << BITS) + z)[good],
                      np.full(len(at), DECAY ** (reach - 2))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


@dataclass
class Kernel:
    """Landmarks as a sparse table: subsequence code to (landmark, weight) entries."""

    landmarks: list[str]

    def __post_init__(self):
        # A landmark that starts with ^ is a word beginning; one with spaces is a phrase, whose
        # words are compared each, after the other landmarks; the rest are whole words.
        phrases = [t.split() for t in self.landmarks if " " in t]
        self.strings = [t for t in self.landmarks if " " not in t]
        self.landmarks = self.strings + [" ".join(t) for t in phrases]
        self.singles = len(self.strings)
        self.strings += sorted({w for t in phrases for w in t})
        part = {w: k for k, w in enumerate(self.strings) if k >= self.singles}
        self.phrases: dict[int, list[tuple[int, list[int]]]] = {}  # by first word
        for k, (first, *rest) in enumerate(phrases):
            self.phrases.setdefault(part[first], []).append((self.singles + k, [part[w] for w in rest]))
        self.silent: dict[str, list[int]] = {}  # without letters: equal or not
        entries: list[tuple[int, int, float]] = []
        norms = []
        for z, text in enumerate(self.strings):
            _, code, weight = _occurrences([text.lstrip("^")], open_end=text[:1] == "^")
            vec = np.bincount(np.unique(code, return_inverse=True)[1], weight) if len(code) else []
            if not len(code):
                self.silent.setdefault(text, []).append(z)
            norms.append(float(np.sqrt(np.sum(np.square(vec)))) or 1.0)
            entries += zip(np.unique(code), [z] * len(vec), vec, strict=True) if len(code) else []
        entries.sort()
        self.norms = np.array(norms)
        self.open_end = np.array([t[:1] == "^" for t in self.strings], dtype=bool)
        code = np.array([e[0] for e in entries], dtype=np.int64)
        self.z = np.array([e[1] for e in entries], dtype=np.int64)
        self.weight = np.array([e[2] for e in entries])
        self.codes, self.first, self.many = np.unique(code, return_index=True, return_counts=True)

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number, string and normalised kernel value, where it reaches FLOOR."""
        w, z, v = self._alike(words)
        if self.silent:
            equal = [(k, e) for k, t in enumerate(words) for e in self.silent.get(t.strip(EDGES), ())]
            if equal:
                more = np.array(equal, dtype=np.int64)
                w, z, v = np.r_[w, more[:, 0]], np.r_[z, more[:, 1]], np.r_[v, np.ones(len(more))]
                order = np.argsort(w, kind="stable")
                w, z, v = w[order], z[order], v[order]
        return w, z, v

    def _alike(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        owner, code, weight = _occurrences(words)
        m = len(self.strings)
        own = np.sqrt(np.bincount(owner, weight ** 2, minlength=len(words)))
        if not len(self.codes):
            return none
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[place] == code)
        if not len(hit):
            return none
        place = place[hit]
        many = self.many[place]
        src = np.repeat(hit, many)
        run = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.first[place], many) + run
        found, total = np.unique(owner[src] * m + self.z[entry], return_inverse=True)
        total = np.bincount(total, weight[src] * self.weight[entry], minlength=len(found))
        w, z = found // m, found % m
        # A beginning counts by how much of it the word has, a whole word by the cosine.
        size = np.where(self.open_end[z], self.norms[z], own[w])
        value = total / (size * self.norms[z])
        keep = value >= FLOOR
        return w[keep], z[keep], np.minimum(value[keep], 1.0)


@dataclass
class Model:
    kernel: Kernel
    direction: np.ndarray  # on kernel values: Nystroem map and machine in one vector
    offset: float
    slope: float  # calibration
    level: float

    def worst(self, sentences: list[dict[int, float]]) -> float:
        """The largest decision of a text's sentences, 0 without any."""
        d = self.direction
        return max((float(sum(v * d[z] for z, v in s.items())) for s in sentences), default=0.0)

    def probability(self, decision):
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.level, -30, 30)))


class Describer:
    """Sentence features of texts, remembering words already compared."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.known, self.rows = kernel, set(), {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known, self.rows = set(), {}
        fresh = list(words - self.known)
        if not fresh:
            return
        self.known.update(fresh)
        for k in range(0, len(fresh), 2_000):  # bounds the memory of one comparison
            some = fresh[k:k + 2_000]
            for w, z, v in zip(*(x.tolist() for x in self.kernel.values(some)), strict=True):
                self.rows.setdefault(some[w], {})[z] = v

    def sentences(self, words: list[str]) -> list[dict[int, float]]:
        """Best kernel values by landmark of each sentence that has any."""
        rows, singles, phrases = self.rows, self.kernel.singles, self.kernel.phrases
        out, best = [], {}
        if rows.keys().isdisjoint(words):
            return out
        begun: list[tuple[int, list[int], float]] = []  # landmark, words to come, least value
        for w in words:
            row = rows.get(w)
            if row is not None:
                for z, v in row.items():
                    if z < singles and v > best.get(z, 0.0):
                        best[z] = v
            if begun or (phrases and row is not None):
                row = row or {}
                going = []
                for z, rest, v in begun:
                    v = min(v, row.get(rest[0], 0.0))
                    if v and len(rest) > 1:
                        going.append((z, rest[1:], v))
                    elif v > best.get(z, 0.0):
                        best[z] = v
                if row or w.strip(EDGES):  # a sign of its own does not part a phrase
                    begun = going + [(z, rest, v) for k, v in row.items() for z, rest in phrases.get(k, ())]
            if w == BREAK or w[-1] in ENDS:
                begun = []
                if best:
                    out.append(best)
                    best = {}
        return [*out, best] if best else out


def _units(words) -> set[str]:
    """Whole words and word beginnings that can become landmarks."""
    found = set()
    for w in words:
        w = w.strip(EDGES)
        if _UNSPACED.fullmatch(w):
            found.add(w)
        elif len(w) >= 3:
            found.add(w)
            found.update("^" + w[:k] for k in range(3, min(len(w), 10)))
    return found


def _telling(a: np.ndarray, b: np.ndarray, p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings, in a of p positive and b of n negative documents, tell the classes
    apart, and the likelihood ratios of all.

    Those beyond STRIKING do, and as many more as keep the expected share of chance
    strings at BY_CHANCE (Benjamini and Hochberg).
    """
    together = (a + b) / (p + n)
    g = a * np.log(a / p / together) + b * np.log(np.maximum(b, 1) / n / together)
    good = a / p > 8 * (b + 0.5) / n
    ranked = np.sort(np.where(good, g, 0.0))[::-1]
    enough = np.flatnonzero(ranked >= np.log(len(g) / BY_CHANCE / np.arange(1, len(g) + 1)))
    least = min(STRIKING, ranked[enough[-1]] if len(enough) else STRIKING)
    return good & (g >= least), g


def _phrase_codes(words: list[str], number: dict[str, int]) -> np.ndarray:
    """Codes of the phrases of two and three numbered words inside sentences."""
    row = []
    for w in words:
        bare = w.strip(EDGES)
        if bare:
            row.append(number.get(bare, 0))
        if w == BREAK or w[-1] in ENDS:
            row.append(0)
    r = np.array(row, dtype=np.int64)
    two = ((r[:-1] << 2 * BITS) | (r[1:] << BITS))[(r[:-1] > 0) & (r[1:] > 0)]
    x, y, z = r[:-2], r[1:-1], r[2:]
    three = ((x << 2 * BITS) | (y << BITS) | z)[(x > 0) & (y > 0) & (z > 0)]
    return np.unique(np.r_[two, three])


def _choose_words(texts: list[list[str]], labels: np.ndarray, p: int, n: int) -> list[tuple]:
    pos, neg = Counter(), Counter()
    for words, y in zip(texts, labels, strict=True):
        if y:
            pos.update(_units(set(words)))
    units = [u for u, a in pos.items() if a >= LEAST]
    known = set(units)
    for words, y in zip(texts, labels, strict=True):
        if not y:
            neg.update(_units(set(words)) & known)
    if not units:
        return []
    telling, g = _telling(np.array([pos[u] for u in units]), np.array([neg[u] for u in units]), p, n)
    ratio = {units[k]: float(g[k]) for k in np.flatnonzero(telling)}
    inside: dict[str, set[int]] = {u: set() for u in ratio}
    for k in np.flatnonzero(labels):
        for u in ratio.keys() & _units(set(texts[k])):
            inside[u].add(int(k))
    # Of strings in the same documents the longest says most.  A beginning, a word of it or a
    # longer word are left out where those chosen already have the documents.
    chosen: list[tuple] = []
    shorter: dict[str, set[int]] = {}
    longer: dict[str, set[int]] = {}
    for u in sorted(ratio, key=lambda u: (-round(ratio[u], 9), -len(u.lstrip("^")), u)):
        bare = u.lstrip("^")
        had = longer.get(bare, set()).union(*(shorter.get(bare[:k], ()) for k in range(1, len(bare) + 1)))
        if len(inside[u] - had) >= LEAST:
            chosen.append((ratio[u], u))
            shorter.setdefault(bare, set()).update(inside[u])
            for k in range(1, len(bare) + 1):
                longer.setdefault(bare[:k], set()).update(inside[u])
    return chosen


def _choose_phrases(texts: list[list[str]], labels: np.ndarray, p: int, n: int,
                    taken: set[str]) -> list[tuple]:
    """Phrases of words that are no landmarks themselves."""
    often = Counter()
    for k in np.flatnonzero(labels):
        often.update({w.strip(EDGES) for w in texts[k]} - {""})
    names = [""] + sorted(w for w, a in often.items() if a >= LEAST and w != BREAK and w not in taken
                          and not any("^" + w[:k] in taken for k in range(1, len(w) + 1)))
    number = {w: k for k, w in enumerate(names) if k}
    rows = [_phrase_codes(texts[k], number) for k in np.flatnonzero(labels)]
    codes, a = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_counts=True)
    codes, a = codes[a >= LEAST], a[a >= LEAST]
    if not len(codes):
        return []

    def known(found):
        place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        return place[codes[place] == found]

    b = np.zeros(len(codes), np.int64)
    for k in np.flatnonzero(labels == 0):
        b[known(_phrase_codes(texts[k], number))] += 1
    telling, g = _telling(a, b, p, n)
    inside: dict[int, set[int]] = {int(k): set() for k in np.flatnonzero(telling)}
    for doc, found in enumerate(rows):
        for k in known(found)[telling[known(found)]].tolist():
            inside[k].add(doc)
    last = (1 << BITS) - 1
    phrase = {k: tuple(names[c] for c in (int(codes[k]) >> 2 * BITS, int(codes[k]) >> BITS & last,
                                          int(codes[k]) & last) if c) for k in inside}
    chosen: list[tuple] = []
    whole: dict[tuple, set[int]] = {}
    for k in sorted(inside, key=lambda k: (-round(float(g[k]), 9), -len(phrase[k]), phrase[k])):
        near = {phrase[k], phrase[k][:2], phrase[k][-2:]}
        if len(inside[k].difference(*(whole.get(t, ()) for t in near))) >= LEAST:
            chosen.append((float(g[k]), " ".join(phrase[k])))
            for t in near:
                whole.setdefault(t, set()).update(inside[k])
    return chosen


def _families(texts: list[list[str]]) -> list[list[int]]:
    """Texts by near copies: half of 64 least hashes of their word triples agree."""
    turns = np.random.default_rng(1).integers(0, 1 << 63, 64, dtype=np.uint64) * 2 + 1
    marks = np.zeros((len(texts), 64), dtype=np.uint64)
    number: dict[str, int] = {}
    for k, words in enumerate(texts):
        ids = np.array([number.setdefault(w, len(number) + 1) for w in words] + [0, 0], dtype=np.uint64)
        h = (ids[:-2] << 42) ^ (ids[1:-1] << 21) ^ ids[2:] if len(words) else ids[:1]
        h = np.unique(h) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        marks[k] = [(h * t).min() for t in turns]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for band in range(0, 64, 4):
        first: dict[bytes, int] = {}
        for k in range(len(texts)):
            other = first.setdefault(marks[k, band:band + 4].tobytes(), k)
            if other != k and top(k) != top(other) and (marks[k] == marks[other]).mean() >= 0.5:
                root[top(k)] = top(other)
    found: dict[int, list[int]] = {}
    for k in range(len(texts)):
        found.setdefault(top(k), []).append(k)
    return list(found.values())


def choose_landmarks(texts: list[list[str]], labels: np.ndarray, count: int | None = None) -> list[str]:
    """Strings that tell the positive class, best first: all of them, or ``count``.

    Near copies are no evidence of their own, so those of a class count as one text that
    has the words of all.
    """
    one, ones = [], []
    for y in (0, 1):
        own = [t for t, label in zip(texts, labels, strict=True) if label == y]
        for family in _families(own):
            one.append(own[family[0]] if len(family) == 1 else [w for k in family for w in (*own[k], BREAK)])
            ones.append(y)
    texts, labels = one, np.array(ones, dtype=int)
    p, n = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    words = _choose_words(texts, labels, p, n)
    phrases = _choose_phrases(texts, labels, p, n, {u for _, u in words})
    both = sorted(words + phrases, key=lambda c: -c[0])
    return [u for _, u in both[:count]]


def _svm(rows: list[dict[int, float]], y: np.ndarray, weight: np.ndarray, ridge: np.ndarray,
         c: float = 10.0) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last coefficient is the offset."""
    m = len(ridge) + 1
    ridge = np.pad(ridge, (0, 1))
    ridge[-1, -1] = 1e-6
    size = np.array([len(r) + 1 for r in rows])
    start = np.cumsum(size) - size
    at = np.array([z for r in rows for z in (*r, m - 1)])
    value = np.array([v for r in rows for v in (*r.values(), 1.0)])
    owner = np.repeat(np.arange(len(rows)), size)
    w = np.zeros(m)
    for _ in range(30):
        decision = np.bincount(owner, value * w[at], minlength=len(rows))
        on = (y * decision < 1) * weight * c
        gram = ridge.copy()
        for k in np.flatnonzero(on):
            cut = slice(start[k], start[k] + size[k])
            gram[np.ix_(at[cut], at[cut])] += on[k] * np.outer(value[cut], value[cut])
        pull = np.bincount(at, value * (on * (y - decision))[owner], minlength=m)
        step = np.linalg.solve(gram, ridge @ w - pull)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _calibrate(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on decisions, slightly smoothed."""
    x, w = np.c_[d, np.ones(len(d))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(h, x.T @ (p - y) + np.array([1e-2, 1e-2]) * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit_rows(texts: list[str], labels: list[int], landmarks: int | None = None) -> Model:
    """Fit on texts in memory.  Without any positive text every score is low."""
    pairs = sorted({(t or "", int(y)) for t, y in zip(texts, labels, strict=True)})
    y = np.array([p[1] for p in pairs], dtype=int)
    same: dict[str, str] = {}  # a word is held once, however often it occurs
    split = [[same.setdefault(w, w) for w in tokens(p[0])] for p in pairs]
    del texts, pairs, same
    chosen = choose_landmarks(split, y, landmarks)
    kernel = Kernel(chosen)
    if not chosen:
        return Model(kernel, np.zeros(0), -1.0, 1.0, -2.0)
    describe = Describer(kernel)
    alike: Counter = Counter({((), -1): 1})  # sentences with the same values are one row
    per_doc = []
    for words, label in zip(split, y, strict=True):
        describe.learn(set(words))
        found = describe.sentences(words)
        per_doc.append(found)
        for s in found:
            if not label or max(s.values()) >= 0.8:
                alike[tuple(sorted(s.items())), 1 if label else -1] += 1
    ys, many = np.array([k[1] for k in alike]), np.array(list(alike.values()))
    zz = np.eye(len(kernel.landmarks))
    for k, text in enumerate(kernel.landmarks):
        words = text.lstrip("^").split()
        describe.learn(set(words))
        for s in describe.sentences(words):
            zz[k, list(s)] = list(s.values())
    zz = (zz + zz.T) / 2
    np.fill_diagonal(zz, 1.0)
    val, vec = np.linalg.eigh(zz)
    ridge = (vec * np.maximum(val, 0.05)) @ vec.T  # the machine's weights are in this metric
    total, above = many.sum(), many[ys > 0].sum()
    balance = np.where(ys > 0, total / (2 * max(1, above)), total / (2 * (total - above)))
    w = _svm([dict(k[0]) for k in alike], ys, balance * many, ridge)
    model = Model(kernel, w[:-1], float(w[-1]), 1.0, 0.0)
    worst = np.array([model.worst(found) for found in per_doc])
    model.slope, model.level = _calibrate(np.maximum(worst, 0) + model.offset, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_negative: int = 4000,
        landmarks: int | None = None) -> Model:
    """Fit on at most so many labelled documents of each class, smallest id hashes first.

    ``labels`` (doc_id, toxic) says which documents may be used.  Rows with a null label
    are not used; a null text counts as empty.  ``landmarks`` bounds their number, if given.  The chosen ids are at most the two
    bounds, so they are sent to the readers of ``docs`` and no text is shuffled.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
              for y, most in ((1, max_positive), (0, max_negative))]
    ids = chosen[0].unionByName(chosen[1])
    return fit_rows(*_columns(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                              .join(F.broadcast(ids), "doc_id").select("text", "toxic")
                              .limit(max_positive + max_negative)), landmarks)


def _columns(bounded: DataFrame) -> list[list]:
    """The columns of a few rows; only the fit holds them, which lets go of the texts once they are split."""
    rows = bounded.collect()
    return [[r[k] for r in rows] for k in range(len(bounded.columns))]


def score_texts(model: Model, texts: list[str], describe: Describer) -> np.ndarray:
    split = [tokens(t or "") for t in texts]
    describe.learn(set().union(*split))
    worst = np.array([model.worst(describe.sentences(words)) for words in split])
    return model.probability(np.maximum(worst, 0) + model.offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts, like texts without any resemblance to a landmark, get the
    lowest score.  Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(shared.value.kernel)
        for b in batches:
            if b.num_rows:
                s = score_texts(shared.value, b.column("text").to_pylist(), describe)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(shared.value.kernel)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(score_texts(shared.value, b.column("text").to_pylist(), describe) < threshold))

    return docs.mapInArrow(run, docs.schema)
