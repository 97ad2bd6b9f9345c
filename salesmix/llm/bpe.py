"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match.  A sequence of tokens is the
BPE encoding exactly if every adjacent pair is stable: merging the pair's characters
yields the two tokens again, so that no merge ever crosses their border.  That is checked
for all pairs of a batch of words at once, on arrays: the piece left of the border grows
along the right edge of the first token, the piece right of it along the left edge of the
second, the lower rank first, and the pair fails if the two pieces' own merge comes before
both.  Words with a failing pair are merged exactly, rank by rank.

The vocabulary file must be of the kind "BPE with word ends, byte-level letters, lower
case".  Texts of plain Latin-1 letters are lower-cased and split here; any other text is
normalised and split into words by the tokenizers library's own rules, whose tables of
letters and digits differ from Python's.  Tokens are always found here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

WORD_CACHE = 400_000  # words whose tokens a task remembers; a speed matter only
# The split pattern of the vocabulary, for texts of Latin-1 letters.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_LATIN = "a-z\xdf-\xf6\xf8-\xff"
LATIN_WORD = re.compile(rf"{_ENDINGS}|[{_LATIN}]+|[0-9]|[^\s0-9{_LATIN}]+")
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xc0-\xff]*").fullmatch
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """Vocabulary with its merges, and the edges of every token's merge tree."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.texts = {i: t for t, i in {**self.vocab, **self.special}.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.path = path
        n = max(self.texts) + 1
        self.split: dict[int, tuple[int, int, int]] = {}
        for (a, b), (k, t) in sorted(self.ranks.items(), key=lambda x: x[1][0]):
            self.split.setdefault(t, (a, b, k))
        keys = np.array([a * n + b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.n = keys[order], n
        self.pair_ranks = np.array([k for k, _ in self.ranks.values()], dtype=np.int64)[order]
        self.right, self.right_rank = self._edges(1)
        self.left, self.left_rank = self._edges(0)
        self.guesses = self._reachable()
        self.longest = max(map(len, self.guesses), default=1)

    @cached_property
    def library(self):
        """The library's normaliser and word splitter, loaded when a text needs them."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _edges(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token: its pieces at one edge, smallest first, and the rank that ends each."""
        chains: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for t in range(self.n):
            chain, rank, at = [], NEVER, t
            while True:
                chain.append((at, rank))
                if at not in self.split:
                    break
                rank = self.split[at][2]
                at = self.split[at][side]
            chains[t] = chain[::-1]
        depth = max(map(len, chains))
        piece, rank = np.zeros((self.n, depth), np.int64), np.full((self.n, depth), NEVER)
        for t, chain in enumerate(chains):
            piece[t, :len(chain)] = [c[0] for c in chain]
            rank[t, :len(chain)] = [c[1] for c in chain]
        return piece, rank

    def stable(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether no merge crosses the border of each pair; with ``own``, before both are whole."""
        good = np.ones(len(a), dtype=bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = self.right[a[live], i[live]], self.left[b[live], j[live]]
            rx, ry = self.right_rank[a[live], i[live]], self.left_rank[b[live], j[live]]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            cross = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            whole = (rx == NEVER) & (ry == NEVER)
            # Of equal ranks the leftmost pair merges first.
            bad = (cross < rx) & (cross <= ry) & (cross != NEVER)
            if own:
                bad &= ~whole
            good[live[bad]] = False
            left_first = rx <= ry
            i[live] += left_first
            j[live] += ~left_first
            live = live[~bad & ~whole]
        return good

    def _reachable(self) -> dict[str, int]:
        """Tokens that merging their own characters yields; only they can be guessed."""
        ids = np.array(sorted(self.split, key=lambda t: self.split[t][2]), dtype=np.int64)
        parts = np.array([self.split[t][:2] for t in ids], dtype=np.int64).reshape(-1, 2)
        fine = dict(zip(ids.tolist(), self.stable(parts[:, 0], parts[:, 1], own=True).tolist(), strict=True))
        reached: dict[int, bool] = {}
        for t, (a, b) in zip(ids.tolist(), parts.tolist(), strict=True):
            reached[t] = fine[t] and reached.get(a, True) and reached.get(b, True)
        return {s: t for s, t in self.vocab.items() if reached.get(t, True)}

    def symbols(self, word: str) -> list[str]:
        """A word's characters as the vocabulary writes them, the last with the word end."""
        if not word.isascii() or not word.isprintable():
            word = "".join(self.letters[b] for b in word.encode("utf-8", "surrogatepass"))
        return [*word[:-1], word[-1] + self.end]

    def guess(self, word: str) -> list[int]:
        if not word.isascii() or not word.isprintable():
            word = "".join(self.letters[b] for b in word.encode("utf-8", "surrogatepass"))
        out, i, n, have = [], 0, len(word), self.guesses
        whole = word + self.end
        while i < n:
            if n - i <= self.longest and (t := have.get(whole[i:])) is not None:
                out.append(t)
                break
            for z in range(min(n - 1, i + self.longest), i, -1):
                if (t := have.get(word[i:z])) is not None:
                    out.append(t)
                    i = z
                    break
            else:
                return []  # no token fits: left to exact merging
        return out

    def merge(self, word: str) -> list[int]:
        """Exact BPE: the lowest rank first, leftmost of equals."""
        ids = [self.vocab[s] for s in self.symbols(word)]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.ranks[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.ranks[pair][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (p := (ids[left], ids[right])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p][0], left, p))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: guessed, checked together, merged where the check fails."""
        found = [self.guess(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.array([t for f in found for t in f], dtype=np.int64)
        bad = sizes == 0
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(found)), sizes)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            key, back = np.unique(flat[pair] * self.n + flat[pair + 1], return_inverse=True)
            good = self.stable(key // self.n, key % self.n)[back]
            bad[owner[pair[~good]]] = True
        for k in np.flatnonzero(bad):
            found[k] = self.merge(words[k])
        return found

    def words(self, text: str) -> list[str]:
        """Words in text order; special tokens are marked by a leading NUL."""
        found = self.by_special.split(text) if self.by_special else [text]
        if len(found) == 1 and PLAIN(text):
            return LATIN_WORD.findall(text.lower())
        out = []
        for part in found:
            if part in self.special:
                out.append("\x00" + part)
            elif part:
                low = self.library.normalizer.normalize_str(part)
                for s, _ in self.library.pre_tokenizer.pre_tokenize_str(low):
                    out.append(bytes(self.byte_of[c] for c in s).decode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as a vocabulary without a decoder is decoded."""
        return " ".join(self.texts[i] for i in ids if i in self.texts)


@lru_cache(maxsize=4)
def loaded(name: str) -> Bpe:
    return Bpe(SparkFiles.get(name))


class Encoder:
    """Texts to tokens, remembering the words of a task."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.known = bpe, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > WORD_CACHE:
            self.known = {}
        fresh = [w for w in words if w not in self.known]
        ordinary = [w for w in fresh if w[:1] != "\x00"]
        for w, ids in zip(ordinary, self.bpe.encode_words(ordinary), strict=True):
            self.known[w] = (len(ids), " ".join(map(str, ids)), self.bpe.decode(ids))
        for w in fresh:
            # A NUL that is text, not a mark, is a word of its own kind.
            if w[:1] == "\x00":
                t = self.bpe.special.get(w[1:])
                ids = [t] if t is not None else self.bpe.encode_words([w])[0]
                self.known[w] = (len(ids), " ".join(map(str, ids)), self.bpe.decode(ids))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by spaces and decoded text, for each text."""
        split = [self.bpe.words(t) for t in texts]
        self.learn(set().union(*split))
        out = []
        for words in split:
            got = [self.known[w] for w in words]
            out.append((sum(g[0] for g in got), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])))
        return out


def ship_vocabulary(df: DataFrame, path: str) -> str:
    """Send the vocabulary file to the executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for every row of ``docs`` (doc_id, text).

    ``ids`` are decimal and joined by single spaces.  A null text counts as empty, with no
    tokens and empty strings.  Other columns are ignored; repeated rows are encoded each.
    """
    return _encoded(docs, path, lambda s: s, ("ids", "decoded"))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encoded`` with SHA-256 of its strings."""
    return _encoded(docs, path, lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest(),
                    ("ids_sha256", "decoded_sha256"))


def _encoded(docs: DataFrame, path: str, shown, names: tuple[str, str]) -> DataFrame:
    name = ship_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(loaded(name))
        for b in batches:
            if b.num_rows:
                got = encoder.encode([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()),
                     *(pa.array([shown(g[k]) for g in got], pa.string()) for k in (1, 2))],
                    ["doc_id", "n_tokens", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, {names[0]} string, {names[1]} string")
