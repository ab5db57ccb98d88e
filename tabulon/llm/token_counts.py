"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Texts are cut into pre-tokens. The distinct new ones of a batch become one flat array of symbols with sequence
borders. In each round all sequences find their lowest-ranked adjacent pair and merge all of its occurrences
at once; a sequence with no mergeable pair leaves with its number of symbols. A merge result ranks behind the
merge that made it, so merging every occurrence in one round gives what one merge at a time gives.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

# Fixed value: how byte-level vocabularies of this kind cut text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = 0x250  # below this code point the pattern also runs on the faster standard engine
_NONE = np.int64(1) << 40
_LONG = 1 << 22  # characters from which pre-tokens are taken in parts
_KNOWN = 500_000  # pre-tokens remembered by a task before it starts afresh


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def plain_pattern() -> re.Pattern:
    """PRE_TOKEN for texts of code points below _PLAIN, with letters and numbers spelled out."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(_PLAIN)]
    spelled = {k: "".join(re.escape(chr(c)) for c in range(_PLAIN) if kinds[c] == k) for k in "LN"}
    return re.compile(
        PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{spelled['L']}{spelled['N']}]")
        .replace(r"\p{L}", f"[{spelled['L']}]")
        .replace(r"\p{N}", f"[{spelled['N']}]")
    )


class Vocabulary:
    """Merge table of a tokenizer file: sorted pair keys with their ranks and results, byte ids, special strings."""

    def __init__(self, source: str):
        spec = json.loads(source)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.fromiter((ids[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((ids[b] for _, b in pairs), np.int64, len(pairs))
        made = np.fromiter((ids[a + b] for a, b in pairs), np.int64, len(pairs))
        keys = left << 32 | right
        self.rank = np.argsort(keys, kind="stable").astype(np.int64)
        self.keys, self.made = keys[self.rank], made[self.rank]
        self.of_byte = np.array([ids[s] for s in byte_symbols()], np.int64)
        marks = [t["content"] for t in spec.get("added_tokens", [])]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(marks, key=len, reverse=True)))) if marks else None

    def lookup(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and place in the merge table of every pair key."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank[at], _NONE), at

    def sizes(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols left of every non-empty word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank, at = np.empty(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        stale = np.ones(len(symbols), bool)  # symbols whose pair with the next one is not looked up yet
        while len(symbols):
            border = owner[1:] != owner[:-1]
            rank[stale] = _NONE
            fresh = np.flatnonzero(stale[:-1] & ~border)
            rank[fresh], at[fresh] = self.lookup(symbols[fresh] << 32 | symbols[fresh + 1])
            first = np.flatnonzero(np.r_[True, border])
            least = np.minimum.reduceat(rank, first)
            spread = np.diff(np.r_[first, len(symbols)])
            done = least == _NONE
            out[owner[first[done]]] = spread[done]
            hit = _alternate(rank == np.repeat(np.where(done, -1, least), spread))
            symbols = np.where(hit, self.made[at], symbols)
            stay = np.r_[True, ~hit[:-1]] & np.repeat(~done, spread)
            symbols, owner, rank, at, hit = symbols[stay], owner[stay], rank[stay], at[stay], hit[stay]
            stale = hit | np.r_[hit[1:], False]
        return out


def _alternate(hit: np.ndarray) -> np.ndarray:
    """Of neighbouring hits (a pair of equal symbols in a run) the first, third and so on."""
    place = np.arange(len(hit))
    opened = np.maximum.accumulate(np.where(hit & np.r_[True, ~hit[:-1]], place, 0))
    return hit & ((place - opened) % 2 == 0)


class Counter:
    """Counts of whole texts; remembers pre-tokens it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.any, self.plain = regex.compile(PRE_TOKEN), plain_pattern()
        self.odd = re.compile(f"[\x1c-\x1f{chr(_PLAIN)}-{chr(0x10FFFF)}]")  # the engines differ on these spaces

    def engine(self, text: str):
        return self.any if self.odd.search(text) else self.plain

    def _parts(self, text: str) -> Iterator[list[str]]:
        if len(text) <= _LONG:
            yield self.engine(text).findall(text)
            return
        found = (m[0] for m in self.engine(text).finditer(text))
        while part := list(islice(found, 1 << 18)):
            yield part

    def learn(self, tokens: list[str] | set[str]) -> None:
        new = [t for t in set(tokens) if t not in self.known]
        if len(self.known) > _KNOWN:
            self.known.clear()
            new = list(set(tokens))
        if new:
            self.known.update(zip(new, self.vocabulary.sizes([t.encode() for t in new]).tolist()))

    def count(self, text: str) -> int:
        total, pieces = 0, [text]
        if self.vocabulary.marks:
            pieces = self.vocabulary.marks.split(text)
            total = len(pieces) - 1
        for piece in pieces:
            for tokens in self._parts(piece):
                self.learn(tokens)
                total += sum(map(self.known.__getitem__, tokens))
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        """Counts of a batch; pre-tokens of many short texts are merged together."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size > _LONG // 4:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[str]) -> Iterator[int]:
        """Cut the texts once, merge all new pre-tokens together, then add up."""
        cut = self.vocabulary.marks.split if self.vocabulary.marks else lambda t: [t]
        short = [[self.engine(p).findall(p) for p in cut(t)] if len(t) <= _LONG else None for t in group]
        self.learn({w for pieces in short if pieces for tokens in pieces for w in tokens})
        size = self.known.__getitem__
        for text, pieces in zip(group, short):
            if pieces is None:
                yield self.count(text)
            else:
                yield len(pieces) - 1 + sum(sum(map(size, tokens)) for tokens in pieces)


def token_count(text: Column, vocabulary_json: str) -> Column:
    """Number of tokens of the whole text; null counts as empty (0).

    ``vocabulary_json`` is the content of a byte-level BPE tokenizer file. Special strings inside a text
    count as one token each, nothing is added, cut or padded.
    """

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(Vocabulary(vocabulary_json))
        for texts in batches:
            yield pa.array(counter.counts(texts.to_pylist()), pa.int64())

    return run(text)
