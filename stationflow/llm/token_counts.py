"""Greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import unused
from stationflow.llm.tokens import _ALPHABET

#: A word takes the space before it along; white space is otherwise a word of its own.
_WORDS = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+").findall
_BYTES = {chr(v): b for b, v in _ALPHABET.items()}


class LongestMatch:
    """Trie of a vocabulary of byte strings with failure links.

    ``fail[v]`` is the node reached from v's string once the pieces that greedy longest
    matching is bound to take first are popped, and ``popped[v]`` their number. So a word is
    counted in one pass over its bytes, without building a piece or stepping back.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        end = [False]
        for piece in vocabulary:
            v = 0
            for b in piece:
                if b not in self.next[v]:
                    self.next[v][b] = len(self.next)
                    self.next.append({})
                    end.append(False)
                v = self.next[v][b]
            end[v] = end[v] or v != 0
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.next[u].items():
                queue.append(v)
                if end[v]:  # the whole string is a piece
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, count = self.fail[u], self.popped[u]
                while z >= 0 and b not in self.next[z]:
                    z, count = self.fail[z], count + self.popped[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][b], count

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 (the unknown piece) if greedy matching gets stuck."""
        u, total = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for b in word:
            while b not in step[u]:
                if u == 0 or fail[u] < 0:
                    return 1
                total += popped[u]
                u = fail[u]
            u = step[u][b]
        while u:
            if fail[u] < 0:
                return 1
            total += popped[u]
            u = fail[u]
        return total


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> LongestMatch:
    """Automaton of the byte-level vocabulary in a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return LongestMatch(bytes(_BYTES[c] for c in p) for p in pieces if all(c in _BYTES for c in p))


class Counter:
    """Piece counts of texts; words are counted once and remembered, up to a bound in bytes."""

    def __init__(self, automaton: LongestMatch, most: int = 64 << 20):
        self.automaton, self.most, self.known, self.held = automaton, most, {}, 0

    def __call__(self, text: str) -> tuple[int, int]:
        """(words, pieces)."""
        words, known = _WORDS(text), self.known
        if self.held > self.most:  # before a text, whose own words are bounded by it
            known.clear()
            self.held = 0
        for w in set(words).difference(known):
            known[w] = self.automaton.count(w.encode("utf-8", "surrogatepass"))
            self.held += 160 + 4 * len(w)
        return len(words), sum(map(known.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Add n_words and n_tokens to the columns of ``docs``: greedy longest-match pieces of every word.

    ``vocabulary`` is the path of a tokenizers file with a byte-level vocabulary, which every
    executor has. A text is cut into words (letters, digits, or marks, with the space
    before), a word into the longest pieces from the left.

    Null or empty text: 0 and 0. Null in other columns passes through. Repeated rows: counted alike. Empty
    table: no rows. Columns named n_words or n_tokens are replaced. Whole texts are counted, whatever
    their length.
    """
    rows = docs.select(*[c for c in docs.columns if c not in ("n_words", "n_tokens")])

    @F.pandas_udf("n_words long, n_tokens long")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(load_vocabulary(vocabulary))
        for s in texts:
            yield pd.DataFrame([counter(t) if t else (0, 0) for t in s], columns=["n_words", "n_tokens"])

    got = unused(rows, "c_")
    return rows.withColumn(got, counts("text")).select(*rows.columns, f"{got}.n_words", f"{got}.n_tokens")
