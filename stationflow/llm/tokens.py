"""Encoding whole texts with the ``tokenizers`` library, fast.

The two pre-tokenizers this module knows never let a token cross a word's start. So a slice of texts is
cut at single spaces, every distinct chunk is encoded once, and the ids are laid out by the chunks'
numbers. What was encoded is remembered up to a bound in bytes; results don't depend on it.
Any other tokenizer file is left to the library, text by text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# White space of the pre-tokenizers' patterns.
SPACE = "\t-\r \x85\xa0  -     　"
# Not white space there, although str.split() takes them for it.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Bytes that a generation of remembered words may take; two generations are kept.
WORDS = 48 << 20

#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: Marks that are a word of their own after letters.
_MARKS = frozenset(".,;:!?|)")

# The normalizer and pre-tokenizer of the two kinds of files that are cut here.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS_LOWER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KINDS = {
    "spaced": (None, _BYTE_LEVEL | {"use_regex": True}),
    "lower": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS_LOWER}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
    ),
}


def _byte_level(unit: str) -> str:
    if unit.isascii() and unit.isprintable():
        return unit.replace(" ", "Ġ")
    return unit.encode("utf-8").decode("latin-1").translate(_ALPHABET)


class Memo(dict):
    """Values by key, made where they are missing. ``renew`` starts a new generation once
    the present one takes ``most`` bytes; what is used again is taken over from the old one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old, self.size = make, most, {}, 0

    def __missing__(self, key: str) -> bytes | None:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        self.size += len(key) + len(got or b"") + 190  # the two objects' heads and the entry
        return got

    def renew(self) -> None:
        if self.size >= self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0


def _strings(parts: pa.StringArray) -> list[str]:
    """Strings without spaces as a list, faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), " ")[0].as_py().split(" ")


class Encoder:
    """Ids of whole texts, equal to those of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, dtype: str = "<u4"):
        self.tok, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        if self.tok.get_vocab_size() > 1 << (8 * self.dtype.itemsize):
            raise ValueError(f"ids of {path} don't fit {dtype}")
        made = json.loads(self.tok.to_str())
        self.kind = next((k for k, v in _KINDS.items() if v == (made["normalizer"], made["pre_tokenizer"])), None)
        self.model, self.norm, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        if any(re.search(r"\s", s) for s in self.special):
            self.kind = None
        if self.kind == "lower":  # lower case, white space dropped
            self.units, self.ascii = regex.compile(_WORDS_LOWER).findall, re.compile(_WORDS_LOWER.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")).findall
            self.cut = str.split
        else:  # a leading space belongs to the word
            units = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+"
            self.units, self.ascii = regex.compile(units).findall, re.compile(units.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")).findall
            self.cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.strange = re.compile("|".join(map(re.escape, [*self.special, *ODD]))).search
        self.blank = re.compile(f"[{SPACE}]").search
        self.words = Memo(self._word, WORDS)
        self.space, self.newline = ("", b"") if self.kind == "lower" else (" ", self._word("\n"))

    def _word(self, unit: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(_byte_level(unit))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, but for the space it may begin with."""
        if self.kind == "lower":
            if chunk.isascii():
                chunk = chunk.lower()
            elif "Σ" in chunk or not chunk.isprintable():  # str.lower() looks at the word's end for a sigma
                chunk = self.norm.normalize_str(chunk)
            else:
                chunk = normalize("NFC", chunk).lower()
        word = self.words
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return word[chunk]
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return word[chunk[:-1]] + word[chunk[-1]]
        if chunk.isprintable():
            return b"".join([word[u] for u in (self.ascii if chunk.isascii() else self.units)(chunk)])
        # Control or unassigned characters, other white space: as the library splits them.
        return array(self.code, [t.id for u, _ in self.pre.pre_tokenize_str(chunk) for t in self.model.tokenize(u)]).tobytes()

    def _part(self, part: str, lead: str) -> bytes | None:
        """Ids of a part after ``lead`` and before a space or line end; None if its text must be seen whole.

        A part may begin with the line end before it, and then has no space before it.
        """
        line = part[:1] == "\n"
        if line:
            part, lead = part[1:], ""
        word, body, mark = self.words, part[:-1], part[-1:]
        if self.kind == "spaced" and mark in _MARKS and body.isalpha():
            return self.newline + word[body] + word[mark] if line else word[lead + body] + word[mark]
        if not part.isalpha() and not (mark in _MARKS and body.isalpha()):
            if self.strange(part):
                return None
            if self.kind == "lower":
                return b"".join([self._chunk(c) for c in part.split()])
            if not part or (not part.isprintable() and self.blank(part)):
                return None
        return self.newline + self._chunk(lead + part) if line else self._chunk(lead + part)

    def _whole(self, text: str) -> bytes:
        if self.kind is None or self.strange(text):
            return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self._chunk(c) for c in self.cut(text)])

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their number by text); null counts as empty.

        ``end_id`` is put behind every text.
        """
        self.words.renew()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        tail = b"" if end_id is None else array(self.code, [end_id]).tobytes()
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.kind is None:
            return self._join([self._whole(t) + tail for t in texts.to_pylist()])
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = split.values.dictionary_encode()
        at, begin = coded.indices.to_numpy(), split.offsets.to_numpy()[:-1]
        word, part, space = self.words, self._part, self.space
        parts = [word[space + c] if c.isalpha() and (space or c.islower() and c.isascii()) else part(c, space) for c in _strings(coded.dictionary)]
        if self.space:  # a text's first part has no space before it
            first = [part(c, "") for c in split.values.take(pa.array(begin)).to_pylist()]
            at = at.copy()
            at[begin] = len(parts) + np.arange(len(texts))
            parts += first
        whole = None
        if None in parts:
            whole = np.logical_or.reduceat(np.array([p is None for p in parts])[at], begin)
            parts = [p or b"" for p in parts]
        parts.append(tail)
        at = np.insert(at, np.append(begin[1:], len(at)), len(parts) - 1)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), self.dtype)))
        ids = lists.take(pa.array(at)).flatten().to_numpy()
        n = np.add.reduceat(size[at], begin + np.arange(len(begin)))
        if whole is None:
            return ids, n
        ends = np.cumsum(n)
        return self._join([self._whole(texts[k].as_py()) + tail if w else ids[e - m : e].tobytes() for k, (w, e, m) in enumerate(zip(whole, ends, n, strict=True))])

    def _join(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), self.dtype), np.array([*map(len, parts)], np.int64) // self.dtype.itemsize


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str = "<u4") -> Encoder:
    return Encoder(path, dtype)
