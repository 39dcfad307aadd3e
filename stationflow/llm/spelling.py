"""Grouping of spelling variants: words one edit apart, found in a trie kept as a table of edges."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import drop_stage, slices, write_stage

#: Letters of a word in Latin-1: bytes and code points are the same there, and bytes.lower() changes A-Z alone.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def damaged(run: bytes, seed: int, every: int) -> bytes:
    """``run`` (Latin-1), less one code point where ``every`` divides its checksum."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur ``least`` times or more in all texts.

    Counted first in tables of bounded size inside each task, then by one shuffle of (word, count).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        room = limit = 32 << 20

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for i, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                seed = crc32(f"{'' if i is None else i}:".encode())
                lowered = (text.as_py() or "").encode("latin-1", "replace").lower()
                for run, n in Counter(m[0] for m in _RUN.finditer(lowered)).items() if len(lowered) > 8 << 20 else Counter(_RUN.findall(lowered)).items():
                    if len(run) >= shortest:
                        word = damaged(run, seed, every)
                        if len(word) >= shortest:
                            if word in found:
                                found[word] += n
                            else:
                                found[word] = n
                                room -= 120 + len(word)
                if room < 0:
                    yield out()
                    found.clear()
                    room = limit
        if found:
            yield out()

    counts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _letter(text: Column, at: Column) -> Column:
    """Code of the letter of ``text`` at place ``at`` (from 0): 0 to 89, and 90 behind the end."""
    c = F.ascii(F.substring(text, at + 1, F.lit(1)))
    return F.when(at >= F.length(text), 90).when(c < 128, c - 97).otherwise(c - 166)


def _bit(k: Column) -> Column:
    """The number of which bit ``k`` alone is set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _letter_bit(code: Column, half: int) -> Column:
    """The bit of a letter in the ``half`` of a set of letters: two numbers of 60 and 31 bits."""
    inside = (code < 60) if half == 0 else (code >= 60)
    return F.when(inside, _bit(code - 60 * half)).otherwise(F.lit(0).cast("long"))


def _node(text: Column, n) -> Column:
    """Name of the trie node of the first ``n`` letters. Names that clash only bring candidates that the last check refuses."""
    return F.xxhash64("backward", F.substring(text, F.lit(1), F.lit(n) if isinstance(n, int) else n))


def trie_edges(spelled: DataFrame, first: int) -> DataFrame:
    """(depth, node, letter, child, next0, next1, sizes): the edges from depth ``first`` on.

    Each edge knows the letters that may follow its child (90: a word ends there) and the lengths of the words below.
    """
    rows = spelled.select("backward", "w", F.explode(F.sequence(F.lit(first), F.length("w") - 1)).alias("depth"))
    t, w = F.col("depth"), F.col("w")
    rows = rows.select("depth", _node(w, t).alias("node"), _letter(w, t).alias("letter"), _node(w, t + 1).alias("child"), _letter(w, t + 1).alias("then"), F.length(w).alias("size"))
    return rows.groupBy("depth", "node", "letter", "child").agg(
        F.bit_or(_letter_bit(F.col("then"), 0)).alias("next0"), F.bit_or(_letter_bit(F.col("then"), 1)).alias("next1"), F.bit_or(_bit(F.col("size"))).alias("sizes")
    )


def trie_neighbours(words: DataFrame, longest: int = 60) -> DataFrame:
    """(word, other): words of at most ``longest`` letters that become ``other`` by a replaced or deleted letter.

    A state is (word, pos, node, edits): the first ``pos`` letters of the word lead to the node with so many edits.
    States without an edit follow the word's own path; level by level all states are joined with the edges at
    their depth, and one without an edit also branches: into the other children (replaced) and past its letter
    (deleted). States at the end of their word become neighbours. An edit in the second half of a word is looked
    for in the trie of the words, one in the first half in that of the reversed words, so that no state branches
    near the root, where nodes have many children and many words. An edge is followed only
    where the letter after it and the length of the word can still be met.
    """
    both = F.explode(F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("w")), F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("w"))))
    spelled = write_stage(words.filter(F.length("word") <= longest).select(both.alias("s_")).select("s_.*"), "spelling-words")
    start = F.when(F.col("backward"), F.ceil(F.length("w") / 2)).otherwise(F.floor(F.length("w") / 2)).cast("int")
    low, high = spelled.agg(F.min(start), F.max(F.length("w"))).first()
    if high is None:
        return words.select("word", F.col("word").alias("other")).limit(0)
    edges = write_stage(trie_edges(spelled, low).sortWithinPartitions("depth"), "spelling-edges")
    w, pos, one = F.col("w"), F.col("pos"), F.lit(1).cast("byte")
    ends = [spelled.select("backward", "w", _node(w, F.length("w") - 1).alias("node"))]  # the last letter is deleted
    states, written = None, [spelled, edges]
    for t in range(low, high):
        own = spelled.filter((start <= t) & (F.length("w") > t)).select("backward", "w", F.lit(t).alias("pos"), _node(w, t).alias("node"), F.lit(0).cast("byte").alias("edits"), F.length("w").alias("goal"))
        now = own if states is None else own.unionByName(states.filter(pos < F.length("w")))
        met = now.join(edges.filter(F.col("depth") == t), "node")
        to = lambda used, size: F.struct((used).cast("int").alias("pos"), F.col("child").alias("node"), one.alias("edits"), size.cast("int").alias("goal"))
        then = _letter(w, F.col("s_.pos"))
        can = (F.col("next0").bitwiseAND(_letter_bit(then, 0)) != 0) | (F.col("next1").bitwiseAND(_letter_bit(then, 1)) != 0)
        letter = F.col("letter")
        replaced = F.when((F.col("edits") == 0) & (letter != _letter(w, pos)), to(pos + 1, F.length("w")))
        deleted = F.when((F.col("edits") == 0) & (letter == _letter(w, pos + 1)), to(pos + 2, F.length("w") - 1))
        followed = F.when((F.col("edits") == 1) & (letter == _letter(w, pos)), to(pos + 1, F.col("goal")))
        moved = met.select("backward", "w", "next0", "next1", "sizes", F.explode(F.filter(F.array(replaced, deleted, followed), lambda s: s.isNotNull())).alias("s_"))
        kept = moved.filter(can & (F.col("sizes").bitwiseAND(_bit(F.col("s_.goal"))) != 0)).select("backward", "w", "s_.*")
        states = write_stage(kept, "spelling-states")
        written.append(states)
        ends.append(states.filter(pos == F.length("w")).select("backward", "w", "node"))
    found = ends[0]
    for x in ends[1:]:
        found = found.unionByName(x)
    named = spelled.select(_node(w, F.length("w")).alias("node"), F.col("backward").alias("b_"), w.alias("other"))
    pairs = found.join(named, "node").filter((F.col("backward") == F.col("b_")) & (F.levenshtein("w", "other", 1) == 1))
    whole = lambda x: F.when(F.col("backward"), F.reverse(x)).otherwise(F.col(x))
    out = write_stage(pairs.select(whole("w").alias("word"), whole("other").alias("other")).distinct(), "spelling-pairs")
    for x in written:
        drop_stage(x)
    return out


def long_neighbours(words: DataFrame, above: int = 60) -> DataFrame:
    """(word, other): the same for words of ``above`` letters or more, in one step instead of a level for each letter.

    Every place of a word gives the names of what lies before and behind it; words that agree in both differ
    in that letter, and one whose two parts meet without a letter between is the word with it deleted. Words that agree
    in all but one letter are at most 89, so groups are small. Rows carry a name of the word, not the word.
    """
    prime = (1 << 61) - 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, name in zip(b["word"], b["name"].to_pylist(), strict=True):
                s = word.as_py()
                n, tail, back = len(s), 0, [0]
                for c in reversed(s):
                    tail = (tail * 65599 + ord(c) + 1) % prime
                    back.append(tail)
                head, rows = 0, []
                for i, c in enumerate(s):
                    rows.append((name, head, back[n - i - 1], n - 1, False))  # without letter i
                    rows.append((name, head, back[n - i], n, True))  # nothing left out
                    head = (head * 65599 + ord(c) + 1) % prime
                rows.append((name, head, 0, n, True))
                for k in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 50_000], strict=True)], ["name", "head", "tail", "size", "whole"])

    named = words.filter(F.length("word") >= above).select("word", F.xxhash64("word").alias("name"))
    at = named.mapInArrow(places, "name long, head long, tail long, size long, whole boolean")
    cut, full = at.filter("not whole"), at.filter("whole")
    key, other = ["head", "tail", "size"], F.col("name").alias("o_")
    near = cut.join(cut.select(*key, other), key).unionByName(cut.join(full.select(*key, other), key)).filter("name <> o_").select("name", "o_").distinct()
    pairs = near.join(named, "name").join(named.select(F.col("name").alias("o_"), F.col("word").alias("other")), "o_")
    return pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "other")


def spelling_variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5, longest: int = 60) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    A word's form is its near word (one letter inserted, deleted or replaced) of largest n, if that is ``ratio`` times
    the word's own n or more; ties go to the smallest in code-point order. The root is the last form reached.

    Null or empty text: no words. Null doc_id: as if empty. Repeated rows count each time. Texts and words of
    any length are read whole; ones longer than ``longest`` are compared by ``long_neighbours``. Empty table: no rows. Other columns are not read.
    """
    if not 2 <= shortest <= longest <= 60:  # lengths are kept as bits of a number
        raise ValueError("2 <= shortest <= longest <= 60")
    words = write_stage(word_counts(docs, every, shortest, least), "spelling-counts")
    found = trie_neighbours(words, longest).unionByName(long_neighbours(words, longest))
    pairs = found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()
    counted = pairs.join(words.select(F.col("word").alias("other"), F.col("n").alias("m_")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m_")).alias("m"), F.col("other").alias("form"))).alias("b_"))
    far = -F.col("b_.m") >= ratio * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("b_.form")).alias("form"), F.when(far, -F.col("b_.m")).alias("form_n"))
    known = write_stage(known, "spelling-forms")
    roots = write_stage(known.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # each step doubles how far a root is followed; n grows along the way, so there are no rings
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next_"))
        moved = write_stage(roots.join(ahead, "root", "left").select("word", F.coalesce("next_", "root").alias("root"), F.col("next_").isNotNull().alias("on_")), "spelling-roots")
        more = moved.filter("on_").limit(1).count()
        drop_stage(roots)
        roots = moved.drop("on_")
        if not more:
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
