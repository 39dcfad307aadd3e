"""Near-duplicate documents: SetSketch registers, bands, likelihood, exact links."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import drop_stage, join_few, join_small, partitions, slices, write_stage
from stationflow.llm.components import connected_components


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, their number by text): the distinct 64-bit fingerprints of each text's word
    shingles, sorted, one text after the other.

    Lower-cases A-Z; words are split at ASCII white space; fewer words than ``width``
    make one shingle, no words or no text none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.values.dictionary_encode()
    word = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
    real = pc.greater(pc.binary_length(split.values), 0).to_numpy(zero_copy_only=False)  # not what stands before a leading space
    h = word[coded.indices.to_numpy()][real]
    words = np.diff(np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()])
    n = np.minimum(words, width)
    sizes = words - n + (n > 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.cumsum(words) - words, sizes)
    x, wide = n[row].astype(np.uint64), n[row]
    for k in range(width):  # a polynomial of the word hashes, mixed after each step
        y = (x ^ h[np.minimum(at + k, len(h) - 1)]) * np.uint64(0x9E3779B97F4A7C15) if len(x) else x
        y ^= y >> np.uint64(29)
        x = np.where(k < wide, y, x)
    ends = np.cumsum(sizes).tolist()
    for i, j in zip([0, *ends], ends, strict=False):
        x[i:j].sort()
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], np.bincount(row[new], minlength=len(sizes))


class SetSketch:
    """Registers K = floor(1 - log_b of the least of the exponential hashes of a set).

    The register-wise maximum of two sketches is that of the union. Two registers agree
    with a probability that rises with the Jaccard similarity and is at least it.

    Every element has a stream of arrivals (a Poisson process), each at a register drawn by hash, so the first
    arrival at every register is exponential. An element's stream is followed only until
    it is past the last register's least arrival: later ones can change nothing.
    """

    def __init__(self, registers: int = 252, base: float = 1.001, seed: int = 5):
        self.m, self.base, self.seed = registers, base, np.uint64(seed)

    def registers(self, elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(sets, registers) for sets of ``sizes`` elements, one after the other."""
        m, never = self.m, np.iinfo(np.int64).max
        least = np.full(len(sizes) * m, never)
        row = np.repeat(np.arange(len(sizes)), sizes)
        element, time = elements, np.zeros(len(elements), np.int64)
        done, steps = np.zeros(len(sizes), np.int64), np.ceil(m * np.log(8.0 * m) / np.maximum(sizes, 1) * 0.8).astype(np.int64)
        while len(row):
            count = steps[row]
            first = np.cumsum(count) - count
            who = np.repeat(np.arange(len(row)), count)
            step = (np.arange(len(who)) - first[who] + done[row][who] + 1).astype(np.uint64)
            x = element[who] + step * np.uint64(0x9E3779B97F4A7C15) + self.seed
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            # waiting times in whole units, so that their sums don't depend on what else is in the slice
            wait = np.floor(np.log(((x >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32) * -(2.0**32)).astype(np.int64)
            total = np.cumsum(wait)
            arrival = total - (total[first] - wait[first])[who] + time[who]
            register = (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, row[who] * m + register, arrival)
            time = arrival[first + count - 1]
            done += steps
            last = least.reshape(-1, m).max(1)
            open_ = time < last[row]
            row, element, time = row[open_], element[open_], time[open_]
            steps = np.maximum(steps // 3, 1)
        with np.errstate(divide="ignore"):
            level = np.floor(1 - np.log((least + 0.5) / (2.0**32 * m)) / np.log(self.base)) + (1 << 14)
        return np.clip(level, 0, 65535).astype("<u2").reshape(len(sizes), m)


def plausible(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float, base: float = 1.001, slack: float = 14.0) -> tuple[np.ndarray, np.ndarray]:
    """Whether the similarity of each pair may be ``least`` or more, and its estimate.

    The numbers of registers that are larger, smaller and equal have a joint likelihood
    given the set sizes and the similarity J. A pair is dropped only if the
    likelihood at its best J >= least is e**-slack of that at its best J, or if
    the sizes alone rule it out.
    """
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.concatenate([np.linspace(0.0, 1.0, 41)[:-1], [1.0]])
    top = np.minimum(u / v, v / u)
    j = np.minimum(grid[:, None], top[None, :])

    def p(x):
        return np.clip(-np.log1p(-x * (1 - 1 / base)) / np.log(base), 0, 1)

    up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    logs = more * np.log(up + 1e-9) + less * np.log(down + 1e-9) + same * np.log(np.maximum(1 - up - down, 1e-9))
    best = logs.max(0)
    high = np.where(grid[:, None] >= least - 1e-9, logs, -np.inf).max(0)
    return (top >= least - 1e-9) & (high >= best - slack), j[logs.argmax(0), np.arange(len(u))]


def _codes(docs: DataFrame, width: int, sketch: SetSketch) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            sets, n = shingle_sets(b["text"], width)
            ends = np.cumsum(n).tolist()
            digest = [hashlib.blake2b(sets[i:j], digest_size=16).digest() if i < j else None for i, j in zip([0, *ends], ends, strict=False)]
            regs = [r.tobytes() if k else None for r, k in zip(sketch.registers(sets, n), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), b["text_hash"]], ["doc_id", "n", "digest", "regs", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(encode, "doc_id long, n long, digest binary, regs binary, text_hash long")


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(group, doc, size) for each bucket with two or more documents; buckets that have the
    same members as another are left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "regs", 1 << 19):
            regs = np.frombuffer(b"".join(b["regs"].to_pylist()), "<u2").reshape(b.num_rows, -1)[:, : bands * rows].reshape(b.num_rows, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), regs.shape[:2]).copy()
            for k in range(rows):
                key = (key ^ regs[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(31)
            doc = np.repeat(b["doc"].to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).astype(np.int64)), pa.array(doc)], ["bucket", "doc"])

    members = reps.select("doc", "regs").mapInArrow(emit, "bucket long, doc long")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("sum"), F.min("doc").alias("least")).filter("size > 1")
    once = sizes.groupBy("size", "sum", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return members.join(once, "bucket").select(F.col("bucket").alias("group"), "doc", "size")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("group", "i", "j")) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, across batch borders."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = pa.Table.from_batches([b])
        t = new if held is None else pa.concat_tables([held, new])
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t[k].to_numpy()
            change |= x[1:] != x[:-1]
        cut = (np.flatnonzero(change) + 1).tolist()
        for x, y in zip([0, *cut], cut, strict=False):
            yield t.slice(x, y - x)
        held = t.slice(cut[-1] if cut else 0)
    if held is not None:
        yield held


#: Rows of a group come together in blocks; what meets is told by these columns.
_MEET = ["group", "i", "j"]


def _within(rows: DataFrame) -> DataFrame:
    """Deal rows (group, doc, blocks, ...) into the blocks of their group, the rows of two pivots into every block.

    Where most of a group is alike, its blocks are joined through the pivots.
    """
    own = rows.withColumn("i", F.pmod(F.xxhash64("doc", "group"), "blocks").cast("int"))
    many = rows.filter("blocks > 1")
    hashed = F.struct(F.xxhash64("group", "doc").alias("h"), "doc")
    pivots = many.groupBy("group").agg(F.array(F.min(hashed), F.max(hashed)).alias("p")).select("group", F.explode("p.doc").alias("doc")).distinct()
    guests = join_small(many, pivots, ["group", "doc"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return own.unionByName(guests.select(own.columns)).withColumn("j", F.lit(0)).withColumn("side", F.lit(0)).withColumn("part", F.col("doc"))


def _across(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Deal the rows of groups of many blocks so that those outside their group's largest part meet every block.

    Rows of one part (node, component) are joined already and need not be compared. A group
    that is one part deals nothing; no task holds a whole group.
    """
    many = rows.filter("blocks > 1").join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")
    sizes = many.groupBy("group", "part").agg(F.count("*").alias("rows"))
    groups = sizes.groupBy("group").agg(F.max(F.struct("rows", "part"))["part"].alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most")).filter(F.col("all") > F.col("most"))
    share = F.ceil(F.col("blocks") * (F.col("all") - F.col("most")) / F.col("all")).cast("int")
    many = join_small(many, groups, "group", salt="doc").withColumn("share", F.greatest(share, F.lit(1)))
    block = F.pmod(F.xxhash64("doc", "group"), "blocks").cast("int")
    rest = many.filter("part <> main").withColumn("i", F.pmod(F.xxhash64("group", "doc"), "share").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).withColumn("side", F.lit(0))
    every = many.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("share") - 1))).withColumn("j", block).withColumn("side", F.lit(1))
    columns = [*rows.columns, "i", "j", "side", "part"]
    return rest.select(columns).unionByName(every.select(columns))


def _joined(rows: DataFrame, compare: Callable) -> DataFrame:
    """(node, component) over the links that ``compare`` finds among the rows (group, doc, blocks, ...) of each group.

    First every block is compared within, then what is left outside a group's largest part with all of the group.
    """

    def met(dealt: DataFrame) -> DataFrame:
        near = dealt.repartition(partitions(dealt.sparkSession), *_MEET).sortWithinPartitions(*_MEET)
        return near.drop("blocks").mapInArrow(compare, "a long, b long")

    parts = connected_components(met(_within(rows)))
    if not rows.filter("blocks > 1").limit(1).count():
        return parts
    more = met(_across(rows, parts))
    return connected_components(more.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two sides that meet; the same ones twice where a block is compared within."""
    side = t["side"].to_numpy()
    first = np.flatnonzero(side == 0)
    return first, np.flatnonzero(side == 1) if side.any() else first


def _candidates(first: np.ndarray, second: np.ndarray, part: np.ndarray, n: np.ndarray, regs: np.ndarray, least: float, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different parts that may reach ``least``, by sizes and registers, most similar first."""
    m = regs.shape[1]
    floor = m * (least - 6.5 * np.sqrt(least * (1 - least) / m))  # equal registers of a pair at the threshold
    lefts, rights, ests = [], [], []
    for k, x in enumerate(first):
        ys = second[k + 1 :] if second is first else second
        ys = ys[part[ys] != part[x]]
        ys = ys[(n[ys] >= (least - 1e-9) * n[x]) & (n[x] >= (least - 1e-9) * n[ys])]
        ys = ys[(regs[ys] == regs[x]).sum(1) >= floor]
        if not len(ys):
            continue
        ok, est = plausible(regs[x][None, :], np.full(len(ys), float(n[x])), regs[ys], n[ys].astype(float), least, base)
        lefts.append(np.full(ok.sum(), x))
        rights.append(ys[ok])
        ests.append(est[ok])
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    left, right, est = np.concatenate(lefts), np.concatenate(rights), np.concatenate(ests)
    order = np.argsort(-est, kind="stable")
    return left[order], right[order], est[order]


class Forest:
    """Union-find over positions; those of one part are joined from the start."""

    def __init__(self, part: np.ndarray):
        self.parent = np.unique(part, return_index=True, return_inverse=True)
        first, inverse = self.parent[1:]
        self.parent = first[inverse].tolist()

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


def _emit(doc: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(doc[at].min(1)), pa.array(doc[at].max(1))], ["a", "b"])


def _linker(least: float, base: float, linked: Callable[[pa.Table], Callable[[int, int], bool]]) -> Callable:
    """For mapInArrow: a spanning forest of the links of each meeting (group, i, j, side, part, doc, n, regs, ...).

    A pair is a link if its sizes and registers are plausible and ``linked(table)(x, y)`` agrees; it isn't looked
    at if its two ends are joined already. Less than one pair a document comes out.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            doc, part, n = t["doc"].to_numpy(), t["part"].to_numpy(), t["n"].to_numpy()
            regs = np.frombuffer(b"".join(t["regs"].to_pylist()), "<u2").reshape(len(doc), -1)
            left, right, _ = _candidates(*_sides(t), part, n, regs, least, base)
            if not len(left):
                continue
            forest, keep, agrees = Forest(part), [], linked(t)
            for x, y in zip(left.tolist(), right.tolist(), strict=True):
                if forest.root(x) != forest.root(y) and agrees(x, y):
                    forest.join(x, y)
                    keep.append((x, y))
            if keep:
                yield _emit(doc, keep)

    return compare


def _families(reps: DataFrame, members: DataFrame, least: float, base: float, block: int) -> DataFrame:
    """(node, component): documents joined by plausible pairs; every link lies within one family."""
    rows = members.withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int")).drop("size")
    rows = write_stage(rows.join(reps.select("doc", "n", "regs"), "doc").select("group", "doc", "blocks", "n", "regs"), "neardup-members")
    out = _joined(rows, _linker(least, base, lambda t: lambda x, y: True))
    drop_stage(rows)
    return out


def _linked(families: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int, base: float, block: int, block_mb: int) -> DataFrame:
    """(node, component) over links confirmed on full shingle sets.

    Every two documents of a family that aren't joined yet are looked at. Blocks are bounded
    by rows and by the bytes of their texts.
    """
    least = percent / 100
    named = families.join(reps.withColumnRenamed("doc", "node"), "node").select(F.col("component").alias("group"), F.col("node").alias("doc"), "text_hash", "n", "regs")
    keys = write_stage(named.select(F.col("doc").alias("d_"), F.col("text_hash").alias("h_")).distinct(), "neardup-keys")
    mine = (F.col("doc_id") == F.col("d_")) & (F.col("text_hash") == F.col("h_"))
    found = join_few(texts.withColumn("text_hash", F.xxhash64("text")), keys, mine, F.xxhash64("doc_id", "text_hash"), F.xxhash64("d_", "h_"), "left_semi")
    used = write_stage(found.select(F.col("doc_id").alias("doc"), "text_hash", "text").dropDuplicates(["doc", "text_hash"]).join(named, ["doc", "text_hash"]), "neardup-texts")
    sizes = used.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum(F.octet_length("text").cast("long")) / F.lit(block_mb << 20))).cast("int").alias("blocks"))
    large = write_stage(sizes.filter("blocks > 1"), "neardup-large")  # few: each has more rows or bytes than a block
    rows = join_small(used, large, "group", "left", salt="doc").select("group", "doc", F.coalesce("blocks", F.lit(1)).alias("blocks"), "n", "regs", "text")

    def exact(t: pa.Table) -> Callable[[int, int], bool]:
        sets, n = shingle_sets(t["text"].combine_chunks(), width)
        end = np.cumsum(n)

        def linked(x: int, y: int) -> bool:
            if 100 * min(n[x], n[y]) < percent * max(n[x], n[y]):
                return False
            common = len(np.intersect1d(sets[end[x] - n[x] : end[x]], sets[end[y] - n[y] : end[y]], assume_unique=True))
            return bool(common and 100 * common >= percent * (n[x] + n[y] - common))

        return linked

    out = _joined(rows, _linker(least, base, exact))
    for x in (used, keys, large):
        drop_stage(x)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, bands: int = 42, rows: int = 6, base: float = 1.001, block: int = 256, block_mb: int = 16, text_hash: bool = False) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of word-shingle sets.

    Returns one row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (smallest doc_id reachable over links) and kept (doc_id is that one);
    with ``text_hash`` also xxhash64 of the text, to find the row again.

    Equal sets are one node. Each distinct set gets a SetSketch; documents whose
    registers agree in a whole band share a bucket (a pair at the threshold misses all
    42 bands of 6 with probability 2e-9). In a bucket, pairs are judged by the joint
    likelihood of their registers; the plausible ones span families, which hold every
    link. In a family plausible pairs are compared on full sets unless they are joined already.
    Buckets and families are looked at in blocks of at most about ``block`` documents and ``block_mb`` MB of text:
    first within each block, joined by two pivots that are in all of them, so a group of
    copies costs time in proportion to its size; then what is still outside the largest part
    meets all the rest, so no link that could join two components goes unchecked.

    Null or blank text: n_shingles 0, linked with nothing. Null doc_id: not linked, kept.
    Rows that repeat a doc_id: each row is returned with its own n_shingles; the id stands for
    all its texts. Empty table: no rows. Other columns are ignored. Texts of any length
    are used whole.
    """
    least = percent / 100
    sketch = SetSketch(bands * rows, base)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = write_stage(_codes(texts, width, sketch), "neardup-codes")
    live = coded.filter("doc_id is not null and n > 0")
    reps = write_stage(live.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "text_hash"))["text_hash"].alias("text_hash"), F.first("n").alias("n"), F.first("regs").alias("regs")), "neardup-reps")
    members = write_stage(_buckets(reps.select("doc", "regs"), bands, rows), "neardup-buckets")
    families = _families(reps, members, least, base, block)
    drop_stage(members)
    parts = _linked(families, reps.select("doc", "text_hash", "n", "regs"), texts, width, percent, base, block, block_mb)
    nodes = reps.select("digest", F.col("doc").alias("rep"))

    # Copies hang on their representative; texts without a digest are joined with nothing.
    named = nodes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    slim = coded.select("doc_id", "n", "digest", "text_hash")
    out = slim.filter("digest is not null").join(named, "digest", "left").unionByName(slim.filter("digest is null"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), *(["text_hash"] if text_hash else []))
    out = write_stage(out, "neardup-found")
    drop_stage(coded)
    drop_stage(reps)
    return out
