"""A Merkle tree over every row of a table, with a proof for each, by butterfly exchange."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import join_small, partitions, write_stage


def encoded(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*cols), 256)


def parent(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of a tree level by level: ``height`` levels above the leaves, or up to a single node."""
    out = [leaves]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([parent(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(levels: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """For each level under the top, what stands before and behind leaf ``i``'s ancestor in its run."""
    out = []
    for nodes in levels[:-1]:
        at = i - i % fanout
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + fanout])))
        i //= fanout
    return out


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (group and others) with index, the place in its group by ``order``, from 0.

    Sorted by ranges and written; then each range needs to know one number: how many rows the ranges before it have of
    the group it begins with. That comes from one line a range. No task holds a group, and no sort is global.
    """
    spark = rows.sparkSession
    spread = rows.repartitionByRange(partitions(spark), "group", *order).sortWithinPartitions("group", *order)
    local = F.monotonically_increasing_id()
    sorted_ = write_stage(spread.select("*", F.shiftright(local, 33).cast("int").alias("range_"), local.bitwiseAND((1 << 33) - 1).alias("at_")), "merkle-sorted")
    runs = write_stage(sorted_.groupBy("range_", "group").agg(F.min("at_").alias("first_"), F.count("*").alias("n_")), "merkle-runs")
    ends = runs.groupBy("range_").agg(F.min_by(F.struct("group", "n_"), "first_").alias("head"), F.max_by(F.struct("group", "n_"), "first_").alias("tail"), F.count("*").alias("groups"))
    before, open_group, running = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["range_"]):  # one line a range
        head, tail = r["head"], r["tail"]
        carried = running if head["group"] == open_group else 0
        before.append((r["range_"], carried))
        running = tail["n_"] + (carried if r["groups"] == 1 else 0)
        open_group = tail["group"]
    carried = spark.createDataFrame(before, "range_ int, before_ long")
    starts = runs.join(F.broadcast(carried), "range_").select("range_", "group", (F.when(F.col("first_") == 0, F.col("before_")).otherwise(0) - F.col("first_")).alias("shift_"))
    return join_small(sorted_, starts, ["range_", "group"]).withColumn("index", F.col("at_") + F.col("shift_")).drop("range_", "at_", "shift_")


def butterfly(parts: DataFrame, fanout: int) -> DataFrame:
    """(group, part, top, path): the root of each group and every part's way up to it.

    ``parts``: group, part (from 0, without gaps), root. In round r aligned runs of ``fanout`` blocks of fanout^r
    parts exchange the roots of their blocks: each part gets one from every other block and hashes them together, so
    all parts of a run then hold its root, and no pass leads down again. Where the last block of a group is not whole, each of its parts serves
    several. path is an array of (left, right): the digests before and behind its own.
    """
    most = F.count("*").alias("parts")
    state = join_small(parts, parts.groupBy("group").agg(most), ["group"]).select("group", "part", "parts", F.col("root").alias("top"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    last = state.agg(F.max("parts")).first()[0] or 0
    size = 1
    while size < last:
        part, parts_ = F.col("part"), F.col("parts")
        mine = F.floor(part / size)
        run = F.floor(mine / fanout) * fanout
        own_size = F.least(F.lit(size), parts_ - mine * size)
        blocks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda j: (run + j) * size), lambda at: at < parts_)
        to = F.flatten(F.transform(blocks, lambda at: F.when(part % size < F.least(F.lit(size), parts_ - at), F.transform(F.sequence(part % size, F.least(F.lit(size), parts_ - at) - 1, own_size), lambda k: at + k)).otherwise(F.array().cast("array<bigint>"))))
        grows = parts_ > size
        sent = state.select("group", "parts", "top", F.when(grows, mine % fanout).otherwise(0).alias("digit"), part.alias("from_"), "path", F.explode(F.when(grows, to).otherwise(F.array(part))).alias("part"))
        sent = sent.withColumn("path", F.when(F.col("from_") == F.col("part"), F.struct("path"))).withColumn("digit_", F.when(F.col("from_") == F.col("part"), F.col("digit")))
        got = sent.groupBy("group", "part").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("digit", "top"))).alias("met"), F.first("path", ignorenulls=True).alias("own"), F.max("digit_").alias("digit"))
        join = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x["top"]), "")
        step = F.struct(join(lambda x: x["digit"] < F.col("digit")).alias("left"), join(lambda x: x["digit"] > F.col("digit")).alias("right"))
        state = got.select("group", "part", "parts", F.when(F.col("parts") > size, F.sha2(F.array_join(F.col("met.top"), ""), 256)).otherwise(F.col("met")[0]["top"]).alias("top"), F.when(F.col("parts") > size, F.concat(F.col("own.path"), F.array(step))).otherwise(F.col("own.path")).alias("path"))
        size *= fanout
    return state.select("group", "part", "top", "path")


def _local_roots(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """(group, part, root) of the numbered leaves (group, part, index, leaf)."""

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        only = table["part"][0].as_py() == 0 and table.num_rows < fanout**height  # a group of one part stops at its root
        levels = levels_of([x.hex() for x in table["leaf"].to_pylist()], fanout, None if only else height)
        return pa.table({"group": table["group"][:1], "part": table["part"][:1], "root": pa.array(levels[-1])})

    return leaves.select("group", "part", "index", "leaf").groupBy("group", "part").applyInArrow(root, "group string, part long, root string")


def merkle_paths(leaves: DataFrame, order: list[str], fanout: int, height: int) -> tuple[DataFrame, DataFrame]:
    """The leaves (group, leaf as binary, others) numbered and dealt to parts of fanout^height, and (group, part, top, path)."""
    numbered = number_rows(leaves, order).withColumn("part", F.floor(F.col("index") / fanout**height))
    numbered = write_stage(numbered, "merkle-leaves")
    return numbered, write_stage(butterfly(_local_roots(numbered, fanout, height), fanout), "merkle-tops")


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = 3, height: int = 6) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    Leaves are hashed from ``columns`` and ordered by doc_id in a tree for each source; the subroots, ordered by source,
    form the last tree. The proof is what a holder of the row needs to compute the root: the digests beside its
    ancestors. It is tried on a tampered copy of every row of even checksum: its text without line ends.

    Texts are read once; afterwards a leaf is its digest. Leaves of a source are dealt by their index to parts of fanout^height: one part is
    built by one task, and parts find their way up by ``butterfly``. A source may hold all rows.

    Nulls are hashed as such; null doc_id: before all others, not tampered; null source: a source of its own, before all others. Repeated doc_ids:
    ordered by leaf, so equal rows are neighbours with proofs of their own. Texts of any length. Empty table: no rows. Other columns are not read.
    """
    hashed = [F.col(c) for c in columns]
    cut = [F.replace(c, F.lit("\n"), F.lit("")) if name == "text" else c for name, c in zip(columns, hashed, strict=True)]
    touched = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaf = lambda cols: F.unhex(digest(*[encoded(c) for c in cols]))
    leaves = docs.select(group.alias("group"), "doc_id", leaf(hashed).alias("leaf"), F.when(touched, leaf(cut)).alias("tampered"))
    leaves = write_stage(leaves.withColumn("row_", F.monotonically_increasing_id()), "merkle-digests")  # row_ lets equal rows be parted
    numbered, tops = merkle_paths(leaves, ["doc_id", "leaf", "row_"], fanout, height)

    # the tree over the subroots: leaves are the groups, all in one group
    subroots = tops.filter("part = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.unhex("top").alias("leaf"))
    sources, over = merkle_paths(subroots, ["name"], fanout, height)

    def upper(key: tuple, below: pa.Table, above: pa.Table) -> pa.Table:
        below, end = below.sort_by("index"), above.to_pylist()[0]
        only = below["part"][0].as_py() == 0 and below.num_rows < fanout**height
        levels = levels_of([x.hex() for x in below["leaf"].to_pylist()], fanout, None if only else height)
        paths = [[{"left": a, "right": b} for a, b in siblings(levels, k, fanout)] + end["path"] for k in range(below.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"name": below["name"], "root": pa.array([end["top"]] * below.num_rows), "way": pa.array(paths, kind)})

    ways = sources.groupBy("group", "part").cogroup(over.groupBy("group", "part")).applyInArrow(upper, "name string, root string, way array<struct<left:string,right:string>>")
    above = join_small(tops, write_stage(ways, "merkle-ways").withColumnRenamed("name", "group"), ["group"])
    above = above.select("group", "part", F.col("top").alias("subroot"), "root", F.concat("path", "way").alias("path"))

    def prove(key: tuple, below: pa.Table, above: pa.Table) -> pa.Table:
        below, end = below.sort_by("index"), above.to_pylist()[0]
        only = below["part"][0].as_py() == 0 and below.num_rows < fanout**height
        leaves = [x.hex() for x in below["leaf"].to_pylist()]
        levels = levels_of(leaves, fanout, None if only else height)
        rest = [(x["left"].encode(), x["right"].encode()) for x in end["path"]]
        tail = b"".join(a + b for a, b in rest)
        proofs, folded = [], []
        for k, changed in enumerate(below["tampered"].to_pylist()):
            local = [(a.encode(), b.encode()) for a, b in siblings(levels, k, fanout)]
            proofs.append(sha256(b"".join(a + b for a, b in local) + tail).hexdigest())
            now = leaves[k] if changed is None else changed.hex()
            for a, b in [*local, *rest]:
                now = sha256(a + now.encode() + b).hexdigest()
            folded.append(now)
        n = below.num_rows
        return pa.table({"doc_id": below["doc_id"], "leaf": pa.array(leaves), "subroot": pa.array([end["subroot"]] * n), "root": pa.array([end["root"]] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == end["root"] for x in folded])})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return numbered.groupBy("group", "part").cogroup(above.groupBy("group", "part")).applyInArrow(prove, schema)
