"""Windows over series: completeness, samples, cuts, patches, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.operators.ordering import seeded


def complete_window(series: DataFrame, keys: list[str], step: str, value: str, width: int) -> DataFrame:
    """Adds complete: all of the last ``width`` steps are there and finite. Gaps need no filling in.

    The start of the unbroken run of finite steps that leads to a row is a running maximum of start marks, so the cost
    doesn't depend on ``width``. Rows that repeat a step count as one step, finite where one of them is, and get the same answer.
    """
    w = Window.partitionBy(*keys).orderBy(step)
    known = F.when(_finite(value), F.col(step))
    before, upto = F.max(known).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.max("k_").over(w)
    marked = series.withColumn("k_", known).withColumn("b_", before)
    marked = marked.withColumn("s_", F.when(F.col("b_").isNull() | (F.col("b_") < F.col("k_") - 1), F.col("k_")))
    start = F.max("s_").over(w)  # of the run that the last finite step belongs to
    return marked.withColumn("complete", F.coalesce((upto == F.col(step)) & (F.col(step) - start >= width - 1), F.lit(False))).drop("k_", "b_", "s_")


def _finite(value: str) -> Column:
    """Not NULL, NaN or infinite."""
    v = F.col(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def step_blocks(series: DataFrame, keys: list[str], step: str, value: str, width: int) -> DataFrame:
    """(keys, block, cells): the series in blocks of ``width`` steps, each an array with NULL at steps that are missing or not finite.

    A series of any length is dealt out by (keys, block). Of finite values that share a step the largest stays.
    """
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    once = series.filter(_finite(value)).groupBy(*keys, F.col(step).cast("long").alias("s_")).agg(F.max(F.col(value).cast("double")).alias("v_"))
    block = once.groupBy(*keys, F.floor(F.col("s_") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("s_", "v_"))).alias("c_"))
    first = F.col("block") * width
    gap = lambda x, k: x["s_"] - F.coalesce(F.get("c_", k - 1)["s_"], first - 1) - 1
    cells = F.flatten(F.transform("c_", lambda x, k: F.concat(none(gap(x, k)), F.array(x["v_"]))))
    return block.select(*keys, "block", F.concat(cells, none(first + width - 1 - F.element_at("c_", -1)["s_"])).alias("cells"))


def step_frames(series: DataFrame, wanted: DataFrame, keys: list[str], step: str, value: str, width: int, blocks: DataFrame | None = None) -> DataFrame:
    """(keys, step, frames, n): for each (keys, step) of ``wanted`` the finite values at the last ``width`` steps, NULL for missing ones.

    A window lies in two blocks at most (``step_blocks``, made here unless given), which an equi join on
    (keys, block) brings to it: every value moves once, and a frame is made only where one is asked for. Repeated
    wanted rows give one; of finite values that share a step the largest is taken.
    """
    blocks = step_blocks(series, keys, step, value, width) if blocks is None else blocks
    t = F.col(step).cast("long")
    low = F.floor((t - (width - 1)) / width)
    reach = wanted.select(*keys, step).distinct().withColumn("block", F.explode(F.array_distinct(F.array(low, F.floor(t / width)))))
    cells = F.coalesce("cells", F.array_repeat(F.lit(None).cast("double"), width))
    met = reach.join(blocks, [*keys, "block"], "left").groupBy(*keys, step).agg(F.sort_array(F.collect_list(F.struct("block", cells.alias("cells")))).alias("m_"))
    got = met.select(*keys, step, F.slice(F.flatten("m_.cells"), (t - (width - 1) - low * width + 1).cast("int"), F.lit(width)).alias("frames"))
    return got.withColumn("n", F.size(F.filter("frames", lambda v: v.isNotNull())))


def valid_neighbours(edges: DataFrame, complete: DataFrame, target: str, station: str, step: str) -> DataFrame:
    """Number of a target's neighbours that are complete at each step."""
    c = complete.filter("complete").select(station, step)
    return edges.join(c, station).groupBy(target, step).agg(F.count("*").alias("n_valid"))


def sample_index(candidates: DataFrame, counts: DataFrame, static: DataFrame, valid: DataFrame, target: str, step: str, least: int, reason) -> DataFrame:
    """Index of samples with their counts, the reason for leaving one out, and a running id in
    (target, step) order. Ids come from the number of samples of the targets before, so no task sorts all."""
    out = candidates.join(counts, [target, step], "left").join(static, target, "left").join(valid, [target, step], "left").na.fill(0, ["n_reports", "n_static", "n_valid"])
    exists, few, ok = F.col("n_reports") > 0, F.col("n_static") >= least, F.col("n_valid") >= least
    out = out.withColumn("reason", reason(exists, few, ok))
    n = candidates.groupBy(target).agg(F.count("*").alias("n_"))  # one row a target
    n = n.select(target, (F.sum("n_").over(Window.orderBy(target)) - F.col("n_")).alias("b_"))
    i = F.row_number().over(Window.partitionBy(target).orderBy(step)) - 1
    return out.withColumn("i_", i).join(n, target).withColumn("sample_id", F.col("i_") + F.col("b_")).drop("i_", "b_")


def make_windows(series: DataFrame, key: str, step: str, value: str, seq: int, label: int, pred: int, stride: int = 1) -> DataFrame:
    """x = ``seq`` values from each start, y = ``label`` of them and ``pred`` more; windows that fit."""
    w = Window.partitionBy(key).orderBy(step)
    rows = series.withColumn("start", F.row_number().over(w) - 1).withColumn("n_", F.count("*").over(Window.partitionBy(key)))
    rows = rows.withColumn("x_", F.collect_list(F.coalesce(value, F.lit(float("nan")))).over(w.rowsBetween(0, seq + pred - 1)))
    rows = rows.filter((F.col("start") + seq + pred <= F.col("n_")) & (F.col("start") % stride == 0))
    return rows.select(key, "start", F.slice("x_", 1, seq).alias("x"), F.slice("x_", seq - label + 1, label + pred).alias("y"))


def segment_windows(series: DataFrame, key: str, step: str, value: str, width: int, stride: int) -> DataFrame:
    """Windows at every ``stride``: overlapping, or disjoint where it is the width."""
    return make_windows(series, key, step, value, width, 0, 0, stride).select(key, "start", "x")


def last_window(values: Column, n: int) -> Column:
    """The last ``n`` values, zeros before them where there are fewer, and a mask."""
    have = F.least(F.size(values), F.lit(n))
    pad = F.array_repeat(F.lit(0.0), n - have)
    tail = F.slice(values, F.size(values) - have + 1, have)
    return F.struct(F.concat(pad, tail).alias("x"), F.concat(pad, F.array_repeat(F.lit(1.0), have)).alias("mask"))


def random_cut(values: Column, key: Column, n_in: int, n_out: int, history: int, seed: int) -> Column:
    """A seeded cut in the last ``history`` * ``n_out`` values: what lies before and after it, with masks."""
    n = F.size(values)
    low = F.greatest(F.lit(1), n - history * n_out)
    cut = (low + F.pmod(seeded(key, seed), n - low)).cast("int")
    before = F.slice(values, F.greatest(F.lit(1), cut - n_in + 1), F.least(cut, F.lit(n_in)))
    after = F.slice(values, cut + 1, F.least(n - cut, F.lit(n_out)))
    pad = lambda x, k, left: F.concat(F.array_repeat(F.lit(0.0), k - F.size(x)), x) if left else F.concat(x, F.array_repeat(F.lit(0.0), k - F.size(x)))
    ones = lambda x: F.transform(x, lambda _: F.lit(1.0))
    return F.struct(cut.alias("cut"), pad(before, n_in, True).alias("insample"), pad(ones(before), n_in, True).alias("in_mask"), pad(after, n_out, False).alias("outsample"), pad(ones(after), n_out, False).alias("out_mask"))


def pad_truncate(values: Column, n: int) -> Column:
    """The first ``n`` values, zeros after them, and a mask."""
    have = F.least(F.size(values), F.lit(n))
    pad = F.array_repeat(F.lit(0.0), n - have)
    return F.struct(F.concat(F.slice(values, 1, n), pad).alias("x"), F.concat(F.array_repeat(F.lit(1.0), have), pad).alias("mask"))


def subsample_long(values: Column, limit: int, factor: int) -> Column:
    """Every ``factor``-th value of a series longer than ``limit``."""
    return F.when(F.size(values) > limit, F.filter(values, lambda x, i: i % factor == 0)).otherwise(values)


def anomaly(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def instance_norm(df: DataFrame, by: list[str], value: str, eps: float = 1e-5) -> DataFrame:
    """Window by window: (x - mean) / sqrt(var + eps); the two columns undo it."""
    w = Window.partitionBy(*by)
    out = df.withColumn("mean", F.avg(value).over(w)).withColumn("std", F.sqrt(F.var_pop(value).over(w) + eps))
    return out.withColumn("normed", (F.col(value) - F.col("mean")) / F.col("std"))


def subtract_last(df: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("centred", F.col(value) - F.last(value).over(w))


def masked_instance_norm(df: DataFrame, by: list[str], value: str, seen: Column, eps: float = 1e-5) -> DataFrame:
    """The same over observed points only; hidden ones become 0."""
    w = Window.partitionBy(*by)
    v = F.when(seen, F.col(value))
    mean = F.avg(v).over(w)
    std = F.sqrt(F.avg(v * v).over(w) - mean * mean + eps)
    return df.withColumn("normed", F.when(seen, (F.col(value) - mean) / std).otherwise(0.0))


def normalize_frame(df: DataFrame, value: str, by: list[str] | None = None, kind: str = "standard", eps: float = 1e-8) -> DataFrame:
    """Standard (sample std) or min-max, over the frame or by sample."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    if by:
        a = {"mean": F.avg(value).over(w), "std": F.stddev_samp(value).over(w), "low": F.min(value).over(w), "high": F.max(value).over(w)}
        out = df
    else:  # one row of totals, not one window of all rows
        total = df.agg(F.avg(value).alias("mean_"), F.stddev_samp(value).alias("std_"), F.min(value).alias("low_"), F.max(value).alias("high_"))
        out = df.crossJoin(F.broadcast(total))
        a = {k: F.col(f"{k}_") for k in ("mean", "std", "low", "high")}
    x = F.col(value)
    normed = (x - a["mean"]) / (a["std"] + eps) if kind == "standard" else (x - a["low"]) / (a["high"] - a["low"] + eps)
    return out.withColumn("normed", normed).select(*df.columns, "normed")


def downsample(df: DataFrame, by: list[str], pos: str, value: str, width: int, kind: str = "avg") -> DataFrame:
    """Mean or maximum of each whole run of ``width``; a shorter tail is left out."""
    f = F.avg if kind == "avg" else F.max
    g = df.groupBy(*by, F.floor(F.col(pos) / width).alias("bin")).agg(f(value).alias("v"), F.count("*").alias("n_"))
    return g.filter(F.col("n_") == width).drop("n_")


def downsample_levels(df: DataFrame, by: list[str], pos: str, value: str, mark: str, width: int, levels: int, kind: str = "avg") -> DataFrame:
    """(by, level, bin, v, mark): a series at full length (level 0) and ``levels`` times downsampled, each from the one before,
    with the mark of the first position of every run."""
    out = now = df.select(*by, F.lit(0).alias("level"), F.col(pos).cast("long").alias("bin"), F.col(value).cast("double").alias("v"), F.col(mark).alias("mark"))
    for k in range(1, levels + 1):
        values = downsample(now, by, "bin", "v", width, kind)
        marks = now.filter(F.col("bin") % width == 0).select(*by, F.floor(F.col("bin") / width).alias("bin"), "mark")
        now = values.join(marks, [*by, "bin"]).select(*by, F.lit(k).alias("level"), "bin", "v", "mark")
        out = out.unionByName(now)
    return out


def even_odd(df: DataFrame, pos: str) -> DataFrame:
    return df.withColumn("half", F.when(F.col(pos) % 2 == 0, "even").otherwise("odd")).withColumn("at", F.floor(F.col(pos) / 2))


def patches(values: Column, width: int, stride: int, pad: int) -> Column:
    """Overlapping patches after the last value is repeated ``pad`` times."""
    long = F.concat(values, F.array_repeat(F.element_at(values, -1), pad))
    starts = F.sequence(F.lit(0), F.floor((F.size(long) - width) / stride).cast("int"))
    return F.transform(starts, lambda i: F.slice(long, i * stride + 1, width))


def frame_mask(df: DataFrame, frame: list[str], value: str) -> DataFrame:
    """1 where any channel of a frame's cell is observed; values elsewhere 0."""
    seen = F.max(F.col(value).isNotNull().cast("int")).over(Window.partitionBy(*frame))
    return df.withColumn("mask", seen).withColumn("filled", F.when(F.col("mask") == 1, F.coalesce(value, F.lit(0.0))).otherwise(0.0))


def chunk_ids(pos: Column, length: int, chunk: int) -> Column:
    """Contiguous and interval chunks of a series padded with zeros to whole chunks."""
    n = -(-length // chunk)
    return F.struct(F.floor(pos / chunk).alias("contiguous"), (pos % n).alias("interval"))


def gate_by_validity(df: DataFrame, target: list[str], rank: str, valid: Column, value: str, k: int) -> DataFrame:
    """Values of neighbours by rank, 0 for incomplete ones and for ranks that are missing."""
    got = df.groupBy(*target).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(rank), F.when(valid, F.col(value)).otherwise(0.0).alias("v"))))).alias("m"))
    return got.select(*target, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("x"))


def assemble_samples(index: DataFrame, edges: DataFrame, series: DataFrame, target: str, station: str, step: str, value: str, width: int, k: int, geometry: tuple[str, ...] = (), mean: float = 0.0, std: float = 1.0, y: DataFrame | None = None, marks=None, features: DataFrame | None = None, background: DataFrame | None = None, target_background: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """One row a sample of ``index`` (target, step as t) with what a model takes in:

    x (width x k, scaled windows of the neighbours by rank), geometry (k x columns of ``edges``) and bg (k x values of
    ``background`` (station, step, bg) at T), all 0 for a neighbour whose window isn't complete and for missing ranks;
    y and bg_target at T from ``y`` (target, step, y) and ``target_background`` (target, step, bg), features from
    ``features`` (target, features), 0 for what is missing; marks at all steps and mark_t at T by the function ``marks``
    of a step. Arrays of double; parts that aren't given are left out.

    The window of each (station, T) is made once and joined to the samples that use it: k rows a sample. ``blocks`` is the series
    as ``step_blocks``, where it is kept as a table.
    """
    want = index.select(target, F.col(step).alias(step)).distinct().join(edges.filter(F.col("rank") <= k).select(target, station, "rank", *geometry), target)
    frames = step_frames(series, want.select(station, step), [station], step, value, width, blocks)
    near = want.join(frames, [station, step])
    zero = F.lit(0.0)
    parts = [F.col("rank").cast("long").alias("rank"), F.transform("frames", lambda v: (v - mean) / std).alias("x"), F.array(*[F.coalesce(F.col(g).cast("double"), zero) for g in geometry]).cast("array<double>").alias("g")]
    if background is not None:
        near = near.join(background.select(station, step, F.col("bg").alias("b_")), [station, step], "left")
        parts.append(F.transform("b_", lambda v: F.coalesce(v, zero)).alias("b"))
    listed = F.collect_list(F.when(F.col("n") == width, F.struct(*parts)))
    row = near.groupBy(target, F.col(step).alias("t")).agg(F.map_from_entries(F.transform(listed, lambda p: F.struct(p["rank"], p))).alias("m"))
    ranks, at = F.sequence(F.lit(1), F.lit(k)), F.sequence(F.lit(1), F.lit(width))
    there = lambda r: F.col("m")[r.cast("long")]
    row = row.withColumn("x", F.transform(at, lambda p: F.transform(ranks, lambda r: F.coalesce(F.get(there(r)["x"], p - 1), zero))))
    out = ["x"]

    def gated(field: str, size: Column) -> Column:
        return F.transform(ranks, lambda r: F.coalesce(there(r)[field], F.array_repeat(zero, size)))

    if geometry:
        row, out = row.withColumn("geometry", gated("g", F.lit(len(geometry)))), [*out, "geometry"]
    if background is not None:
        n = background.agg(F.coalesce(F.max(F.size("bg")), F.lit(0)).alias("n_bg_"))  # one row
        row, out = row.crossJoin(F.broadcast(n)).withColumn("bg", gated("b", F.col("n_bg_"))), [*out, "bg"]
    if marks is not None:
        row = row.withColumn("marks", F.transform(F.sequence(F.col("t") - (width - 1), F.col("t")), marks)).withColumn("mark_t", marks(F.col("t")))
        out = [*out, "marks", "mark_t"]
    for name, table, column, keyed in (("y", y, "y", True), ("bg_target", target_background, "bg", True), ("features", features, "features", False)):
        if table is not None:
            right = table.select(target, *([F.col(step).alias("t")] if keyed else []), F.transform(column, lambda v: F.coalesce(F.nanvl(v.cast("double"), zero), zero)).alias(name))
            row, out = row.join(right, [target, *(["t"] if keyed else [])], "left"), [*out, name]
    return row.select(target, "t", *out)
