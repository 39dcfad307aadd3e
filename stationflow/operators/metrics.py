"""Task metrics: forecasting, imputation, anomaly detection, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forecast_errors(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """MAE, MSE, RMSE, MAPE, MSPE (over rows whose truth isn't 0)."""
    d = F.col(pred) - F.col(truth)
    rel = F.try_divide(d, F.nullif(F.col(truth), F.lit(0.0)))
    return df.groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(rel)).alias("mape"), F.avg(rel * rel).alias("mspe"))


def rse(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """Root relative squared error."""
    t, d = F.col(truth), F.col(truth) - F.col(pred)
    return df.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(d * d), F.var_pop(t) * F.count(t))).alias("rse"))


def corr_last_axis(df: DataFrame, truth: str, pred: str, time: str, series: str, by: list[str]) -> DataFrame:
    """Mean over series of sum(u v) / sqrt(sum(u^2 v^2)), u and v centred over time: not Pearson's r."""
    w = Window.partitionBy(*by, series)
    u, v = F.col(truth) - F.avg(truth).over(w), F.col(pred) - F.avg(pred).over(w)
    rows = df.withColumn("uv", u * v)
    one = rows.groupBy(*by, series).agg(F.try_divide(F.sum("uv"), F.sqrt(F.sum(F.col("uv") * F.col("uv")))).alias("c"))
    return one.groupBy(*by).agg(F.avg("c").alias("corr"))


def errors_with_total(df: DataFrame, truth: str, pred: str, var: str) -> DataFrame:
    """By variable and overall (NULL), from one scan."""
    d = F.col(pred) - F.col(truth)
    return df.groupingSets([[F.col(var)], []], F.col(var)).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def masked_errors(df: DataFrame, truth: str, pred: str, mask: Column, by: list[str]) -> DataFrame:
    """Errors of hidden points only."""
    return forecast_errors(df.filter(mask), truth, pred, by)


def competition_errors(df: DataFrame, series: list[str], step: str, truth: str, pred: str, train: DataFrame, lag: int) -> DataFrame:
    """sMAPE and MAPE in percent (0 denominators count as 1), and MASE against a seasonal naive forecast of the training part."""
    w = Window.partitionBy(*series).orderBy(step)
    scale = train.withColumn("d_", F.abs(F.col(truth) - F.lag(truth, lag).over(w))).groupBy(*series).agg(F.avg("d_").alias("scale"))
    d = F.abs(F.col(truth) - F.col(pred))
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    e = df.groupBy(*series).agg(F.avg(200 * d / one(F.abs(F.col(truth)) + F.abs(F.col(pred)))).alias("smape"), F.avg(100 * d / one(F.abs(F.col(truth)))).alias("mape"), F.avg(d).alias("mae"))
    return e.join(scale, series, "left").withColumn("mase", F.try_divide("mae", "scale")).drop("mae", "scale")


def owa(model: DataFrame, baseline: DataFrame, group: str) -> DataFrame:
    """Overall weighted average against a baseline by group, and the mean of all groups weighted by size."""
    mean = lambda x, p: x.groupBy(group).agg(F.avg("smape").alias(f"smape{p}"), F.avg("mase").alias(f"mase{p}"), F.count("*").alias(f"n{p}"))
    j = mean(model, "").join(mean(baseline, "_b"), group)
    j = j.withColumn("owa", (F.try_divide("smape", "smape_b") + F.try_divide("mase", "mase_b")) / 2)
    groups = j.select(F.col(group).cast("string").alias("grp"), "smape", "mase", "owa", "n")
    w = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n"))
    total = j.agg(*[w(c).alias(c) for c in ("smape", "mase", "smape_b", "mase_b")], F.sum("n").alias("n"))
    total = total.select(F.lit("Average").alias("grp"), "smape", "mase", ((F.try_divide("smape", "smape_b") + F.try_divide("mase", "mase_b")) / 2).alias("owa"), "n")
    return groups.unionByName(total)


#: The groups of the competition that stand alone; the rest are told as Others.
ALONE = ("Yearly", "Quarterly", "Monthly")


def competition_summary(model: DataFrame, baseline: DataFrame, group: str, digits: int = 3) -> DataFrame:
    """(grp, smape, mase, owa, n): Yearly, Quarterly and Monthly, Others (all other groups weighted by size) and Average, to ``digits`` digits."""
    named = F.when(F.col(group).isin(*ALONE), F.col(group)).otherwise("Others")
    mean = lambda x, p: x.groupBy(named.alias("grp")).agg(F.avg("smape").alias(f"smape{p}"), F.avg("mase").alias(f"mase{p}"), F.count("*").alias(f"n{p}"))
    j = mean(model, "").join(mean(baseline, "_b"), "grp").drop("n_b")
    w = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n"))
    total = j.agg(*[w(c).alias(c) for c in ("smape", "mase", "smape_b", "mase_b")], F.sum("n").alias("n")).withColumn("grp", F.lit("Average"))
    owa = (F.try_divide("smape", "smape_b") + F.try_divide("mase", "mase_b")) / 2
    return j.unionByName(total).select("grp", *[F.round(x, digits).alias(n) for x, n in ((F.col("smape"), "smape"), (F.col("mase"), "mase"), (owa, "owa"))], "n")


def anomaly_flags(train: DataFrame, test: DataFrame, score: str, ratio: float) -> DataFrame:
    """Test rows flagged where the score is over the percentile of both parts that leaves ``ratio`` percent."""
    t = train.select(score).unionByName(test.select(score)).agg(F.percentile(score, 1 - ratio / 100).alias("threshold"))  # one row
    return test.crossJoin(F.broadcast(t)).withColumn("pred", (F.col(score) > F.col("threshold")).cast("int"))


def point_adjust(df: DataFrame, by: list[str], step: str, truth: str, pred: str) -> DataFrame:
    """A run of true anomalies with a hit counts as hit throughout."""
    w = Window.partitionBy(*by).orderBy(step)
    start = F.coalesce((F.col(truth) != F.lag(truth).over(w)).cast("int"), F.lit(0))
    runs = df.withColumn("s_", start).withColumn("run_", F.sum("s_").over(w))
    hit = F.max(pred).over(Window.partitionBy(*by, "run_"))
    return runs.withColumn("adjusted", F.when(F.col(truth) == 1, hit).otherwise(F.col(pred))).drop("s_", "run_")


def detection_scores(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    c = df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.avg((t == p).cast("double")).alias("accuracy"))
    prec, rec = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select(*(by or []), "accuracy", F.coalesce(prec, F.lit(0.0)).alias("precision"), F.coalesce(rec, F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Codes of the sorted categories: a table of classes."""
    classes = df.select(label).distinct()
    return df.join(F.broadcast(classes.withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)), label)


def reconstruction_score(df: DataFrame, by: list[str], value: str, rebuilt: str) -> DataFrame:
    d = F.col(value) - F.col(rebuilt)
    return df.groupBy(*by).agg(F.avg(d * d).alias("score"))
