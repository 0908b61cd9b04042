"""Statistics over metric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, metrics: Sequence[str], *keys: str) -> DataFrame:
    """(keys, metric, value), nulls left out."""
    return df.unpivot(list(keys), list(metrics), "metric", "value").where("value is not null")


def describe(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """n, mean, std, min, quartiles and max of each metric."""
    q = [F.percentile("value", p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return unpivoted(df, metrics).groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), *q, F.max("value").alias("max"))


def correlations(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(a, b, r) of each pair of metrics, in one aggregate over rows that have both; null if a
    metric does not vary."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs.append(F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r{i}"))
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(f"r{i}", F.lit(None)).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def compare(real: DataFrame, baseline: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Real against baseline, a row for each metric: means, deviations, difference, percent
    increase, pooled two-sample t, Cohen's d and its label, and counts."""
    rows = unpivoted(real.withColumn("_kind", F.lit(1)), metrics, "_kind").unionByName(unpivoted(baseline.withColumn("_kind", F.lit(0)), metrics, "_kind"))
    def of(kind: int):
        return F.when(F.col("_kind") == kind, F.col("value"))

    sums = []
    for kind, name in ((1, "real"), (0, "baseline")):
        sums += [F.avg(of(kind)).alias(f"{name}_mean"), F.stddev_samp(of(kind)).alias(f"{name}_std"), F.count(of(kind)).alias(f"{name}_n")]
    out = rows.groupBy("metric").agg(*sums)
    pooled = ((F.col("real_n") - 1) * F.col("real_std") ** 2 + (F.col("baseline_n") - 1) * F.col("baseline_std") ** 2) / F.nullif(F.col("real_n") + F.col("baseline_n") - 2, F.lit(0))
    out = out.withColumn("difference", F.col("real_mean") - F.col("baseline_mean"))
    out = out.withColumn("percent_increase", F.when(F.col("baseline_mean") > 0, F.col("difference") / F.col("baseline_mean") * 100).otherwise(0.0))
    error = F.sqrt(pooled * (1 / F.nullif("real_n", F.lit(0)) + 1 / F.nullif("baseline_n", F.lit(0))))
    out = out.withColumn("t_statistic", F.when(error > 0, F.col("difference") / error))
    spread = F.sqrt((F.col("real_std") ** 2 + F.col("baseline_std") ** 2) / 2)
    out = out.withColumn("cohens_d", F.when(spread > 0, F.col("difference") / spread))
    size = F.abs("cohens_d")
    return out.withColumn("effect", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").when(size.isNotNull(), "large"))


def compare_runs(runs: dict[str, DataFrame], metric: str) -> DataFrame:
    """(run, n, mean) of a metric in several runs, such as those with different taggers."""
    found = None
    for name, df in runs.items():
        one = df.agg(F.count(metric).alias("n"), F.avg(metric).alias("mean")).select(F.lit(name).alias("run"), "n", "mean")
        found = one if found is None else found.unionByName(one)
    return found


def with_p_values(table: DataFrame) -> DataFrame:
    """compare()'s rows with p_value; they are as many as there are metrics, so the driver does it."""
    rows = [tuple(r) + (p_value(r["t_statistic"], r["real_n"] + r["baseline_n"] - 2),) for r in table.collect()]
    return table.sparkSession.createDataFrame(rows, table.schema.add("p_value", "double"))


def p_value(t: float | None, df: int) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or df < 1:
        return None
    return _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def histogram(df: DataFrame, metric: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal bins from the smallest to the largest value, which is in the last bin."""
    ends = F.broadcast(df.agg(F.min(metric).alias("_low"), F.max(metric).alias("_high")))
    place = F.least(F.floor((F.col(metric) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins) + 1, F.lit(bins))
    found = df.where(F.col(metric).isNotNull()).join(ends)
    return found.groupBy(F.when(F.col("_high") > F.col("_low"), place).otherwise(1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def by_direction(df: DataFrame, metric: str) -> DataFrame:
    """(utter_order, n, mean) of a metric."""
    return df.where(F.col(metric).isNotNull() & F.col("utter_order").isNotNull()).groupBy("utter_order").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
