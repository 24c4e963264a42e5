"""Ranks over whole columns.  A global window would bring every row to one task, so ranks are
taken over the distinct values (counted first, map-side) and joined back to the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges into which a column's distinct values are dealt for running counts; their bounds are
#: quantiles of the distinct values, so that a heavy tail doesn't put most of them in one range.
RANGES = 256


def long_form(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(key, metric, value) rows."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.metric", "c.value")


def _positions(rows: DataFrame) -> DataFrame:
    """(metric, value, less, same, n, kinds) for each distinct value.  Running counts are in two
    steps: sums of value ranges (few rows), then within a range.  The bounds of the ranges needn't
    be exact quantiles: any bounds give the same counts."""
    counts = rows.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("same"))
    cuts = F.array_sort(F.array_distinct(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 4 * RANGES)))
    edges = counts.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("same").alias("n"), F.count(F.lit(1)).alias("kinds"), cuts.alias("cuts"))
    # The number of bounds up to the value, found by halving.
    steps = RANGES.bit_length()
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("a"), F.size("cuts").alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s).otherwise(F.when(F.get("cuts", F.floor((s["a"] + s["b"]) / 2).cast("int")) <= F.col("value"), F.struct((F.floor((s["a"] + s["b"]) / 2).cast("int") + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b")))),
        lambda s: s["a"],
    )
    dealt = counts.join(edges, "metric").withColumn("range", F.when(F.col("value").isNull(), -1).otherwise(found)).drop("cuts")
    sums = dealt.groupBy("metric", "range").agg(F.sum("same").alias("s"))
    before = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("metric", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("metric", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("inner", F.coalesce(F.sum("same").over(within), F.lit(0))).join(sums, ["metric", "range"])
    return found.select("metric", "value", (F.col("base") + F.col("inner")).alias("less"), "same", "n", "kinds", "lo", "hi")


def percentile_ranks(rows: DataFrame, key: str) -> DataFrame:
    """(key, metric, score): average rank of ties by the count, in percent; 50 for a constant."""
    p = _positions(rows)
    score = F.when(F.col("kinds") <= 1, 50.0).otherwise((F.col("less") + (F.col("same") + 1) / 2) / F.col("n") * 100)
    return rows.join(p, ["metric", "value"]).select(key, "metric", score.alias("score"))


def strict_ranks(rows: DataFrame, key: str) -> DataFrame:
    """(key, metric, score): share of smaller values among the others, in percent; a constant is
    0 if it is 0, else 50."""
    p = _positions(rows)
    flat = F.when(F.col("value") == 0, 0.0).otherwise(50.0)
    score = F.when(F.col("kinds") <= 1, flat).otherwise(F.col("less") / (F.col("n") - 1) * 100)
    return rows.join(p, ["metric", "value"]).select(key, "metric", score.alias("score"))


def minmax(rows: DataFrame, key: str) -> DataFrame:
    """(key, metric, score): place between least and greatest, in percent; a constant as above."""
    e = rows.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.when(F.col("value") == 0, 0.0).otherwise(50.0)
    score = F.when(F.col("hi") == F.col("lo"), flat).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100)
    return rows.join(e, "metric").select(key, "metric", score.alias("score"))


def weighted_composite(scores: DataFrame, key: str, weights: Mapping[str, float], name: str) -> DataFrame:
    """The weighted mean of a key's scores; a sum of weights of 0 counts as 1."""
    total = sum(weights.values()) or 1.0
    w = F.lit(0.0)
    for metric, weight in weights.items():
        w = F.when(F.col("metric") == metric, float(weight)).otherwise(w)
    return scores.groupBy(key).agg((F.sum(F.col("score") * w) / total).alias(name))
