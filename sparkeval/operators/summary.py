"""Summaries of score columns: one long row for each metric, by group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import small, staged

#: Percentiles that one pass finds, and the accuracy of their ranks, which is far finer than a step.
STEPS, ACCURACY = 1000, 20_000
#: Different values of a group that one task may walk through.
VALUES = 200_000


def long_form(df: DataFrame, metrics: list[str], *groups: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics]))
    return df.select(*groups, pairs.alias("m")).select(*groups, "m.metric", "m.score")


def _percentiles(score: Column) -> Column:
    return F.percentile_approx(score, [i / STEPS for i in range(STEPS + 1)], ACCURACY)


def _same(keys: list[str]) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))


def _within(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Scores with their group's ``low``, ``high`` and ranks; a row for each group is broadcast if small."""
    bounds = state.select(*[F.col(k).alias(f"__{k}") for k in keys], "low", "high", "first", "last")
    return rows.where("score is not null").join(F.broadcast(bounds) if small(state) else bounds, _same(keys))


def _narrowed(percentiles: Column, first: Column, last: Column, n: Column) -> dict[str, Column]:
    """The percentiles that hold the ranks ``first`` to ``last`` (from 0) of ``n`` between them."""
    low = F.greatest(F.floor(first * STEPS / n) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil((last + 1) * STEPS / n) + 1, F.lit(STEPS)).cast("int")
    return {"low": F.get(percentiles, low), "high": F.get(percentiles, high)}


def summarise(df: DataFrame, metrics: list[str], *groups: str) -> DataFrame:
    """n, mean, exact median, population standard deviation, least and greatest of each metric.

    An empty table gives no rows; null scores do not count.  The median is by selection: one pass
    gives the other statistics and percentiles, two of which hold the median between them; the next
    counts the scores below, and those between by value.  So equal scores are one row a task, however
    many, and nothing is sorted or dealt by group but what lies between.  Of very large groups, more
    passes first bring that down by a factor of some hundreds each.  ``df`` is computed once: its
    scores and groups are written, and the passes read them.
    """
    keys = [*groups, "metric"]
    rows = long_form(staged(df.select(*groups, *metrics), "scores"), metrics, *groups)
    stats = [F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max")]
    found = rows.groupBy(*keys).agg(*stats, _percentiles(F.col("score")).alias("p"))
    n = F.greatest("n", F.lit(1))
    found = found.withColumns({"first": F.floor((n - 1) / 2), "last": F.floor(n / 2)})
    found = found.withColumns(_narrowed(F.col("p"), F.col("first"), F.col("last"), n)).withColumn("between", F.col("n") * 5 / STEPS).drop("p")
    found = staged(found, "statistics")
    state = found.select(*keys, "low", "high", "first", "last", "between", "min", "max")
    while state.where((F.col("between") > VALUES) & (F.col("low") < F.col("high"))).limit(1).count():
        state = staged(_pass(rows, state, keys), "narrowed")
    medians = staged(_medians(rows, state, keys), "medians")
    lost = state.where("min is not null").join(medians.where("median is not null"), _same(keys), "left_anti")
    if lost.limit(1).count():  # bounds that a sketch got wrong: the widest are right, if slow
        wide = _medians(rows, lost.withColumns({"low": F.col("min"), "high": F.col("max")}), keys)
        medians = medians.where("median is not null").union(wide)
    return found.drop("low", "high", "first", "last", "between").join(medians, _same(keys), "left").select(*keys, "n", "mean", "median", "std", "min", "max")


def _pass(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds narrowed once more: percentiles of what lies between them, at ranks less those below."""
    own = [f"__{k}" for k in keys]
    inside = F.col("score").between(F.col("low"), F.col("high"))
    counts = _within(rows, state, keys).groupBy(*own).agg(
        F.count(F.when(F.col("score") < F.col("low"), 1)).alias("below"), F.count(F.when(inside, 1)).alias("m"),
        _percentiles(F.when(inside, F.col("score"))).alias("p"), F.min(F.when(inside, F.col("score"))).alias("least"), F.max(F.when(inside, F.col("score"))).alias("most"),
    )
    first, last, m = F.col("first") - F.col("below"), F.col("last") - F.col("below"), F.greatest("m", F.lit(1))
    held = (first >= 0) & (last < F.col("m"))  # else the bounds were wrong, and the widest are right
    new = {k: F.when(held, v).otherwise(F.col(w)) for (k, v), w in zip(_narrowed(F.col("p"), first, last, m).items(), ("min", "max"), strict=True)}
    new["between"] = F.when(F.col("least") == F.col("most"), 1.0).otherwise(F.col("m") * 5 / STEPS)
    return state.join(counts, _same(keys)).withColumns(new).select(*keys, "low", "high", "first", "last", "between", "min", "max")


def _medians(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The keys (by other names) and median: values between the bounds with their counts, and one row
    for all that are below."""
    own = [f"__{k}" for k in keys]
    place = F.when(F.col("score") < F.col("low"), F.lit(None)).otherwise(F.col("score")).alias("value")
    upto = _within(rows, state, keys).where(F.col("score") <= F.col("high"))
    counts = upto.groupBy(*own, "first", "last", place).agg(F.count("*").alias("c"))
    ends = F.sum("c").over(Window.partitionBy(*own).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("end", ends).withColumn("start", F.col("end") - F.col("c"))
    holds = lambda rank: F.max(F.when((F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("end")), F.col("value")))
    return at.groupBy(*own).agg(((holds("first") + holds("last")) / 2).alias("median"))


def render(summary: DataFrame) -> str:
    """The summary as text, four places; it has one row for each metric and group."""
    rows = summary.orderBy(*[c for c in summary.columns if c not in ("n", "mean", "median", "std", "min", "max")]).collect()
    return "\n".join("\t".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in [tuple(summary.columns), *map(tuple, rows)]) + "\n"
