"""Statistics that arrive in parts: states that batches of scenarios are merged into, and quantiles of groups of any size.

A state has a row for each row_key: counts, means and squared deviations of its values, least and largest with their scenarios, and counts
of each mask. States of parts are merged by aggregation alone, in any order and number, and give the tables of ``stats`` on the whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlake.functions.durable import Workspace
from gridlake.operators.stats import ensemble_quantiles

MASKS = (0, 1, 2)
_SAME_ACROSS_ROWS = ("base", "min_bound", "max_bound")


def state(stat: DataFrame, mask: int) -> DataFrame:
    """The state of one part of a long table (row_key, scenario_idx, value, mask, min_bound, max_bound), over values of at least this mask.

    (row_key, n, mean, m2) are number, mean and sum of squared deviations of all of them, (other_n, other_mean, other_m2) of those
    besides scenario 0, whose value is ``base``; low and high are (value, scenario) with the first scenario winning ties and the base
    always among them; mask_0 to mask_2 count masks. A part may hold any scenarios of any rows, but no scenario of a row twice."""
    use, others = F.col("mask") >= mask, F.col("scenario_idx") > 0
    seen = use | ~others
    moments = []
    for prefix, keep in (("", use), ("other_", use & others)):
        x = F.when(keep, F.col("value"))
        n = F.count(x)
        moments += [n.alias(f"{prefix}n"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{prefix}mean"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias(f"{prefix}m2")]
    low = F.min(F.when(seen, F.struct("value", "scenario_idx"))).alias("low")
    high = F.max(F.when(seen, F.struct("value", (-F.col("scenario_idx")).alias("n")))).alias("high")
    base = F.max(F.when(~others, F.col("value"))).alias("base")
    counts = [F.count_if(F.col("mask") == m).alias(f"mask_{m}") for m in MASKS]
    return stat.groupBy("row_key").agg(*moments, low, high, base, F.min("min_bound").alias("min_bound"), F.max("max_bound").alias("max_bound"), *counts)


def merged(states: Sequence[DataFrame]) -> DataFrame:
    """One state of several. Squared deviations are taken from a mean that the parts of a row agree on, so large values with small deviations keep their digits."""
    rows = reduce(DataFrame.unionByName, states)
    of_row = Window.partitionBy("row_key")
    aggs: list[Column] = []
    for p in ("", "other_"):
        rows = rows.withColumn(f"_{p}pivot", F.max(F.when(F.col(f"{p}n") > 0, F.col(f"{p}mean"))).over(of_row))
    for p in ("", "other_"):
        n, off = F.col(f"{p}n"), F.coalesce(F.col(f"{p}mean") - F.col(f"_{p}pivot"), F.lit(0.0))
        total = F.sum(n)
        shift = F.try_divide(F.sum(n * off), total)
        aggs += [total.alias(f"{p}n"), F.coalesce(F.max(f"_{p}pivot") + shift, F.lit(0.0)).alias(f"{p}mean")]
        aggs += [F.coalesce(F.sum(F.col(f"{p}m2")) + F.sum(n * off * off) - total * shift * shift, F.lit(0.0)).alias(f"{p}m2")]
    aggs += [F.min("low").alias("low"), F.max("high").alias("high"), F.max("base").alias("base"), F.min("min_bound").alias("min_bound"), F.max("max_bound").alias("max_bound")]
    aggs += [F.sum(f"mask_{m}").alias(f"mask_{m}") for m in MASKS]
    return rows.groupBy("row_key").agg(*aggs).select(*states[0].columns)


def mean_rms_of(states: DataFrame) -> DataFrame:
    """``stats.mean_rms`` of what the state was made from."""
    many = F.col("n") > 1
    off = F.col("other_mean") - F.col("base")
    square = F.greatest("other_m2", F.lit(0.0)) + F.col("other_n") * off * off  # null without a base
    rms = F.when(many & (F.col("other_n") > 0), F.sqrt(square / (F.col("n") - 1))).when(F.col("base").isNotNull() | ~many, 0.0)
    std = F.when(many, F.sqrt(F.greatest("m2", F.lit(0.0)) / (F.col("n") - 1))).otherwise(0.0)
    return states.select("row_key", "n", "mean", std.alias("std"), rms.alias("rms"))


def min_max_of(states: DataFrame) -> DataFrame:
    """``stats.min_max`` of what the state was made from."""
    low, high = F.col("low.value"), F.col("high.value")
    return states.where("base IS NOT NULL").select("row_key", "base", low.alias("min"), high.alias("max"), (low - F.col("base")).alias("d_min"), (high - F.col("base")).alias("d_max"), "min_bound", "max_bound", F.col("low.scenario_idx").alias("argmin"), (-F.col("high.n")).alias("argmax"))


def mask_count_of(states: DataFrame, mask: int) -> DataFrame:
    """``stats.mask_count`` of what the state was made from."""
    return states.select("row_key", F.col(f"mask_{mask}").alias("n"))


def stat_block(rows: DataFrame, convergence: DataFrame, keys: Sequence[str], value: str, flagged: Column, low: Column, high: Column) -> DataFrame:
    """Long table (row_key, scenario_idx, value, mask, min_bound, max_bound) of any kind of result rows (event_idx, keys..., value), one for each key and event.

    Event 0 is the base; of the others those that converged are kept, mask 2 where ``flagged`` (null: not), else 1. Scenarios that
    didn't converge are filled in with value 0 and mask 0 for every row of the base case, with its bounds. Voltages and angles of buses are flagged where a
    bus went from PV to PQ, generators where their bus did, circuits where they are over their rating."""
    shown = rows.select(F.concat_ws("_", *keys).alias("row_key"), F.col("event_idx").alias("scenario_idx"), F.col(value).cast("double").alias("value"), F.when(flagged, 2).otherwise(1).alias("mask"), low.cast("double").alias("min_bound"), high.cast("double").alias("max_bound"))
    good = convergence.where("converged").select(F.col("event_idx").alias("scenario_idx")).distinct()
    # scenarios are few beside rows, which stay where they are
    solved = shown.where("scenario_idx = 0").unionByName(shown.where("scenario_idx <> 0").join(F.broadcast(good), "scenario_idx", "left_semi").select(*shown.columns))
    failed = convergence.where("NOT converged AND event_idx <> 0").select(F.col("event_idx").alias("scenario_idx")).distinct()
    base = shown.where("scenario_idx = 0").select("row_key", "min_bound", "max_bound")
    filled = base.crossJoin(F.broadcast(failed)).select("row_key", "scenario_idx", F.lit(0.0).alias("value"), F.lit(0).alias("mask"), "min_bound", "max_bound")
    return solved.unionByName(filled)


def exact_quantiles(series: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ("machine", "step"), large: int = 1_000_000, accuracy: int = 10_000) -> DataFrame:
    """(keys, q, value): what ``ensemble_quantiles`` gives, for groups of any size. Null values are left out.

    Groups of at most ``large`` values are gathered. Of a larger one, a sketch in bounded memory tells between which values a quantile
    lies; one more pass counts what is below and how often each value in between occurs, some 4 / accuracy of the group, from which the order
    statistics are read off. Should a sketch have been wrong, its bracket is widened and counted again."""
    rows = series.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"))
    with Workspace(series.sparkSession) as tables:
        sizes = tables.keep(tables.durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)))  # at most rows / large
        if sizes.isEmpty():
            return ensemble_quantiles(rows, quantiles, keys)
        some = rows.join(F.broadcast(sizes), list(keys))
        found, left, margin = None, sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))), 2.0 / accuracy
        while True:
            points = sorted({min(1.0, max(0.0, q + s * margin)) for q in quantiles for s in (-1, 1)})
            sketch = some.groupBy(*keys).agg(F.percentile_approx("value", points, accuracy).alias("at"))
            index = lambda s: F.element_at(F.create_map(*[F.lit(x) for q in quantiles for x in (float(q), points.index(min(1.0, max(0.0, q + s * margin))) + 1)]), F.col("q"))  # noqa: B023, E731
            brackets = left.join(sketch, list(keys)).select(*keys, "q", "n", F.element_at("at", index(-1)).alias("low"), F.element_at("at", index(1)).alias("high"))
            brackets = tables.durable(brackets)
            near = some.drop("n").join(F.broadcast(brackets), list(keys)).where("value <= high").withColumn("value", F.when(F.col("value") >= F.col("low"), F.col("value")))
            counted = tables.durable(near.groupBy(*keys, "q", "n", "value").agg(F.count(F.lit(1)).alias("times")))
            order = Window.partitionBy(*keys, "q").orderBy(F.col("value").asc_nulls_first())
            upto = counted.withColumn("upto", F.sum("times").over(order))
            exact = F.col("q") * (F.col("n") - 1)
            rank = F.floor(exact)
            at = lambda r: F.min(F.when((F.col("upto") > r) & F.col("value").isNotNull(), F.col("value")))
            below = F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("times"))), F.lit(0)).alias("below")
            one = upto.groupBy(*keys, "q", "n").agg(at(rank).alias("a"), at(F.least(rank + 1, F.col("n") - 1)).alias("b"), below)
            good = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("below") <= rank)
            one = tables.keep(tables.durable(one.withColumn("good", good).withColumn("result", F.col("a") + (exact - rank) * (F.col("b") - F.col("a")))))
            part = one.where("good").select(*keys, "q", F.col("result").alias("value"))
            found = part if found is None else found.union(part)
            left = one.where("NOT good").select(*keys, "n", "q")
            if left.isEmpty() or margin >= 1:
                break
            margin *= 8
    return found.union(ensemble_quantiles(rows.join(F.broadcast(sizes.select(*keys)), list(keys), "left_anti"), quantiles, keys))


def quantile_sketch(series: DataFrame, keys: Sequence[str] = ("machine", "step")) -> DataFrame:
    """(keys, sketch): a KLL sketch of each group, some kilobytes whatever its size; sketches of parts are merged by ``merged_sketches``."""
    return series.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.expr("kll_sketch_agg_double(cast(value AS double))").alias("sketch"))


def merged_sketches(sketches: Sequence[DataFrame], keys: Sequence[str] = ("machine", "step")) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy(*keys).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def quantiles_of_sketches(sketches: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ("machine", "step")) -> DataFrame:
    """(keys, n, q, value): approximate quantiles, as a rule within 0.0133 of the group in rank (the stated error of sketches of this size)."""
    points = ", ".join(f"{float(q)!r}D" for q in quantiles)
    rows = sketches.select(*keys, F.expr("kll_sketch_get_n_double(sketch)").alias("n"), F.expr(f"kll_sketch_get_quantile_double(sketch, array({points}))").alias("values"))
    each = rows.select(*keys, "n", F.posexplode("values").alias("place", "value"))
    return each.select(*keys, "n", F.get(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("place")).alias("q"), "value")
