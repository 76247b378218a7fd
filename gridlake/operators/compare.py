"""Comparison of two runs: coverage, differences, convergence and timers, all by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlake.functions.exprs import circular_diff
from gridlake.operators.electrical import CO_PARTITIONING


#: Columns of a convergence row that are compared even if the scenario was not solved.
DISCRETE = ("event_idx", "contingency", "name", "type", "converged", "iterations", "status_code")


def require_unique(frame: DataFrame, keys: Sequence[str], fail: bool = False) -> DataFrame:
    """(duplicated_keys, duplicated_rows); with ``fail`` raises ValueError if there are any."""
    groups = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = groups.agg(F.count(F.lit(1)).alias("duplicated_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated_rows"))
    if fail and (n := out.first()["duplicated_keys"]):
        raise ValueError(f"{n} keys occur more than once")
    return out


def _outer(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys], F.lit(True).alias("_in_a"))
    b = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys], F.lit(True).alias("_in_b"))
    return a.join(b, list(keys), "full").fillna(False, ["_in_a", "_in_b"])


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """One row: matched, only_a, only_b, match_percent (of all keys) and, for each column of ``same``, its mismatches among matched rows."""
    both = _outer(a, b, keys)
    matched = F.col("_in_a") & F.col("_in_b")
    aggs = [F.count_if(matched).alias("matched"), F.count_if(~F.col("_in_b")).alias("only_a"), F.count_if(~F.col("_in_a")).alias("only_b"), (100.0 * F.count_if(matched) / F.count(F.lit(1))).alias("match_percent")]
    aggs += [F.count_if(matched & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_mismatch") for c in same]
    return both.agg(*aggs)


def numeric_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], angles: Sequence[str] = (), atol: float = 1e-6, rtol: float = 1e-6, zero: float = 1e-9) -> DataFrame:
    """(column, n, mean_a, mean_b, mean_diff, mean_abs_diff, rms_diff, max_abs_diff, mean_percent, mean_symmetric_percent, within) of matched rows.

    Percent differences are against abs(b) where that is over ``zero``; ``within`` counts abs(diff) <= atol + rtol * abs(b). Angle differences
    are wrapped. One join and one aggregate for all columns, unpivoted afterwards.
    """
    both = _outer(a, b, keys).where("_in_a AND _in_b")
    names = ("n", "mean_a", "mean_b", "mean_diff", "mean_abs_diff", "rms_diff", "max_abs_diff", "mean_percent", "mean_symmetric_percent", "within")
    aggs = []
    for c in (*values, *angles):
        x, y = F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double")
        d = circular_diff(x, y) if c in angles else x - y
        percent = F.when(F.abs(y) > zero, 100 * F.abs(d) / F.abs(y))
        symmetric = F.when(F.abs(x) + F.abs(y) > zero, 200 * F.abs(d) / (F.abs(x) + F.abs(y)))
        parts = (F.count(d).cast("double"), F.avg(x), F.avg(y), F.avg(d), F.avg(F.abs(d)), F.sqrt(F.avg(d * d)), F.max(F.abs(d)), F.avg(percent), F.avg(symmetric), F.count_if(F.abs(d) <= atol + rtol * F.abs(y)).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("column"), *[p.alias(n) for p, n in zip(parts, names, strict=True)]).alias(f"_{c}"))
    one = both.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.col(f"_{c}") for c in (*values, *angles)])).alias("m")).select("m.*")
    return rows.withColumns({"n": F.col("n").cast("long"), "within": F.col("within").cast("long")})


def numeric_sums(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], angles: Sequence[str] = (), atol: float = 1e-6, rtol: float = 1e-6, zero: float = 1e-9) -> DataFrame:
    """What ``numeric_metrics`` is made of, as sums that can be added up over parts of the runs: a row a column."""
    both = _outer(a, b, keys).where("_in_a AND _in_b")
    aggs = []
    for c in (*values, *angles):
        x, y = F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double")
        d = circular_diff(x, y) if c in angles else x - y
        percent = F.when(F.abs(y) > zero, 100 * F.abs(d) / F.abs(y))
        symmetric = F.when(F.abs(x) + F.abs(y) > zero, 200 * F.abs(d) / (F.abs(x) + F.abs(y)))
        sums = {"sum_a": x, "sum_b": y, "sum_diff": d, "sum_abs_diff": F.abs(d), "sum_squares": d * d}
        parts = [F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in sums.items()]
        parts += [F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("max_abs_diff")]
        parts += [F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in (("sum_percent", percent), ("sum_symmetric", symmetric))]
        parts += [F.count(percent).alias("n_percent"), F.count(symmetric).alias("n_symmetric"), F.count_if(F.abs(d) <= atol + rtol * F.abs(y)).alias("within")]
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(d).alias("n"), F.count(x).alias("n_a"), F.count(y).alias("n_b"), *parts))
    return both.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def metrics_of_sums(sums: DataFrame) -> DataFrame:
    """The columns of ``numeric_metrics`` from the rows of ``numeric_sums`` of any number of parts."""
    names = [c for c in sums.columns if c not in ("column", "max_abs_diff")]
    one = sums.groupBy("column").agg(*[F.sum(c).alias(c) for c in names], F.max("max_abs_diff").alias("max_abs_diff"))
    mean = lambda c, n="n": F.try_divide(F.col(c), F.col(n))
    return one.select(
        "column", "n", mean("sum_a", "n_a").alias("mean_a"), mean("sum_b", "n_b").alias("mean_b"), mean("sum_diff").alias("mean_diff"), mean("sum_abs_diff").alias("mean_abs_diff"),
        F.sqrt(mean("sum_squares")).alias("rms_diff"), F.when(F.col("n") > 0, F.col("max_abs_diff")).alias("max_abs_diff"),
        mean("sum_percent", "n_percent").alias("mean_percent"), mean("sum_symmetric", "n_symmetric").alias("mean_symmetric_percent"), "within",
    )


def unmatched_by(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str], ranked: bool = False) -> DataFrame:
    """(by..., only_a, only_b): keys of one side only, counted by some of the key columns, say scenario or circuit; groups without any are left out.
    ``ranked`` adds rank: 1 for the largest count of both sides, equal counts sharing theirs. Counts are ranked, which are few, and not the groups."""
    both = _outer(a.select(*keys), b.select(*keys), keys)
    rows = both.groupBy(*by).agg(F.count_if(~F.col("_in_b")).alias("only_a"), F.count_if(~F.col("_in_a")).alias("only_b"))
    rows = rows.where("only_a > 0 OR only_b > 0")
    if not ranked:
        return rows
    total = F.col("only_a") + F.col("only_b")
    ranks = rows.select(total.alias("_total")).distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_total"))).cast("long"))
    return rows.withColumn("_total", total).join(ranks, "_total").drop("_total")


def convergence_matrix(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("name", "type")) -> DataFrame:
    """One row: both, neither, only_a and only_b converged, agreement percent, over scenarios of both runs."""
    both = _outer(a.select(*keys, "converged"), b.select(*keys, "converged"), keys).where("_in_a AND _in_b")
    x, y = F.col("converged_a"), F.col("converged_b")
    return both.agg(F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), (100.0 * F.count_if(x == y) / F.count(F.lit(1))).alias("agreement_percent"))


def convergence_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("name", "type"), values: Sequence[str] = ("iterations", "final_tolerance"), ok: str = "OK", **tolerances: float) -> DataFrame:
    """``numeric_metrics`` of convergence columns over the scenarios that both runs solved with status ``ok``."""
    solved = F.col("converged") & (F.col("status_code") == ok)
    return numeric_metrics(a.where(solved), b.where(solved), keys, values, **tolerances)


def status_transitions(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("name", "type")) -> DataFrame:
    """(status_a, status_b, n) of scenarios in both runs."""
    both = _outer(a.select(*keys, "status_code"), b.select(*keys, "status_code"), keys).where("_in_a AND _in_b")
    return both.groupBy(F.col("status_code_a").alias("status_a"), F.col("status_code_b").alias("status_b")).agg(F.count(F.lit(1)).alias("n"))


def series_stats(frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, median, p95, min and max of a column."""
    v = F.col(value)
    return frame.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.95).alias("p95"), F.min(v).alias("min"), F.max(v).alias("max"))


def annotate_coverage(unmatched: DataFrame, a: DataFrame, b: DataFrame, key: str = "event_idx") -> DataFrame:
    """Unmatched counts by scenario with each side's converged and status_code (null where the side lacks the scenario)."""
    out = unmatched
    for frame, s in ((a, "a"), (b, "b")):
        out = out.join(frame.select(key, F.col("converged").alias(f"converged_{s}"), F.col("status_code").alias(f"status_{s}")), key, "left")
    return out


def compare_buses(a: DataFrame, b: DataFrame, categories: Sequence[str] = ("name", "area", "zone", "owner")) -> DataFrame:
    """One row: matched, only_a and only_b buses, mean and max base voltage difference, mismatches of each category."""
    both = _outer(a.select("bus_id", "base_kv", *categories), b.select("bus_id", "base_kv", *categories), ["bus_id"])
    matched = F.col("_in_a") & F.col("_in_b")
    d = F.abs(F.col("base_kv_a") - F.col("base_kv_b"))
    return both.agg(F.count_if(matched).alias("matched"), F.count_if(~F.col("_in_b")).alias("only_a"), F.count_if(~F.col("_in_a")).alias("only_b"), F.avg(d).alias("mean_kv_diff"), F.max(d).alias("max_kv_diff"), *[F.count_if(matched & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_mismatch") for c in categories])


def timer_comparison(a: DataFrame, b: DataFrame, comparable: Sequence[str] | None = None) -> DataFrame:
    """(timer, seconds_a, seconds_b, speedup, reduction_percent): speed-up of b only for names in both (and in ``comparable``, if given)."""
    both = a.select("timer", F.col("seconds").alias("seconds_a")).join(b.select("timer", F.col("seconds").alias("seconds_b")), "timer", "full")
    fair = F.lit(True) if comparable is None else F.col("timer").isin(*comparable)
    fair = fair & (F.col("seconds_b") > 0) & (F.col("seconds_a") > 0)
    return both.withColumns({"speedup": F.when(fair, F.col("seconds_a") / F.col("seconds_b")), "reduction_percent": F.when(fair, 100 * (1 - F.col("seconds_b") / F.col("seconds_a")))})


def _close(x: Column, y: Column, atol: float, rtol: float) -> Column:
    infinite = F.abs(x) == float("inf")
    infinite = infinite | (F.abs(y) == float("inf"))
    near = F.abs(x - y) <= atol + rtol * F.abs(y)
    return (F.isnan(x) & F.isnan(y)) | (x.isNull() & y.isNull()) | F.when(infinite, x == y).otherwise(F.coalesce(near, F.lit(False)) & ~F.isnan(x) & ~F.isnan(y))


def assert_close(golden: DataFrame, candidate: DataFrame, exact: Sequence[str], floats: Sequence[str], atol: float = 1e-6, rtol: float = 1e-6, converged: str | None = None, discrete: Sequence[str] = DISCRETE) -> DataFrame:
    """One row: rows only in golden, only in candidate, and of each float column the values further apart than atol + rtol * abs(candidate).

    Exact columns are the key; rows with an equal key are paired in order of their floats. NaN equals NaN, infinities must be equal.
    ``converged`` names an exact column that tells solved rows (null: solved); of the others only the columns of ``discrete`` are compared, as
    the residuals of a diverging solution mean nothing. Exact columns left out of that must be numbers, strings or booleans. Rows stay where their
    keys are numbered if joins needn't be dealt by all of their keys, so this sets CO_PARTITIONING.
    """
    if converged is not None:
        solved = F.coalesce(F.col(converged), F.lit(True))
        kept = (*discrete, converged)
        golden, candidate = (
            f.withColumns({c: F.when(solved, F.col(c)).otherwise(F.lit("0").cast(f.schema[c].dataType) if c in exact else F.lit(None)) for c in (*exact, *floats) if c not in kept})
            for f in (golden, candidate)
        )
    golden.sparkSession.conf.set(CO_PARTITIONING, "false")
    n = F.row_number().over(Window.partitionBy(*exact).orderBy(*floats))
    both = _outer(golden.select(*exact, *floats).withColumn("_n", n), candidate.select(*exact, *floats).withColumn("_n", n), [*exact, "_n"])
    matched = F.col("_in_a") & F.col("_in_b")
    bad = [F.count_if(matched & ~_close(F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double"), atol, rtol)).alias(f"{c}_bad") for c in floats]
    return both.agg(F.count_if(~F.col("_in_b")).alias("only_golden"), F.count_if(~F.col("_in_a")).alias("only_candidate"), *bad)
