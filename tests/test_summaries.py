"""Merged states against the statistics of the whole, blocks of statistics, and quantiles of large groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import stats, summaries

LONG = "row_key string, scenario_idx int, value double, mask int, min_bound double, max_bound double"


def rounded(frame):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


def close(found, wanted):
    """The same rows by row_key, doubles to 12 digits or 1e-5 (deviations of values of 1e9 have no more)."""
    a, b = (sorted(map(tuple, f.collect())) for f in (found, wanted))
    same = lambda x, y: math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-5) if isinstance(x, float) and isinstance(y, float) else x == y
    return len(a) == len(b) and all(same(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_any_batching_gives_the_statistics_of_the_whole(spark, parts):
    rng = random.Random(parts)
    rows = [(f"k{k}", s, 1e9 * (k == 1) + rng.choice([rng.gauss(0, 1), 2.0, 2.0]), rng.randrange(3), -1.0 - k, 1.0 + k) for k in range(9) for s in range(14) if (k, s) != (4, 0) and rng.random() < 0.9 and not (k == 5 and s > 0)]
    whole = spark.createDataFrame(rows, LONG)
    dealt = [spark.createDataFrame([r for r in rows if (hash((r[0], r[1])) % parts) == p], LONG) for p in range(parts)]
    for mask in (0, 1, 2):
        states = [summaries.state(d, mask) for d in dealt]
        one = summaries.merged(states) if parts < 5 else summaries.merged([summaries.merged(states[:3]), summaries.merged(states[3:])])
        for found, wanted in ((summaries.mean_rms_of(one), stats.mean_rms(whole, mask)), (summaries.min_max_of(one), stats.min_max(whole, mask)), (summaries.mask_count_of(one, mask), stats.mask_count(whole, mask))):
            assert found.columns == wanted.columns and close(found, wanted)


def test_blocks_of_buses(spark):
    voltage = spark.createDataFrame([(e, b, 1.0 + e / 10 + b / 100) for e in range(4) for b in (1, 2)], "event_idx int, bus_id long, v_pu double")
    convergence = spark.createDataFrame([(1, True), (2, False), (3, True), (2, False)], "event_idx int, converged boolean")
    changed = (F.col("event_idx") == 3) & (F.col("bus_id") == 2)
    found = summaries.stat_block(voltage, convergence, ["bus_id"], "v_pu", changed, F.lit(0.9), F.lit(1.1))
    assert rounded(found.select("row_key", "scenario_idx", "value", "mask")) == [("1", 0, 1.01, 1), ("1", 1, 1.11, 1), ("1", 2, 0.0, 0), ("1", 3, 1.31, 1), ("2", 0, 1.02, 1), ("2", 1, 1.12, 1), ("2", 2, 0.0, 0), ("2", 3, 1.32, 2)]


def test_exact_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(size=30_000), 2: np.round(rng.exponential(size=20_001), 1), 3: np.full(9_000, 7.0), 4: rng.normal(size=50), 5: np.concatenate([np.full(20_000, -1.0), [5.0]])}
    rows = spark.createDataFrame([(k, 0, float(v)) for k, vs in groups.items() for v in vs] + [(1, 0, None)], "machine int, step int, value double")
    qs = [0.0, 0.05, 0.5, 0.937, 1.0]
    for accuracy in (100, 2000):
        found = {(r.machine, r.q): r.value for r in summaries.exact_quantiles(rows, qs, large=5_000, accuracy=accuracy).collect()}
        assert set(found) == {(k, q) for k in groups for q in qs}
        for (k, q), v in found.items():
            assert abs(v - np.quantile(groups[k], q)) < 1e-12, (k, q)


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("machine"), F.lit(0).alias("step"), (F.col("id") * 7919 % 60_000 / 1.0).alias("value"))
    parts = [summaries.quantile_sketch(rows.where(F.pmod(F.xxhash64("value"), F.lit(3)) == i)) for i in range(3)]
    for r in summaries.quantiles_of_sketches(summaries.merged_sketches(parts), [0.1, 0.5, 0.99]).collect():
        assert r.n == 30_000 and abs(r.value / 60_000 - r.q) < 0.0133


def test_result_rows_of_a_block_are_not_shuffled(spark):
    rows = spark.range(60).select((F.col("id") % 3).cast("int").alias("event_idx"), "id", F.lit(1.0).alias("p"))
    cases = spark.createDataFrame([(1, True), (2, False)], "event_idx int, converged boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = summaries.stat_block(rows, cases, ["id"], "p", F.lit(False), F.lit(0.0), F.lit(2.0))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
