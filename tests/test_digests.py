"""Comparisons of stored runs: the same answers as comparing all rows, and only changed buckets are read."""

import math

import pytest
from pyspark.sql import functions as F

from gridlake.operators import compare, digests

KEYS = ["event_idx", "bus"]


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    rows = spark.range(400).select((F.col("id") % 40).cast("int").alias("event_idx"), F.floor(F.col("id") / 40).alias("bus"), (F.col("id") * 1.25 - 60).alias("p"), ((F.col("id") * 37) % 360 * 1.0).alias("angle"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("name"))
    one = rows.withColumn("p", F.when((F.col("event_idx") == 17) & (F.col("bus") == 3), 1e6).otherwise(F.col("p")))
    more = one.where("NOT (event_idx = 5 AND bus > 7)").withColumns({"angle": F.when(F.col("event_idx") == 22, F.pmod(F.col("angle") + 359, F.lit(360))).otherwise(F.col("angle")), "name": F.when(F.col("event_idx") == 30, None).otherwise(F.col("name"))})
    more = more.withColumn("p", F.when((F.col("event_idx") == 39) & (F.col("bus") == 0), float("nan")).when(F.col("event_idx") == 38, None).otherwise(F.col("p")))
    out = {"a": rows, "one": one, "more": more}
    for name, frame in out.items():
        digests.store_run(frame, f"{folder}/{name}", KEYS, ["p"], ["angle"], bucket=4)
    return {name: (frame, f"{folder}/{name}") for name, frame in out.items()}


def values(frame):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 7) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("x", "y"), [("a", "a"), ("a", "one"), ("one", "more"), ("more", "a")])
def test_same_as_comparing_all_rows(spark, runs, x, y):
    (a, path_a), (b, path_b) = runs[x], runs[y]
    assert values(digests.coverage_of_runs(spark, path_a, path_b, KEYS, ["name", "p"])) == values(compare.coverage(a, b, KEYS, ["name", "p"]))
    assert values(digests.unmatched_of_runs(spark, path_a, path_b, KEYS, ["event_idx"])) == values(compare.unmatched_by(a, b, KEYS, ["event_idx"]))
    assert values(digests.close_runs(spark, path_a, path_b, [*KEYS], ["p", "angle"])) == values(compare.assert_close(a, b, KEYS, ["p", "angle"]))
    found, wanted = digests.metrics_of_runs(spark, path_a, path_b, KEYS, ["p"], ["angle"]), compare.numeric_metrics(a, b, KEYS, ["p"], ["angle"])
    assert found.columns == wanted.columns and values(found) == values(wanted)


def test_only_changed_buckets_are_read(spark, runs):
    path = {name: p for name, (_, p) in runs.items()}
    assert digests.changed_buckets(spark, path["a"], path["a"]) == []
    assert digests.read_run(spark, path["a"], []).count() == 0
    assert digests.changed_buckets(spark, path["a"], path["one"]) == [17 // 4]
    assert digests.changed_buckets(spark, path["one"], path["more"]) == [1, 5, 7, 9]
    assert digests.changed_buckets(spark, path["one"], path["more"], keys_only=True) == [1]
    read = digests.read_run(spark, path["one"], [4])
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "event_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.event_bucket for r in read.select("event_bucket").distinct().collect()} == {4}


def test_order_and_layout_of_rows_dont_matter_but_repeats_do(spark):
    rows = spark.range(30).select((F.col("id") % 3).alias("event_idx"), "id", F.lit(0).cast("long").alias("event_bucket"))
    digest = lambda f: [tuple(r) for r in digests.digest_rows(f, ["event_idx", "id"], ["id"]).collect()]
    assert digest(rows) == digest(rows.repartition(5).orderBy(F.desc("id")))
    assert digest(rows) != digest(rows.union(rows.where("id < 2")))
    moved = rows.select("event_idx", F.when(F.col("id") == 0, None).otherwise(F.col("id")).alias("id"), "event_bucket")
    assert digest(rows) != digest(moved)


def test_metrics_add_up_over_parts(spark, runs):
    a, b = runs["a"][0], runs["more"][0]
    part = F.col("event_idx") % 3
    sums = None
    for i in range(3):
        some = compare.numeric_sums(a.where(part == i), b.where(part == i), KEYS, ["p"], ["angle"])
        sums = some if sums is None else sums.unionByName(some)
    assert values(compare.metrics_of_sums(sums)) == values(compare.numeric_metrics(a, b, KEYS, ["p"], ["angle"]))
