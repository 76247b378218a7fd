"""Queries on top of flows: rows of circuits and events aren't shuffled before they are summed up."""

import random
import re

import pytest
from pyspark.sql import Window, functions as F

from gridlake.operators import electrical, limits, measure, stats
from gridlake.plans import catalog
from tests.checks import assert_same, connection
from tests.test_flows import KEYS, collected, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def in_blocks(spark, monkeypatch):
    """Nothing is small enough to be broadcast unasked, and flows go by blocks of buses."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(electrical, "flow_layout", lambda circuit, voltage: "by_bus")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above_flows(frame):
    """Of each place where circuits are multiplied by events: the shuffles and sorts above it, up to the first aggregate."""
    found, path = [], []
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[ :+*()\-\d]*", line).group())
        path = [x for x in path if x[0] < depth] + [(depth, line[depth:])]
        if re.search(r"Generate explode\(_pairs", line):
            names = [name for _, name in reversed(path[:-1])]
            last = next((i for i, name in enumerate(names) if "Aggregate" in name), len(names))
            found.append([name for name in names[:last] if re.match(r"Exchange|Sort ", name)])
    assert found
    return found


def matches(spark, name):
    assert_same(catalog.queries()[name](spark, SF).toPandas(), connection(SF).sql(catalog.oracle_sql()[name]).df())


def test_f7_area_export_shuffles_sums_only(spark, in_blocks):
    assert above_flows(catalog.queries()["area_export"](spark, SF)) == [[]]
    matches(spark, "area_export")


def test_f7_areas_of_circuits_give_the_same_export(spark):
    circuit, voltage = tables(spark)
    bus = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(12)], "bus_id long, area int")
    wanted = collected(stats.area_export(electrical.line_flow(circuit, voltage), bus))
    assert wanted and collected(stats.area_export(electrical.line_flow(stats.between_areas(circuit, bus), voltage))) == wanted


def test_f8_area_kv_filter_shuffles_no_rows_of_events(spark, in_blocks):
    assert above_flows(catalog.queries()["area_kv_filter"](spark, SF)) == [[]]
    for name in ("area_kv_filter", "worst_circuits"):
        matches(spark, name)


def test_f8_circuits_can_be_filtered_as_well_as_rows(spark):
    circuit, voltage = tables(spark)
    bus = spark.createDataFrame([(i, i % 3 if i % 5 else None, [10.0, 70.0, 500.0][i % 3]) for i in range(12)], "bus_id long, area int, base_kv double")
    for wanted in ((), ([1],), ([0, 2], 60.0, 200.0), ([], 60.0)):
        rows = limits.area_kv_filter(electrical.line_flow(circuit, voltage), bus, *wanted)
        assert collected(electrical.line_flow(limits.area_kv_filter(circuit, bus, *wanted), voltage).select(rows.columns)) == collected(rows)


def test_f21_monitor_filter_shuffles_no_rows_of_events(spark, in_blocks):
    assert above_flows(catalog.queries()["monitor_filter"](spark, SF)) == [[]]
    matches(spark, "monitor_filter")


def test_f10_build_stat_shuffles_no_rows(spark, in_blocks):
    assert above_flows(catalog.queries()["build_stat"](spark, SF)) == [[]]  # one reading of the rows, too
    matches(spark, "build_stat")


@pytest.mark.parametrize("unique", [False, True])
def test_f10_stat_of_rows(spark, unique):
    rows = [(e, 1, b, "1", 10.0 * e + b, 5.0, int(e == 2)) for e in range(5) for b in range(2, 4)]
    rows = spark.createDataFrame(rows if unique else rows + rows[:1] + rows[4:7], "event_idx int, from_bus long, to_bus long, ckt string, p double, rate double, viol int")
    told = spark.createDataFrame([(0, True), (1, True), (1, True), (2, True), (3, False), (4, None), (9, False)], "event_idx long, converged boolean")
    found = collected(stats.build_stat(rows, told, unique=unique).select("row_key", "scenario_idx", "value", "mask", "min_bound", "max_bound"))
    wanted = [(f"1_{b}_1", e, 10.0 * e + b, 2 if e == 2 else 1, -5.0, 5.0) for e in (0, 1, 2) for b in (2, 3)]
    filled = [(f"1_{b}_1", e, 0.0, 0, -5.0, 5.0) for e in (3, 9) for b in ((2, 3) if unique else (2, 2, 3))]  # as before, a base row that is given twice fills in twice
    assert found == sorted(wanted + filled, key=str)


def test_f23_measurements_travel_with_their_circuits(spark, in_blocks):
    assert above_flows(catalog.queries()["predicted_branch_value"](spark, SF)) == [[]]
    matches(spark, "predicted_branch_value")


def test_f23_circuits_with_events_in_blocks(spark):
    circuit, voltage = tables(spark)
    voltage = voltage.union(voltage.where("bus_id = 3 AND event_idx = 2"))
    told = circuit.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(99))).alias("case_id"), "from_bus", "to_bus", "ckt", F.element_at(F.array(*[F.lit(t) for t in measure.BRANCH_TYPES]), (F.col("to_bus") % 6 + 1).cast("int")).alias("type"), F.lit(1.0).alias("value"))
    state = voltage.withColumnRenamed("event_idx", "case_id")
    flow = electrical.line_flow(circuit, voltage).withColumnRenamed("event_idx", "case_id")
    wanted = measure.predicted_value(told.withColumn("bus_id", F.lit(None).cast("long")), state, state.selectExpr("case_id", "bus_id", "0e0 AS p", "0e0 AS q"), flow)
    columns = [*told.columns, "predicted"]
    found = collected(measure.predicted_of_circuits(told, circuit, voltage).select(columns))
    assert found and found == collected(wanted.select(columns))
    own = circuit.withColumn("event_idx", F.explode(F.array(F.lit(0), F.lit(2), F.lit(99))))
    assert collected(electrical.line_flow(own, voltage, layout="by_bus").select(KEYS)) == collected(electrical.line_flow(own, voltage, layout="broadcast").select(KEYS))


def test_f15_deltas_of_voltages_deal_circuits_once(spark, monkeypatch):
    circuit, voltage = tables(spark, 3)
    voltage = voltage.union(voltage.where("bus_id = 3 AND event_idx IN (0, 2)"))
    bus = spark.createDataFrame([(i, 10.0 * i, i % 3) for i in range(12)], "bus_id long, base_kv double, area int")
    told = spark.createDataFrame([(e, "Line") for e in range(1, 5)], "event_idx int, type string")
    labels = spark.createDataFrame([(e, f"[1] {e}") for e in range(2, 7)], "event_idx int, label string")
    wanted = collected(limits.delta_of_voltages(circuit, voltage, bus, told, labels, "C", layout="broadcast"))
    monkeypatch.setattr(limits, "flow_layout", lambda c, v: "by_bus")
    monkeypatch.setattr(limits, "durable", lambda f: pytest.fail("base rows were written"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = limits.delta_of_voltages(circuit, voltage, bus, told, labels, "C")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(_cell", plan)) == 3 and above_flows(found) == [[]]
        assert wanted and collected(found) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["delta_rows", "delta_skipped"])
def test_f16_f37_event_rows_find_base_rows_where_they_are(spark, in_blocks, name):
    frame = catalog.queries()[name](spark, SF)
    assert above_flows(frame) == [[], []]
    matches(spark, name)


def test_f24_most_rows_are_left_out_before_they_are_sorted(spark):
    rng = random.Random(5)
    values = [None, float("nan"), float("inf"), float("-inf"), 1.0000001, 1.0000002, *[rng.choice([float(i), rng.random()]) for i in range(9)]]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), i, rng.choice(values)) for i in range(3_000)]
    rows = spark.createDataFrame(rows, "g long, h string, i long, loading double").repartition(3)
    for by, k in ((["g", "h"], 1), (["g", "h"], 7), (["h"], 400), ([], 5)):
        n = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("loading", 6).desc(), "i"))
        wanted = rows.withColumn("rank", n).where(F.col("rank") <= k)
        assert list(map(str, collected(limits.worst(rows, by, k, ["i"])))) == list(map(str, collected(wanted)))  # NaN isn't itself
    assert limits._foremost(spark.range(40_000).selectExpr("id DIV 26 AS g", "hash(id) * 1e0 AS loading"), ["g"], 2).count() < 4_000
    matches(spark, "scenario_rank")


@pytest.mark.parametrize("name", ["overload_violations", "violation_list", "scenario_summary"])
def test_r04_f3_ignored_circuits_are_left_out_before_events_multiply_them(spark, in_blocks, name):
    assert not any(above_flows(catalog.queries()[name](spark, SF)))
    matches(spark, name)


def test_r04_f3_circuits_can_be_ignored_as_well_as_rows(spark):
    circuit, voltage = tables(spark)
    ignored = circuit.where("to_bus % 2 = 0")
    found = limits.overload_violations(electrical.line_flow(limits.not_ignored(circuit, ignored), voltage))
    wanted = limits.overload_violations(electrical.line_flow(circuit, voltage), True, ignored)
    assert collected(found) == collected(wanted)


@pytest.mark.parametrize("name", ["mismatch_summary", "generator_output"])
def test_r04_f19_injections_are_shuffled_once(spark, monkeypatch, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(electrical, "_sized", lambda voltage: (voltage, False))
    try:
        above = above_flows(catalog.queries()[name](spark, SF))
        assert [[x for x in found if "Exchange" in x] for found in above] == [[]]
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        made = next(i for i, line in enumerate(lines) if "Generate explode(_pairs" in line)
        depth = lambda line: len(re.match(r"[ :+*()\-\d]*", line).group())
        path, least = [], depth(lines[made])
        for line in reversed(lines[:made]):
            if depth(line) < least:
                least = depth(line)
                path.append(line[least:])
        assert len([x for x in path if x.startswith("Exchange hashpartitioning(bus_id") or x.startswith("Exchange hashpartitioning(event_idx") and "bus_id" in x]) == 1
        matches(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
