"""Flows of scenarios: the three ways of joining voltages, and deltas against the base, give the same rows; what their plans shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridlake.functions.exprs import rounded6
from gridlake.operators import electrical, limits

CIRCUIT = "from_bus long, to_bus long, ckt string, r double, x double, b double, rate_a double, rate_b double, rate_c double, status int, tap double, shift_deg double, switched boolean"


def tables(spark, seed=1, buses=14, events=6):
    rng = random.Random(seed)
    rows = {}
    while len(rows) < 40:
        a, b = rng.sample(range(buses), 2)
        rows[a, b, rng.choice("12")] = (rng.random() / 10, 0.01 + rng.random(), rng.random() / 50, rng.choice([0.0, 5.0, 90.0]), 3.0, rng.choice([0.0, 50.0]), int(rng.random() < 0.8), rng.choice([0.0, 0.0, 0.97, 1.02]), rng.choice([0.0, 5.0]), rng.random() < 0.5)
    circuit = spark.createDataFrame([(*k, *v) for k, v in rows.items()], CIRCUIT)
    voltage = [(e, i, 0.95 + rng.random() / 10, rng.uniform(-40, 40), rng.random() < 0.05) for e in range(events) for i in range(buses) if rng.random() < 0.95]
    return circuit, spark.createDataFrame(voltage, "event_idx int, bus_id long, v_pu double, angle_deg double, isolated boolean")


def collected(frame):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


KEYS = ["event_idx", "from_bus", "to_bus", "ckt", "p_from", "q_from", "p_to", "q_to", "v_from_pu", "ang_to_deg"]


@pytest.mark.parametrize("own_events", [False, True])
def test_layouts_give_the_same_flows(spark, own_events):
    circuit, voltage = tables(spark)
    if own_events:
        circuit = circuit.withColumn("event_idx", F.explode(F.array(F.lit(0), F.lit(2), F.lit(99))))
    wanted = collected(electrical.line_flow(circuit, voltage, layout="broadcast").select(*KEYS))
    assert wanted
    for layout in ("by_event", "by_bus", None):
        assert collected(electrical.line_flow(circuit, voltage, layout=layout).select(*KEYS)) == wanted


def exchanges(frame):
    """(those that were asked for, those that joins and aggregates added) of the physical plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if re.search(r"(?<!Broadcast)Exchange hashpartitioning", line)]
    return [x for x in found if "REPARTITION_BY_COL" in x], [x for x in found if "REPARTITION_BY_COL" not in x]


@pytest.mark.parametrize("own_events", [False, True])
def test_by_event_nothing_is_shuffled_above_the_voltages(spark, own_events):
    circuit, voltage = tables(spark)
    if own_events:
        circuit = circuit.withColumn("event_idx", F.explode(F.array(F.lit(0), F.lit(2))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = limits.flat_rows(electrical.line_flow(circuit, voltage, layout="by_event"), "C")
        asked, added = exchanges(rows)
        assert len(asked) == (3 if own_events else 2) and not added
        assert "Join" in rows._jdf.queryExecution().executedPlan().toString()
        assert exchanges(limits.flat_rows(electrical.line_flow(circuit, voltage, layout="by_bus"), "C"))[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_layout_given_runs_no_job(spark, monkeypatch):
    circuit, voltage = tables(spark)
    monkeypatch.setattr(electrical, "fits", lambda frame: pytest.fail("counted"))
    for layout in ("broadcast", "by_event", "by_bus"):
        electrical.line_flow(circuit, voltage, layout=layout)


def test_layout_by_counting(spark, monkeypatch):
    circuit, voltage = tables(spark)
    assert electrical.flow_layout(circuit, voltage) == "broadcast"
    monkeypatch.setattr(electrical, "BROADCAST_ROWS", 50)
    assert electrical.flow_layout(circuit, voltage) == "by_bus"  # six events can't keep the tasks busy
    many = voltage.crossJoin(spark.range(4).withColumnRenamed("id", "k")).withColumn("event_idx", F.col("event_idx") + 10 * F.col("k").cast("int"))
    assert electrical.flow_layout(circuit, many) == "by_event"
    monkeypatch.setattr(electrical, "BROADCAST_ROWS", 30)
    assert electrical.flow_layout(circuit, many) == "by_bus"


def test_by_bus_shuffles_circuits_not_their_events(spark):
    circuit, voltage = tables(spark)
    voltage = voltage.union(voltage.where("bus_id = 3 AND event_idx = 2"))  # a voltage that is given twice counts twice, as in any join
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = electrical.line_flow(circuit, voltage, layout="by_bus")
        dealt = [x for x in exchanges(rows)[1] if "REPARTITION_BY_NUM" in x]
        added = [x for x in exchanges(rows)[1] if x not in dealt]
        assert len(dealt) == 3 and all("(_cell" in x for x in dealt)  # circuits and both ends' voltages
        assert len(added) == 2 and all("(bus_id" in x for x in added)  # voltages are packed by bus
        assert collected(rows.select(*KEYS)) == collected(electrical.line_flow(circuit, voltage, layout="broadcast").select(*KEYS))
        spark.conf.set("spark.sql.shuffle.partitions", "1000")  # more than cells
        assert len(exchanges(electrical.line_flow(circuit, voltage, layout="by_bus"))[1]) == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("layout", ["broadcast", "by_event", "by_bus"])
def test_deltas_of_voltages_equal_deltas_of_rows(spark, layout):
    circuit, voltage = tables(spark, 3)
    voltage = voltage.where("NOT (event_idx = 0 AND bus_id = 4)")  # its circuits have no base row
    bus = spark.createDataFrame([(i, 10.0 * i, i % 3) for i in range(12)], "bus_id long, base_kv double, area int")
    told = spark.createDataFrame([(e, "Line") for e in range(1, 5)], "event_idx int, type string")
    labels = spark.createDataFrame([(e, f"[1] {e}") for e in range(2, 7)], "event_idx int, label string")
    names = spark.createDataFrame([(e, f"N{e}") for e in range(1, 4)], "event_idx int, contingency string")
    wanted = limits.delta_rows(limits.flat_rows(electrical.line_flow(circuit, voltage, layout="by_bus"), "C", names), bus, told, labels)
    found = limits.delta_of_voltages(circuit, voltage, bus, told, labels, "C", names, layout)
    assert found.columns == wanted.columns and collected(found) == collected(wanted) and collected(found)


def test_deltas_of_voltages_shuffle_no_event_rows(spark):
    circuit, voltage = tables(spark)
    bus, told, labels = (spark.createDataFrame([], s) for s in ("bus_id long, base_kv double, area int", "event_idx int, type string", "event_idx int, label string"))
    frame = limits.delta_of_voltages(circuit, voltage, bus, told, labels, layout="broadcast")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[from_bus#\d+L, to_bus", plan) and not [x for x in exchanges(frame)[1] if "ckt" in x]


def test_rounding_in_doubles(spark):
    values = [0.1234565, -0.1234565, 2.5e-7, -7.5e-7, 123456.7890125, 1e300, -9.5e12, float("nan"), float("inf"), None, 0.0]
    rng = random.Random(1)
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-7, 9) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded6(F.col("v")).alias("r"), (F.round("v", 6) + 0.0).alias("w")).collect()
    for r in rows:
        same = (r.r is None and r.w is None) or (r.r != r.r and r.w != r.w) or abs(r.r - r.w) <= 1e-15 * max(1, abs(r.w)) or (abs(r.v) >= 9e12 and r.r == r.v)
        assert same or abs(r.v * 1e6 % 1 - 0.5) < 1e-3, r


def test_injection_in_blocks(spark, monkeypatch):
    circuit, voltage = tables(spark)
    shunt = spark.range(14).select(F.col("id").alias("bus_id"), F.lit(0.1).alias("g"), F.lit(0.2).alias("b"))
    ybus = electrical.ybus_coo(circuit.where("r > 0"), shunt)
    wanted = collected(electrical.bus_injection(ybus, voltage))
    monkeypatch.setattr(electrical, "BROADCAST_ROWS", 1)
    found = electrical.bus_injection(ybus, voltage)
    assert len([x for x in exchanges(found)[1] if "(_cell" in x]) == 3  # entries and the voltages of rows and columns
    assert collected(found) == wanted


def test_admittances_of_cells_are_summed_where_circuits_are(spark):
    circuit, _ = tables(spark)
    turned = circuit.where("from_bus % 3 = 0").select(F.col("to_bus").alias("from_bus"), F.col("from_bus").alias("to_bus"), *circuit.columns[2:])
    loops = circuit.where("from_bus = 2").withColumn("to_bus", F.col("from_bus"))
    odd = circuit.where("to_bus = 5").withColumns({"r": F.lit(0.0), "x": F.lit(0.0)}).union(circuit.where("to_bus = 6").withColumn("from_bus", F.lit(None).cast("long")))
    circuit = circuit.union(turned).union(loops).union(odd)
    shunt = spark.range(3, 20).select(F.col("id").alias("bus_id"), F.lit(0.1).alias("g"), F.lit(0.2).alias("b"))
    plain = electrical.branch_elements(circuit)
    ends = (("from_bus", "from_bus", "yff"), ("from_bus", "to_bus", "yft"), ("to_bus", "from_bus", "ytf"), ("to_bus", "to_bus", "ytt"))
    parts = shunt.selectExpr("bus_id AS i", "bus_id AS j", "g AS re", "b AS im")
    for i, j, p in ends:
        parts = parts.union(plain.selectExpr(f"{i} AS i", f"{j} AS j", f"{p}_re AS re", f"{p}_im AS im"))
    wanted = collected(parts.groupBy("i", "j").agg(F.sum("re"), F.sum("im")))
    assert collected(electrical.ybus_coo(circuit, shunt)) == wanted
    for blocks in (1, 3):
        cell = electrical.pair_cell(*[electrical.block_of(F.col(c), blocks) for c in ("from_bus", "to_bus")], blocks)
        found = electrical.ybus_coo(circuit.withColumn(electrical.CELL, cell).repartition(5, electrical.CELL), shunt)
        assert collected(found) == wanted
        added = [x for x in exchanges(found)[1] if "REPARTITION_BY_NUM" not in x]
        assert added and not [x for x in added if "j#" in x]  # own admittances alone


@pytest.mark.parametrize("cells, parts", [(36, 36), (36, 200), (72, 200), (225, 225)])
def test_r04_f10_no_two_cells_share_a_partition(spark, cells, parts):
    numbers = electrical.apart(spark, cells, parts)
    dealt = spark.createDataFrame([(n,) for n in numbers], "cell int").repartition(parts, "cell")
    assert len(numbers) == cells == dealt.select(F.spark_partition_id().alias("p")).distinct().count()
