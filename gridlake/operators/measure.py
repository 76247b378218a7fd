"""Measurement quality: predicted values, residuals, chi-square tests, bad-data flags. Tables are keyed by case_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlake.operators.electrical import line_flow
from gridlake.operators.keyed import attach_to_branch, attach_to_bus

BUS_TYPES = ("VM", "VA", "PI", "PJ", "QI", "QJ", "VUL", "VLL")
BRANCH_TYPES = ("PIJ", "PJI", "QIJ", "QJI", "IIJ", "IJI")


def assign_measurements(measurement: DataFrame, bus: DataFrame, branch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bus measurements, branch measurements) attached to the network, numbered within their element by type, tag and value text."""
    at_bus = attach_to_bus(measurement.where(F.col("type").isin(*BUS_TYPES)), bus.select("bus_id"))
    order = lambda *k: F.row_number().over(Window.partitionBy("case_id", *k).orderBy("type", "tag_text", F.format_string("%.6f", "value"), "idx"))
    a = at_bus.withColumn("tag_text", F.lit("")).withColumn("nth", order("bus_id")).drop("tag_text")
    if "from_bus" not in measurement.columns:
        return a, a.limit(0)
    lines = measurement.where(F.col("type").isin(*BRANCH_TYPES)).drop("bus_id")
    b = attach_to_branch(lines, branch.select("from_bus", "to_bus").distinct()).withColumn("tag_text", F.coalesce("ckt", F.lit("")))
    return a, b.withColumn("nth", order("from_bus", "to_bus")).drop("tag_text")


def limit_measurements(bus: DataFrame, cases: DataFrame, vmin: float, vmax: float, deviation: float) -> DataFrame:
    """VUL and VLL pseudo measurements of every bus that isn't isolated, voltage-controlled or the slack, in every case."""
    free = bus.where(~F.col("type").isin(2, 3, 4)).select("bus_id").crossJoin(F.broadcast(cases.select("case_id").distinct()))
    both = F.array(F.struct(F.lit("VUL").alias("type"), F.lit(vmax).alias("value")), F.struct(F.lit("VLL").alias("type"), F.lit(vmin).alias("value")))
    return free.select("case_id", "bus_id", F.explode(both).alias("m")).select("case_id", "bus_id", F.col("m.type").alias("type"), F.col("m.value").alias("value"), F.lit(deviation).alias("deviation"))


def predicted_value(measurement: DataFrame, voltage: DataFrame, injection: DataFrame, flow: DataFrame | None = None, sbase: float = 100.0) -> DataFrame:
    """Adds ``predicted``. VM: v, VA: angle in degrees, PI and QI (PJ, QJ): injections; VUL and VLL: v only where the limit is violated, else the limit;
    PIJ, QIJ, PJI, QJI: flow / sbase; IIJ, IJI: current magnitude S / v. State tables carry case_id."""
    v, t = F.col("v_pu"), F.col("type")
    at_bus = measurement.where(F.col("type").isin(*BUS_TYPES)).join(voltage.select("case_id", "bus_id", "v_pu", "angle_deg"), ["case_id", "bus_id"])
    at_bus = at_bus.join(injection.select("case_id", "bus_id", F.col("p").alias("_p"), F.col("q").alias("_q")), ["case_id", "bus_id"], "left")
    value = F.when(t == "VM", v).when(t == "VA", F.col("angle_deg")).when(t.isin("PI", "PJ"), F.col("_p")).when(t.isin("QI", "QJ"), F.col("_q"))
    value = value.when(t == "VUL", F.greatest(v, F.col("value"))).when(t == "VLL", F.least(v, F.col("value")))
    out = at_bus.withColumn("predicted", value).drop("v_pu", "angle_deg", "_p", "_q")
    if flow is None:
        return out
    lines = measurement.where(F.col("type").isin(*BRANCH_TYPES)).join(flow.select("case_id", "from_bus", "to_bus", "ckt", "p_from", "q_from", "p_to", "q_to", "v_from_pu", "v_to_pu"), ["case_id", "from_bus", "to_bus", "ckt"])
    lines = lines.withColumn("predicted", _of_flow(t, sbase)).drop("p_from", "q_from", "p_to", "q_to", "v_from_pu", "v_to_pu")
    return out.unionByName(lines, allowMissingColumns=True)


def _of_flow(t: Column, sbase: float) -> Column:
    value = F.when(t == "PIJ", F.col("p_from")).when(t == "PJI", F.col("p_to")).when(t == "QIJ", F.col("q_from")).when(t == "QJI", F.col("q_to"))
    return value.when(t == "IIJ", F.hypot("p_from", "q_from") / F.col("v_from_pu")).when(t == "IJI", F.hypot("p_to", "q_to") / F.col("v_to_pu")) / sbase


def predicted_of_circuits(measurement: DataFrame, circuit: DataFrame, voltage: DataFrame, sbase: float = 100.0) -> DataFrame:
    """Branch measurements with the ``predicted`` that ``predicted_value`` finds in the flow of these circuits and voltages (with event_idx, or case_id).

    Measurements travel with their circuit, so flows are worked out for the case in which a circuit is measured, not for all of them."""
    voltage = voltage.withColumnRenamed("case_id", "event_idx")
    told = measurement.where(F.col("type").isin(*BRANCH_TYPES)).select(F.col("case_id").alias("event_idx"), "from_bus", "to_bus", "ckt", F.struct(*measurement.columns).alias("_told"))
    rows = line_flow(circuit.drop("event_idx").join(told, ["from_bus", "to_bus", "ckt"]), voltage, sbase=sbase)
    return rows.select("_told.*", _of_flow(F.col("_told.type"), sbase).alias("predicted"))


def residuals(measured: DataFrame) -> DataFrame:
    """Adds residual (measured - predicted), weight (1/dev^2, 0 if dev <= 0) and norm (residual over 1/sqrt(weight), or over 1)."""
    weight = F.when(F.col("deviation") > 0, 1 / (F.col("deviation") * F.col("deviation"))).otherwise(0.0)
    rows = measured.withColumns({"residual": F.col("value") - F.col("predicted"), "weight": weight})
    return rows.withColumn("norm", F.when(F.col("weight") > 0, F.col("residual") * F.sqrt("weight")).otherwise(F.col("residual")))


def chi_threshold(dof: Column, n_bus: Column) -> Column:
    """For 1 <= dof <= 3n the Wilson-Hilferty value at 95 %, otherwise a step by network size."""
    a = 2.0 / (9.0 * dof)
    by_size = F.when(n_bus <= 50, 50.0).when(n_bus <= 100, 150.0).when(n_bus <= 300, 500.0).when(n_bus <= 500, 1000.0).otherwise(2000.0)
    return F.when((dof >= 1) & (dof <= 3 * n_bus), dof * F.pow(1 - a + 1.645 * F.sqrt(a), F.lit(3.0))).otherwise(by_size)


def chi_square(rows: DataFrame, n_bus: int) -> DataFrame:
    """(case_id, chi, n, dof, threshold, passed): sum of weighted squares, dof = max(1, n - (2 n_bus - 1))."""
    per = rows.groupBy("case_id").agg(F.sum(F.col("residual") * F.col("residual") * F.col("weight")).alias("chi"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("dof", F.greatest(F.col("n") - (2 * n_bus - 1), F.lit(1)).cast("long"))
    per = per.withColumn("threshold", chi_threshold(F.col("dof"), F.lit(n_bus)))
    return per.withColumn("passed", F.col("chi") < F.col("threshold"))


def _limit(threshold: float, slack: Column, k: Column) -> Column:
    t = F.col("type")
    base = F.when(t == "VM", 3.0).when((t == "VA") & slack, 50.0).when(t == "VA", 5.0).otherwise(1.0)
    return base * threshold * F.pow(F.lit(2.0), k)


def flag_bad(rows: DataFrame, chi: DataFrame, bus: DataFrame, threshold: float, history: DataFrame | None = None, keep: int = 5) -> DataFrame:
    """Rows flagged as bad: abs(norm) above threshold times 3 (VM), 50 (VA at the slack), 5 (other VA), doubled for each earlier flag (history: case_id, idx, k).
    A case that fails the chi-square test without a flag gets its largest norm flagged. Of each case the ``keep`` worst stay (ties by idx)."""
    slack = bus.select("bus_id", (F.col("type") == 3).alias("_slack"))
    joined = rows.join(slack, "bus_id", "left").fillna(False, ["_slack"])
    if history is not None:
        joined = joined.join(history.select("case_id", "idx", F.col("k").alias("_k")), ["case_id", "idx"], "left").fillna(0, ["_k"])
    else:
        joined = joined.withColumn("_k", F.lit(0))
    joined = joined.withColumns({"size": F.abs("norm"), "limit": _limit(threshold, F.col("_slack"), F.col("_k"))})
    joined = joined.withColumn("over", F.col("size") > F.col("limit"))
    worst = Window.partitionBy("case_id").orderBy(F.col("over").desc(), F.round("size", 6).desc(), "idx")
    top = joined.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= keep)
    top = top.join(chi.select("case_id", "passed"), "case_id")
    return top.where(F.col("over") | ((F.col("rank") == 1) & ~F.col("passed"))).select("case_id", "idx", "type", "bus_id", "norm", "limit", "rank")


def top_residuals(rows: DataFrame, threshold: float, n: int = 10) -> DataFrame:
    """The n largest abs(norm) of each case with their limit (times 3 for VM, 5 for VA) and BAD or OK."""
    limit = threshold * F.when(F.col("type") == "VM", 3.0).when(F.col("type") == "VA", 5.0).otherwise(1.0)
    size = F.abs("norm")
    order = Window.partitionBy("case_id").orderBy(F.round(size, 6).desc(), "idx")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.select("case_id", "rank", "idx", "type", "norm", limit.alias("limit"), F.when(size > limit, "BAD").otherwise("OK").alias("verdict"))


def deweight(measurement: DataFrame, flags: DataFrame, history: DataFrame) -> DataFrame:
    """Measurements with the deviation of flagged ones times 10^(k+1), k the times they were flagged before."""
    f = flags.select("case_id", "idx", F.lit(True).alias("_f")).distinct()
    rows = measurement.join(f, ["case_id", "idx"], "left").join(history.select("case_id", "idx", F.col("k").alias("_k")), ["case_id", "idx"], "left")
    factor = F.when(F.col("_f"), F.pow(F.lit(10.0), F.coalesce("_k", F.lit(0)) + 1)).otherwise(1.0)
    return rows.withColumn("deviation", F.col("deviation") * factor).select(*measurement.columns)


def iteration_stop(history: DataFrame) -> DataFrame:
    """(case_id, iteration, stop) of stored iterations (chi, threshold, flagged): after the first, stop if chi < threshold and nothing
    is flagged, or chi > 1.1 times the one before."""
    before = F.lag("chi").over(Window.partitionBy("case_id").orderBy("iteration"))
    stop = before.isNotNull() & (((F.col("chi") < F.col("threshold")) & (F.col("flagged") == 0)) | (F.col("chi") > 1.1 * before))
    return history.select("case_id", "iteration", stop.alias("stop"))


def iteration_report(history: DataFrame) -> DataFrame:
    """Per iteration: new flags, flags so far, chi-square and its reduction against the iteration before in percent."""
    order = Window.partitionBy("case_id").orderBy("iteration")
    before = F.lag("chi").over(order)
    return history.select("case_id", "iteration", "flagged", F.sum("flagged").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), "chi", F.when(before != 0, 100 * (before - F.col("chi")) / before).alias("reduction_percent"))


def persistent_bad(flags: DataFrame) -> DataFrame:
    """(case_id, idx, times, first_norm, last_norm, label) of flags over iterations: flagged again and smaller than at first, flagged again, or once."""
    rows = flags.groupBy("case_id", "idx").agg(F.count(F.lit(1)).alias("times"), F.min_by("norm", "iteration").alias("first_norm"), F.max_by("norm", "iteration").alias("last_norm"))
    label = F.when((F.col("times") > 1) & (F.abs("last_norm") < F.abs("first_norm")), "Persistent (reduced)").when(F.col("times") > 1, "Persistent").otherwise("Recently flagged")
    return rows.withColumn("label", label)


def consistency_check(circuit: DataFrame, measured: DataFrame, state: DataFrame) -> DataFrame:
    """Lossless circuits (abs r < 1e-8 < abs x) whose first PIJ or PJI is about zero: an angle difference over 0.001 rad is a warning with the
    expected power v1 v2 / x sin, else a voltage difference over 0.01 a note. state: bus_id, v_pu, angle_deg."""
    first = measured.where(F.col("type").isin("PIJ", "PJI")).groupBy("from_bus", "to_bus", "ckt").agg(F.min_by("value", "idx").alias("measured"))
    place = lambda end, p: state.select(F.col("bus_id").alias(end), F.col("v_pu").alias(f"v{p}"), F.radians("angle_deg").alias(f"t{p}"))
    rows = circuit.where((F.abs("r") < 1e-8) & (F.abs("x") > 1e-8)).join(first.where(F.abs("measured") < 1e-4), ["from_bus", "to_bus", "ckt"]).join(place("from_bus", "1"), "from_bus").join(place("to_bus", "2"), "to_bus")
    dt, dv = F.col("t1") - F.col("t2"), F.col("v1") - F.col("v2")
    kind = F.when(F.abs(dt) > 0.001, "warning").when(F.abs(dv) > 0.01, "note")
    rows = rows.withColumns({"kind": kind, "expected": F.when(F.abs(dt) > 0.001, F.col("v1") * F.col("v2") / F.col("x") * F.sin(dt))})
    return rows.where("kind IS NOT NULL").select("from_bus", "to_bus", "ckt", "kind", "measured", "expected")


def measurement_coverage(measurement: DataFrame, n_bus: int) -> DataFrame:
    """(case_id, type, n, buses, case_n, underdetermined): counts by case and type; a case is underdetermined with no more measurements than states."""
    per = measurement.groupBy("case_id", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bus_id").alias("buses"))
    total = measurement.groupBy("case_id").agg(F.count(F.lit(1)).alias("case_n"))
    return per.join(total, "case_id").withColumn("underdetermined", F.col("case_n") <= 2 * n_bus - 1)
