"""Limits, filters and violations over scenario result rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlake.functions.durable import durable
from gridlake.functions.exprs import circular_diff, select_rating
from gridlake.operators.electrical import BLOCKS, CELL, fits, flow_layout, flow_of_blocks, in_blocks, line_flow, packed_columns

CIRCUIT = ("from_bus", "to_bus", "ckt")


BASE_CASE = "base_case"


def flat_rows(flow: DataFrame, rating: str = "A", names: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event and circuit: contingency, power, mva, rate, loading (0 if rate <= 0), viol and both ends' state. Event 0 always uses
    rate A and is the base case; ``names`` (event_idx, contingency) names the others, which are null without it. Columns of ``keep`` come last."""
    which = F.when(F.col("event_idx") == 0, "A").otherwise(rating)
    rate = select_rating(which, F.col("rate_a"), F.col("rate_b"), F.col("rate_c"))
    mva = F.sqrt(F.col("p_from") * F.col("p_from") + F.col("q_from") * F.col("q_from"))
    named = flow.join(names.select("event_idx", "contingency"), "event_idx", "left") if names is not None else flow.withColumn("contingency", F.lit(None).cast("string"))
    rows = named.withColumns({"mva": mva, "rate": rate, "contingency": F.when(F.col("event_idx") == 0, BASE_CASE).otherwise(F.col("contingency"))})
    loading = F.when(F.col("rate") > 0, 100 * F.col("mva") / F.col("rate")).otherwise(0.0)
    viol = ((F.col("rate") > 0) & (F.col("mva") > F.col("rate"))).cast("int")
    return rows.select("event_idx", "contingency", *CIRCUIT, F.col("p_from").alias("p"), F.col("q_from").alias("q"), "mva", "rate", loading.alias("loading"), viol.alias("viol"), "v_from_pu", "v_to_pu", "ang_from_deg", "ang_to_deg", *keep)


def monitor_filter(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows of the circuits on a monitor list; without a list all. A list takes the place of the area and voltage filter. As with that,
    circuits can be filtered as well as their rows."""
    return rows if allowed is None else rows.join(allowed.select(*CIRCUIT).distinct(), list(CIRCUIT), "left_semi")


def area_kv_filter(rows: DataFrame, bus: DataFrame, areas: Sequence[int] = (), kv_min: float = 0.0, kv_max: float = 0.0) -> DataFrame:
    """Rows with an end in one of ``areas`` and the higher of both base voltages within the bounds; empty and 0 mean unbounded. Circuits
    can be filtered as well as their rows, and are fewer: then rows of events aren't shuffled. Buses of a checked size are broadcast."""
    place = lambda end, p: bus.select(F.col("bus_id").alias(end), F.col("area").alias(f"_{p}a"), F.col("base_kv").alias(f"_{p}k"))
    sent = F.broadcast if fits(bus) else lambda f: f
    joined = rows.join(sent(place("from_bus", "f")), "from_bus").join(sent(place("to_bus", "t")), "to_bus")
    kv, keep = F.greatest("_fk", "_tk"), F.lit(True)
    if areas:
        keep = keep & (F.col("_fa").isin(*areas) | F.col("_ta").isin(*areas))
    if kv_min > 0:
        keep = keep & (kv >= kv_min)
    if kv_max > 0:
        keep = keep & (kv <= kv_max)
    return joined.where(keep).select(*rows.columns)


def delta_rows(rows: DataFrame, bus: DataFrame, scenarios: DataFrame, facilities: DataFrame) -> DataFrame:
    """Event rows beside the base row (event 0) of the same circuit; circuits without a base row are skipped.

    ``scenarios`` (event_idx, type) and ``facilities`` (event_idx, label) describe the events, ``bus`` both ends. Columns: event_idx, contingency, type,
    the circuit, base_kv and area of both ends, base_ and cont_ of rate, p, q, mva and loading, _base and _cont of v_from, v_to, ang_from and
    ang_to, the angle across the circuit before and after (d_angle_base, d_angle_cont) and cont_event_facility. Buses are joined to the base
    rows, which are as many as circuits, before events multiply them. Rows with CELL, as ``line_flow`` makes them, stay where they
    are, and only base rows are looked up in memory; else both sides are shuffled by circuit.
    """
    keys = _keys(rows)
    base = _with_buses(_base_columns(rows.where("event_idx = 0"), keys[len(CIRCUIT) :]), F.broadcast(bus) if fits(bus) else bus)
    base = base.hint("shuffle_hash") if len(keys) > len(CIRCUIT) else base
    event = rows.where("event_idx <> 0").select("event_idx", "contingency", *keys, *[F.col(c).alias(f"cont_{c}") for c in _PAIRS], *[F.col(c).alias(f"{n}_cont") for n, c in _ENDS.items()])
    return _delta_columns(event.join(base, keys), scenarios, facilities, fits(scenarios) and fits(facilities))


def _keys(rows: DataFrame) -> list[str]:
    return [*CIRCUIT, *([CELL] if CELL in rows.columns else [])]


_PAIRS = ("rate", "p", "q", "mva", "loading")
_ENDS = {"v_from": "v_from_pu", "v_to": "v_to_pu", "ang_from": "ang_from_deg", "ang_to": "ang_to_deg"}


def _base_columns(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return rows.select(*CIRCUIT, *keep, *[F.col(c).alias(f"base_{c}") for c in _PAIRS], *[F.col(c).alias(f"{n}_base") for n, c in _ENDS.items()])


def _with_buses(base: DataFrame, bus: DataFrame) -> DataFrame:
    for end in ("from", "to"):
        base = base.join(bus.select(F.col("bus_id").alias(f"{end}_bus"), F.col("base_kv").alias(f"base_kv_{end}"), F.col("area").alias(f"area_{end}")), f"{end}_bus", "left")
    return base


def _delta_columns(rows: DataFrame, scenarios: DataFrame, facilities: DataFrame, small: bool) -> DataFrame:
    """``small``: there are few enough scenarios to be broadcast, so that event rows stay where they are."""
    told = scenarios.select("event_idx", "type").join(facilities.select("event_idx", F.col("label").alias("cont_event_facility")), "event_idx", "full")
    across = [circular_diff(F.col(f"ang_from_{s}"), F.col(f"ang_to_{s}")).alias(f"d_angle_{s}") for s in ("base", "cont")]
    both = lambda names, a, b: [c for n in names for c in (a.format(n), b.format(n))]
    front = ["event_idx", "contingency", "type", *CIRCUIT, "base_kv_from", "base_kv_to", "area_from", "area_to"]
    told = F.broadcast(told) if small else told.hint("shuffle_hash")
    return rows.join(told, "event_idx", "left").select(*front, *both(_PAIRS, "base_{}", "cont_{}"), *both(_ENDS, "{}_base", "{}_cont"), *across, "cont_event_facility")


#: Coalescing to more partitions than there are moves no rows; it ends a generated stage, so that flows and what is made of them are compiled apart.
_ANY = 1 << 24


def delta_of_voltages(circuit: DataFrame, voltage: DataFrame, bus: DataFrame, scenarios: DataFrame, facilities: DataFrame, rating: str = "A", names: DataFrame | None = None, layout: str | None = None) -> DataFrame:
    """What ``delta_rows`` gives for the flat rows of these voltages, event 0 being the base.

    The base flow is worked out once a circuit and carried along when events multiply the circuits, so event rows never have to find
    their base row: nothing is shuffled by circuit. In blocks of buses ("by_bus") both flows come from the same packed voltages, so circuits are dealt once;
    else the base rows, as many as circuits, are written to a table that outlives the call. ``layout`` is that of ``line_flow``; with "broadcast" the
    scenarios' names are broadcast too. Circuits without base voltages are skipped."""
    counted, layout = layout is None, layout or flow_layout(circuit, voltage)
    small = fits(scenarios) and fits(facilities) if counted else layout == "broadcast"
    own = [c for c in circuit.columns if c not in CIRCUIT]
    spent = ("r", "x", "b", "tap", "shift_deg", "switched", "p_to", "q_to")
    if layout == "by_bus" and not (circuit.isStreaming or voltage.isStreaming or "event_idx" in own):
        ends = [f"{c}_{e}" for e in ("from", "to") for c in ("base_kv", "area")]
        told = bus.select("bus_id", "base_kv", "area")
        flow = flow_of_blocks(in_blocks(_with_buses(circuit, F.broadcast(told) if counted and fits(told) else told), voltage, None if counted else BLOCKS).drop(CELL), base=True)
        packed = packed_columns(flow)
        lines = _base_columns(flat_rows(flow, rating, keep=[*own, *ends, *packed]), [*own, *ends, *packed]).coalesce(_ANY)
        carried = [c for c in lines.columns if c not in (*CIRCUIT, *own, *packed)]
        return _event_deltas(flow_of_blocks(lines).drop(*spent), rating, names, carried, scenarios, facilities, small)
    layout = None if counted else layout
    base = flat_rows(line_flow(circuit, voltage.where("event_idx = 0"), layout=layout), rating, keep=own)
    lines = durable(_with_buses(_base_columns(base, own), bus))  # one stage for both flows would outgrow what the JVM compiles
    carried = [c for c in lines.columns if c not in (*CIRCUIT, *own)]
    return _event_deltas(line_flow(lines, voltage.where("event_idx <> 0"), layout=layout).drop(*spent), rating, names, carried, scenarios, facilities, small)


def _event_deltas(flow: DataFrame, rating: str, names: DataFrame | None, carried: Sequence[str], scenarios: DataFrame, facilities: DataFrame, small: bool) -> DataFrame:
    event = flat_rows(flow.coalesce(_ANY), rating, names, keep=carried)
    event = event.select("event_idx", "contingency", *CIRCUIT, *[F.col(c).alias(f"cont_{c}") for c in _PAIRS], *[F.col(c).alias(f"{n}_cont") for n, c in _ENDS.items()], *carried)
    return _delta_columns(event, scenarios, facilities, small)


def delta_skipped(rows: DataFrame) -> DataFrame:
    """(event_idx, skipped): event rows whose circuit has no base row."""
    keys = _keys(rows)  # as in delta_rows
    base = rows.where("event_idx = 0").select(*keys)
    return rows.where("event_idx <> 0").join(base.hint("shuffle_hash") if len(keys) > len(CIRCUIT) else base, keys, "left_anti").groupBy("event_idx").agg(F.count(F.lit(1)).alias("skipped"))


def performance_index(flow: DataFrame) -> DataFrame:
    """(event_idx, circuit, pi, viol): (S / rate_a)^2, violated above 1; 0 when rate_a <= 0."""
    ratio = F.when(F.col("rate_a") > 0, F.hypot("p_from", "q_from") / F.col("rate_a")).otherwise(0.0)
    return flow.select("event_idx", *CIRCUIT, (ratio * ratio).alias("pi"), (ratio > 1).alias("viol"))


def voltage_violations(voltage: DataFrame, vmin: float, vmax: float, ignored: DataFrame | None = None, buses: DataFrame | None = None) -> DataFrame:
    """Event rows of buses above vmax or below vmin, without ignored ones; ``buses`` restricts them (say to an area)."""
    out = voltage.where((F.col("v_pu") > vmax) | (F.col("v_pu") < vmin))
    if buses is not None:
        out = out.join(buses.select("bus_id"), "bus_id", "left_semi")
    return out if ignored is None else out.join(ignored.select("bus_id"), "bus_id", "left_anti")


def ignore_baseline(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of events other than 0 whose key isn't violated in event 0 already."""
    base = found.where("event_idx = 0").select(*keys).distinct()
    return found.where("event_idx <> 0").join(base, list(keys), "left_anti")


def overload_violations(flow: DataFrame, use_b: bool = True, ignored: DataFrame | None = None) -> DataFrame:
    """Rows whose apparent power is above a positive rate: B if asked for and present, else A. Where rows are many, ``not_ignored`` can be applied to the circuits."""
    rate = F.when(F.lit(use_b) & (F.col("rate_b") > 0), F.col("rate_b")).otherwise(F.col("rate_a"))
    s = F.hypot("p_from", "q_from")
    # a filter by s would be pushed below the flows and repeat all that s is made of, in code too large to be compiled; a generator isn't
    rows = flow.where("status = 1").select("event_idx", *CIRCUIT, s.alias("s"), rate.alias("rate"))
    over = F.when((F.col("rate") > 0) & (F.col("s") > F.col("rate")), F.array(F.struct("s", "rate")))
    out = rows.select("event_idx", *CIRCUIT, F.inline(over))
    return out if ignored is None else not_ignored(out, ignored)


def not_ignored(rows: DataFrame, ignored: DataFrame) -> DataFrame:
    """Circuits, or rows of them, that aren't among ``ignored``."""
    return rows.join(ignored.select(*CIRCUIT), list(CIRCUIT), "left_anti").select(*rows.columns)


def watched_line_verdict(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(from_bus, to_bus, ckt, secure) for each requested line, whichever way round; true unless one of its rows is violated."""
    ends = lambda f: [F.least("from_bus", "to_bus").alias("_u"), F.greatest("from_bus", "to_bus").alias("_v"), "ckt"]
    worst = rows.select(*ends(rows), "viol").groupBy("_u", "_v", "ckt").agg(F.max("viol").alias("viol"))
    asked = lines.select(*CIRCUIT, *ends(lines)[:2])
    return asked.join(worst, ["_u", "_v", "ckt"], "left").select(*CIRCUIT, (F.coalesce("viol", F.lit(0)) == 0).alias("secure"))


def violation_list(bus_rows: DataFrame, branch_rows: DataFrame) -> DataFrame:
    """(event_idx, kind, bus1, bus2, tag, text) of bus and branch violations."""
    none = F.lit(None)
    a = bus_rows.select("event_idx", F.lit("bus").alias("kind"), F.col("bus_id").alias("bus1"), none.cast("long").alias("bus2"), none.cast("string").alias("tag"), F.concat(F.lit("voltage at bus "), F.col("bus_id").cast("string")).alias("text"))
    b = branch_rows.select("event_idx", F.lit("branch").alias("kind"), F.col("from_bus").alias("bus1"), F.col("to_bus").alias("bus2"), F.col("ckt").alias("tag"), F.concat(F.lit("overload of branch "), F.concat_ws(" ", "from_bus", "to_bus", "ckt")).alias("text"))
    return a.unionByName(b)


def violation_code(has_bus: Column, has_branch: Column) -> Column:
    """1 none, 2 bus, 3 branch, 4 both."""
    return F.when(has_bus & has_branch, 4).when(has_branch, 3).when(has_bus, 2).otherwise(1)


def status_code(outcomes: DataFrame) -> DataFrame:
    """Adds ``status_code`` to rows with solved, slack_ok, n_islands, elements_found and has_slack."""
    code = F.when(F.col("solved") & ~F.col("slack_ok"), "SLACK_OVERLOAD").when(F.col("solved"), "OK").when(F.col("n_islands") > 1, "ISLANDED")
    return outcomes.withColumn("status_code", code.when(~F.col("elements_found") | ~F.col("has_slack"), "NO_SLACK").otherwise("DIVERGED"))


def slack_capacity(output: DataFrame, generator: DataFrame, bus: DataFrame) -> DataFrame:
    """(event_idx, bus_id, p, pmax, ok) of reference buses: ok iff p <= pmax + max(1 % of pmax, 0.1)."""
    top = generator.where("status = 1").groupBy("bus_id").agg(F.sum("pmax").alias("pmax"))
    rows = output.join(bus.where(F.col("type") == 3).select("bus_id"), "bus_id", "left_semi").join(top, "bus_id", "left").fillna(0.0, ["pmax"])
    return rows.select("event_idx", "bus_id", "p", "pmax", (F.col("p") <= F.col("pmax") + F.greatest(0.01 * F.col("pmax"), F.lit(0.1))).alias("ok"))


def deadband_screen(devices: DataFrame, voltage: DataFrame) -> DataFrame:
    """Devices (device, own_bus, remote_bus, low, high, kind, tap, step, rmi, rma, to_side) that would act on the voltage of their controlled bus.

    The controlled bus is the remote one if it isn't 0 or null. Where it has no voltage, a shunt goes by its own bus and a tap changer
    by 1.0. A band narrower than 0.002 is widened to 0.001 either side of its middle. Returns device, event_idx, v_pu, direction (1
    raise, -1 lower) and, for tap changers, new_tap: the present tap and a step (its sign turned for control of the to bus), clamped to [rmi, rma].
    A tap changer that can't move, as it is at its limit, isn't reported. Events are those of the own bus.
    """
    own = voltage.select("event_idx", F.col("bus_id").alias("own_bus"), F.col("v_pu").alias("_own"))
    remote = voltage.select("event_idx", F.col("bus_id").alias("remote_bus"), F.col("v_pu").alias("_remote"))
    rows = devices.join(own, "own_bus").join(remote, ["event_idx", "remote_bus"], "left")
    absent = F.when(F.col("kind") == "tap", 1.0).otherwise(F.col("_own"))
    rows = rows.withColumn("v_pu", F.when(F.coalesce("remote_bus", F.lit(0)) != 0, F.coalesce("_remote", absent)).otherwise(F.col("_own")))
    middle, narrow = (F.col("low") + F.col("high")) / 2, F.col("high") - F.col("low") < 0.002
    low, high = F.when(narrow, middle - 0.001).otherwise(F.col("low")), F.when(narrow, middle + 0.001).otherwise(F.col("high"))
    rows = rows.withColumn("direction", F.when(F.col("v_pu") < low, 1).when(F.col("v_pu") > high, -1)).where("direction IS NOT NULL")
    moved = F.col("tap") + F.col("direction") * F.when(F.col("to_side"), -1).otherwise(1) * F.col("step")
    rows = rows.withColumn("new_tap", F.when(F.col("kind") == "tap", F.greatest(F.least(moved, F.col("rma")), F.col("rmi"))))
    stays = (F.col("kind") == "tap") & (F.abs(F.col("new_tap") - F.col("tap")) < 1e-8)
    return rows.where(~stays).select("device", "event_idx", "v_pu", "direction", "new_tap")


def scenario_summary(convergence: DataFrame, bus_rows: DataFrame, branch_rows: DataFrame) -> DataFrame:
    """Per scenario name, type, converged, iterations and whether a voltage or a branch is violated."""
    flag = lambda f, name: f.select("event_idx").distinct().withColumn(name, F.lit(True))
    rows = convergence.join(flag(bus_rows, "has_voltage_violation"), "event_idx", "left").join(flag(branch_rows, "has_branch_violation"), "event_idx", "left")
    return rows.select("event_idx", "name", "type", "converged", "iterations", F.coalesce("has_voltage_violation", F.lit(False)).alias("has_voltage_violation"), F.coalesce("has_branch_violation", F.lit(False)).alias("has_branch_violation"))


def rating_search(outcomes: DataFrame) -> DataFrame:
    """(tie, rating, limited): where the search for the largest secure rating of each tie ends, from evaluated (tie, rating, ok[, feasible]) rows.

    A rating is secure if all its rows are ok, and feasible unless one of its rows says that capacity doesn't allow it. If 1.0 is
    secure, the search climbs by 0.05 while ratings are feasible and secure, and from the last such one by 0.01. Else it steps down by 0.05 to
    the first secure (or infeasible) rating, goes back up one step, and from there down by 0.01 to the first secure one. ``limited`` says
    that a rating out of capacity, or one that wasn't evaluated, ended it; going down, the rating is then the last one before, which
    isn't secure. Null if nothing down to 0 is secure; ties without an outcome at 1.0 are left out.
    """
    feasible = F.bool_and("feasible") if "feasible" in outcomes.columns else F.lit(True)
    per = outcomes.groupBy("tie", F.round(F.col("rating") * 100).cast("int").alias("k")).agg(F.bool_and("ok").alias("ok"), feasible.alias("feasible"))
    code = F.when(~F.col("feasible"), -1).when(F.col("ok"), 1).otherwise(0)
    known = per.groupBy("tie").agg(F.map_from_entries(F.collect_list(F.struct("k", code.alias("code")))).alias("m"), F.max("k").alias("most"))
    at = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(-1))
    first = lambda ks, stop: F.get(F.filter(ks, stop), F.lit(0))
    down_to = lambda start, by: F.when(start >= 0, F.sequence(start, F.pmod(start, F.lit(by)), F.lit(-by)))
    rows = known.where(F.try_element_at("m", F.lit(100)).isNotNull()).withColumn("up", at(F.lit(100)) == 1)
    coarse = F.when(F.col("up"), first(F.sequence(F.lit(105), F.greatest("most", F.lit(105)) + 5, F.lit(5)), lambda k: at(k) != 1)).otherwise(first(down_to(F.lit(95), 5), lambda k: at(k) != 0))
    rows = rows.withColumn("coarse", coarse)
    fine = F.when(F.col("up"), first(F.sequence(F.col("coarse") - 4, F.greatest("most", F.col("coarse")) + 1), lambda k: at(k) != 1)).otherwise(first(down_to(F.col("coarse") + 4, 1), lambda k: at(k) != 0))
    rows = rows.withColumn("fine", fine).withColumn("limited", at(F.col("fine")) == -1)
    back = F.when(F.col("up"), -1).when(F.col("limited"), 1).otherwise(0)
    return rows.select("tie", ((F.col("fine") + back) / 100).alias("rating"), "limited")


def worst(rows: DataFrame, by: Sequence[str], k: int, order: Sequence[str] = CIRCUIT) -> DataFrame:
    """The k most loaded rows of each group, numbered by loading (ties by key). Where rows of a group lie together, as those of a circuit's events
    do, most are left out before anything is sorted or shuffled."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("loading", 6).desc(), *order))
    rows = rows if rows.isStreaming else _foremost(rows, by, k)
    return rows.withColumn("rank", n).where(F.col("rank") <= k)


def _foremost(rows: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Rows without those that k others of their group and Arrow batch exceed in loading: all that can be among the k foremost, and some more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.zeros(batch.num_rows, np.int64)
            for i in range(len(by)):
                codes = batch.column(i).dictionary_encode()
                group = group * (len(codes.dictionary) + 1) + codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
                group = np.unique(group, return_inverse=True)[1]
            score = batch.column(len(by)).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            score = np.where(np.isnan(score), np.inf, score)  # in Spark's order NaN is the greatest, null the least
            order = np.lexsort((-score, group))
            starts = np.searchsorted(group[order], np.arange(group.max(initial=-1) + 1))
            ends = np.append(starts[1:], batch.num_rows)
            least = np.where(starts + k <= ends, score[order][np.minimum(starts + k, ends) - 1], -np.inf)
            own = batch.schema.names[len(by) + 1 :]
            yield pa.RecordBatch.from_arrays(batch.columns[len(by) + 1 :], names=own).filter(pa.array(score >= least[group]))

    # groups and scores come first under names of their own, rows behind them
    scored = rows.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.round("loading", 6).cast("double").alias("_score"), *rows.columns)
    return scored.mapInArrow(run, rows.schema)
