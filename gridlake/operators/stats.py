"""Statistics over scenario results held as long tables (row_key, scenario_idx, value, mask); scenario 0 is the base case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlake.operators.electrical import fits


def _base() -> Column:
    return F.max(F.when(F.col("scenario_idx") == 0, F.col("value")))


def mean_rms(stat: DataFrame, mask: int) -> DataFrame:
    """(row_key, n, mean, std, rms) over values with at least this mask; std is that of a sample, rms the deviation from the base:
    sqrt(sum over other scenarios of (x - base)^2 / (n - 1)). Both are 0 if n <= 1, all three if there is no such value. A row's base
    is attached in the shuffle that groups it, so that large values with small deviations keep their digits. rms is null without a base."""
    use = F.col("mask") >= mask
    based = stat.withColumn("_base", F.max(F.when(F.col("scenario_idx") == 0, F.col("value"))).over(Window.partitionBy("row_key")))
    x = F.when(use, F.col("value"))
    off = F.when(use & (F.col("scenario_idx") > 0), F.col("value") - F.col("_base"))
    other = F.count(F.when(use & (F.col("scenario_idx") > 0), 1)).alias("m")
    rows = based.groupBy("row_key").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.max("_base").alias("base"), other, F.sum(off * off).alias("square"))
    many = F.col("n") > 1
    rms = F.when(many & (F.col("m") > 0), F.sqrt(F.col("square") / (F.col("n") - 1))).when(F.col("base").isNotNull() | ~many, 0.0)
    return rows.select("row_key", "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(many, F.col("sd")).otherwise(0.0).alias("std"), rms.alias("rms"))


def min_max(stat: DataFrame, mask: int) -> DataFrame:
    """(row_key, base, min, max, d_min, d_max, min_bound, max_bound, argmin, argmax), seeded by the base value whatever its mask;
    the first scenario wins ties. Rows without a base value are left out."""
    base = F.col("scenario_idx") == 0
    use = base | (F.col("mask") >= mask)
    low = F.min(F.when(use, F.struct("value", "scenario_idx"))).alias("low")
    high = F.max(F.when(use, F.struct("value", (-F.col("scenario_idx")).alias("n")))).alias("high")
    rows = stat.groupBy("row_key").agg(_base().alias("base"), low, high, F.min("min_bound").alias("min_bound"), F.max("max_bound").alias("max_bound")).where("base IS NOT NULL")
    return rows.select("row_key", "base", F.col("low.value").alias("min"), F.col("high.value").alias("max"), (F.col("low.value") - F.col("base")).alias("d_min"), (F.col("high.value") - F.col("base")).alias("d_max"), "min_bound", "max_bound", F.col("low.scenario_idx").alias("argmin"), (-F.col("high.n")).alias("argmax"))


def mask_count(stat: DataFrame, mask: int) -> DataFrame:
    """(row_key, n): values with exactly this mask; rows without any count 0."""
    return stat.groupBy("row_key").agg(F.count(F.when(F.col("mask") == mask, 1)).alias("n"))


def column_sums(stat: DataFrame, mask: int) -> DataFrame:
    """(scenario_idx, total, avg_over_all_rows): sum of values with at least this mask, and that over all rows, counted or not."""
    total = F.coalesce(F.sum(F.when(F.col("mask") >= mask, F.col("value"))), F.lit(0.0))
    return stat.groupBy("scenario_idx").agg(total.alias("total"), (total / F.count(F.lit(1))).alias("avg_over_all_rows"))


def build_stat(rows: DataFrame, convergence: DataFrame, value: str = "p", unique: bool = False) -> DataFrame:
    """Long table of result rows: base is scenario 0, event t is t; bounds are plus and minus rate_a, mask is 2 where the row is flagged
    (viol), else 1. Scenarios that did not converge are filled in with value 0 and mask 0 for every circuit of the base case. ``unique`` says
    that no circuit comes twice in an event; else repeated rows are looked for, which shuffles all of them. Rows are read once, and scenarios broadcast."""
    key = F.concat_ws("_", "from_bus", "to_bus", "ckt").alias("row_key")
    good = convergence.where("converged").select("event_idx")
    good = good.union(rows.sparkSession.range(1).select(F.lit(0))).where("event_idx IS NOT NULL").distinct().select("event_idx", F.col("event_idx").alias("scenario_idx"), F.lit(True).alias("_solved"))
    failed = convergence.where("NOT converged AND event_idx <> 0").select(F.lit(0), F.col("event_idx"), F.lit(False))
    if not unique:
        keys = ["event_idx", "from_bus", "to_bus", "ckt"]
        again = rows.withColumn("_again", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
        rows = again.where("_again = 1 OR event_idx = 0")
    solved = F.col("_solved")
    long = rows.join(F.broadcast(good.union(failed)), "event_idx")
    long = long if unique else long.where("_again = 1 OR NOT _solved")
    return long.select(key, "scenario_idx", F.when(solved, F.col(value)).otherwise(0.0).alias("value"), F.when(~solved, 0).when(F.col("viol") == 1, 2).otherwise(1).alias("mask"), (-F.col("rate")).alias("min_bound"), F.col("rate").alias("max_bound"))


def network_counts(bus: DataFrame, circuit: DataFrame, generator: DataFrame, load: DataFrame, storage: DataFrame | None = None) -> DataFrame:
    """(kind, bus_id, n): generators, loads, storage units and circuit ends per bus, and totals of all kinds with a null bus."""
    per = lambda f, kind: f.groupBy("bus_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "bus_id", "n")
    ends = circuit.select(F.explode(F.array("from_bus", "to_bus")).alias("bus_id"))
    total = lambda f, kind: f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("bus_id"), "n")
    out = per(generator, "generator").union(per(load, "load")).union(per(ends, "circuit_end"))
    branches = circuit.select("from_bus", "to_bus").distinct()
    kinds = [(generator, "generator"), (load, "load"), (circuit, "circuit"), (bus, "bus"), (branches, "branch")]
    if storage is not None:
        out = out.union(per(storage, "storage"))
        kinds.append((storage, "storage"))
    for f, kind in kinds:
        out = out.union(total(f, kind))
    return out


def area_load(load: DataFrame, bus: DataFrame) -> DataFrame:
    """(area, zone, pl): loads in service by area and zone; a null zone is the whole area."""
    rows = load.where("status = 1").join(bus.select("bus_id", "area", "zone"), "bus_id")
    return rows.rollup("area", "zone").agg(F.sum("pl").alias("pl")).where("area IS NOT NULL")


def generator_margins(generator: DataFrame, bus: DataFrame) -> DataFrame:
    """(area, zone, pg, pmin, pmax) of online units; a null zone is the whole area."""
    rows = generator.where("status = 1").join(bus.select("bus_id", "area", "zone"), "bus_id")
    return rows.rollup("area", "zone").agg(*[F.sum(c).alias(c) for c in ("pg", "pmin", "pmax")]).where("area IS NOT NULL")


def between_areas(rows: DataFrame, bus: DataFrame) -> DataFrame:
    """Rows whose ends lie in different areas, with these: area_from and area_to. Buses of a checked size are broadcast."""
    place = lambda end, name: bus.select(F.col("bus_id").alias(end), F.col("area").alias(name))
    sent = F.broadcast if fits(bus) else lambda f: f
    return rows.join(sent(place("from_bus", "area_from")), "from_bus").join(sent(place("to_bus", "area_to")), "to_bus").where("area_from <> area_to")


def area_export(flow: DataFrame, bus: DataFrame | None = None) -> DataFrame:
    """(event_idx, area, export): power leaving each area over circuits to other areas, counted at their from end. Without ``bus``, the flow is that of
    circuits that went through ``between_areas``: then areas are looked up once a circuit and its rows of events aren't shuffled."""
    rows = flow if bus is None else between_areas(flow, bus)
    sides = F.array(F.struct(F.col("area_from").alias("area"), F.col("p_from").alias("p")), F.struct(F.col("area_to").alias("area"), (-F.col("p_from")).alias("p")))
    return rows.select("event_idx", F.explode(sides).alias("s")).groupBy("event_idx", F.col("s.area").alias("area")).agg(F.sum("s.p").alias("export"))


def zone_totals(bus: DataFrame, generator: DataFrame, load: DataFrame) -> DataFrame:
    """(zone, pl, ql, pg, qg) of in-service equipment for every zone that has buses."""
    zone = bus.select("bus_id", "zone")
    d = load.where("status = 1").join(zone, "bus_id").groupBy("zone").agg(F.sum("pl").alias("pl"), F.sum("ql").alias("ql"))
    g = generator.where("status = 1").join(zone, "bus_id").groupBy("zone").agg(F.sum("pg").alias("pg"), F.sum("qg").alias("qg"))
    return bus.select("zone").distinct().join(d, "zone", "left").join(g, "zone", "left").fillna(0.0)


def source_sink_report(generator: DataFrame, load: DataFrame, bus: DataFrame, source: tuple[int, int], sink: tuple[int, int], gen_factor: float, load_factor: float) -> DataFrame:
    """(side, bus_id, tag, now, scaled): online generators of the source area and loads of the sink area, before and after scaling."""
    from gridlake.operators.electrical import scale_generation, scale_load

    inside = lambda p: bus.where((F.col("area") == p[0]) & (F.lit(p[1] <= 0) | (F.col("zone") == p[1]))).select("bus_id")
    g = generator.where("status = 1").join(inside(source), "bus_id", "left_semi")
    d = load.where("status = 1").join(inside(sink), "bus_id", "left_semi")
    after_g = scale_generation(g, bus, *source, gen_factor).select("bus_id", "gen_id", F.col("pg").alias("scaled"))
    after_d = scale_load(d, bus, *sink, load_factor).select("bus_id", "load_id", F.col("pl").alias("scaled"))
    a = g.join(after_g, ["bus_id", "gen_id"]).select(F.lit("source").alias("side"), "bus_id", F.col("gen_id").alias("tag"), F.col("pg").alias("now"), "scaled")
    b = d.join(after_d, ["bus_id", "load_id"]).select(F.lit("sink").alias("side"), "bus_id", F.col("load_id").alias("tag"), F.col("pl").alias("now"), "scaled")
    return a.union(b)


def source_sink_totals(report: DataFrame) -> DataFrame:
    """(side, n, now, scaled, least, most) of a source and sink report."""
    return report.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("now").alias("now"), F.sum("scaled").alias("scaled"), F.min("scaled").alias("least"), F.max("scaled").alias("most"))


def reduce(values: DataFrame, value: str, flag: str | None = None) -> DataFrame:
    """One row: sum, max and min of a column and, of a boolean one, any and all."""
    aggs = [F.sum(value).alias("sum"), F.max(value).alias("max"), F.min(value).alias("min")]
    if flag:
        aggs += [F.bool_or(flag).alias("any"), F.bool_and(flag).alias("all")]
    return values.agg(*aggs)


def timer_stats(timers: DataFrame) -> DataFrame:
    """(timer, n, avg, max, min, std) over ranks; the sample deviation is null for one rank."""
    return timers.groupBy("timer").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("avg"), F.max("seconds").alias("max"), F.min("seconds").alias("min"), F.stddev_samp("seconds").alias("std"))


def load_balance(tasks: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Tasks per rank of each run: total, min, max, mean, population std, cv_percent and max_over_mean."""
    rows = tasks.groupBy(*by).agg(F.sum("tasks").alias("total"), F.min("tasks").alias("min"), F.max("tasks").alias("max"), F.avg("tasks").alias("mean"), F.stddev_pop("tasks").alias("std"))
    mean = F.when(F.col("mean") != 0, F.col("mean"))
    return rows.withColumns({"cv_percent": 100 * F.col("std") / mean, "max_over_mean": F.col("max") / mean})


def ensemble_quantiles(series: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ("machine", "step")) -> DataFrame:
    """(keys, q, value): exact quantiles over an ensemble, linear between order statistics at q * (n - 1). A group has as many values as
    the ensemble has members; for unbounded groups use ``approximate_quantiles``."""
    found = series.groupBy(*keys).agg(F.percentile("value", F.array(*[F.lit(q) for q in quantiles])).alias("v"))
    return found.select(*keys, F.posexplode("v").alias("pos", "value")).select(*keys, F.element_at(F.array(*[F.lit(q) for q in quantiles]), F.col("pos") + 1).alias("q"), "value")


def approximate_quantiles(series: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ("machine", "step"), accuracy: int = 10_000) -> DataFrame:
    """(keys, values array) within 1/accuracy in rank, in bounded memory a group."""
    return series.groupBy(*keys).agg(F.percentile_approx("value", list(quantiles), accuracy).alias("values"))


def watch_pivot(rows: DataFrame, events: Sequence[int], lines: DataFrame) -> DataFrame:
    """A row per watched line with columns P_e and Q_e of each listed event (0 is the base); missing rows are 0."""
    keys = ["from_bus", "to_bus", "ckt"]
    joined = lines.select(*keys).join(rows.where(F.col("event_idx").isin(*events)), keys, "left")
    aggs = [F.coalesce(F.sum(F.when(F.col("event_idx") == e, F.col(c))), F.lit(0.0)).alias(f"{c.upper()}_{e}") for e in events for c in ("p", "q")]
    return joined.groupBy(*keys).agg(*aggs)
