"""Time series of machines and buses: excursions, spreads, watch lists and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def sustained_excursion(series: DataFrame, high: float = 61.0, low: float = 59.0, hold: float = 0.5, start: float = 0.0, segment: float = 600.0) -> DataFrame:
    """(machine, t, value, side): samples at which an excursion has lasted at least ``hold``.

    Up side, per machine from ``start`` on: beyond the limit and idle starts the clock; beyond, running and rising is a violation if
    the clock shows at least hold; running otherwise turns idle, and that sample doesn't restart the clock. Down is its mirror.
    So a sample beyond and moving away (R) always leaves it running, a sample inside (B) idle, and one beyond but not moving away (F)
    toggles: the state is the last R or B, turned by the parity of the F since.

    It is a segmented scan: a segment of ``segment`` seconds is a function of the state in which it is entered (running or not), and the clock it
    leaves running began inside it or is the one it was entered with. Windows over the samples reach over one machine's segment only, and
    give both outcomes; the segments' functions, a row each, are composed along the machine, and the entering states joined back. A
    segment's first sample, whose kind depends on the last value before, is composed as a function of its own. So a machine with very many
    samples is spread over its segments. Rows are ordered by (t, value); null values are left out.
    """
    rows = series.where((F.col("t") >= start) & F.col("value").isNotNull()).select("machine", "t", "value")
    rows = rows.withColumn("segment", F.floor((F.col("t") - start) / segment))
    states = _samples(rows, high, low)
    entered = _composed(_functions(states), high, low, hold)
    likely = states.where("n = 1 OR up_kind = 'R' OR down_kind = 'R'")
    found = likely.join(entered, ["machine", "segment"])
    sides = []
    for side in _SIDES:
        was = F.when(F.col(f"{side}_enters"), F.col(f"{side}_was1")).otherwise(F.col(f"{side}_was0"))
        since = F.when(F.col(f"{side}_enters"), F.col(f"{side}_since1")).otherwise(F.col(f"{side}_since0"))
        later = (F.col(f"{side}_kind") == "R") & was & (F.col("t") - F.coalesce(since, f"{side}_clock") >= hold)
        sides.append(F.when(F.coalesce(F.when(F.col("n") == 1, F.col(f"{side}_hit")).otherwise(later), F.lit(False)), side))
    return found.withColumn("side", F.explode(F.array_compact(F.array(*sides)))).select("machine", "t", "value", "side")


_SIDES = ("up", "down")


def _kind(side: str, value: Column, before: Column, high: float, low: float) -> Column:
    beyond = value > high if side == "up" else value < low
    away = value > before if side == "up" else value < before
    return F.when(~beyond, "B").when(F.coalesce(away, F.lit(False)), "R").otherwise("F")


def _samples(rows: DataFrame, high: float, low: float) -> DataFrame:
    """Samples with their number n in the segment and, for each side, kind (null for n = 1) and the state after and before them and the clock's start, for
    a segment that is idle (0) or running (1) after its first sample."""
    order = Window.partitionBy("machine", "segment").orderBy("t", "value")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"n": F.row_number().over(order), "before": F.lag("value").over(order)})
    for side in _SIDES:
        kind = F.when(F.col("n") > 1, _kind(side, F.col("value"), F.col("before"), high, low))
        out = out.withColumn(f"{side}_kind", kind)
        out = out.withColumn(f"{side}_f", F.sum(F.when(F.col(f"{side}_kind") == "F", 1).otherwise(0)).over(so_far))
        mark = F.when(F.col(f"{side}_kind") != "F", F.struct((F.col(f"{side}_kind") == "R").alias("on"), F.col(f"{side}_f").alias("f")))
        out = out.withColumn(f"{side}_mark", F.last(mark, ignorenulls=True).over(so_far))
        odd = F.pmod(F.col(f"{side}_f") - F.coalesce(f"{side}_mark.f", F.lit(0)), F.lit(2)) == 1
        out = out.withColumns({f"{side}_on{i}": F.coalesce(f"{side}_mark.on", F.lit(bool(i))) != odd for i in (0, 1)})
        out = out.withColumns({f"{side}_was{i}": F.lag(f"{side}_on{i}").over(order) for i in (0, 1)})
        begins = {i: F.when(F.col(f"{side}_on{i}") & ~F.col(f"{side}_was{i}"), F.col("t")) for i in (0, 1)}
        out = out.withColumns({f"{side}_since{i}": F.last(begins[i], ignorenulls=True).over(so_far) for i in (0, 1)})
    return out.drop("before", *[f"{side}_{c}" for side in _SIDES for c in ("f", "mark")])


def _functions(states: DataFrame) -> DataFrame:
    """A row for each segment: its first sample, its last value, and for each side the state it is left in and the clock's start for both states after the first sample."""
    at_end = [F.max_by(f"{side}_{c}{i}", "n").alias(f"{side}_{c}{i}") for side in _SIDES for c in ("on", "since") for i in (0, 1)]
    return states.groupBy("machine", "segment").agg(F.min(F.struct("t", "value")).alias("first"), F.max(F.struct("t", "value")).alias("last"), *at_end)


def _composed(functions: DataFrame, high: float, low: float, hold: float) -> DataFrame:
    """For each segment and side whether its first sample is a violation (hit), the state after it (enters) and the start of the clock then (clock)."""
    order = Window.partitionBy("machine").orderBy("segment")
    past, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    out = functions.withColumn("before", F.lag("last.value").over(order))
    for side in _SIDES:
        c = lambda name: F.col(f"{side}_{name}")  # noqa: B023, E731
        out = out.withColumn(f"{side}_kind", _kind(side, F.col("first.value"), F.col("before"), high, low))
        after = {i: F.when(c("kind") == "B", False).when(c("kind") == "R", True).otherwise(not i) for i in (0, 1)}
        whole = {i: F.when(after[i], c("on1")).otherwise(c("on0")) for i in (0, 1)}  # the segment's function, its first sample included
        out = out.withColumns({f"{side}_g{i}": whole[i] for i in (0, 1)})
        out = out.withColumn(f"{side}_turns", F.sum((c("g0") & ~c("g1")).cast("int")).over(so_far))
        mark = F.when(c("g0") == c("g1"), F.struct(c("g0").alias("on"), c("turns").alias("turns")))
        out = out.withColumn(f"{side}_mark", F.last(mark, ignorenulls=True).over(so_far))
        out = out.withColumn(f"{side}_left", F.coalesce(c("mark.on"), F.lit(False)) != (F.pmod(c("turns") - F.coalesce(c("mark.turns"), F.lit(0)), F.lit(2)) == 1))
        out = out.withColumn(f"{side}_was", F.coalesce(F.lag(f"{side}_left").over(order), F.lit(False)))
        out = out.withColumn(f"{side}_enters", F.when(c("was"), after[1]).otherwise(after[0]))
        begins = F.when(c("enters") & ~c("was"), F.col("first.t"))
        out = out.withColumn(f"{side}_own", F.coalesce(F.when(c("enters"), c("since1")).otherwise(c("since0")), begins))
        clock = F.last(c("own"), ignorenulls=True).over(past)
        out = out.withColumn(f"{side}_hit", (c("kind") == "R") & c("was") & (F.col("first.t") - clock >= hold))
        out = out.withColumn(f"{side}_clock", F.coalesce(begins, clock))
    return out.select("machine", "segment", *[f"{side}_{c}" for side in _SIDES for c in ("hit", "enters", "clock")])


def over_limit(series: DataFrame, limit: float) -> DataFrame:
    """(machine, n, most): machines with a value above the limit."""
    return series.where(F.col("value") > limit).groupBy("machine").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


def angle_spread(states: DataFrame, limit: float = 360.0, keys: Sequence[str] = ("scenario_idx", "step")) -> DataFrame:
    """(keys, spread, secure): secure iff the angles (degrees) spread by at most ``limit``; a group without angles isn't secure."""
    rows = states.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("spread"))
    return rows.withColumn("secure", F.coalesce(F.col("spread") <= limit, F.lit(False)))


def unpivot_watch(wide: DataFrame, time: str = "t") -> DataFrame:
    """Columns ``bus_tag_VAR`` (VAR one of ANG, SPD, GENP, GENQ) as rows (t, bus_id, gen_id, var, value); other columns are left out."""
    names = [c for c in wide.columns if c != time and c.rsplit("_", 1)[-1] in ("ANG", "SPD", "GENP", "GENQ")]
    long = wide.unpivot([time], names, "_name", "value")
    part = lambda i: F.regexp_extract("_name", r"^(\d+)_(.*)_(\w+)$", i)
    return long.select(F.col(time).alias("t"), part(1).cast("long").alias("bus_id"), F.trim(part(2)).alias("gen_id"), part(3).alias("var"), F.col("value").cast("double").alias("value"))


def watched_generators(generator: DataFrame, bus: DataFrame, area: int, zone: int = 0) -> DataFrame:
    """In-service generators of an area and, if positive, zone."""
    inside = bus.where((F.col("area") == area) & (F.lit(zone <= 0) | (F.col("zone") == zone))).select("bus_id")
    return generator.where("status = 1").join(inside, "bus_id", "left_semi").select("bus_id", "gen_id")


def observations(asked: DataFrame, elements: DataFrame) -> DataFrame:
    """Asked-for (type, bus_id, tag) with the element's value; what matches none stays, found false and value 0.

    Types are trimmed and lower-cased, tags canonical; elements have the same three columns and value.
    """
    from gridlake.functions.exprs import canonical_tag

    clean = lambda f: f.withColumns({"type": F.lower(F.trim("type")), "tag": F.coalesce(canonical_tag(F.col("tag")), F.lit(""))})
    rows = clean(asked).join(clean(elements).select("type", "bus_id", "tag", "value"), ["type", "bus_id", "tag"], "left")
    return rows.select("type", "bus_id", "tag", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("found"))
