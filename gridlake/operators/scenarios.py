"""Generation, combination and screening of outage scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlake.functions.durable import Workspace
from gridlake.functions.ordering import number
from gridlake.operators import topology
from gridlake.operators.keyed import scenario_name


def n1_branches(circuit: DataFrame) -> DataFrame:
    """One scenario per circuit."""
    rows = circuit.select("from_bus", "to_bus", "ckt", F.lit(None).cast("long").alias("bus_id"), F.lit(None).cast("string").alias("gen_id"))
    return scenario_name(rows).withColumn("type", F.lit("Line"))


def n1_generators(generator: DataFrame) -> DataFrame:
    """One scenario per generator."""
    none = F.lit(None).cast("long")
    rows = generator.select(none.alias("from_bus"), none.alias("to_bus"), F.lit(None).cast("string").alias("ckt"), "bus_id", "gen_id")
    return scenario_name(rows).withColumn("type", F.lit("Generator"))


def in_area(bus: DataFrame, area: int, zone: int = 0) -> DataFrame:
    """Buses of an area and, if zone is positive, of that zone."""
    return bus.where((F.col("area") == area) & (F.lit(zone <= 0) | (F.col("zone") == zone)))


def n1_in_area(circuit: DataFrame, generator: DataFrame, bus: DataFrame, area: int, zone: int = 0) -> DataFrame:
    """In-service outages of an area: generators at its buses, lines with both ends there. Names are LineCTGn and GenCTGn by key order."""
    inside = in_area(bus, area, zone).select("bus_id")
    lines = circuit.where("status = 1")
    for end in ("from_bus", "to_bus"):
        lines = lines.join(inside.withColumnRenamed("bus_id", end), end, "left_semi")
    machines = generator.where("status = 1").join(inside, "bus_id", "left_semi")
    lines = number(lines.select("from_bus", "to_bus", "ckt"), ["from_bus", "to_bus", "ckt"], "n", start=1)
    machines = number(machines.select("bus_id", "gen_id"), ["bus_id", "gen_id"], "n", start=1)
    a = lines.select(F.concat(F.lit("LineCTG"), F.col("n").cast("string")).alias("name"), F.col("from_bus").alias("bus1"), F.col("to_bus").alias("bus2"), F.col("ckt").alias("tag"))
    b = machines.select(F.concat(F.lit("GenCTG"), F.col("n").cast("string")).alias("name"), F.col("bus_id").alias("bus1"), F.lit(None).cast("long").alias("bus2"), F.col("gen_id").alias("tag"))
    return a.union(b)


def n2_pairs(singles: DataFrame, caps: dict[str, int | None] | None = None) -> DataFrame:
    """(kind, a, b): unordered pairs of single outages (idx, type, name), of kinds GG, GL and LL; idx is unique within a type.

    A cap of n keeps a kind's first n pairs by (a, b); None keeps all, 0 none. Pairs are numbered in this order and the numbers are dealt out:
    pair number k names the places of its two outages in closed form, and two equi-joins on the numbered lists fetch them. So no plan
    multiplies the lists, and n pairs are n rows from the start. Of capped kinds only the first outages that can occur are numbered.
    """
    caps = caps or {}
    spark, parts, lists = singles.sparkSession, [], {}

    def listed(kind: str, cap: int | None) -> tuple[DataFrame, int]:
        if (kind, cap) not in lists:
            some = singles.where(F.col("type") == kind).select("idx")
            some = number(some if cap is None else some.orderBy("idx").limit(cap), ["idx"], "place")
            lists[kind, cap] = some, some.count()
        return lists[kind, cap]

    for kind, left, right in (("GG", "Generator", "Generator"), ("GL", "Generator", "Line"), ("LL", "Line", "Line")):
        cap = caps.get(kind)
        if cap == 0:
            continue
        (a, n), (b, m) = (listed(t, None if cap is None else cap + 1) for t in (left, right))
        total = n * (n - 1) // 2 if left == right else n * m
        k = F.col("id")
        if left == right:
            # the pairs before those of the i-th outage are i * (2n - i - 1) / 2; the root may be off by one, which is put right in integers
            before = lambda i: F.call_function("div", i * (2 * n - i - 1), F.lit(2).cast("long"))  # noqa: B023, E731
            guess = F.floor((2 * n - 1 - F.sqrt(F.greatest(F.lit(float((2 * n - 1) ** 2)) - 8.0 * k, F.lit(0.0)))) / 2).cast("long")
            numbers = spark.range(total if cap is None else min(cap, total)).withColumn("i", guess)
            numbers = numbers.withColumn("i", F.when(before(F.col("i")) > k, F.col("i") - 1).when(before(F.col("i") + 1) <= k, F.col("i") + 1).otherwise(F.col("i")))
            numbers = numbers.withColumn("j", k - before(F.col("i")) + F.col("i") + 1)
        else:
            numbers = spark.range(total if cap is None else min(cap, total)).withColumns({"i": F.call_function("div", k, F.lit(max(m, 1)).cast("long")), "j": k % max(m, 1)})
        first, second = a.select(F.col("place").alias("i"), F.col("idx").alias("a")), b.select(F.col("place").alias("j"), F.col("idx").alias("b"))
        parts.append(numbers.join(first, "i").join(second, "j").select(F.lit(kind).alias("kind"), "a", "b"))
    out = parts[0] if parts else singles.select(F.lit("").alias("kind"), F.col("idx").alias("a"), F.col("idx").alias("b")).limit(0)
    for p in parts[1:]:
        out = out.union(p)
    return out


def _content(elements: DataFrame, place: Column) -> DataFrame:
    """(event_idx, type, n, members, place) of scenarios: number of elements, sorted set of them, place in the list."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("from_bus", "to_bus", "ckt", "bus_id", "gen_id")]
    element = F.concat(*[part for t in texts for part in (F.length(t).cast("string"), F.lit(":"), t)])  # lengths keep different elements apart; a struct would be thrice as wide
    return elements.groupBy("event_idx", "type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(element)).alias("members")).withColumn("place", place)


def _repeated(new: DataFrame, old: DataFrame) -> DataFrame:
    """(event_idx, type) of scenarios of ``new`` that repeat one of a smaller place in ``old``: same type and count, and each element is found there.

    Without repeated elements that is having the same elements, an equi-join. A scenario of one element in all places repeats the first that has this
    element. Of others that repeat elements, if there are any, only the rarest one is looked up; the scenarios that have it are compared in full."""
    plain = F.size("members") == F.col("n")
    first = old.where(plain).groupBy("type", "members").agg(F.min("place").alias("first"))
    same = new.where(plain).join(first, ["type", "members"]).where("first < place").select("event_idx", "type")
    each = lambda f: f.withColumn("element", F.explode("members"))
    known = each(old.select("type", "n", "members", "place"))
    times = known.groupBy("type", "n", "element").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first"))
    alone = each(new.where(~plain & (F.size("members") == 1))).join(times, ["type", "n", "element"]).where("first < place").select("event_idx", "type")
    same, several = same.union(alone), new.where(~plain & (F.size("members") > 1))
    if several.isEmpty():
        return same.distinct()
    rarest = each(several).join(times.drop("first"), ["type", "n", "element"], "left")
    rarest = rarest.groupBy("event_idx", "type", "n", "place").agg(F.min_by("element", F.struct(F.coalesce("times", F.lit(0)), "element")).alias("element"), F.first("members").alias("members"))
    found = rarest.join(known.select("type", "n", "element", F.col("members").alias("others"), F.col("place").alias("earlier")), ["type", "n", "element"])
    found = found.where((F.col("earlier") < F.col("place")) & (F.size(F.array_except("members", "others")) == 0))
    return same.union(found.select("event_idx", "type")).distinct()


def dedup_scenarios(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Scenarios of ``new`` (elements with event_idx and type) that repeat no existing one: none of their type and number of elements has each of their
    elements, in any order. So one that lists an element twice repeats one that has it once beside another."""
    with Workspace(new.sparkSession) as tables:
        repeated = tables.keep(tables.durable(_repeated(tables.durable(_content(new, F.lit(1))), tables.durable(_content(existing, F.lit(0))))))
    return new.join(repeated, ["event_idx", "type"], "left_anti").select(*new.columns)


def combine(auto: DataFrame, file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(combined, counts): the automatic list, then the scenarios of the file list, in order of event_idx, that repeat neither an automatic one
    nor one of the file before them; event_idx follows list order. counts has auto, added and skipped.

    What repeats a skipped scenario repeats the one for which that was skipped, so the file is checked against itself in one join. Contents of
    scenarios are written once while this runs; a table of the repeated ones, keys only, outlives the call."""
    content = lambda f, place: _content(f, F.struct(F.lit(place).alias("list"), F.col("event_idx").alias("at")))
    with Workspace(file.sparkSession) as tables:
        listed, old = tables.durable(content(file, 1)), tables.durable(content(auto, 0))
        repeated = tables.keep(tables.durable(_repeated(listed, old.unionByName(listed))))
    added = file.join(repeated, ["event_idx", "type"], "left_anti").select(*file.columns)
    old = auto.select("event_idx").distinct().select(F.lit(0).alias("_list"), F.col("event_idx").alias("_old"))
    old = old.union(added.select("event_idx").distinct().select(F.lit(1), F.col("event_idx")))
    index = number(old, ["_list", "_old"], "_new", start=1)
    whole = auto.withColumn("_list", F.lit(0)).unionByName(added.withColumn("_list", F.lit(1))).withColumnRenamed("event_idx", "_old")
    combined = whole.join(index, ["_list", "_old"]).withColumnRenamed("_new", "event_idx").drop("_list", "_old")
    distinct = lambda f: f.agg(F.countDistinct("event_idx").alias("n"))
    counts = distinct(auto).select(F.col("n").alias("auto")).crossJoin(distinct(added).select(F.col("n").alias("added")))
    counts = counts.crossJoin(distinct(file).select(F.col("n").alias("_file"))).select("auto", "added", (F.col("_file") - F.col("added")).alias("skipped"))
    return combined, counts


def task_grid(faults: DataFrame, configs: DataFrame, n_configs: int) -> DataFrame:
    """(task, fault, config) of all pairs: task = fault * n_configs + config."""
    return faults.crossJoin(F.broadcast(configs)).select((F.col("fault") * n_configs + F.col("config")).alias("task"), "fault", "config")


def screen_n1(circuit: DataFrame, bus: DataFrame) -> DataFrame:
    """Line outages that keep every bus connected: both ends have another line in service and the circuit is no bridge."""
    enough = topology.outage_candidates_by_degree(circuit)
    bridges = topology.screen_outages(bus, circuit).where("bridge").select("from_bus", "to_bus", "ckt")
    return enough.join(bridges, ["from_bus", "to_bus", "ckt"], "left_anti")
