"""Keyed attachment of values to buses and branches, indexing, overrides and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridlake.functions.durable import Workspace
from gridlake.functions.ordering import number

END = ("from_bus", "to_bus")


def scenario_name(elements: DataFrame) -> DataFrame:
    """Adds ``scenario``: BR_from_to_ckt for rows with a branch, GN_bus_id for rows with a generator."""
    branch = F.concat_ws("_", F.lit("BR"), "from_bus", "to_bus", "ckt")
    machine = F.concat_ws("_", F.lit("GN"), "bus_id", "gen_id")
    return elements.withColumn("scenario", F.when(F.col("from_bus").isNotNull(), branch).otherwise(machine))


def facility_label(elements: DataFrame, bus: DataFrame) -> DataFrame:
    """(event_idx, label): the first element, ``[area] from to ckt`` or ``gen bus id``, and `` (+n more)`` if there are others."""
    areas = bus.select(F.col("bus_id").alias("from_bus"), "area")
    text = F.when(F.col("from_bus").isNotNull(), F.concat(F.lit("["), F.coalesce(F.col("area").cast("string"), F.lit("")), F.lit("] "), F.concat_ws(" ", "from_bus", "to_bus", "ckt")))
    text = text.otherwise(F.concat_ws(" ", F.lit("gen"), "bus_id", "gen_id"))
    first = elements.join(areas, "from_bus", "left").groupBy("event_idx").agg(F.min_by(text, "pos").alias("text"), F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return first.select("event_idx", F.concat("text", more).alias("label"))


def attach_to_bus(values: DataFrame, bus: DataFrame) -> DataFrame:
    """Values joined with their bus; several values a bus are allowed, values of unknown buses are dropped."""
    return values.join(bus, "bus_id")


def attach_to_branch(values: DataFrame, branch: DataFrame) -> DataFrame:
    """Values joined on (from_bus, to_bus); only values without a direct match try the swapped pair. Adds ``swapped``."""
    pairs = branch.select(*END).distinct()
    direct = values.join(branch, [*END]).withColumn("swapped", F.lit(False))
    rest = values.join(pairs, [*END], "left_anti")
    turned = rest.select(*[F.col({"from_bus": "to_bus", "to_bus": "from_bus"}.get(c, c)).alias(c) for c in rest.columns])
    return direct.unionByName(turned.join(branch, [*END]).withColumn("swapped", F.lit(True)))


def dense_index(frame: DataFrame, key: str, name: str = "dense") -> DataFrame:
    """Adds the rank 0..n-1 of the distinct ``key``, of any type that can be ordered; rows without a key are left out.

    Keys are numbered in ranges, so no window or task covers all keys, however they are spread. The distinct keys are written before they
    are dealt into ranges; ``frame`` itself is read once for them and once for the result.
    """
    with Workspace(frame.sparkSession) as tables:
        keys = tables.durable(frame.select(key).where(F.col(key).isNotNull()).distinct())
        return frame.join(number(keys, [key], name), key)


def neighbors(branch: DataFrame) -> DataFrame:
    """(bus_id, circuits, buses): number of circuit ends at each bus and its sorted distinct opposite buses."""
    ends = branch.select(F.col("from_bus").alias("bus_id"), F.col("to_bus").alias("other")).union(branch.select(F.col("to_bus"), F.col("from_bus")))
    return ends.groupBy("bus_id").agg(F.count(F.lit(1)).alias("circuits"), F.array_sort(F.collect_set("other")).alias("buses"))


def apply_overrides(entity: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-key columns of ``overrides`` replace those of ``entity`` where the key matches and the new value isn't null.
    Of several overrides of one key the one with the greatest value of a column ``seq``, if there is one, counts."""
    names = [c for c in overrides.columns if c not in keys and c != "seq"]
    if "seq" in overrides.columns:
        last = F.max_by(F.struct(*names), "seq").alias("_new")
        overrides = overrides.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_new.{c}").alias(c) for c in names])
    fresh = overrides.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = entity.join(fresh, list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in entity.columns])


def apply_setpoints(generator: DataFrame, table: DataFrame) -> DataFrame:
    """Generators per scenario of ``table`` (bus_id, gen_id, scenario_idx, value): pg := value, status := 0 iff value = 0.
    Generators that the table doesn't name are left out of it."""
    joined = generator.join(table, ["bus_id", "gen_id"])
    return joined.withColumn("pg", F.col("value")).withColumn("status", F.when(F.col("value") == 0.0, 0).otherwise(1)).drop("value")


def apply_scenarios(circuit: DataFrame, elements: DataFrame, keys: Sequence[str] = (*END, "ckt")) -> DataFrame:
    """Rows of every scenario of ``elements``, with status 0 for those that the scenario takes out.

    The scenario list is small beside the network; the fan-out to scenarios x rows is the result itself. Each row learns which scenarios take it
    out before they multiply it, so the result isn't shuffled.
    """
    out = elements.groupBy(*keys).agg(F.collect_set("event_idx").alias("_out"))
    every = circuit.join(out, list(keys), "left").crossJoin(F.broadcast(elements.select("event_idx").distinct()))
    joined = every.select("event_idx", *keys, *[c for c in circuit.columns if c not in keys], "_out")
    return joined.withColumn("status", F.when(F.array_contains("_out", F.col("event_idx")), 0).otherwise(F.col("status"))).drop("_out")


def elements_not_found(circuit: DataFrame, elements: DataFrame, keys: Sequence[str] = (*END, "ckt")) -> DataFrame:
    """Elements of scenarios that name no row of the network."""
    return elements.join(circuit.select(*keys).distinct(), list(keys), "left_anti")


def lookup_names(bus: DataFrame, area: DataFrame, zone: DataFrame, owner: DataFrame) -> DataFrame:
    """Bus rows with area_name, zone_name and owner_name; quotes are trimmed, absent names are empty."""
    out = bus
    for kind, table in (("area", area), ("zone", zone), ("owner", owner)):
        names = table.select(F.col("number").alias(kind), F.trim(F.regexp_replace(F.trim("name"), r"^'|'$", "")).alias(f"{kind}_name"))
        out = out.join(names, kind, "left").withColumn(f"{kind}_name", F.coalesce(f"{kind}_name", F.lit("")))
    return out


def first_writer_dedup(frame: DataFrame, key: str, part: str) -> DataFrame:
    """One row per key, that of the lowest part; no sort, a partial aggregate."""
    rest = [c for c in frame.columns if c != key]
    first = frame.groupBy(key).agg(F.min_by(F.struct(*rest), part).alias("_first"))
    return first.select(*[F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in frame.columns])


def indexed_store(updates: DataFrame) -> DataFrame:
    """(idx, value): the value last written to each index, by ``seq``."""
    return updates.groupBy("idx").agg(F.max_by("value", "seq").alias("value"))


def merge_partial_records(sections: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Records put together from sections: for each field the last section that has a value for it."""
    numbered = [s.withColumn("_section", F.lit(i)) for i, s in enumerate(sections)]
    whole = numbered[0]
    for s in numbered[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    fields = [c for c in whole.columns if c not in (*keys, "_section")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_section"))).alias(c) for c in fields]
    return whole.groupBy(*keys).agg(*last)
