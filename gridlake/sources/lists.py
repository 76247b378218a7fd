"""Readers of measurement, contingency, fault and monitor lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.functions.exprs import canonical_tag
from gridlake.operators.measure import BUS_TYPES, BRANCH_TYPES


def _xml(spark: SparkSession, path: str, row: str, fields: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"`{f}` string" for f in fields)
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """(type, bus_id, from_bus, to_bus, ckt, value, deviation); unknown types and rows without their element are dropped, ckt is two characters."""
    rows = _xml(spark, path, "Measurement", ("Type", "Bus", "FromBus", "ToBus", "CKT", "Value", "Deviation"))
    n = lambda c, t: F.expr(f"try_cast(trim({c}) AS {t})")
    kind = F.upper(F.trim("Type"))
    out = rows.select(kind.alias("type"), n("Bus", "bigint").alias("bus_id"), n("FromBus", "bigint").alias("from_bus"), n("ToBus", "bigint").alias("to_bus"), F.rpad(F.trim("CKT"), 2, " ").alias("ckt"), n("Value", "double").alias("value"), n("Deviation", "double").alias("deviation"))
    at_bus = F.col("type").isin(*[t for t in BUS_TYPES if t[0] != "V" or t in ("VM", "VA")]) & F.col("bus_id").isNotNull()
    on_branch = F.col("type").isin(*BRANCH_TYPES) & F.col("from_bus").isNotNull() & F.col("to_bus").isNotNull() & F.col("ckt").isNotNull()
    return out.where(at_bus | on_branch)


def read_contingencies(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, pos, from_bus, to_bus, ckt, bus_id, gen_id) of outage elements.

    Lists are blank-separated; the short names CKT and GenID win over the long ones. Kept only if the bus list is twice
    as long as the tags (Line) or as long as the ids (Generator); other kinds are read as whichever of both fits.
    """
    rows = _xml(spark, path, "Contingency", ("contingencyType", "contingencyName", "contingencyLineBuses", "contingencyLineNames", "CKT", "contingencyBuses", "contingencyGenerators", "GenID"))
    split = lambda *c: F.expr(f"filter(split(trim(coalesce({', '.join(c)}, '')), '\\\\s+'), x -> x <> '')")
    rows = rows.select(F.trim("contingencyName").alias("name"), F.trim("contingencyType").alias("type"), split("contingencyLineBuses").alias("lb"), split("CKT", "contingencyLineNames").alias("lt"), split("contingencyBuses").alias("gb"), split("GenID", "contingencyGenerators").alias("gi"))
    lines = rows.where("size(lt) > 0 AND size(lb) = 2 * size(lt)").select("name", "type", F.posexplode("lt").alias("pos", "tag"), "lb")
    lines = lines.select("name", "type", "pos", F.expr("try_cast(lb[2 * pos] AS bigint)").alias("from_bus"), F.expr("try_cast(lb[2 * pos + 1] AS bigint)").alias("to_bus"), canonical_tag(F.col("tag")).alias("ckt"))
    machines = rows.where("size(gi) > 0 AND size(gb) = size(gi)").select("name", "type", F.posexplode("gi").alias("pos", "tag"), "gb")
    machines = machines.select("name", "type", "pos", F.expr("try_cast(gb[pos] AS bigint)").alias("bus_id"), canonical_tag(F.col("tag")).alias("gen_id"))
    return lines.unionByName(machines, allowMissingColumns=True)


def read_monitor_list(spark: SparkSession, path: str) -> DataFrame:
    """(from_bus, to_bus, ckt) of CSV lines; blank lines, ``#`` lines and lines without a number in front are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("v")).where(F.col("v").rlike(r"^\s*\d+\s*,"))
    parts = lines.select(F.split("v", ",").alias("p")).where("size(p) >= 3")
    return parts.select(F.expr("try_cast(trim(p[0]) AS bigint)").alias("from_bus"), F.expr("try_cast(trim(p[1]) AS bigint)").alias("to_bus"), canonical_tag(F.col("p")[2]).alias("ckt"))


def read_fault_events(spark: SparkSession, path: str) -> DataFrame:
    """(begin, end, from_bus, to_bus, step) of fault events with a step, an end and two different buses."""
    rows = _xml(spark, path, "faultEvent", ("beginFault", "endFault", "faultBranch", "timeStep"))
    n = lambda c: F.expr(f"try_cast(trim({c}) AS double)")
    parts = F.split(F.trim("faultBranch"), r"\s+")
    out = rows.select(n("beginFault").alias("begin"), n("endFault").alias("end"), parts.alias("p"), n("timeStep").alias("step"))
    out = out.select("begin", "end", F.expr("try_cast(get(p, 0) AS bigint)").alias("from_bus"), F.expr("try_cast(get(p, 1) AS bigint)").alias("to_bus"), "step")
    return out.where("step <> 0 AND `end` <> 0 AND from_bus <> to_bus")
