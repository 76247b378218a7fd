"""Numbering rows in a global order without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlake.functions.durable import durable

_BITS = 33  # of a row's place inside its partition, as monotonically_increasing_id lays them out


def number(frame: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``frame`` with ``name``: start, start + 1, ... in the given order (ties in any, but a fixed, order).

    Rows are dealt into ranges and sorted there; a durable table fixes each row's range and place, and only
    the ranges' row counts (one number a partition) reach the driver, to be broadcast as offsets.
    """
    place, part = f"_{name}_place", f"_{name}_part"
    dealt = durable(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(place, _BITS))
    at, offsets = start, []
    for r in sorted(dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r[part]):
        offsets.append((r[part], at))
        at += r["n"]
    before = frame.sparkSession.createDataFrame(offsets, f"{part} long, _before long")
    numbered = dealt.join(F.broadcast(before), part)
    return numbered.withColumn(name, F.col("_before") + F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))).drop(place, part, "_before")
