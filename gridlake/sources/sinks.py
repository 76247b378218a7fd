"""Result writers: flat and delta rows in buckets of events, per-case tables, nested cases and convergence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

BUCKET = 256
#: Buckets that a task writes at once; only if it meets more are its rows sorted by bucket, which takes them all to disk.
_OPEN, _WRITERS = 4, "spark.sql.maxConcurrentOutputFileWriters"
_PLACES = ((4, r"(base_|cont_)?(p|q|mva|rate)"), (2, r"(base_|cont_)?loading"), (6, r"v_(from|to)_(pu|base|cont)|ang_(from|to)_(deg|base|cont)|d_angle_(base|cont)"))


def rounded(rows: DataFrame) -> DataFrame:
    """Power to 4 places, loading to 2, voltages and angles to 6; those of delta rows too."""
    return rows.withColumns({c: F.round(c, places) for c in rows.columns for places, names in _PLACES if re.fullmatch(names, c)})


def _write(rows: DataFrame, path: str, fmt: str) -> None:
    bucketed = rounded(rows).withColumn("event_bucket", F.floor(F.col("event_idx") / BUCKET).cast("int"))
    writer = bucketed.write.partitionBy("event_bucket").mode("overwrite")
    conf = rows.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, _OPEN)
    try:
        (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)
    finally:
        conf.set(_WRITERS, before)


def write_flat(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One row per event and circuit, in folders of BUCKET events, so that a comparison reads only the buckets it needs."""
    _write(rows, path, fmt)


def write_delta(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Event rows beside their base row, bucketed like flat rows."""
    _write(rows, path, fmt)


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """A CSV folder per table (buses, branches, generators, convergence, summary), the contingency column in front if there is one."""
    for name, table in tables.items():
        first = [c for c in ("contingency", "event_idx") if c in table.columns]
        table.select(*first, *[c for c in table.columns if c not in first]).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def nested_case_json(convergence: DataFrame, buses: DataFrame, branches: DataFrame, generators: DataFrame) -> DataFrame:
    """(event_idx, json): one object a scenario with name, type, its flags and solution {convergence, buses, branches, generators}.

    Flags are has_voltage_violation and has_branch_violation, where ``convergence`` has them (as ``scenario_summary`` gives it).
    """

    def gathered(table: DataFrame, name: str) -> DataFrame:
        rest = [c for c in table.columns if c != "event_idx"]
        return table.groupBy("event_idx").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    rows = convergence
    for table, name in ((buses, "buses"), (branches, "branches"), (generators, "generators")):
        rows = rows.join(gathered(table, name), "event_idx", "left")
    solution = F.struct(F.struct("converged", "iterations").alias("convergence"), "buses", "branches", "generators").alias("solution")
    flags = [c for c in ("has_voltage_violation", "has_branch_violation") if c in convergence.columns]
    return rows.select("event_idx", F.to_json(F.struct("event_idx", "name", "type", *flags, solution)).alias("json"))


def write_nested(cases: DataFrame, path: str) -> None:
    cases.select("json").write.mode("overwrite").text(path)


def convergence_rows(convergence: DataFrame) -> DataFrame:
    """Convergence rows in order of event_idx."""
    return convergence.orderBy("event_idx")


def write_convergence(convergence: DataFrame, path: str) -> None:
    convergence_rows(convergence).write.mode("overwrite").csv(path, header=True)
