"""Grid tables as projections of the given star-schema tables, and helpers to query them in Spark and in SQL.

The same text defines a role in Spark (placeholders become DataFrames) and in the SQL check (they become CTE names).
Outage scenarios are the loss of each zone's circuit of the highest rating: an N-1 list that grows with the zones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridlake.operators.electrical import CELL, CO_PARTITIONING, LEAST_BLOCKS, at_least, block_of, pair_cell

#: Lines of a cell of two blocks of buses, for ``circuit_in_cells``.
CELL_LINES = 1_000_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "bus": """SELECT c_custkey AS bus_id, c_name AS name,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 13.8e0 WHEN 'BUILDING' THEN 69e0 WHEN 'FURNITURE' THEN 138e0 WHEN 'HOUSEHOLD' THEN 230e0 ELSE 500e0 END AS base_kv,
        CAST(CASE WHEN c_custkey % 211 = 0 THEN 4 WHEN c_custkey = 1 THEN 3 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS type,
        n_regionkey AS area, c_nationkey AS zone, CAST(c_custkey % 7 AS INT) AS owner,
        9e-1 + 2e-1 * (c_acctbal + 1000) / 11000 AS v_pu, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS angle_deg
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    "area": "SELECT r_regionkey AS number, r_name AS name FROM {region}",
    "zone": "SELECT n_nationkey AS number, n_name AS name FROM {nation} WHERE n_nationkey <> 7",
    "owner": "SELECT DISTINCT CAST(c_custkey % 7 AS INT) AS number, concat('''OWNER ', CAST(c_custkey % 7 AS VARCHAR(9)), '''') AS name FROM {customer}",
    "circuit": """SELECT from_bus, to_bus, ckt, r, x, b, rate_a, 11e-1 * rate_a AS rate_b, CASE WHEN ckt = '3' THEN 0e0 ELSE 12e-1 * rate_a END AS rate_c, status,
        CASE WHEN ckt = '2' THEN 95e-2 + 1e-2 * ((from_bus + to_bus) % 11) ELSE 0e0 END AS tap,
        CASE WHEN ckt = '2' THEN 5e0 * ((from_bus + to_bus) % 3) ELSE 0e0 END AS shift_deg, ckt = '2' AND from_bus % 2 = 0 AS switched
        FROM (SELECT o_custkey AS from_bus, l_partkey % (SELECT count(*) FROM {customer}) AS to_bus, CAST(l_linenumber AS VARCHAR(9)) AS ckt,
          1e-3 + min(l_tax) / 10 AS r, 1e-2 + min(l_discount) AS x, 2e-2 * min(l_quantity) / 50 AS b, round(avg(p_retailprice) / 20, 6) AS rate_a,
          CAST(CASE WHEN min(l_returnflag) = 'R' AND max(l_linestatus) = 'F' THEN 0 ELSE 1 END AS INT) AS status
          FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey
          GROUP BY o_custkey, l_partkey % (SELECT count(*) FROM {customer}), l_linenumber) AS grouped WHERE from_bus <> to_bus""",
    "generator": """SELECT bus_id, gen_id, pg, 13e-1 * pg AS pmax, 2e-1 * pg AS pmin, 5e-1 * pg AS qmax, -3e-1 * pg AS qmin, 5e-2 * pg AS qg, status FROM (
        SELECT o_custkey AS bus_id, CAST(o_orderkey % 9 AS VARCHAR(9)) AS gen_id, round(sum(o_totalprice) / 5000, 6) AS pg,
        CAST(CASE WHEN min(o_orderstatus) = 'F' THEN 0 ELSE 1 END AS INT) AS status FROM {orders} GROUP BY o_custkey, o_orderkey % 9) AS grouped""",
    "load": """SELECT bus_id, load_id, pl, 3e-1 * pl AS ql, 1e-2 * pl AS ip, 2e-2 * pl AS iq, 3e-2 * pl AS yp, 4e-2 * pl AS yq, status FROM (
        SELECT o_custkey AS bus_id, CAST(l_suppkey % 3 AS VARCHAR(9)) AS load_id, round(sum(l_extendedprice) / 10000, 6) AS pl,
        CAST(CASE WHEN max(l_linestatus) = 'F' THEN 0 ELSE 1 END AS INT) AS status
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey % 3) AS grouped""",
    "shunt": "SELECT bus_id, gen_id AS shunt_id, status, 1e-3 * pg AS gl, 2e-3 * pg AS bl FROM {generator} WHERE bus_id % 3 = 0",
    "switched_shunt": "SELECT bus_id, CAST(CASE WHEN bus_id % 4 = 0 THEN 0 ELSE 1 END AS INT) AS status, CAST(bus_id % 10 AS DOUBLE) AS binit FROM {bus} WHERE bus_id % 6 = 0",
    "scenario": """SELECT CAST(zone + 1 AS INT) AS event_idx, from_bus, to_bus, ckt FROM (
        SELECT zone, from_bus, to_bus, ckt, row_number() OVER (PARTITION BY zone ORDER BY rate_a DESC, from_bus, to_bus, ckt) AS place
        FROM {circuit} JOIN {bus} ON bus_id = from_bus WHERE status = 1) AS ranked WHERE place = 1""",
    "voltage": """SELECT event_idx, bus_id, v_pu + 1e-2 * ((bus_id * 31 + event_idx * 17) % 11 - 5) AS v_pu,
        angle_deg + 1e0 * ((bus_id * 13 + event_idx * 7) % 9 - 4) AS angle_deg FROM {bus} CROSS JOIN (
        SELECT event_idx FROM {scenario} UNION ALL SELECT CAST(0 AS INT)) AS events""",
    "flat_a": """SELECT CAST(l_orderkey % 50 AS INT) AS event_idx, o_custkey AS from_bus, l_partkey AS to_bus, CAST(l_linenumber AS VARCHAR(9)) AS ckt,
        round(sum(l_extendedprice) / 1000, 6) AS p, sum(l_quantity) AS q, CAST(l_orderkey % 360 AS DOUBLE) AS angle FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
        GROUP BY l_orderkey, o_custkey, l_partkey, l_linenumber""",
    "flat_b": """SELECT CAST(l_orderkey % 50 AS INT) AS event_idx, o_custkey AS from_bus, l_partkey AS to_bus, CAST(l_linenumber AS VARCHAR(9)) AS ckt,
        round(sum(l_extendedprice) / 1000 * CASE WHEN l_linenumber = 2 THEN 10001e-4 ELSE 1e0 END, 6) AS p, sum(l_quantity) AS q, CAST((l_orderkey + 359) % 360 AS DOUBLE) AS angle
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_suppkey % 10 <> 0 GROUP BY l_orderkey, o_custkey, l_partkey, l_linenumber""",
    "convergence_a": """SELECT o_orderkey AS event_idx, concat('C', CAST(o_orderkey AS VARCHAR(20))) AS name, CASE WHEN o_custkey % 3 = 0 THEN 'Generator' ELSE 'Line' END AS type,
        o_orderstatus <> 'P' AS converged, CAST(o_orderkey % 12 AS INT) AS iterations, o_totalprice / 1e6 AS final_tolerance,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'DIVERGED' WHEN '2-HIGH' THEN 'ISLANDED' ELSE 'OK' END AS status_code FROM {orders}""",
    "convergence_b": """SELECT event_idx, name, type, CASE WHEN event_idx % 17 = 0 THEN NOT converged ELSE converged END AS converged, CAST(iterations + event_idx % 3 AS INT) AS iterations,
        final_tolerance * 11e-1 AS final_tolerance, CASE WHEN event_idx % 17 = 0 THEN 'NO_SLACK' ELSE status_code END AS status_code FROM {convergence_a} WHERE event_idx % 23 <> 0""",
    "series": """SELECT user_id AS machine, CAST(event_id AS DOUBLE) / 10 AS t, 57e0 + 6e0 * (value - floor(value)) AS value, CAST(event_id % 20 AS INT) AS scenario_idx, CAST(floor(event_id / 1000) AS INT) AS step
        FROM {events} WHERE value IS NOT NULL""",
    "measurement": """SELECT event_id AS idx, CAST(event_id % 8 AS INT) AS case_id, user_id % (SELECT count(*) FROM {customer}) AS bus_id,
        CASE event_type WHEN 'view' THEN 'VM' WHEN 'signup' THEN 'VA' WHEN 'click' THEN 'PI' WHEN 'purchase' THEN 'QI' ELSE 'VM' END AS type,
        value / 100 AS value, 1e-2 + 1e-3 * (event_id % 10) AS deviation FROM {events} WHERE value IS NOT NULL""",
    "coo": "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS re, sum(l_discount) AS im FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    "stat": """SELECT concat(CAST(l_suppkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(9))) AS row_key, CAST(l_orderkey % 12 AS INT) AS scenario_idx, sum(l_quantity) AS value,
        CAST(min(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END) AS INT) AS mask, -1e2 * l_linenumber AS min_bound, 1e2 * l_linenumber AS max_bound
        FROM {lineitem} GROUP BY l_suppkey, l_linenumber, l_orderkey % 12""",
}


def frame(spark: SparkSession, sf_dir: str, name: str, fixed: dict[str, DataFrame] | None = None) -> DataFrame:
    """A role, or a given table, as a DataFrame. Roles in ``fixed`` are taken from there, for other roles too."""
    if fixed and name in fixed:
        return fixed[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "scenario" and fixed and "circuit" in fixed:
        return _scenario(fixed["circuit"], frame(spark, sf_dir, "bus", fixed))
    used = sorted(set(re.findall(r"\{(\w+)\}", SQL[name])))
    return spark.sql(SQL[name].replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), **{n: frame(spark, sf_dir, n, fixed) for n in used})


def _scenario(circuit: DataFrame, bus: DataFrame) -> DataFrame:
    """The role ``scenario`` from a written table of circuits: its SQL sorts all circuits in as many tasks as there are zones, here those whose
    rate is the highest of a zone are the only ones to be compared."""
    rate = F.coalesce("rate_a", F.lit(float("-inf"))).alias("rate_a")
    on = circuit.where("status = 1").select("from_bus", "to_bus", "ckt", rate)
    zone = bus.select(F.col("bus_id").alias("from_bus"), "zone")
    most = on.groupBy("from_bus").agg(F.max("rate_a").alias("rate_a")).join(zone, "from_bus").groupBy("zone").agg(F.max("rate_a").alias("rate_a"))
    few = on.join(F.broadcast(most.select("rate_a").distinct()), "rate_a", "left_semi").join(zone, "from_bus").join(F.broadcast(most), ["zone", "rate_a"])
    place = F.row_number().over(Window.partitionBy("zone").orderBy("from_bus", "to_bus", "ckt"))
    return few.withColumn("place", place).where("place = 1").select((F.col("zone") + 1).cast("int").alias("event_idx"), "from_bus", "to_bus", "ckt")


def circuit_in_cells(spark: SparkSession, sf_dir: str, blocks: int | None = None) -> DataFrame:
    """The role ``circuit`` with CELL: lines are dealt once, by the blocks of their two buses, and find their parts and are grouped there.

    Parts go to all cells of their bus's block, so lines needn't be shuffled by part too. Flags are compared before lines are shuffled: 0, 1 and 2 are
    below, equal and above. Without ``blocks``, so many that a cell has CELL_LINES. Joins keep the partitioning by cells as in ``electrical._in_blocks``."""
    spark.conf.set(CO_PARTITIONING, "false")
    lineitem, orders, part, customer = (frame(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer"))
    buses, n = customer.count(), blocks or max(LEAST_BLOCKS, math.ceil(math.sqrt(2 * lineitem.count() / CELL_LINES)))
    tasks = at_least(lineitem, 3 * n * (n + 1) // 2)  # few cells share one
    beside = lambda c, v: F.when(F.col(c) < v, 0).when(F.col(c) == v, 1).when(F.col(c) > v, 2)
    to_bus: Callable[[str], Column] = lambda c: F.col(c) % F.lit(buses or None).cast("long")
    block: Callable[[Column], Column] = lambda bus: block_of(bus.cast("long"), n)
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_discount", "l_quantity", beside("l_returnflag", "R").alias("flag"), beside("l_linestatus", "F").alias("line"))
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("from_bus")), "l_orderkey").drop("l_orderkey").where(F.col("from_bus") != to_bus("l_partkey"))
    dealt = lines.withColumn(CELL, pair_cell(block(F.col("from_bus")), block(to_bus("l_partkey")), n)).repartition(tasks, CELL)
    keys = part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice").where("l_partkey IS NOT NULL").repartition(tasks, "l_partkey")  # else the few that read them spill
    keys = keys.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = keys.withColumn(CELL, pair_cell(block(to_bus("l_partkey")), F.col("_other"), n)).drop("_other").repartition(tasks, CELL)
    met = dealt.join(keys.hint("shuffle_hash"), [CELL, "l_partkey"]).withColumn("to_bus", to_bus("l_partkey"))
    grouped = met.groupBy(CELL, "from_bus", "to_bus", "l_linenumber").agg(
        (1e-3 + F.min("l_tax") / 10).alias("r"),
        (1e-2 + F.min("l_discount")).alias("x"),
        (2e-2 * F.min("l_quantity") / 50).alias("b"),
        F.round(F.avg("p_retailprice") / 20, 6).alias("rate_a"),
        F.when((F.min("flag") == 1) & (F.max("line") == 1), 0).otherwise(1).alias("status"),
    )
    grouped = grouped.withColumn("ckt", F.col("l_linenumber").cast("string"))
    return spark.sql(f"{SQL['circuit'].partition('FROM (')[0]}, {CELL} FROM {{grouped}}", grouped=grouped)


def check_sql(body: str) -> str:
    """SQL of a query whose body names roles and tables in braces. A body may open with CTEs of its own."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n not in TABLES and n not in order:
                visit(SQL[n])
                order.append(n)

    visit(body)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    heads = [f"{n} AS ({plain(SQL[n])})" for n in order]
    body = plain(body.strip())
    if not re.match(r"SELECT\b", body):
        return "WITH RECURSIVE " + ", ".join([*heads, body])
    return (f"WITH {', '.join(heads)} " if heads else "") + body
