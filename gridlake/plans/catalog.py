"""Registered queries of the grid operators over the role tables, each with the SQL that must give the same rows.

Doubles are rounded to six places on both sides, as sums are added up in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridlake.functions import exprs as x
from gridlake.functions.durable import durable, shared_folder
from gridlake.operators import compare, coo, digests, electrical, keyed, limits, measure, outages, scenarios, series, stats, summaries, topology
from gridlake.plans import roles
from gridlake.sources import archives, lists, nested, ranges, sinks
from gridlake.streaming import streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Rows that a task holds of tables that are dealt.
DEALT_ROWS = 250_000
#: Bytes of a nested case that is given in one piece.
CASE_BYTES = 16_000_000
#: Parts in which measurements, contingencies and faults are listed.
LISTS = 64


class Roles:
    """Role tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.fixed = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return roles.frame(self.spark, self.sf_dir, name, self.fixed)

    def fix(self, *names: str) -> Roles:
        """Writes these roles, which the query or other roles read several times, so that they are worked out once."""
        for name in names:
            if name not in self.fixed:
                self.fixed[name] = durable(getattr(self, name))
        return self

    def parts(self, rows: int) -> int:
        """So many partitions that each has at most some DEALT_ROWS of these rows: a task's memory doesn't grow with the table."""
        return max(-(-rows // DEALT_ROWS), int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def deal(self, **by: tuple[str, ...]) -> Roles:
        """Deals given tables by these columns before anything is joined or grouped by them, by the rows of lineitem, which files tell without being read."""
        for name, columns in by.items():
            if name not in self.fixed:
                self.fixed[name] = getattr(self, name).repartition(self.lines, *columns)
        return self

    @property
    def lines(self) -> int:
        return self.parts(roles.frame(self.spark, self.sf_dir, "lineitem").count())

    def slim(self, name: str, *columns: str) -> Roles:
        """Writes these columns of a role, which are all that the query reads of it."""
        if name not in self.fixed:
            self.fixed[name] = durable(getattr(self, name).select(*columns))
        return self


def _register(name: str, build: Callable[[Roles], DataFrame], sql: str | None, doubles: str = "") -> None:
    exact = doubles.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(Roles(spark, sf_dir))
        return out.withColumns({c: x.rounded6(F.col(c)) for c in exact}) if exact else out

    _QUERIES[name] = run
    if sql is not None:
        if exact:
            body = sql.strip()
            head, _, last = ("", "", body) if body.startswith("SELECT") else body.rpartition("\nFINALLY ")
            sql = (head + "\n" if head else "") + f"SELECT * REPLACE ({', '.join(f'round("{c}", 6) + 0e0 AS "{c}"' for c in exact)}) FROM ({last}) AS found"
        _SQL[name] = roles.check_sql(sql.replace("\nFINALLY ", "\n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- pieces shared by several queries -------------------------------------------------------------------------------

_FLOW = """flow AS MATERIALIZED (SELECT event_idx, from_bus, to_bus, ckt, status, rate_a, rate_b, rate_c, vf, vt, af, ad, CASE WHEN status = 1 THEN 1e2 * vf * (vf * gff + vt * (gft * cos(d) + bft * sin(d))) ELSE 0e0 END AS p_from,
 CASE WHEN status = 1 THEN 1e2 * vf * (-vf * bff + vt * (gft * sin(d) - bft * cos(d))) ELSE 0e0 END AS q_from,
 CASE WHEN status = 1 THEN 1e2 * vt * (vt * gtt + vf * (gtf * cos(d) - btf * sin(d))) ELSE 0e0 END AS p_to,
 CASE WHEN status = 1 THEN 1e2 * vt * (-vt * btt + vf * (-gtf * sin(d) - btf * cos(d))) ELSE 0e0 END AS q_to FROM (
 SELECT v.event_idx, e.*, v.v_pu AS vf, w.v_pu AS vt, v.angle_deg AS af, w.angle_deg AS ad, radians(v.angle_deg) - radians(w.angle_deg) AS d
 FROM elements e JOIN {voltage} v ON v.bus_id = e.from_bus JOIN {voltage} w ON w.bus_id = e.to_bus AND w.event_idx = v.event_idx) AS j)"""
_ELEMENTS = """elements AS MATERIALIZED (SELECT *, g / (t * t) AS gff, (h + b / 2) / (t * t) AS bff, g AS gtt, h + b / 2 AS btt,
 -(g * cos(s) - h * sin(s)) / t AS gft, -(h * cos(s) + g * sin(s)) / t AS bft, -(g * cos(s) + h * sin(s)) / t AS gtf, -(h * cos(s) - g * sin(s)) / t AS btf FROM (
 SELECT from_bus, to_bus, ckt, status, rate_a, rate_b, rate_c, CASE WHEN status = 1 THEN b ELSE 0e0 END AS b, CASE WHEN status = 1 THEN r / (r * r + x * x) ELSE 0e0 END AS g,
 CASE WHEN status = 1 THEN -x / (r * r + x * x) ELSE 0e0 END AS h, CASE WHEN tap <> 0 THEN tap ELSE 1e0 END AS t,
 CASE WHEN tap = 0 THEN 0e0 WHEN switched THEN -radians(shift_deg) ELSE radians(shift_deg) END AS s FROM {circuit}) AS y)"""
_FLAT = f"""{_ELEMENTS}, {_FLOW}, flat AS MATERIALIZED (SELECT event_idx, CASE WHEN event_idx = 0 THEN 'base_case' ELSE contingency END AS contingency, from_bus, to_bus, ckt, p, q, mva, rate, CASE WHEN rate > 0 THEN 100 * mva / rate ELSE 0e0 END AS loading,
 CAST(CASE WHEN rate > 0 AND mva > rate THEN 1 ELSE 0 END AS INT) AS viol, vf AS v_from_pu, vt AS v_to_pu, af AS ang_from_deg, ad AS ang_to_deg FROM (SELECT *, p_from AS p, q_from AS q, sqrt(p_from * p_from + q_from * q_from) AS mva,
 CASE WHEN event_idx = 0 THEN rate_a WHEN rate_c > 0 THEN rate_c WHEN rate_b > 0 THEN rate_b ELSE rate_a END AS rate FROM flow) AS m LEFT JOIN (SELECT event_idx AS ev, concat('BR_', from_bus, '_', to_bus, '_', ckt) AS contingency FROM {{scenario}}) AS nm ON ev = event_idx)"""
_STATE = "p q mva rate loading v_from_pu v_to_pu ang_from_deg ang_to_deg"


def _flow(r: Roles, some: Callable[[DataFrame], DataFrame] | None = None, cells: bool = False) -> DataFrame:
    """Flows of all circuits, or of those that ``some`` keeps (and adds columns to): what a circuit alone decides is settled before events multiply it."""
    r.fix("circuit", "scenario", "voltage")
    return electrical.line_flow(some(r.circuit) if some else r.circuit, r.voltage, cells=cells)


def _flat(r: Roles, some: Callable[[DataFrame], DataFrame] | None = None, cells: bool = False) -> DataFrame:
    flow = _flow(r, some, cells)
    names = F.broadcast(keyed.scenario_name(_outages(r)).withColumnRenamed("scenario", "contingency"))
    return limits.flat_rows(flow, "C", names, [c for c in (electrical.CELL,) if c in flow.columns])


def _outages(r: Roles) -> DataFrame:
    """The scenarios as one-element outages."""
    none = [F.lit(None).cast("long").alias("bus_id"), F.lit(None).cast("string").alias("gen_id")]
    return r.scenario.select("event_idx", F.lit("Line").alias("type"), F.lit(0).alias("pos"), "from_bus", "to_bus", "ckt", *none)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["worst_circuits"](spark, sf_dir)


_register("flat_rows", _flat, f"{_FLAT}\nFINALLY SELECT * FROM flat", _STATE)
_register(
    "worst_circuits",
    lambda r: limits.worst(_flat(r, lambda circuit: limits.area_kv_filter(circuit, r.fix("bus").bus, [1, 2], 69.0, 230.0)).select("event_idx", "from_bus", "to_bus", "ckt", "loading", "viol"), ["event_idx"], 10).select("event_idx", "from_bus", "to_bus", "ckt", "loading", "viol", "rank"),
    f"""{_FLAT}
FINALLY SELECT event_idx, from_bus, to_bus, ckt, loading, viol, rank FROM (SELECT f.*, CAST(row_number() OVER (PARTITION BY event_idx ORDER BY round(loading, 6) DESC, from_bus, to_bus, ckt) AS INT) AS rank
 FROM flat f JOIN {{bus}} a ON a.bus_id = from_bus JOIN {{bus}} b ON b.bus_id = to_bus WHERE (a.area IN (1, 2) OR b.area IN (1, 2)) AND greatest(a.base_kv, b.base_kv) BETWEEN 69 AND 230) AS ranked WHERE rank <= 10""",
    "loading",
)

# --- scalar functions -----------------------------------------------------------------------------------------------

_register(
    "canonical_tag",
    lambda r: r.lineitem.select(F.concat(F.lit(" '"), F.col("l_linenumber").cast("string"), F.lit(" "), "l_returnflag", F.lit("' ")).alias("raw")).distinct().select("raw", x.canonical_tag(F.col("raw")).alias("tag"), x.padded_tag(F.col("raw")).alias("padded")),
    "SELECT DISTINCT ' ''' || l_linenumber || ' ' || l_returnflag || ''' ' AS raw, CAST(l_linenumber AS VARCHAR) AS tag, rpad(CAST(l_linenumber AS VARCHAR), 2, ' ') AS padded FROM {lineitem}",
)
_register(
    "csv_field",
    lambda r: r.part.select("p_partkey", x.csv_field(F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(', "x"'))).otherwise(F.col("p_name"))).alias("field")),
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('"', p_name, ', ""x""', '"') ELSE p_name END AS field FROM {part}""",
)
_register("scenario_name", lambda r: scenarios.n1_branches(r.circuit).select("from_bus", "to_bus", "ckt", "scenario"), "SELECT from_bus, to_bus, ckt, 'BR_' || from_bus || '_' || to_bus || '_' || ckt AS scenario FROM {circuit}")


def _elements(r: Roles, fix: bool = False) -> DataFrame:
    """Three-element scenarios: runs of circuits of one from bus. ``fix`` writes them, for queries that read them several times."""
    if fix:
        if "elements" not in r.fixed:
            r.fixed["elements"] = durable(_elements(r))
        return r.fixed["elements"]
    n = F.row_number().over(Window.partitionBy("from_bus").orderBy("to_bus", "ckt")) - 1
    c = r.circuit.select("from_bus", "to_bus", "ckt").withColumn("n", n)
    return c.select((F.col("from_bus") * 1000 + F.floor(F.col("n") / 3)).cast("long").alias("event_idx"), F.lit("Line").alias("type"), (F.col("n") % 3).alias("pos"), "from_bus", "to_bus", "ckt", F.lit(None).cast("long").alias("bus_id"), F.lit(None).cast("string").alias("gen_id"))


_ELEMENT_SQL = "el AS (SELECT from_bus * 1000 + n // 3 AS event_idx, n % 3 AS pos, from_bus, to_bus, ckt FROM (SELECT from_bus, to_bus, ckt, row_number() OVER (PARTITION BY from_bus ORDER BY to_bus, ckt) - 1 AS n FROM {circuit}) AS q)"
_register(
    "facility_label",
    lambda r: keyed.facility_label(_elements(r), r.bus),
    f"{_ELEMENT_SQL}\nFINALLY SELECT event_idx, max(CASE WHEN pos = 0 THEN '[' || area || '] ' || from_bus || ' ' || to_bus || ' ' || ckt END) || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ' more)' ELSE '' END AS label FROM el JOIN {{bus}} ON bus_id = from_bus GROUP BY event_idx",
)
_register("circular_diff", lambda r: r.bus.select("bus_id", x.circular_diff(F.col("angle_deg"), F.col("angle_deg") * -1.5).alias("d")), "SELECT bus_id, (25e-1 * angle_deg + 180) - 360 * floor((25e-1 * angle_deg + 180) / 360) - 180 AS d FROM {bus}", "d")
_register(
    "select_rating",
    lambda r: r.circuit.select("from_bus", "to_bus", "ckt", *[x.select_rating(w, F.col("rate_a"), F.col("rate_b"), F.col("rate_c")).alias(f"rate_{w.lower()}") for w in "ABC"]),
    "SELECT from_bus, to_bus, ckt, rate_a, CASE WHEN rate_b > 0 THEN rate_b ELSE rate_a END AS rate_b, CASE WHEN rate_c > 0 THEN rate_c WHEN rate_b > 0 THEN rate_b ELSE rate_a END AS rate_c FROM {circuit}",
    "rate_a rate_b rate_c",
)


def _complex(r: Roles) -> DataFrame:
    a, b = x.named(""), None
    c = r.coo.select("i", "j", F.col("re").alias("a_re"), F.col("im").alias("a_im"))
    a, b = x.named("a"), x.Complex(F.col("a_im") + 1, F.col("a_re"))
    return c.select("i", "j", *[z.alias(n) for p, v in (("m", a.times(b)), ("q", a.over(b)), ("c", a.conj())) for n, z in x.columns(p, v).items()], a.abs().alias("size"))


_register(
    "complex_functions",
    _complex,
    "SELECT i, j, re * (im + 1) - im * re AS m_re, re * re + im * (im + 1) AS m_im, (re * (im + 1) + im * re) / ((im + 1) * (im + 1) + re * re) AS q_re, (im * (im + 1) - re * re) / ((im + 1) * (im + 1) + re * re) AS q_im, re AS c_re, -im AS c_im, sqrt(re * re + im * im) AS size FROM {coo}",
    "m_re m_im q_re q_im c_re c_im size",
)


def _vector(r: Roles) -> DataFrame:
    return r.coo.groupBy("i").agg((F.sum("re") / 1000).alias("re"), (F.sum("im") / 100).alias("im"))


_VEC = "vec AS (SELECT i, sum(re) / 1000 AS re, sum(im) / 100 AS im FROM {coo} GROUP BY i)"
_register("element_exp", lambda r: coo.element_map(_vector(r), "exp"), f"{_VEC}\nFINALLY SELECT i, exp(re) * cos(im) AS re, exp(re) * sin(im) AS im FROM vec", "re im")
_register("element_abs", lambda r: coo.element_map(_vector(r), "abs"), f"{_VEC}\nFINALLY SELECT i, sqrt(re * re + im * im) AS re, 0e0 AS im FROM vec", "re im")
_register("element_reciprocal", lambda r: coo.element_map(_vector(r), "reciprocal"), f"{_VEC}\nFINALLY SELECT i, re / (re * re + im * im) AS re, -im / (re * re + im * im) AS im FROM vec", "re im")
_register("element_conj", lambda r: coo.element_map(_vector(r), "conj"), f"{_VEC}\nFINALLY SELECT i, re, -im AS im FROM vec", "re im")

# --- keyed attachment -----------------------------------------------------------------------------------------------

_register("attach_to_bus", lambda r: keyed.attach_to_bus(r.events.select("event_id", F.col("user_id").alias("bus_id"), "value"), r.bus).select("event_id", "bus_id", "value", "name", "area"), "SELECT event_id, bus_id, value, name, area FROM {events} JOIN {bus} ON bus_id = user_id")


def _pairs(r: Roles) -> DataFrame:
    return r.lineitem.join(r.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("from_bus"), (F.col("o_custkey") % 200).alias("to_bus")).agg(F.sum("l_quantity").alias("value"))


_register(
    "attach_to_branch",
    lambda r: keyed.attach_to_branch(_pairs(r), r.circuit.groupBy("from_bus", "to_bus").agg(F.min("rate_a").alias("rate_a"))),
    """val AS (SELECT l_suppkey AS f, o_custkey % 200 AS t, sum(l_quantity) AS value FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY 1, 2), br AS (SELECT from_bus, to_bus, min(rate_a) AS rate_a FROM {circuit} GROUP BY 1, 2),
direct AS (SELECT from_bus, to_bus, value, rate_a, FALSE AS swapped FROM val JOIN br ON f = from_bus AND t = to_bus)
FINALLY SELECT * FROM direct UNION ALL SELECT from_bus, to_bus, value, rate_a, TRUE FROM val JOIN br ON t = from_bus AND f = to_bus WHERE NOT EXISTS (SELECT 1 FROM br x WHERE x.from_bus = f AND x.to_bus = t)""",
    "value rate_a",
)
_register("dense_index", lambda r: keyed.dense_index(r.fix("circuit").circuit.select("from_bus", "to_bus", "ckt", (F.col("from_bus") * 1_000_003 + F.col("to_bus") * 7).alias("key")), "key"), "SELECT from_bus, to_bus, ckt, from_bus * 1000003 + to_bus * 7 AS key, dense_rank() OVER (ORDER BY from_bus * 1000003 + to_bus * 7) - 1 AS dense FROM {circuit}")
_register(
    "neighbors",
    lambda r: keyed.neighbors(r.circuit).withColumn("buses", F.array_join(F.col("buses").cast("array<string>"), ",")),
    "ends AS (SELECT from_bus AS bus_id, to_bus AS other FROM {circuit} UNION ALL SELECT to_bus, from_bus FROM {circuit}), one AS (SELECT DISTINCT * FROM ends)\nFINALLY SELECT n.bus_id, n.circuits, b.buses FROM (SELECT bus_id, count(*) AS circuits FROM ends GROUP BY bus_id) AS n JOIN (SELECT bus_id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS buses FROM one GROUP BY bus_id) AS b ON b.bus_id = n.bus_id",
)
_register(
    "apply_overrides",
    lambda r: keyed.apply_overrides(r.generator.select("bus_id", "gen_id", "pg", "status"), r.orders.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("bus_id"), (F.col("o_orderkey") % 9).cast("string").alias("gen_id"), F.col("o_totalprice").alias("pg"), F.col("o_orderkey").alias("seq")), ["bus_id", "gen_id"]),
    """SELECT g.bus_id, g.gen_id, coalesce(o.pg, g.pg) AS pg, g.status FROM {generator} g LEFT JOIN (SELECT o_custkey AS bus_id, CAST(o_orderkey % 9 AS VARCHAR) AS gen_id, arg_max(o_totalprice, o_orderkey) AS pg FROM {orders} WHERE o_orderkey % 5 = 0 GROUP BY 1, 2) AS o
 ON o.bus_id = g.bus_id AND o.gen_id = g.gen_id""",
    "pg",
)
_SETPOINTS = "SELECT o_custkey AS bus_id, CAST(o_orderkey % 9 AS VARCHAR) AS gen_id, CAST(o_orderkey % 4 AS INT) AS scenario_idx, sum(CASE WHEN o_orderstatus = 'F' THEN 0e0 ELSE o_totalprice END) / 1000 AS value FROM {orders} GROUP BY 1, 2, 3"
_register(
    "apply_setpoints",
    lambda r: keyed.apply_setpoints(
        r.generator.select("bus_id", "gen_id", "pg", "status"),
        r.orders.groupBy(F.col("o_custkey").alias("bus_id"), (F.col("o_orderkey") % 9).cast("string").alias("gen_id"), (F.col("o_orderkey") % 4).cast("int").alias("scenario_idx")).agg((F.sum(F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice"))) / 1000).alias("value")),
    ),
    f"SELECT g.bus_id, g.gen_id, s.scenario_idx, s.value AS pg, CAST(CASE WHEN s.value = 0 THEN 0 ELSE 1 END AS INT) AS status FROM {{generator}} g JOIN ({_SETPOINTS}) AS s ON s.bus_id = g.bus_id AND s.gen_id = g.gen_id",
    "pg",
)
_register(
    "apply_scenarios",
    lambda r: keyed.apply_scenarios(r.fix("circuit", "scenario").circuit.select("from_bus", "to_bus", "ckt", "status"), r.scenario).groupBy("event_idx", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("from_bus") * 7 + F.col("to_bus")).alias("mark")),
    "SELECT s.event_idx, CAST(CASE WHEN s.from_bus = c.from_bus AND s.to_bus = c.to_bus AND s.ckt = c.ckt THEN 0 ELSE status END AS INT) AS status, count(*) AS n, CAST(sum(c.from_bus * 7 + c.to_bus) AS BIGINT) AS mark FROM {circuit} c CROSS JOIN {scenario} s GROUP BY 1, 2",
)
_register(
    "elements_not_found",
    lambda r: keyed.elements_not_found(r.circuit, _elements(r).withColumn("to_bus", F.when(F.col("pos") == 2, F.col("to_bus") + 1).otherwise(F.col("to_bus")))).select("event_idx", "from_bus", "to_bus", "ckt"),
    f"{_ELEMENT_SQL}, moved AS (SELECT event_idx, from_bus, CASE WHEN pos = 2 THEN to_bus + 1 ELSE to_bus END AS to_bus, ckt FROM el)\nFINALLY SELECT m.* FROM moved m WHERE NOT EXISTS (SELECT 1 FROM {{circuit}} c WHERE c.from_bus = m.from_bus AND c.to_bus = m.to_bus AND c.ckt = m.ckt)",
)
_register(
    "lookup_names",
    lambda r: keyed.lookup_names(r.bus.select("bus_id", "area", "zone", "owner"), r.area, r.zone, r.owner),
    "SELECT b.bus_id, b.area, b.zone, b.owner, a.name AS area_name, coalesce(z.name, '') AS zone_name, trim(o.name, '''') AS owner_name FROM {bus} b LEFT JOIN {area} a ON a.number = area LEFT JOIN {zone} z ON z.number = zone LEFT JOIN {owner} o ON o.number = owner",
)
_register(
    "first_writer_dedup",
    lambda r: keyed.first_writer_dedup(r.orders.select(F.col("o_custkey").alias("bus_id"), F.col("o_orderkey").alias("part"), "o_orderstatus", "o_totalprice"), "bus_id", "part"),
    "SELECT o_custkey AS bus_id, min(o_orderkey) AS part, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM {orders} GROUP BY 1",
)
_register("indexed_store", lambda r: keyed.indexed_store(r.events.select((F.col("user_id") * 3 % 101).alias("idx"), "value", F.col("event_id").alias("seq"))), "SELECT user_id * 3 % 101 AS idx, arg_max(value, event_id) AS value FROM {events} GROUP BY 1")
_register(
    "merge_partial_records",
    lambda r: keyed.merge_partial_records(
        [r.generator.select("bus_id", F.col("gen_id").alias("tag"), "pg", "qmax"), r.load.select("bus_id", F.col("load_id").alias("tag"), "pl"), r.shunt.select("bus_id", F.col("shunt_id").alias("tag"), F.col("gl").alias("pg"))], ["bus_id", "tag"]
    ),
    "SELECT bus_id, tag, coalesce(max(pg2), max(pg1)) AS pg, max(qmax) AS qmax, max(pl) AS pl FROM (SELECT bus_id, gen_id AS tag, pg AS pg1, NULL AS pg2, qmax, NULL AS pl FROM {generator} UNION ALL SELECT bus_id, load_id, NULL, NULL, NULL, pl FROM {load} UNION ALL SELECT bus_id, shunt_id, NULL, gl, NULL, NULL FROM {shunt}) AS u GROUP BY 1, 2",
    "pg qmax pl",
)

# --- topology -------------------------------------------------------------------------------------------------------

_register("lone_buses", lambda r: topology.lone_buses(r.bus, r.circuit).select("bus_id"), "SELECT bus_id FROM {bus} b WHERE type <> 4 AND NOT EXISTS (SELECT 1 FROM {circuit} c WHERE status = 1 AND (c.from_bus = b.bus_id OR c.to_bus = b.bus_id))")
_ISLANDS = """live AS (SELECT bus_id FROM {bus} WHERE type <> 4), onn AS MATERIALIZED (SELECT DISTINCT from_bus AS u, to_bus AS v FROM {circuit} WHERE status = 1 AND from_bus IN (SELECT bus_id FROM live) AND to_bus IN (SELECT bus_id FROM live)),
e AS MATERIALIZED (SELECT u, v FROM onn UNION SELECT v, u FROM onn), top(bus_id) AS (SELECT min(bus_id) FROM live UNION SELECT e.v FROM top JOIN e ON e.u = top.bus_id), rest AS MATERIALIZED (SELECT bus_id FROM live WHERE bus_id NOT IN (SELECT bus_id FROM top)),
walk(bus_id, seen) AS (SELECT bus_id, bus_id FROM rest UNION SELECT e.v, walk.seen FROM walk JOIN e ON e.u = walk.bus_id),
isl AS (SELECT bus_id, min(seen) AS island FROM walk GROUP BY bus_id UNION ALL SELECT bus_id, (SELECT min(bus_id) FROM live) FROM top), siz AS (SELECT island, count(*) AS n_buses FROM isl GROUP BY island)"""
_register(
    "islands",
    lambda r: topology.islands(r.bus, r.circuit),
    f"{_ISLANDS}\nFINALLY SELECT bus_id, isl.island, n_buses, isl.island = (SELECT island FROM siz ORDER BY n_buses DESC, island LIMIT 1) AS main FROM isl JOIN siz ON siz.island = isl.island",
)
_ENDS = ("from_bus", "to_bus", "ckt", "status")
_register(
    "islands_by_scenario",
    lambda r: outages.scenario_islands(r.slim("circuit", *_ENDS, "rate_a").fix("scenario").bus, r.circuit, r.scenario).select("event_idx", "islands", F.col("main_buses").alias("largest")),
    """live AS (SELECT bus_id FROM {bus} WHERE type <> 4), lo AS (SELECT min(bus_id) AS b FROM live),
onn AS MATERIALIZED (SELECT DISTINCT f.event_idx, c.from_bus AS u, c.to_bus AS v FROM {circuit} c CROSS JOIN {scenario} f WHERE status = 1 AND NOT (c.from_bus = f.from_bus AND c.to_bus = f.to_bus AND c.ckt = f.ckt) AND c.from_bus IN (SELECT bus_id FROM live) AND c.to_bus IN (SELECT bus_id FROM live)),
e AS MATERIALIZED (SELECT event_idx, u, v FROM onn UNION SELECT event_idx, v, u FROM onn), top(event_idx, bus_id) AS (SELECT event_idx, b FROM {scenario} CROSS JOIN lo UNION SELECT e.event_idx, e.v FROM top JOIN e ON e.u = top.bus_id AND e.event_idx = top.event_idx),
rest AS MATERIALIZED (SELECT event_idx, bus_id FROM live CROSS JOIN {scenario} f WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.event_idx = f.event_idx AND top.bus_id = live.bus_id)),
walk(event_idx, bus_id, seen) AS (SELECT event_idx, bus_id, bus_id FROM rest UNION SELECT e.event_idx, e.v, walk.seen FROM walk JOIN e ON e.u = walk.bus_id AND e.event_idx = walk.event_idx),
isl AS (SELECT event_idx, bus_id, min(seen) AS island FROM walk GROUP BY 1, 2 UNION ALL SELECT event_idx, bus_id, (SELECT b FROM lo) FROM top), siz AS (SELECT event_idx, island, count(*) AS n FROM isl GROUP BY 1, 2)
FINALLY SELECT event_idx, count(*) AS islands, max(n) AS largest FROM siz GROUP BY 1""",
)
_register(
    "islands_of_outages",  # every circuit in service as a scenario of its own: too slow in SQL; see tests/test_outages.py
    lambda r: outages.scenario_islands(r.slim("circuit", *_ENDS).bus, r.circuit, r.circuit.where("status = 1").select(F.concat_ws("_", F.lit("BR"), "from_bus", "to_bus", "ckt").alias("event_idx"), "from_bus", "to_bus", "ckt")),
    None,
)
_register("screen_outages", lambda r: topology.screen_outages(r.slim("circuit", *_ENDS).bus, r.circuit), None)  # removal of every circuit in turn is too slow in SQL; see tests/test_topology.py
_DEGREE = "deg AS (SELECT bus_id FROM (SELECT from_bus AS bus_id FROM {circuit} WHERE status = 1 UNION ALL SELECT to_bus FROM {circuit} WHERE status = 1) AS d GROUP BY 1 HAVING count(*) >= 2)"
_register("outage_candidates_by_degree", lambda r: topology.outage_candidates_by_degree(r.circuit).select("from_bus", "to_bus", "ckt"), f"{_DEGREE}\nFINALLY SELECT from_bus, to_bus, ckt FROM {{circuit}} WHERE status = 1 AND from_bus IN (SELECT bus_id FROM deg) AND to_bus IN (SELECT bus_id FROM deg)")
_register("screen_n1", lambda r: scenarios.screen_n1(r.slim("circuit", *_ENDS).circuit, r.bus).select("from_bus", "to_bus", "ckt"), None)
_register(
    "transfer_slack",
    lambda r: topology.transfer_slack(r.bus, r.generator.where("status = 1").withColumn("event_idx", (F.col("bus_id") % 6).cast("int"))),
    "cap AS (SELECT CAST(g.bus_id % 6 AS INT) AS event_idx, g.bus_id, b.type, sum(pmax) AS pmax FROM {generator} g JOIN {bus} b ON b.bus_id = g.bus_id WHERE status = 1 AND type <> 4 GROUP BY 1, 2, 3)\nFINALLY SELECT event_idx, coalesce(min(CASE WHEN type = 3 THEN bus_id END), (SELECT c.bus_id FROM cap c WHERE c.event_idx = cap.event_idx AND c.pmax > 0 ORDER BY round(c.pmax, 6) DESC, c.bus_id LIMIT 1)) AS slack_bus, min(CASE WHEN type = 3 THEN bus_id END) IS NULL AS transferred FROM cap GROUP BY event_idx",
)
_register(
    "tie_lines",
    lambda r: topology.tie_lines(r.circuit, r.bus, 1, 0, 2, 3).select("from_bus", "to_bus", "ckt"),
    "SELECT from_bus, to_bus, ckt FROM {circuit} JOIN {bus} a ON a.bus_id = from_bus JOIN {bus} b ON b.bus_id = to_bus WHERE (a.area = 1 AND b.area = 2 AND b.zone = 3) OR (b.area = 1 AND a.area = 2 AND a.zone = 3)",
)

# --- scenarios ------------------------------------------------------------------------------------------------------

_register("n1_branches", lambda r: scenarios.n1_branches(r.circuit).select("scenario", "type"), "SELECT 'BR_' || from_bus || '_' || to_bus || '_' || ckt AS scenario, 'Line' AS type FROM {circuit}")
_register("n1_generators", lambda r: scenarios.n1_generators(r.generator).select("scenario", "type"), "SELECT 'GN_' || bus_id || '_' || gen_id AS scenario, 'Generator' AS type FROM {generator}")
_register(
    "n1_in_area",
    lambda r: scenarios.n1_in_area(r.circuit, r.generator, r.bus, 1),
    """ins AS (SELECT bus_id FROM {bus} WHERE area = 1)
FINALLY SELECT 'LineCTG' || row_number() OVER (ORDER BY from_bus, to_bus, ckt) AS name, from_bus AS bus1, to_bus AS bus2, ckt AS tag FROM {circuit} WHERE status = 1 AND from_bus IN (SELECT bus_id FROM ins) AND to_bus IN (SELECT bus_id FROM ins)
 UNION ALL SELECT 'GenCTG' || row_number() OVER (ORDER BY bus_id, gen_id), bus_id, NULL, gen_id FROM {generator} WHERE status = 1 AND bus_id IN (SELECT bus_id FROM ins)""",
)


def _singles(r: Roles) -> DataFrame:
    a = r.generator.select((F.col("bus_id") * 20 + F.col("gen_id").cast("int")).alias("idx"), F.lit("Generator").alias("type"))
    return a.union(r.circuit.select((F.col("from_bus") * 1_000_000 + F.col("to_bus") * 10 + F.col("ckt").cast("int")).alias("idx"), F.lit("Line")))


_SINGLES = """si AS (SELECT bus_id * 20 + CAST(gen_id AS INT) AS idx, 'Generator' AS type FROM {generator} UNION ALL SELECT from_bus * 1000000 + to_bus * 10 + CAST(ckt AS INT), 'Line' FROM {circuit}),
g AS MATERIALIZED (SELECT idx FROM si WHERE type = 'Generator' ORDER BY idx LIMIT 200), l AS MATERIALIZED (SELECT idx FROM si WHERE type = 'Line' ORDER BY idx LIMIT 200)"""  # the first pairs need no later ones
_register(
    "n2_pairs",
    lambda r: scenarios.n2_pairs(_singles(r), {"GG": 60, "GL": 40, "LL": 25}),
    f"""{_SINGLES}, gg AS (SELECT 'GG' AS kind, a.idx AS a, b.idx AS b FROM g a JOIN g b ON a.idx < b.idx ORDER BY 2, 3 LIMIT 60), gl AS (SELECT 'GL' AS kind, a.idx AS a, b.idx AS b FROM g a CROSS JOIN l b ORDER BY 2, 3 LIMIT 40), ll AS (SELECT 'LL' AS kind, a.idx AS a, b.idx AS b FROM l a JOIN l b ON a.idx < b.idx ORDER BY 2, 3 LIMIT 25)
FINALLY SELECT * FROM gg UNION ALL SELECT * FROM gl UNION ALL SELECT * FROM ll""",
)
def _with_repeats(r: Roles) -> DataFrame:
    """Each scenario twice more: backwards, and with its first element in every place."""
    el, e = _elements(r, fix=True), F.col("event_idx")
    firsts = el.where("pos = 0").select("event_idx", *[F.col(c).alias(f"_{c}") for c in ("from_bus", "to_bus", "ckt")])
    filled = el.join(firsts, "event_idx").withColumns({c: F.col(f"_{c}") for c in ("from_bus", "to_bus", "ckt")}).select(*el.columns)
    back = el.withColumns({"event_idx": e * 10 + 1, "pos": 5 - F.col("pos")})
    return el.withColumn("event_idx", e * 10).unionByName(back).unionByName(filled.withColumn("event_idx", e * 10 + 2))


# a scenario and its backward copy repeat an existing scenario that is the same; one of n times x repeats any existing one of n elements with x among them
_REPEATS = """sc AS (SELECT event_idx AS e, count(*) AS n, bool_or(from_bus < to_bus) AS old FROM el GROUP BY 1), one AS (SELECT event_idx AS e, from_bus, to_bus, ckt FROM el WHERE pos = 0),
wide AS (SELECT DISTINCT one.e FROM one JOIN sc ON sc.e = one.e JOIN el ON el.from_bus = one.from_bus AND el.to_bus = one.to_bus AND el.ckt = one.ckt JOIN sc q ON q.e = el.event_idx AND q.n = sc.n WHERE q.old)"""


def _old(r: Roles) -> DataFrame:
    """Scenarios with a circuit towards a larger bus."""
    el = _elements(r, fix=True)
    return el.join(el.where("from_bus < to_bus").select("event_idx").distinct(), "event_idx", "left_semi")


_register(
    "dedup_scenarios",
    lambda r: scenarios.dedup_scenarios(_with_repeats(r), _old(r)).select("event_idx").distinct(),
    f"{_ELEMENT_SQL}, {_REPEATS}\nFINALLY SELECT e * 10 + k AS event_idx FROM sc CROSS JOIN range(0, 3) AS g(k) WHERE CASE WHEN k = 2 THEN e NOT IN (SELECT e FROM wide) ELSE NOT old END",
)
_register(
    "combine_scenarios",
    lambda r: scenarios.combine(_old(r), _with_repeats(r))[1],
    f"{_ELEMENT_SQL}, {_REPEATS}\nFINALLY SELECT count(CASE WHEN old THEN 1 END) AS auto, count(CASE WHEN NOT old THEN 1 END) AS added, 2 * count(*) + count(CASE WHEN old THEN 1 END) AS skipped FROM sc",
)  # in the file a backward copy, and one element in all places, come right behind the scenario that they repeat
_register(
    "combined_scenarios",
    lambda r: scenarios.combine(_old(r), _with_repeats(r))[0].select("event_idx", "pos", "from_bus", "to_bus", "ckt"),
    f"""{_ELEMENT_SQL}, {_REPEATS}, al AS (SELECT CASE WHEN old THEN 0 ELSE 1 END AS list, el.* FROM el JOIN sc ON e = event_idx)
FINALLY SELECT dense_rank() OVER (ORDER BY list, event_idx) AS event_idx, pos, from_bus, to_bus, ckt FROM al""",
)
_register("task_grid", lambda r: scenarios.task_grid(r.customer.select(F.col("c_custkey").alias("fault")), r.nation.select(F.col("n_nationkey").alias("config")), 25), "SELECT c_custkey * 25 + n_nationkey AS task, c_custkey AS fault, n_nationkey AS config FROM {customer} CROSS JOIN {nation}")

# --- electrical quantities ------------------------------------------------------------------------------------------

_register("branch_admittance", lambda r: electrical.branch_admittance(r.circuit), f"{_ELEMENTS}\nFINALLY SELECT from_bus, to_bus, sum(gft) AS fwd_re, sum(bft) AS fwd_im, sum(gtf) AS rev_re, sum(btf) AS rev_im FROM elements GROUP BY 1, 2", "fwd_re fwd_im rev_re rev_im")
_SHUNT = """shn AS (SELECT b.bus_id, (coalesce(gl, 0e0)) / 1e2 AS g, (coalesce(bl, 0e0) + coalesce(binit, 0e0)) / 1e2 AS b FROM {bus} b LEFT JOIN (SELECT bus_id, sum(gl) AS gl, sum(bl) AS bl FROM {shunt} WHERE status = 1 GROUP BY 1) AS f ON f.bus_id = b.bus_id
 LEFT JOIN (SELECT bus_id, sum(binit) AS binit FROM {switched_shunt} WHERE status = 1 GROUP BY 1) AS s ON s.bus_id = b.bus_id)"""
_YBUS = f"{_ELEMENTS}, {_SHUNT}, ybus AS (SELECT i, j, sum(re) AS re, sum(im) AS im FROM (SELECT from_bus AS i, from_bus AS j, gff AS re, bff AS im FROM elements UNION ALL SELECT from_bus, to_bus, gft, bft FROM elements UNION ALL SELECT to_bus, from_bus, gtf, btf FROM elements UNION ALL SELECT to_bus, to_bus, gtt, btt FROM elements UNION ALL SELECT bus_id, bus_id, g, b FROM shn) AS u GROUP BY 1, 2)"
_INJECT = f"{_YBUS}, inj AS (SELECT v.event_idx, i AS bus_id, sum(v.v_pu * w.v_pu * (re * cos(radians(v.angle_deg) - radians(w.angle_deg)) + im * sin(radians(v.angle_deg) - radians(w.angle_deg)))) AS p, sum(v.v_pu * w.v_pu * (re * sin(radians(v.angle_deg) - radians(w.angle_deg)) - im * cos(radians(v.angle_deg) - radians(w.angle_deg)))) AS q FROM ybus JOIN {{voltage}} v ON v.bus_id = i JOIN {{voltage}} w ON w.bus_id = j AND w.event_idx = v.event_idx GROUP BY 1, 2)"
_SCHED = "sch AS (SELECT coalesce(g.bus_id, d.bus_id) AS bus_id, (coalesce(pg, 0e0) - coalesce(pl, 0e0)) / 1e2 AS p, (coalesce(qg, 0e0) - coalesce(ql, 0e0)) / 1e2 AS q FROM (SELECT bus_id, sum(pg) AS pg, sum(qg) AS qg FROM {generator} WHERE status = 1 GROUP BY 1) AS g FULL JOIN (SELECT bus_id, sum(pl) AS pl, sum(ql) AS ql FROM {load} WHERE status = 1 GROUP BY 1) AS d ON d.bus_id = g.bus_id)"


def _shunts(r: Roles) -> DataFrame:
    return electrical.bus_shunt(r.bus, r.shunt, r.switched_shunt)


def _injection(r: Roles) -> DataFrame:
    r.fix("circuit", "scenario", "voltage")
    return electrical.bus_injection(electrical.ybus_coo(r.circuit, _shunts(r)), r.voltage)


_register("bus_shunt", _shunts, f"{_SHUNT}\nFINALLY SELECT * FROM shn", "g b")
_register("ybus_coo", lambda r: electrical.ybus_coo(roles.circuit_in_cells(r.spark, r.sf_dir), _shunts(r)), f"{_YBUS}\nFINALLY SELECT * FROM ybus", "re im")
_register("line_flow", lambda r: _flow(r).select("event_idx", "from_bus", "to_bus", "ckt", "p_from", "q_from", "p_to", "q_to"), f"{_ELEMENTS}, {_FLOW}\nFINALLY SELECT event_idx, from_bus, to_bus, ckt, p_from, q_from, p_to, q_to FROM flow", "p_from q_from p_to q_to")
_register("bus_injection", _injection, f"{_INJECT}\nFINALLY SELECT * FROM inj", "p q")
_register("scheduled_injection", lambda r: electrical.scheduled_injection(r.generator, r.load, 1.0), f"{_SCHED}\nFINALLY SELECT bus_id, 1e2 * p AS p, 1e2 * q AS q FROM sch", "p q")
_ZIP = "zl AS (SELECT event_idx, v.bus_id, ip * v_pu + yp * v_pu * v_pu AS p, iq * v_pu - yq * v_pu * v_pu AS q FROM {voltage} v JOIN (SELECT bus_id, sum(ip) AS ip, sum(iq) AS iq, sum(yp) AS yp, sum(yq) AS yq FROM {load} WHERE status = 1 GROUP BY 1) AS s ON s.bus_id = v.bus_id)"
_register("zip_load", lambda r: electrical.zip_load(r.load, r.voltage), f"{_ZIP}\nFINALLY SELECT * FROM zl", "p q")
_OUTPUT = f"{_INJECT}, {_ZIP}, outp AS (SELECT inj.event_idx, inj.bus_id, CASE WHEN type = 3 THEN inj.p * 1e2 + coalesce(pl, 0e0) + coalesce(zl.p, 0e0) ELSE coalesce(pg, 0e0) END AS p FROM inj JOIN {{bus}} b ON b.bus_id = inj.bus_id LEFT JOIN (SELECT bus_id, sum(pg) AS pg FROM {{generator}} WHERE status = 1 GROUP BY 1) AS g ON g.bus_id = inj.bus_id LEFT JOIN (SELECT bus_id, sum(pl) AS pl FROM {{load}} WHERE status = 1 GROUP BY 1) AS d ON d.bus_id = inj.bus_id LEFT JOIN zl ON zl.bus_id = inj.bus_id AND zl.event_idx = inj.event_idx)"


def _output(r: Roles) -> DataFrame:
    return electrical.generator_output(r.bus, r.generator, r.load, _injection(r), r.voltage)


_register("generator_output", _output, f"{_OUTPUT}\nFINALLY SELECT * FROM outp", "p")
_register(
    "bus_result",
    lambda r: electrical.bus_result(r.bus, r.generator, r.load, r.voltage, _shunts(r)),
    f"""{_SHUNT}
FINALLY SELECT event_idx, v.bus_id, z.type, area, zone, base_kv, v.v_pu, v.angle_deg, coalesce(p_gen, 0e0) AS p_gen, coalesce(q_gen, 0e0) AS q_gen, coalesce(p_load, 0e0) AS p_load, coalesce(q_load, 0e0) AS q_load, coalesce(p_gen, 0e0) - coalesce(p_load, 0e0) AS p_net, coalesce(q_gen, 0e0) - coalesce(q_load, 0e0) AS q_net, 1e2 * shn.b * v.v_pu * v.v_pu AS shunt_mvar
 FROM {{voltage}} v JOIN {{bus}} z ON z.bus_id = v.bus_id JOIN shn ON shn.bus_id = v.bus_id LEFT JOIN (SELECT bus_id, sum(pg) AS p_gen, sum(qg) AS q_gen FROM {{generator}} WHERE status = 1 GROUP BY 1) AS g ON g.bus_id = v.bus_id LEFT JOIN (SELECT bus_id, sum(pl) AS p_load, sum(ql) AS q_load FROM {{load}} WHERE status = 1 GROUP BY 1) AS d ON d.bus_id = v.bus_id""",
    "v_pu angle_deg p_gen q_gen p_load q_load p_net q_net shunt_mvar",
)
_register(
    "branch_result",
    lambda r: electrical.branch_result(_flow(r)),
    f"{_ELEMENTS}, {_FLOW}\nFINALLY SELECT event_idx, from_bus, to_bus, ckt, p_from, q_from, p_to, q_to, sqrt(p_from * p_from + q_from * q_from) AS s_from, sqrt(p_to * p_to + q_to * q_to) AS s_to, p_from + p_to AS p_loss, q_from + q_to AS q_loss, rate_a, CASE WHEN rate_a > 0 THEN greatest(sqrt(p_from * p_from + q_from * q_from), sqrt(p_to * p_to + q_to * q_to)) / rate_a * 100 ELSE 0e0 END AS loading FROM flow WHERE status = 1",
    "p_from q_from p_to q_to s_from s_to p_loss q_loss loading",
)
_register("generator_result", lambda r: electrical.generator_result(r.generator.withColumn("vs", 1 + 0.001 * (F.col("bus_id") % 50))), "SELECT bus_id, gen_id, CASE WHEN status = 1 THEN pg ELSE 0e0 END AS p, CASE WHEN status = 1 THEN qg ELSE 0e0 END AS q, qmax, qmin, 1e0 + 1e-3 * (bus_id % 50) AS v_set, status FROM {generator}", "p q qmax qmin v_set")
_register(
    "mismatch_summary",
    lambda r: electrical.mismatch_summary(electrical.scheduled_injection(r.generator, r.load), _injection(r)),
    f"""{_INJECT}, {_SCHED}, mm AS (SELECT event_idx, inj.bus_id, round(abs(inj.p - sch.p), 6) AS dp, round(abs(inj.q - sch.q), 6) AS dq FROM inj JOIN sch ON sch.bus_id = inj.bus_id), mp AS (SELECT *, row_number() OVER (PARTITION BY event_idx ORDER BY dp DESC, bus_id) AS n, row_number() OVER (PARTITION BY event_idx ORDER BY dq DESC, bus_id) AS m FROM mm)
FINALLY SELECT event_idx, max(CASE WHEN n = 1 THEN bus_id END) AS max_p_bus, max(dp) AS max_p, max(CASE WHEN m = 1 THEN bus_id END) AS max_q_bus, max(dq) AS max_q FROM mp GROUP BY event_idx""",
    "max_p max_q",
)
_register(
    "scale_load",
    lambda r: electrical.scale_load(r.load, r.bus, 2, 0, 1.25).select("bus_id", "load_id", "pl", "ql", "ip", "yq"),
    "SELECT l.bus_id, load_id, pl * f AS pl, ql * f AS ql, ip * f AS ip, yq * f AS yq FROM (SELECT *, CASE WHEN status = 1 AND bus_id IN (SELECT bus_id FROM {bus} WHERE area = 2) THEN 125e-2 ELSE 1e0 END AS f FROM {load}) AS l",
    "pl ql ip yq",
)
_register(
    "scale_generation",
    lambda r: electrical.scale_generation(electrical.scale_generation(r.generator, r.bus, 2, 0, 0.4), r.bus, 3, 8, -0.5).select("bus_id", "gen_id", "pg"),
    "SELECT g.bus_id, gen_id, CASE WHEN status = 1 AND area = 2 THEN pg + 4e-1 * (pmax - pg) WHEN status = 1 AND area = 3 AND zone = 8 THEN pg - 5e-1 * (pg - pmin) ELSE pg END AS pg FROM {generator} g LEFT JOIN {bus} b ON b.bus_id = g.bus_id",
    "pg",
)


def _ratings(r: Roles) -> DataFrame:
    g = stats.generator_margins(r.generator, r.bus).where("zone IS NULL").select("area", F.col("pg").alias("gen"), "pmin", "pmax")
    d = stats.area_load(r.load, r.bus).where("zone IS NULL").select("area", F.col("pl").alias("load_total"))
    return electrical.rating_to_scale(g.join(d, "area").withColumn("rating", F.explode(F.array(*[F.lit(v) for v in (0.5, 0.95, 1.0, 1.05, 2.0)])))).select("area", "rating", "load_rating", "scale", "feasible")


_register(
    "rating_to_scale",
    _ratings,
    """g AS (SELECT area, sum(pg) AS gen, sum(pmin) AS pmin, sum(pmax) AS pmax FROM {generator} x JOIN {bus} b ON b.bus_id = x.bus_id WHERE status = 1 GROUP BY 1), d AS (SELECT area, sum(pl) AS t FROM {load} x JOIN {bus} b ON b.bus_id = x.bus_id WHERE status = 1 GROUP BY 1),
k AS (SELECT g.*, t, rating, (rating - 1) * t AS ex FROM g JOIN d ON d.area = g.area CROSS JOIN (VALUES (5e-1), (95e-2), (1e0), (105e-2), (2e0)) AS v(rating)), u AS (SELECT *, greatest(least(ex, pmax - gen), pmin - gen) AS used FROM k)
FINALLY SELECT area, rating, 1 + used / t AS load_rating, CASE WHEN used > 0 THEN used / (pmax - gen) WHEN used < 0 THEN used / (gen - pmin) ELSE 0e0 END AS scale, ex <= pmax - gen AND ex >= pmin - gen AS feasible FROM u""",
    "load_rating scale",
)
_register(
    "allocate_reactive",
    lambda r: electrical.allocate_reactive(r.generator.withColumn("rmpct", F.lit(0.0)), r.generator.groupBy("bus_id").agg((F.sum(F.when(F.col("status") == 1, F.col("qmax"))) * F.when(F.col("bus_id") % 3 == 0, 1.5).when(F.col("bus_id") % 3 == 1, -2.0).otherwise(0.5)).alias("q_required"))),
    """SELECT g.bus_id, gen_id, CASE WHEN req > top + 1e-1 THEN qmax WHEN req < low - 1e-1 THEN qmin ELSE greatest(least(req * qmax / top, qmax), qmin) END AS q, req > top + 1e-1 OR req < low - 1e-1 OR req * qmax / top > qmax OR req * qmax / top < qmin AS clamped, req > top + 1e-1 OR req < low - 1e-1 AS to_pq
 FROM {generator} g JOIN (SELECT bus_id, sum(qmax) AS top, sum(qmin) AS low, sum(qmax) * CASE WHEN bus_id % 3 = 0 THEN 15e-1 WHEN bus_id % 3 = 1 THEN -2e0 ELSE 5e-1 END AS req FROM {generator} WHERE status = 1 GROUP BY bus_id) AS t ON t.bus_id = g.bus_id WHERE status = 1""",
    "q",
)

# --- limits ---------------------------------------------------------------------------------------------------------

_register(
    "monitor_filter",
    lambda r: _flat(r, lambda circuit: limits.monitor_filter(circuit, circuit.where("(from_bus + to_bus) % 9 = 0").select("from_bus", "to_bus", "ckt"))).select("event_idx", "from_bus", "to_bus", "ckt", "loading"),
    f"{_FLAT}\nFINALLY SELECT event_idx, from_bus, to_bus, ckt, loading FROM flat WHERE (from_bus + to_bus) % 9 = 0",
    "loading",
)
_register(
    "area_kv_filter",
    lambda r: _flat(r, lambda circuit: limits.area_kv_filter(circuit, r.fix("bus").bus, [0, 3], 69.0, 138.0)).select("event_idx", "from_bus", "to_bus", "ckt", "mva"),
    f"{_FLAT}\nFINALLY SELECT event_idx, from_bus, to_bus, ckt, mva FROM flat JOIN {{bus}} a ON a.bus_id = from_bus JOIN {{bus}} b ON b.bus_id = to_bus WHERE (a.area IN (0, 3) OR b.area IN (0, 3)) AND greatest(a.base_kv, b.base_kv) BETWEEN 69 AND 138",
    "mva",
)
_wrap = lambda d: f"({d}) + 180e0 - 360e0 * floor((({d}) + 180e0) / 360e0) - 180e0"


def _delta(r: Roles) -> DataFrame:
    """Circuits whose ends' sum is divisible by 5 have no base row."""
    r.fix("bus")
    return limits.delta_rows(_flat(r, cells=True).where("event_idx > 0 OR (from_bus + to_bus) % 5 <> 0"), r.bus, _outages(r), keyed.facility_label(_outages(r), r.bus))


def _delta_of_voltages(r: Roles) -> DataFrame:
    """The same rows: circuits without a base row give none."""
    r.fix("circuit", "scenario", "voltage", "bus")
    names = F.broadcast(keyed.scenario_name(_outages(r)).withColumnRenamed("scenario", "contingency"))
    return limits.delta_of_voltages(r.circuit.where("(from_bus + to_bus) % 5 <> 0"), r.voltage, r.bus, _outages(r), keyed.facility_label(_outages(r), r.bus), "C", names)


_DELTA = f"""{_FLAT}, fac AS (SELECT event_idx, concat('[', area, '] ', from_bus, ' ', to_bus, ' ', ckt) AS label FROM {{scenario}} JOIN {{bus}} ON bus_id = from_bus),
delta AS (SELECT c.event_idx, c.contingency, 'Line' AS type, c.from_bus, c.to_bus, c.ckt, f.base_kv AS base_kv_from, t.base_kv AS base_kv_to, f.area AS area_from, t.area AS area_to,
 {", ".join(f"b.{n} AS base_{n}, c.{n} AS cont_{n}" for n in ("rate", "p", "q", "mva", "loading"))}, {", ".join(f"b.{c} AS {n}_base, c.{c} AS {n}_cont" for n, c in (("v_from", "v_from_pu"), ("v_to", "v_to_pu"), ("ang_from", "ang_from_deg"), ("ang_to", "ang_to_deg")))},
 {_wrap('b.ang_from_deg - b.ang_to_deg')} AS d_angle_base, {_wrap('c.ang_from_deg - c.ang_to_deg')} AS d_angle_cont, fac.label AS cont_event_facility
 FROM flat c JOIN flat b ON b.event_idx = 0 AND b.from_bus = c.from_bus AND b.to_bus = c.to_bus AND b.ckt = c.ckt JOIN {{bus}} f ON f.bus_id = c.from_bus JOIN {{bus}} t ON t.bus_id = c.to_bus JOIN fac ON fac.event_idx = c.event_idx
 WHERE c.event_idx > 0 AND (c.from_bus + c.to_bus) % 5 <> 0)"""
_STATES = " ".join(f"{a}_{n}" for n in ("p", "q", "mva", "loading") for a in ("base", "cont")) + " d_angle_base d_angle_cont"
_register("delta_rows", _delta, f"{_DELTA}\nFINALLY SELECT * FROM delta", _STATES)
_register("delta_of_voltages", _delta_of_voltages, f"{_DELTA}\nFINALLY SELECT * FROM delta", _STATES)
_register("delta_skipped", lambda r: limits.delta_skipped(_flat(r, cells=True).where("event_idx > 0 OR (from_bus + to_bus) % 5 <> 0")), f"{_FLAT}\nFINALLY SELECT event_idx, count(*) AS skipped FROM flat WHERE event_idx > 0 AND (from_bus + to_bus) % 5 = 0 GROUP BY 1")
_register("performance_index", lambda r: limits.performance_index(_flow(r)), f"{_ELEMENTS}, {_FLOW}\nFINALLY SELECT event_idx, from_bus, to_bus, ckt, CASE WHEN rate_a > 0 THEN (p_from * p_from + q_from * q_from) / (rate_a * rate_a) ELSE 0e0 END AS pi, CASE WHEN rate_a > 0 THEN sqrt(p_from * p_from + q_from * q_from) / rate_a > 1 ELSE FALSE END AS viol FROM flow", "pi")
_VV = "vv AS (SELECT event_idx, v.bus_id, v_pu FROM {voltage} v WHERE v_pu > 106e-2 OR v_pu < 93e-2)"


def _voltage_bad(r: Roles) -> DataFrame:
    return limits.voltage_violations(r.voltage, 0.93, 1.06).select("event_idx", "bus_id", "v_pu")


_register("voltage_violations", lambda r: limits.voltage_violations(r.voltage, 0.93, 1.06, r.bus.where("bus_id % 4 = 1"), r.bus.where("area = 2")).select("event_idx", "bus_id", "v_pu"), f"{_VV}\nFINALLY SELECT * FROM vv WHERE bus_id % 4 <> 1 AND bus_id IN (SELECT bus_id FROM {{bus}} WHERE area = 2)", "v_pu")
_register("ignore_baseline", lambda r: limits.ignore_baseline(_voltage_bad(r), ["bus_id"]), f"{_VV}\nFINALLY SELECT * FROM vv WHERE event_idx <> 0 AND bus_id NOT IN (SELECT bus_id FROM vv WHERE event_idx = 0)", "v_pu")
_OVER = f"{_ELEMENTS}, {_FLOW}, ov AS (SELECT event_idx, from_bus, to_bus, ckt, s, rate FROM (SELECT *, sqrt(p_from * p_from + q_from * q_from) AS s, CASE WHEN rate_b > 0 THEN rate_b ELSE rate_a END AS rate FROM flow WHERE status = 1) AS f WHERE rate > 0 AND s > rate)"


def _overloads(r: Roles) -> DataFrame:
    """Ignored circuits are left out before events multiply them, so that no rows of events are looked up."""
    watched = lambda circuit: limits.not_ignored(circuit, circuit.where("ckt = '5'"))
    return limits.overload_violations(_flow(r, watched), True)


_register("overload_violations", _overloads, f"{_OVER}\nFINALLY SELECT * FROM ov WHERE ckt <> '5'", "s rate")
_register(
    "watched_line_verdict",
    lambda r: limits.watched_line_verdict(r.circuit.where("from_bus % 11 = 2").select(F.col("to_bus").alias("from_bus"), F.col("from_bus").alias("to_bus"), "ckt"), _flat(r)),
    f"{_FLAT}, ver AS (SELECT least(from_bus, to_bus) AS u, greatest(from_bus, to_bus) AS v, ckt, max(viol) AS viol FROM flat GROUP BY 1, 2, 3)\nFINALLY SELECT c.to_bus AS from_bus, c.from_bus AS to_bus, c.ckt, coalesce(viol, 0) = 0 AS secure FROM {{circuit}} c LEFT JOIN ver ON u = least(c.from_bus, c.to_bus) AND v = greatest(c.from_bus, c.to_bus) AND ver.ckt = c.ckt WHERE c.from_bus % 11 = 2",
)
_register(
    "violation_list",
    lambda r: limits.violation_list(_voltage_bad(r), _overloads(r)),
    f"{_VV}, {_OVER}\nFINALLY SELECT event_idx, 'bus' AS kind, bus_id AS bus1, NULL AS bus2, NULL AS tag, 'voltage at bus ' || bus_id AS text FROM vv UNION ALL SELECT event_idx, 'branch', from_bus, to_bus, ckt, 'overload of branch ' || from_bus || ' ' || to_bus || ' ' || ckt FROM ov WHERE ckt <> '5'",
)
_register(
    "violation_code",
    lambda r: r.convergence_a.select("event_idx", limits.violation_code(F.col("iterations") > 6, F.col("converged")).alias("code")),
    "SELECT event_idx, CAST(CASE WHEN iterations > 6 AND converged THEN 4 WHEN converged THEN 3 WHEN iterations > 6 THEN 2 ELSE 1 END AS INT) AS code FROM {convergence_a}",
)
_register(
    "status_code",
    lambda r: limits.status_code(r.convergence_a.select("event_idx", F.col("converged").alias("solved"), (F.col("iterations") < 9).alias("slack_ok"), (F.col("event_idx") % 3).alias("n_islands"), (F.col("event_idx") % 5 > 0).alias("elements_found"), (F.col("event_idx") % 7 > 0).alias("has_slack"))).select("event_idx", "status_code"),
    "SELECT event_idx, CASE WHEN converged AND iterations >= 9 THEN 'SLACK_OVERLOAD' WHEN converged THEN 'OK' WHEN event_idx % 3 > 1 THEN 'ISLANDED' WHEN event_idx % 5 = 0 OR event_idx % 7 = 0 THEN 'NO_SLACK' ELSE 'DIVERGED' END AS status_code FROM {convergence_a}",
)
_register(
    "slack_capacity",
    lambda r: limits.slack_capacity(_output(r), r.generator, r.bus),
    f"{_OUTPUT}, cap AS (SELECT outp.*, coalesce(pmax, 0e0) AS pmax FROM outp JOIN {{bus}} b ON b.bus_id = outp.bus_id AND type = 3 LEFT JOIN (SELECT bus_id, sum(pmax) AS pmax FROM {{generator}} WHERE status = 1 GROUP BY 1) AS g ON g.bus_id = outp.bus_id)\nFINALLY SELECT event_idx, bus_id, p, pmax, p <= pmax + greatest(1e-2 * pmax, 1e-1) AS ok FROM cap",
    "p pmax",
)


def _devices(r: Roles) -> DataFrame:
    """Shunts and tap changers, some controlling another bus, some a bus that doesn't exist; taps from one limit to the other."""
    low, b = 0.94 + 0.001 * (F.col("bus_id") % 9), F.col("bus_id")
    return r.bus.select(
        b.alias("device"), b.alias("own_bus"), F.when(b % 40 == 0, -7).when(b % 8 == 0, b + 2).otherwise(0).alias("remote_bus"), low.alias("low"), F.when(b % 12 == 0, low + 0.001).otherwise(low + 0.1).alias("high"),
        F.when(b % 3 == 0, "shunt").otherwise("tap").alias("kind"), (0.9 + 0.0125 * (b % 17)).alias("tap"), F.lit(0.00625).alias("step"), F.lit(0.9).alias("rmi"), F.lit(1.1).alias("rma"), (b % 16 == 0).alias("to_side"),
    )


_register(
    "deadband_screen",
    lambda r: limits.deadband_screen(_devices(r), r.voltage),
    """dev AS (SELECT bus_id AS device, CASE WHEN bus_id % 40 = 0 THEN -7 WHEN bus_id % 8 = 0 THEN bus_id + 2 END AS ctl, 94e-2 + 1e-3 * (bus_id % 9) AS low, CASE WHEN bus_id % 12 = 0 THEN 1e-3 ELSE 1e-1 END AS w, 9e-1 + 125e-4 * (bus_id % 17) AS tap, bus_id % 3 <> 0 AS is_tap FROM {bus}),
seen AS (SELECT dev.*, o.event_idx, CASE WHEN ctl IS NULL THEN o.v_pu WHEN q.v_pu IS NOT NULL THEN q.v_pu WHEN is_tap THEN 1e0 ELSE o.v_pu END AS v_pu FROM dev JOIN {voltage} o ON o.bus_id = device LEFT JOIN {voltage} q ON q.bus_id = ctl AND q.event_idx = o.event_idx),
dir AS (SELECT *, CAST(CASE WHEN v_pu < CASE WHEN w < 2e-3 THEN low + w / 2 - 1e-3 ELSE low END THEN 1 WHEN v_pu > CASE WHEN w < 2e-3 THEN low + w / 2 + 1e-3 ELSE low + w END THEN -1 END AS INT) AS direction FROM seen),
mov AS (SELECT *, CASE WHEN is_tap THEN greatest(9e-1, least(11e-1, tap + direction * CASE WHEN device % 16 = 0 THEN -625e-5 ELSE 625e-5 END)) END AS new_tap FROM dir WHERE direction IS NOT NULL)
FINALLY SELECT device, event_idx, v_pu, direction, new_tap FROM mov WHERE NOT is_tap OR abs(new_tap - tap) >= 1e-8""",
    "v_pu new_tap",
)


def _cases(r: Roles) -> DataFrame:
    """Convergence of the outage scenarios."""
    return r.convergence_a.withColumn("event_idx", F.col("event_idx").cast("int")).join(r.scenario.select("event_idx"), "event_idx", "left_semi")


_register(
    "scenario_summary",
    lambda r: limits.scenario_summary(r.convergence_a, _voltage_bad(r).where("event_idx % 2 = 0"), _overloads(r)),
    f"{_VV}, {_OVER}\nFINALLY SELECT event_idx, name, type, converged, iterations, event_idx % 2 = 0 AND event_idx IN (SELECT event_idx FROM vv) AS has_voltage_violation, event_idx IN (SELECT event_idx FROM ov WHERE ckt <> '5') AS has_branch_violation FROM {{convergence_a}}",
)


def _outcomes(r: Roles) -> DataFrame:
    """Ratings from 0.5 to 1.5, each in two scenarios: secure below a limit with some exceptions on either side, out of capacity at the ends."""
    k, t = F.col("k"), F.col("tie")
    bus = r.bus.select("bus_id")
    bus = bus.repartition(r.parts(bus.count() * 101), "bus_id")  # dealt before ratings multiply them, so that these are grouped where they are made
    rows = bus.select(F.col("bus_id").alias("tie"), F.explode(F.sequence(F.lit(50), F.lit(150))).alias("k")).withColumn("scenario", F.explode(F.array(F.lit(0), F.lit(1))))
    ok = F.when((k * 31 + t * 17 + F.col("scenario") * 5) % 13 == 0, k > 70 + t % 61).otherwise(k <= 70 + t % 61)
    return rows.select("tie", (k / 100.0).alias("rating"), ok.alias("ok"), ((k <= 120 + t % 37) & (k >= 50 + t % 29)).alias("feasible"))


_register(
    "rating_search",
    lambda r: limits.rating_search(_outcomes(r)),
    """o AS (SELECT bus_id AS tie, k, CASE WHEN k > 120 + bus_id % 37 OR k < 50 + bus_id % 29 THEN -1 WHEN bool_and(CASE WHEN (k * 31 + bus_id * 17 + s * 5) % 13 = 0 THEN k > 70 + bus_id % 61 ELSE k <= 70 + bus_id % 61 END) THEN 1 ELSE 0 END AS code
  FROM {bus} CROSS JOIN range(50, 151) AS g(k) CROSS JOIN range(0, 2) AS h(s) GROUP BY 1, 2),
c AS (SELECT b.tie, b.code = 1 AS up, CASE WHEN b.code = 1 THEN coalesce(min(CASE WHEN o.k > 100 AND o.code <> 1 THEN o.k END), 155) ELSE coalesce(max(CASE WHEN o.k < 100 AND o.code <> 0 THEN o.k END), 45) END AS stop FROM o b JOIN o ON o.tie = b.tie AND o.k % 5 = 0 WHERE b.k = 100 GROUP BY b.tie, b.code),
f AS (SELECT c.tie, up, CASE WHEN up THEN coalesce(min(CASE WHEN o.code <> 1 THEN o.k END), 151) ELSE coalesce(max(CASE WHEN o.code <> 0 THEN o.k END), 49) END AS fine FROM c LEFT JOIN o ON o.tie = c.tie AND CASE WHEN up THEN o.k > stop - 5 ELSE o.k < stop + 5 END GROUP BY c.tie, up)
FINALLY SELECT f.tie, (fine + CASE WHEN up THEN -1 WHEN coalesce(o.code, -1) = -1 THEN 1 ELSE 0 END) / 1e2 AS rating, coalesce(o.code, -1) = -1 AS limited FROM f LEFT JOIN o ON o.tie = f.tie AND o.k = fine""",
    "rating",
)
_register(
    "scenario_rank",
    lambda r: limits.worst(_flat(r).select("from_bus", "event_idx", "to_bus", "ckt", "loading"), ["from_bus"], 2, ("event_idx", "to_bus", "ckt")).select("from_bus", "rank", "event_idx", "to_bus", "ckt", "loading"),
    f"{_FLAT}\nFINALLY SELECT from_bus, rank, event_idx, to_bus, ckt, loading FROM (SELECT *, CAST(row_number() OVER (PARTITION BY from_bus ORDER BY round(loading, 6) DESC, event_idx, to_bus, ckt) AS INT) AS rank FROM flat) AS k WHERE rank <= 2",
    "loading",
)

# --- statistics -----------------------------------------------------------------------------------------------------

_register(
    "mean_rms",
    lambda r: stats.mean_rms(r.stat, 1),
    """k AS (SELECT row_key, count(*) FILTER (WHERE mask >= 1) AS n, avg(value) FILTER (WHERE mask >= 1) AS mean, stddev_samp(value) FILTER (WHERE mask >= 1) AS sd FROM {stat} GROUP BY 1),
d AS (SELECT s.row_key, sum((s.value - b.value) * (s.value - b.value)) AS sq FROM {stat} s JOIN {stat} b ON b.row_key = s.row_key AND b.scenario_idx = 0 WHERE s.scenario_idx > 0 AND s.mask >= 1 GROUP BY 1)
FINALLY SELECT k.row_key, n, coalesce(mean, 0e0) AS mean, CASE WHEN n > 1 THEN sd ELSE 0e0 END AS std, CASE WHEN n > 1 AND sq IS NOT NULL THEN sqrt(sq / (n - 1)) WHEN n <= 1 OR EXISTS (SELECT 1 FROM {stat} b WHERE b.row_key = k.row_key AND b.scenario_idx = 0) THEN 0e0 END AS rms FROM k LEFT JOIN d ON d.row_key = k.row_key""",
    "mean std rms",
)
_register(
    "min_max",
    lambda r: stats.min_max(r.stat, 2),
    """u AS (SELECT s.*, b.value AS base FROM {stat} s JOIN {stat} b ON b.row_key = s.row_key AND b.scenario_idx = 0), w AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY value, scenario_idx) AS lo, row_number() OVER (PARTITION BY row_key ORDER BY value DESC, scenario_idx) AS hi FROM u WHERE scenario_idx = 0 OR mask >= 2),
m AS (SELECT row_key, min(base) AS base, min(value) AS mi, max(value) AS ma, max(CASE WHEN lo = 1 THEN scenario_idx END) AS argmin, max(CASE WHEN hi = 1 THEN scenario_idx END) AS argmax FROM w GROUP BY 1)
FINALLY SELECT m.row_key, base, mi AS "min", ma AS "max", mi - base AS d_min, ma - base AS d_max, min_bound, max_bound, argmin, argmax FROM m JOIN (SELECT row_key, min(min_bound) AS min_bound, max(max_bound) AS max_bound FROM {stat} GROUP BY 1) AS b ON b.row_key = m.row_key""",
    "base d_min d_max min_bound max_bound",
)
_register("mask_count", lambda r: stats.mask_count(r.stat, 1), "SELECT row_key, count(*) FILTER (WHERE mask = 1) AS n FROM {stat} GROUP BY 1")
_register("column_sums", lambda r: stats.column_sums(r.stat, 1), "SELECT scenario_idx, coalesce(sum(value) FILTER (WHERE mask >= 1), 0e0) AS total, coalesce(sum(value) FILTER (WHERE mask >= 1), 0e0) / count(*) AS avg_over_all_rows FROM {stat} GROUP BY 1", "total avg_over_all_rows")


def _state_of_parts(r: Roles, mask: int) -> DataFrame:
    """The state of scenarios that came in four batches."""
    long = r.fix("stat").stat
    return summaries.merged([summaries.state(long.where(F.col("scenario_idx") % 4 == i), mask) for i in range(4)])


_register(
    "mean_rms_of_parts",
    lambda r: summaries.mean_rms_of(_state_of_parts(r, 1)),
    """k AS (SELECT row_key, count(*) FILTER (WHERE mask >= 1) AS n, avg(value) FILTER (WHERE mask >= 1) AS mean, stddev_samp(value) FILTER (WHERE mask >= 1) AS sd FROM {stat} GROUP BY 1),
d AS (SELECT s.row_key, sum((s.value - b.value) * (s.value - b.value)) AS sq FROM {stat} s JOIN {stat} b ON b.row_key = s.row_key AND b.scenario_idx = 0 WHERE s.scenario_idx > 0 AND s.mask >= 1 GROUP BY 1)
FINALLY SELECT k.row_key, n, coalesce(mean, 0e0) AS mean, CASE WHEN n > 1 THEN sd ELSE 0e0 END AS std, CASE WHEN n > 1 AND sq IS NOT NULL THEN sqrt(sq / (n - 1)) WHEN n <= 1 OR EXISTS (SELECT 1 FROM {stat} b WHERE b.row_key = k.row_key AND b.scenario_idx = 0) THEN 0e0 END AS rms FROM k LEFT JOIN d ON d.row_key = k.row_key""",
    "mean std rms",
)
_register(
    "min_max_of_parts",
    lambda r: summaries.min_max_of(_state_of_parts(r, 2)),
    """u AS (SELECT s.*, b.value AS base FROM {stat} s JOIN {stat} b ON b.row_key = s.row_key AND b.scenario_idx = 0), w AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY value, scenario_idx) AS lo, row_number() OVER (PARTITION BY row_key ORDER BY value DESC, scenario_idx) AS hi FROM u WHERE scenario_idx = 0 OR mask >= 2),
m AS (SELECT row_key, min(base) AS base, min(value) AS mi, max(value) AS ma, max(CASE WHEN lo = 1 THEN scenario_idx END) AS argmin, max(CASE WHEN hi = 1 THEN scenario_idx END) AS argmax FROM w GROUP BY 1)
FINALLY SELECT m.row_key, base, mi AS "min", ma AS "max", mi - base AS d_min, ma - base AS d_max, min_bound, max_bound, argmin, argmax FROM m JOIN (SELECT row_key, min(min_bound) AS min_bound, max(max_bound) AS max_bound FROM {stat} GROUP BY 1) AS b ON b.row_key = m.row_key""",
    "base d_min d_max min_bound max_bound",
)
_register(
    "build_stat",
    lambda r: stats.build_stat(_flat(r), _cases(r).withColumn("converged", F.col("event_idx") % 3 > 0), unique=True),
    f"""{_FLAT}, kk AS (SELECT *, from_bus || '_' || to_bus || '_' || ckt AS row_key FROM flat)
FINALLY SELECT row_key, event_idx AS scenario_idx, p AS value, CAST(CASE WHEN viol = 1 THEN 2 ELSE 1 END AS INT) AS mask, -rate AS min_bound, rate AS max_bound FROM kk WHERE event_idx = 0 OR event_idx % 3 > 0
 UNION ALL SELECT row_key, e, 0e0, 0, -rate, rate FROM kk CROSS JOIN (SELECT event_idx AS e FROM {{scenario}} WHERE event_idx % 3 = 0 AND event_idx IN (SELECT event_idx FROM {{convergence_a}})) AS v WHERE event_idx = 0""",
    "value min_bound max_bound",
)
_register(
    "bus_stat",  # PV buses that a scenario turned into PQ ones are flagged
    lambda r: summaries.stat_block(r.voltage.join(r.bus.select("bus_id", "type"), "bus_id"), _cases(r).withColumn("converged", F.col("event_idx") % 3 > 0), ["bus_id"], "v_pu", (F.col("type") == 2) & ((F.col("bus_id") + F.col("event_idx")) % 7 == 0) & (F.col("event_idx") > 0), F.lit(0.9), F.lit(1.1)),
    """bad AS (SELECT event_idx AS e FROM {scenario} WHERE event_idx % 3 = 0 AND event_idx IN (SELECT event_idx FROM {convergence_a}))
FINALLY SELECT CAST(v.bus_id AS VARCHAR) AS row_key, v.event_idx AS scenario_idx, v.v_pu AS value, CAST(CASE WHEN b.type = 2 AND (v.bus_id + v.event_idx) % 7 = 0 AND v.event_idx > 0 THEN 2 ELSE 1 END AS INT) AS mask, 9e-1 AS min_bound, 11e-1 AS max_bound FROM {voltage} v JOIN {bus} b ON b.bus_id = v.bus_id WHERE v.event_idx = 0 OR (v.event_idx % 3 > 0 AND v.event_idx IN (SELECT event_idx FROM {convergence_a}))
 UNION ALL SELECT CAST(bus_id AS VARCHAR), e, 0e0, 0, 9e-1, 11e-1 FROM {bus} CROSS JOIN bad""",
    "value min_bound max_bound",
)
_register(
    "generator_stat",  # every scenario takes the unit to another output; bounds are its limits
    lambda r: summaries.stat_block(r.slim("circuit", *_ENDS, "rate_a").fix("scenario").slim("generator", "bus_id", "gen_id", "pg", "pmin", "pmax").generator.crossJoin(F.broadcast(r.scenario.select("event_idx").union(r.spark.range(1).select(F.lit(0))))).withColumn("p", F.col("pg") * (1 + F.col("event_idx") / 100)), _cases(r).withColumn("converged", F.col("event_idx") % 3 > 0), ["bus_id", "gen_id"], "p", F.col("p") > F.col("pmax"), F.col("pmin"), F.col("pmax")),
    """ev AS (SELECT 0 AS e UNION ALL SELECT event_idx FROM {scenario} WHERE event_idx IN (SELECT event_idx FROM {convergence_a}))
FINALLY SELECT concat(bus_id, '_', gen_id) AS row_key, CAST(e AS INT) AS scenario_idx, CASE WHEN e > 0 AND e % 3 = 0 THEN 0e0 ELSE pg * (1 + e / 1e2) END AS value, CAST(CASE WHEN e > 0 AND e % 3 = 0 THEN 0 WHEN pg * (1 + e / 1e2) > pmax THEN 2 ELSE 1 END AS INT) AS mask, pmin AS min_bound, pmax AS max_bound FROM {generator} CROSS JOIN ev""",
    "value min_bound max_bound",
)
_register(
    "network_counts",
    lambda r: stats.network_counts(r.bus, r.circuit, r.generator, r.load, r.shunt),
    """SELECT 'generator' AS kind, bus_id, count(*) AS n FROM {generator} GROUP BY 2 UNION ALL SELECT 'load', bus_id, count(*) FROM {load} GROUP BY 2 UNION ALL SELECT 'circuit_end', bus_id, count(*) FROM (SELECT from_bus AS bus_id FROM {circuit} UNION ALL SELECT to_bus FROM {circuit}) AS e GROUP BY 2
 UNION ALL SELECT 'generator', NULL, count(*) FROM {generator} UNION ALL SELECT 'load', NULL, count(*) FROM {load} UNION ALL SELECT 'circuit', NULL, count(*) FROM {circuit} UNION ALL SELECT 'bus', NULL, count(*) FROM {bus} UNION ALL SELECT 'storage', bus_id, count(*) FROM {shunt} GROUP BY 2 UNION ALL SELECT 'storage', NULL, count(*) FROM {shunt} UNION ALL SELECT 'branch', NULL, count(*) FROM (SELECT DISTINCT from_bus, to_bus FROM {circuit}) AS d""",
)
_register("area_load", lambda r: stats.area_load(r.load, r.bus), "SELECT area, zone, sum(pl) AS pl FROM {load} l JOIN {bus} b ON b.bus_id = l.bus_id WHERE status = 1 GROUP BY GROUPING SETS ((area), (area, zone))", "pl")
_register("generator_margins", lambda r: stats.generator_margins(r.generator, r.bus), "SELECT area, zone, sum(pg) AS pg, sum(pmin) AS pmin, sum(pmax) AS pmax FROM {generator} g JOIN {bus} b ON b.bus_id = g.bus_id WHERE status = 1 GROUP BY GROUPING SETS ((area), (area, zone))", "pg pmin pmax")
_register(
    "area_export",
    lambda r: stats.area_export(_flow(r, lambda circuit: stats.between_areas(circuit, r.fix("bus").bus))),
    f"{_ELEMENTS}, {_FLOW}, tie AS (SELECT event_idx, a.area AS f, b.area AS t, p_from FROM flow JOIN {{bus}} a ON a.bus_id = from_bus JOIN {{bus}} b ON b.bus_id = to_bus WHERE a.area <> b.area)\nFINALLY SELECT event_idx, area, sum(p) AS export FROM (SELECT event_idx, f AS area, p_from AS p FROM tie UNION ALL SELECT event_idx, t, -p_from FROM tie) AS u GROUP BY 1, 2",
    "export",
)
_register(
    "zone_totals",
    lambda r: stats.zone_totals(r.bus, r.generator, r.load),
    "SELECT z.zone, coalesce(pl, 0e0) AS pl, coalesce(ql, 0e0) AS ql, coalesce(pg, 0e0) AS pg, coalesce(qg, 0e0) AS qg FROM (SELECT DISTINCT zone FROM {bus}) AS z LEFT JOIN (SELECT zone, sum(pl) AS pl, sum(ql) AS ql FROM {load} l JOIN {bus} b ON b.bus_id = l.bus_id WHERE status = 1 GROUP BY 1) AS d ON d.zone = z.zone LEFT JOIN (SELECT zone, sum(pg) AS pg, sum(qg) AS qg FROM {generator} g JOIN {bus} b ON b.bus_id = g.bus_id WHERE status = 1 GROUP BY 1) AS g ON g.zone = z.zone",
    "pl ql pg qg",
)
_SOURCE = "rep AS (SELECT 'source' AS side, g.bus_id, gen_id AS tag, pg AS now, pg + 5e-1 * (pmax - pg) AS scaled FROM {generator} g JOIN {bus} b ON b.bus_id = g.bus_id WHERE status = 1 AND area = 1 UNION ALL SELECT 'sink', l.bus_id, load_id, pl, pl * 2e0 FROM {load} l JOIN {bus} b ON b.bus_id = l.bus_id WHERE status = 1 AND area = 2 AND zone = 12)"


def _report(r: Roles) -> DataFrame:
    return stats.source_sink_report(r.generator, r.load, r.bus, (1, 0), (2, 12), 0.5, 2.0)


_register("source_sink_report", _report, f"{_SOURCE}\nFINALLY SELECT * FROM rep", "now scaled")
_register("source_sink_totals", lambda r: stats.source_sink_totals(_report(r)), f"{_SOURCE}\nFINALLY SELECT side, count(*) AS n, sum(now) AS now, sum(scaled) AS scaled, min(scaled) AS least, max(scaled) AS most FROM rep GROUP BY 1", "now scaled least most")
_register("reduce", lambda r: stats.reduce(r.lineitem.withColumn("returned", F.col("l_returnflag") == "R"), "l_quantity", "returned"), """SELECT sum(l_quantity) AS "sum", max(l_quantity) AS "max", min(l_quantity) AS "min", bool_or(l_returnflag = 'R') AS "any", bool_and(l_returnflag = 'R') AS "all" FROM {lineitem}""")


def _timers(r: Roles) -> DataFrame:
    return r.lineitem.select(F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("timer"), (F.col("l_suppkey") % 20).alias("rank"), (F.col("l_extendedprice") / 1000).alias("seconds"))


_TIMER = "tim AS (SELECT l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS timer, l_suppkey % 20 AS rank, l_extendedprice / 1000 AS seconds FROM {lineitem})"
_register("timer_stats", lambda r: stats.timer_stats(_timers(r)), f'{_TIMER}\nFINALLY SELECT timer, count(*) AS n, avg(seconds) AS "avg", max(seconds) AS "max", min(seconds) AS "min", stddev_samp(seconds) AS std FROM tim GROUP BY 1', "avg max min std")
_register(
    "load_balance",
    lambda r: stats.load_balance(_timers(r).groupBy(F.col("timer").alias("file"), "rank").agg(F.count(F.lit(1)).alias("tasks"))),
    f'{_TIMER}, tk AS (SELECT timer AS file, rank, count(*) AS tasks FROM tim GROUP BY 1, 2)\nFINALLY SELECT file, CAST(sum(tasks) AS BIGINT) AS total, min(tasks) AS "min", max(tasks) AS "max", avg(tasks) AS mean, stddev_pop(tasks) AS std, 100 * stddev_pop(tasks) / avg(tasks) AS cv_percent, max(tasks) / avg(tasks) AS max_over_mean FROM tk GROUP BY 1',
    "mean std cv_percent max_over_mean",
)
_register(
    "ensemble_quantiles",
    lambda r: stats.ensemble_quantiles(r.series, [0.05, 0.5, 0.95]),
    "SELECT machine, step, q, quantile_cont(value, 5e-2) AS value FROM {series}, (VALUES (5e-2)) AS v(q) GROUP BY 1, 2, 3 UNION ALL SELECT machine, step, 5e-1, quantile_cont(value, 5e-1) FROM {series} GROUP BY 1, 2 UNION ALL SELECT machine, step, 95e-2, quantile_cont(value, 95e-2) FROM {series} GROUP BY 1, 2",
    "value",
)
_register(
    "exact_quantiles",
    lambda r: summaries.exact_quantiles(r.series, [0.05, 0.5, 0.95], large=100),
    "SELECT machine, step, q, quantile_cont(value, 5e-2) AS value FROM {series}, (VALUES (5e-2)) AS v(q) GROUP BY 1, 2, 3 UNION ALL SELECT machine, step, 5e-1, quantile_cont(value, 5e-1) FROM {series} GROUP BY 1, 2 UNION ALL SELECT machine, step, 95e-2, quantile_cont(value, 95e-2) FROM {series} GROUP BY 1, 2",
    "value",
)
_register(
    "quantiles_of_sketches",  # approximate, so only what is exact has SQL: the size of each merged sketch; see tests/test_summaries.py for its error
    lambda r: summaries.quantiles_of_sketches(summaries.merged_sketches([summaries.quantile_sketch(r.series.where(F.col("scenario_idx") % 3 == i)) for i in range(3)]), [0.5]).select("machine", "step", "n", "q"),
    "SELECT machine, step, count(value) AS n, 5e-1 AS q FROM {series} GROUP BY 1, 2",
    "q",
)
_register(
    "watch_pivot",
    lambda r: stats.watch_pivot(_flat(r), [0, 1, 2], r.circuit.where("from_bus % 13 = 1")),
    f"{_FLAT}\nFINALLY SELECT c.from_bus, c.to_bus, c.ckt, {', '.join(f'coalesce(sum({k}) FILTER (WHERE event_idx = {e}), 0e0) AS {k.upper()}_{e}' for e in (0, 1, 2) for k in 'pq')} FROM {{circuit}} c LEFT JOIN flat f ON f.from_bus = c.from_bus AND f.to_bus = c.to_bus AND f.ckt = c.ckt WHERE c.from_bus % 13 = 1 GROUP BY 1, 2, 3",
    "P_0 Q_0 P_1 Q_1 P_2 Q_2",
)

# --- series ---------------------------------------------------------------------------------------------------------

_EXCURSION = "ord AS (SELECT machine, t, value, row_number() OVER (PARTITION BY machine ORDER BY t, value) AS n, lag(value) OVER (PARTITION BY machine ORDER BY t, value) AS before FROM {series} WHERE t >= 5e0)," + ", ".join(
    f"""{side}(machine, n, since, hit) AS (SELECT machine, n, CASE WHEN {beyond} THEN t END, FALSE FROM ord WHERE n = 1 UNION ALL SELECT o.machine, o.n, CASE WHEN NOT ({beyond.replace('value', 'o.value')}) THEN NULL WHEN w.since IS NULL THEN o.t WHEN {away} THEN w.since END,
 w.since IS NOT NULL AND {beyond.replace('value', 'o.value')} AND {away} AND o.t - w.since >= 5e-1 FROM {side} w JOIN ord o ON o.machine = w.machine AND o.n = w.n + 1)"""
    for side, beyond, away in (("up", "value > 61", "o.value > o.before"), ("down", "value < 59", "o.value < o.before"))
)
_register(
    "sustained_excursion",
    lambda r: series.sustained_excursion(r.series, start=5.0),
    f"{_EXCURSION}\nFINALLY SELECT o.machine, t, value, 'up' AS side FROM up JOIN ord o ON o.machine = up.machine AND o.n = up.n WHERE hit UNION ALL SELECT o.machine, t, value, 'down' FROM down JOIN ord o ON o.machine = down.machine AND o.n = down.n WHERE hit",
    "t value",
)
_register("over_limit", lambda r: series.over_limit(r.series, 62.5), "SELECT machine, count(*) AS n, max(value) AS most FROM {series} WHERE value > 625e-1 GROUP BY 1", "most")
_register("angle_spread", lambda r: series.angle_spread(r.series, 5.95), "SELECT scenario_idx, step, max(value) - min(value) AS spread, max(value) - min(value) <= 595e-2 AS secure FROM {series} GROUP BY 1, 2", "spread")
_register(
    "unpivot_watch",
    lambda r: series.unpivot_watch(r.generator.select((F.col("bus_id") * 10 + F.col("gen_id").cast("int")).cast("double").alias("t"), F.col("pg").alias("12_1_GENP"), F.col("qg").alias("12_1_GENQ"), F.col("pmax").alias("7_A_SPD"), F.col("pmin").alias("other"))),
    "SELECT CAST(bus_id * 10 + CAST(gen_id AS INT) AS DOUBLE) AS t, CAST(12 AS BIGINT) AS bus_id, '1' AS gen_id, 'GENP' AS var, pg AS value FROM {generator} UNION ALL SELECT CAST(bus_id * 10 + CAST(gen_id AS INT) AS DOUBLE), 12, '1', 'GENQ', qg FROM {generator} UNION ALL SELECT CAST(bus_id * 10 + CAST(gen_id AS INT) AS DOUBLE), 7, 'A', 'SPD', pmax FROM {generator}",
    "value",
)
_register("watched_generators", lambda r: series.watched_generators(r.generator, r.bus, 3, 0), "SELECT g.bus_id, gen_id FROM {generator} g JOIN {bus} b ON b.bus_id = g.bus_id WHERE status = 1 AND area = 3")
_register(
    "observations",
    lambda r: series.observations(r.customer.select(F.when(F.col("c_custkey") % 2 == 0, " Generator").otherwise("BUS").alias("type"), (F.col("c_custkey") * 2).alias("bus_id"), F.when(F.col("c_custkey") % 2 == 0, "'3 '").alias("tag")), r.generator.select(F.lit("generator").alias("type"), "bus_id", F.col("gen_id").alias("tag"), F.col("pg").alias("value")).union(r.bus.select(F.lit("bus"), "bus_id", F.lit(""), "v_pu"))),
    """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'generator' ELSE 'bus' END AS type, c_custkey * 2 AS bus_id, CASE WHEN c_custkey % 2 = 0 THEN '3' ELSE '' END AS tag, coalesce(pg, v_pu, 0e0) AS value, coalesce(pg, v_pu) IS NOT NULL AS found
 FROM {customer} LEFT JOIN {generator} g ON c_custkey % 2 = 0 AND g.bus_id = c_custkey * 2 AND gen_id = '3' LEFT JOIN {bus} b ON c_custkey % 2 = 1 AND b.bus_id = c_custkey * 2""",
    "value",
)
_register("power_angle", lambda r: r.bus.select("bus_id", x.power_angle(F.col("angle_deg") * 3, F.lit(12.5)).alias("angle")), f"SELECT bus_id, {_wrap('angle_deg * 3 - 125e-1')} AS angle FROM {{bus}}", "angle")

# --- measurements ---------------------------------------------------------------------------------------------------

_N_BUS = "(SELECT count(*) FROM {bus})"


def _n_bus(r: Roles) -> int:
    return r.bus.count()

_STATE_SQL = "vst AS (SELECT event_idx AS case_id, v.bus_id, v.v_pu, v.angle_deg, 1e-1 * v.v_pu AS p, 5e-2 * v.v_pu AS q FROM {voltage} v)"
_MEASURED = f"""{_STATE_SQL}, mea AS (SELECT m.*, CASE type WHEN 'VM' THEN v_pu WHEN 'VA' THEN angle_deg WHEN 'PI' THEN p WHEN 'QI' THEN q END AS predicted FROM {{measurement}} m JOIN vst ON vst.case_id = m.case_id AND vst.bus_id = m.bus_id),
res AS (SELECT *, value - predicted AS residual, 1 / (deviation * deviation) AS weight, (value - predicted) / deviation AS norm FROM mea)"""


def _measured(r: Roles) -> DataFrame:
    state = r.voltage.select(F.col("event_idx").alias("case_id"), "bus_id", "v_pu", "angle_deg")
    return measure.residuals(measure.predicted_value(r.measurement, state, state.select("case_id", "bus_id", (0.1 * F.col("v_pu")).alias("p"), (0.05 * F.col("v_pu")).alias("q"))))


_register("assign_measurements", lambda r: measure.assign_measurements(r.measurement, r.bus, r.circuit)[0].select("case_id", "bus_id", "idx", "type", "nth"), "SELECT m.case_id, m.bus_id, idx, m.type, CAST(row_number() OVER (PARTITION BY case_id, m.bus_id ORDER BY m.type, printf('%.6f', value), idx) AS INT) AS nth FROM {measurement} m JOIN {bus} b ON b.bus_id = m.bus_id")
_register(
    "limit_measurements",
    lambda r: measure.limit_measurements(r.bus, r.measurement, 0.95, 1.05, 0.01),
    "SELECT case_id, bus_id, t AS type, x AS value, 1e-2 AS deviation FROM {bus} CROSS JOIN (SELECT DISTINCT case_id FROM {measurement}) AS c CROSS JOIN (VALUES ('VUL', 105e-2), ('VLL', 95e-2)) AS v(t, x) WHERE type = 1",
)
_register("predicted_value", lambda r: _measured(r).select("case_id", "idx", "type", "predicted"), f"{_MEASURED}\nFINALLY SELECT case_id, idx, type, predicted FROM res", "predicted")



def _branch_measurement(r: Roles) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in measure.BRANCH_TYPES]), (F.col("to_bus") % 6 + 1).cast("int"))
    return r.circuit.select(((F.col("from_bus") + F.col("to_bus")) % 8).cast("int").alias("case_id"), "from_bus", "to_bus", "ckt", kind.alias("type"), F.col("rate_a").alias("value"), F.lit(0.01).alias("deviation"))


def _branch_predicted(r: Roles) -> DataFrame:
    r.fix("circuit", "scenario", "voltage")
    state = r.voltage.withColumnRenamed("event_idx", "case_id")
    limit = measure.limit_measurements(r.bus, r.measurement, 0.95, 1.05, 0.01)
    found = measure.predicted_value(limit, state, state.select("case_id", "bus_id", F.lit(0.0).alias("p"), F.lit(0.0).alias("q")))
    found = found.unionByName(measure.predicted_of_circuits(_branch_measurement(r), r.circuit, r.voltage), allowMissingColumns=True)
    return found.select("case_id", "bus_id", "from_bus", "to_bus", "ckt", "type", "predicted")


_register(
    "predicted_branch_value",
    _branch_predicted,
    f"""{_ELEMENTS}, {_FLOW}, km AS (SELECT CAST((from_bus + to_bus) % 8 AS INT) AS case_id, from_bus, to_bus, ckt, ['PIJ', 'PJI', 'QIJ', 'QJI', 'IIJ', 'IJI'][to_bus % 6 + 1] AS type FROM {{circuit}})
FINALLY SELECT km.case_id, NULL AS bus_id, km.from_bus, km.to_bus, km.ckt, km.type, CASE km.type WHEN 'PIJ' THEN p_from WHEN 'PJI' THEN p_to WHEN 'QIJ' THEN q_from WHEN 'QJI' THEN q_to WHEN 'IIJ' THEN sqrt(p_from * p_from + q_from * q_from) / vf ELSE sqrt(p_to * p_to + q_to * q_to) / vt END / 1e2 AS predicted
 FROM km JOIN flow ON flow.event_idx = km.case_id AND flow.from_bus = km.from_bus AND flow.to_bus = km.to_bus AND flow.ckt = km.ckt
 UNION ALL SELECT v.event_idx, v.bus_id, NULL, NULL, NULL, t, CASE WHEN t = 'VUL' THEN greatest(v.v_pu, 105e-2) ELSE least(v.v_pu, 95e-2) END FROM {{voltage}} v JOIN {{bus}} b ON b.bus_id = v.bus_id AND b.type = 1 CROSS JOIN (VALUES ('VUL'), ('VLL')) AS w(t) WHERE v.event_idx IN (SELECT case_id FROM {{measurement}})""",
    "predicted",
)
_register(
    "assign_branch_measurements",
    lambda r: measure.assign_measurements(_branch_measurement(r).withColumns({"idx": F.col("ckt").cast("int"), "bus_id": F.lit(None).cast("long")}), r.bus, r.circuit)[1].select("case_id", "from_bus", "to_bus", "ckt", "type", "nth"),
    "SELECT CAST((from_bus + to_bus) % 8 AS INT) AS case_id, from_bus, to_bus, ckt, ['PIJ', 'PJI', 'QIJ', 'QJI', 'IIJ', 'IJI'][to_bus % 6 + 1] AS type, CAST(row_number() OVER (PARTITION BY from_bus, to_bus ORDER BY ckt) AS INT) AS nth FROM {circuit}",
)
_register("residuals", lambda r: _measured(r).select("case_id", "idx", "residual", "weight", "norm"), f"{_MEASURED}\nFINALLY SELECT case_id, idx, residual, weight, norm FROM res", "residual weight norm")
_CHI = f"""{_MEASURED}, chi AS (SELECT *, CASE WHEN dof >= 1 AND dof <= 3 * {_N_BUS} THEN dof * pow(1 - 2e0 / (9e0 * dof) + 1645e-3 * sqrt(2e0 / (9e0 * dof)), 3) WHEN {_N_BUS} <= 50 THEN 50e0 WHEN {_N_BUS} <= 100 THEN 150e0 WHEN {_N_BUS} <= 300 THEN 500e0 WHEN {_N_BUS} <= 500 THEN 1000e0 ELSE 2000e0 END AS threshold FROM (SELECT case_id, sum(residual * residual * weight) AS chi, count(*) AS n, greatest(count(*) - (2 * {_N_BUS} - 1), 1) AS dof FROM res GROUP BY 1) AS c)"""
_register("chi_square", lambda r: measure.chi_square(_measured(r), _n_bus(r)), f"{_CHI}\nFINALLY SELECT case_id, chi, n, dof, threshold, chi < threshold AS passed FROM chi", "chi threshold")
_register("chi_threshold", lambda r: r.customer.select("c_custkey", measure.chi_threshold(F.col("c_custkey"), F.lit(200)).alias("threshold")), "SELECT c_custkey, CASE WHEN c_custkey >= 1 AND c_custkey <= 600 THEN c_custkey * pow(1 - 2e0 / (9e0 * c_custkey) + 1645e-3 * sqrt(2e0 / (9e0 * c_custkey)), 3) ELSE 500e0 END AS threshold FROM {customer}", "threshold")
_BAD = f"""{_CHI}, fl AS (SELECT res.case_id, idx, res.type, res.bus_id, norm, 10e0 * CASE WHEN res.type = 'VM' THEN 3 WHEN res.type = 'VA' AND b.type = 3 THEN 50 WHEN res.type = 'VA' THEN 5 ELSE 1 END AS lim FROM res JOIN {{bus}} b ON b.bus_id = res.bus_id),
rk AS (SELECT *, abs(norm) > lim AS ov, row_number() OVER (PARTITION BY case_id ORDER BY (abs(norm) > lim) DESC, round(abs(norm), 6) DESC, idx) AS rank FROM fl),
bad AS (SELECT rk.case_id, idx, type, bus_id, norm, lim AS "limit", CAST(rank AS INT) AS rank FROM rk JOIN chi ON chi.case_id = rk.case_id WHERE rank <= 5 AND (ov OR (rank = 1 AND chi >= threshold)))"""


def _flags(r: Roles) -> DataFrame:
    m = _measured(r)
    return measure.flag_bad(m, measure.chi_square(m, _n_bus(r)), r.bus, 10.0)


_register("flag_bad", _flags, f"{_BAD}\nFINALLY SELECT * FROM bad", "norm")
_register(
    "top_residuals",
    lambda r: measure.top_residuals(_measured(r), 10.0),
    f"{_MEASURED}, tr AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(abs(norm), 6) DESC, idx) AS INT) AS rank, idx, type, norm, 10e0 * CASE type WHEN 'VM' THEN 3 WHEN 'VA' THEN 5 ELSE 1 END AS lim FROM res)\nFINALLY SELECT case_id, rank, idx, type, norm, lim AS \"limit\", CASE WHEN abs(norm) > lim THEN 'BAD' ELSE 'OK' END AS verdict FROM tr WHERE rank <= 10",
    "norm",
)
_register(
    "deweight",
    lambda r: measure.deweight(r.measurement.select("case_id", "idx", "deviation"), r.measurement.where("idx % 7 = 0"), r.measurement.where("idx % 14 = 0").withColumn("k", (F.col("idx") % 3).cast("int"))),
    "SELECT case_id, idx, deviation * CASE WHEN idx % 14 = 0 THEN pow(10e0, idx % 3 + 1) WHEN idx % 7 = 0 THEN 10e0 ELSE 1e0 END AS deviation FROM {measurement}",
    "deviation",
)
_HISTORY = "hist AS (SELECT case_id, idx // 1000 AS iteration, avg(value) * 100 AS chi, 40e0 AS threshold, count(*) FILTER (WHERE deviation > 187e-4) AS flagged FROM {measurement} GROUP BY 1, 2)"


def _history(r: Roles) -> DataFrame:
    return r.measurement.groupBy("case_id", F.floor(F.col("idx") / 1000).alias("iteration")).agg((F.avg("value") * 100).alias("chi"), F.lit(40.0).alias("threshold"), F.count_if(F.col("deviation") > 0.0187).alias("flagged"))


_register("iteration_stop", lambda r: measure.iteration_stop(_history(r)), f"{_HISTORY}, lg AS (SELECT *, lag(chi) OVER (PARTITION BY case_id ORDER BY iteration) AS before FROM hist)\nFINALLY SELECT case_id, iteration, before IS NOT NULL AND ((chi < threshold AND flagged = 0) OR chi > 11e-1 * before) AS stop FROM lg")
_register("iteration_report", lambda r: measure.iteration_report(_history(r)), f"{_HISTORY}, lg AS (SELECT *, lag(chi) OVER (PARTITION BY case_id ORDER BY iteration) AS before FROM hist)\nFINALLY SELECT case_id, iteration, flagged, CAST(sum(flagged) OVER (PARTITION BY case_id ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative, chi, 100 * (before - chi) / before AS reduction_percent FROM lg", "chi reduction_percent")
_register(
    "persistent_bad",
    lambda r: measure.persistent_bad(r.measurement.where("deviation > 0.0165").select("case_id", (F.col("bus_id") % 40).alias("idx"), F.col("idx").alias("iteration"), F.col("value").alias("norm"))),
    "pb AS (SELECT case_id, bus_id % 40 AS idx, count(*) AS times, arg_min(value, idx) AS first_norm, arg_max(value, idx) AS last_norm FROM {measurement} WHERE deviation > 165e-4 GROUP BY 1, 2)\nFINALLY SELECT *, CASE WHEN times > 1 AND abs(last_norm) < abs(first_norm) THEN 'Persistent (reduced)' WHEN times > 1 THEN 'Persistent' ELSE 'Recently flagged' END AS label FROM pb",
    "first_norm last_norm",
)
_register(
    "consistency_check",
    lambda r: measure.consistency_check(
        r.circuit.withColumn("r", F.when(F.col("ckt") == "1", 0.0).otherwise(F.col("r"))),
        r.circuit.where("ckt = '1'").select("from_bus", "to_bus", "ckt", F.lit("PIJ").alias("type"), F.lit(1).alias("idx"), F.when(F.col("to_bus") % 2 == 0, 0.0).otherwise(1.0).alias("value")),
        r.voltage.where("event_idx = 0").select("bus_id", "v_pu", "angle_deg"),
    ),
    """con AS (SELECT from_bus, to_bus, ckt, x, v.v_pu AS v1, w.v_pu AS v2, radians(v.angle_deg) - radians(w.angle_deg) AS dt FROM {circuit} JOIN {voltage} v ON v.bus_id = from_bus AND v.event_idx = 0 JOIN {voltage} w ON w.bus_id = to_bus AND w.event_idx = 0 WHERE ckt = '1' AND to_bus % 2 = 0)
FINALLY SELECT from_bus, to_bus, ckt, CASE WHEN abs(dt) > 1e-3 THEN 'warning' ELSE 'note' END AS kind, 0e0 AS measured, CASE WHEN abs(dt) > 1e-3 THEN v1 * v2 / x * sin(dt) END AS expected FROM con WHERE abs(dt) > 1e-3 OR abs(v1 - v2) > 1e-2""",
    "expected",
)
_register("measurement_coverage", lambda r: measure.measurement_coverage(r.measurement, _n_bus(r)), "SELECT m.case_id, type, count(*) AS n, count(DISTINCT bus_id) AS buses, case_n, case_n <= 2 * (SELECT count(*) FROM {bus}) - 1 AS underdetermined FROM {measurement} m JOIN (SELECT case_id, count(*) AS case_n FROM {measurement} GROUP BY 1) AS t ON t.case_id = m.case_id GROUP BY 1, 2, case_n")

# --- comparison -----------------------------------------------------------------------------------------------------

_KEYS = ["event_idx", "from_bus", "to_bus", "ckt"]
_ONE_A, _ONE_B = ("{}u AS (SELECT event_idx, from_bus, to_bus, ckt, sum(p) AS p, sum(q) AS q, max(angle) AS angle FROM {{flat_{}}} GROUP BY 1, 2, 3, 4)".format(s, s) for s in "ab")
_BOTH = f"{_ONE_A}, {_ONE_B}, fj AS (SELECT coalesce(a.event_idx, b.event_idx) AS event_idx, coalesce(a.from_bus, b.from_bus) AS from_bus, a.p AS pa, b.p AS pb, a.q AS qa, b.q AS qb, a.angle AS aa, b.angle AS ab, a.event_idx IS NOT NULL AS ina, b.event_idx IS NOT NULL AS inb FROM au a FULL JOIN bu b ON a.event_idx = b.event_idx AND a.from_bus = b.from_bus AND a.to_bus = b.to_bus AND a.ckt = b.ckt)"


def _dealt_flat(r: Roles, which: str) -> DataFrame:
    return getattr(r.deal(lineitem=("l_orderkey",), orders=("o_orderkey",)), f"flat_{which}")


def _run(r: Roles, which: str) -> DataFrame:
    return _dealt_flat(r, which).repartition(r.lines, *_KEYS).groupBy(*_KEYS).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.max("angle").alias("angle"))


_register("require_unique", lambda r: compare.require_unique(r.lineitem, ["l_orderkey", "l_linenumber"]), "SELECT count(*) AS duplicated_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicated_rows FROM (SELECT count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) AS d")
_register("coverage", lambda r: compare.coverage(_run(r, "a"), _run(r, "b"), _KEYS, ["q"]), f"{_BOTH}\nFINALLY SELECT count(*) FILTER (WHERE ina AND inb) AS matched, count(*) FILTER (WHERE NOT inb) AS only_a, count(*) FILTER (WHERE NOT ina) AS only_b, 1e2 * count(*) FILTER (WHERE ina AND inb) / count(*) AS match_percent, count(*) FILTER (WHERE ina AND inb AND qa <> qb) AS q_mismatch FROM fj", "match_percent")


def _metric_sql(name: str, a: str, b: str, d: str) -> str:
    return f"""SELECT '{name}' AS "column", count(*) AS n, avg({a}) AS mean_a, avg({b}) AS mean_b, avg({d}) AS mean_diff, avg(abs({d})) AS mean_abs_diff, sqrt(avg(({d}) * ({d}))) AS rms_diff, max(abs({d})) AS max_abs_diff,
 avg(CASE WHEN abs({b}) > 1e-9 THEN 100 * abs({d}) / abs({b}) END) AS mean_percent, avg(CASE WHEN abs({a}) + abs({b}) > 1e-9 THEN 200 * abs({d}) / (abs({a}) + abs({b})) END) AS mean_symmetric_percent, count(*) FILTER (WHERE abs({d}) <= 1e-6 + 1e-6 * abs({b})) AS within FROM fj WHERE ina AND inb"""


_register(
    "numeric_metrics",
    lambda r: compare.numeric_metrics(_run(r, "a"), _run(r, "b"), _KEYS, ["p"], ["angle"]),
    f"{_BOTH}\nFINALLY {_metric_sql('p', 'pa', 'pb', 'pa - pb')} UNION ALL {_metric_sql('angle', 'aa', 'ab', _wrap('aa - ab'))}",
    "mean_a mean_b mean_diff mean_abs_diff rms_diff max_abs_diff mean_percent mean_symmetric_percent",
)
def _stored(r: Roles) -> tuple[str, str]:
    """Run A, and a run of which two of fifty events differ: event 7 in its powers, event 11 in its rows."""
    a, folder = r.deal(lineitem=("l_orderkey",), orders=("o_orderkey",)).fix("flat_a").flat_a, _folder(r)
    b = a.where("NOT (event_idx = 11 AND to_bus % 3 = 0)").withColumn("p", F.when((F.col("event_idx") == 7) & (F.col("ckt") == "2"), F.col("p") * 1.0001).otherwise(F.col("p")))
    for name, run in (("a", a), ("b", b)):
        one = run.repartition(r.lines, *_KEYS).groupBy(*_KEYS).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.min("angle").alias("angle"))
        digests.store_run(one, f"{folder}/{name}", _KEYS, ["p", "q"], ["angle"], bucket=1, tasks=r.lines)
    return f"{folder}/a", f"{folder}/b"


_STORED = """sa AS (SELECT event_idx, from_bus, to_bus, ckt, sum(p) AS p, sum(q) AS q, min(angle) AS angle FROM {flat_a} GROUP BY 1, 2, 3, 4),
sb AS (SELECT event_idx, from_bus, to_bus, ckt, sum(CASE WHEN event_idx = 7 AND ckt = '2' THEN p * 10001e-4 ELSE p END) AS p, sum(q) AS q, min(angle) AS angle FROM {flat_a} WHERE NOT (event_idx = 11 AND to_bus % 3 = 0) GROUP BY 1, 2, 3, 4),
j AS (SELECT a.*, b.event_idx IS NOT NULL AS inb, b.p AS pb, b.q AS qb, b.angle AS angleb FROM sa a LEFT JOIN sb b ON b.event_idx = a.event_idx AND b.from_bus = a.from_bus AND b.to_bus = a.to_bus AND b.ckt = a.ckt)"""
_register(
    "coverage_of_runs",
    lambda r: digests.coverage_of_runs(r.spark, *_stored(r), _KEYS, ["q"]),
    f"{_STORED}\nFINALLY SELECT count(*) FILTER (WHERE inb) AS matched, count(*) FILTER (WHERE NOT inb) AS only_a, CAST(0 AS BIGINT) AS only_b, 1e2 * count(*) FILTER (WHERE inb) / count(*) AS match_percent, CAST(0 AS BIGINT) AS q_mismatch FROM j",
    "match_percent",
)
_register(
    "metrics_of_runs",
    lambda r: digests.metrics_of_runs(r.spark, *_stored(r), _KEYS, ["p", "q"], ["angle"]).select("column", "n", "mean_a", "mean_b", "mean_diff", "mean_abs_diff", "rms_diff", "max_abs_diff", "within"),
    f"{_STORED}\nFINALLY " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, avg({c}) AS mean_a, avg({c}b) AS mean_b, avg({c} - {c}b) AS mean_diff, avg(abs({c} - {c}b)) AS mean_abs_diff, sqrt(avg(({c} - {c}b) * ({c} - {c}b))) AS rms_diff, max(abs({c} - {c}b)) AS max_abs_diff, count(*) FILTER (WHERE abs({c} - {c}b) <= 1e-6 + 1e-6 * abs({c}b)) AS within FROM j WHERE inb" for c in ("p", "q", "angle")),
    "mean_a mean_b mean_diff mean_abs_diff rms_diff max_abs_diff",
)
_register("unmatched_of_runs", lambda r: digests.unmatched_of_runs(r.spark, *_stored(r), _KEYS, ["event_idx"]), f"{_STORED}\nFINALLY SELECT event_idx, count(*) AS only_a, CAST(0 AS BIGINT) AS only_b FROM j WHERE NOT inb GROUP BY 1")
_register(
    "unmatched_by_circuit",
    lambda r: compare.unmatched_by(_run(r, "a"), _run(r, "b"), _KEYS, ["from_bus", "to_bus", "ckt"], ranked=True),
    f"""{_ONE_A}, {_ONE_B}, per AS (SELECT coalesce(a.from_bus, b.from_bus) AS from_bus, coalesce(a.to_bus, b.to_bus) AS to_bus, coalesce(a.ckt, b.ckt) AS ckt, count(*) FILTER (WHERE b.event_idx IS NULL) AS only_a, count(*) FILTER (WHERE a.event_idx IS NULL) AS only_b
 FROM au a FULL JOIN bu b ON a.event_idx = b.event_idx AND a.from_bus = b.from_bus AND a.to_bus = b.to_bus AND a.ckt = b.ckt GROUP BY 1, 2, 3)
FINALLY SELECT *, dense_rank() OVER (ORDER BY only_a + only_b DESC) AS rank FROM per WHERE only_a > 0 OR only_b > 0""",
)
_register("unmatched_by", lambda r: compare.unmatched_by(_run(r, "a"), _run(r, "b"), _KEYS, ["event_idx"]), f"{_BOTH}\nFINALLY SELECT event_idx, count(*) FILTER (WHERE NOT inb) AS only_a, count(*) FILTER (WHERE NOT ina) AS only_b FROM fj GROUP BY 1 HAVING count(*) FILTER (WHERE NOT (ina AND inb)) > 0")
_register(
    "convergence_matrix",
    lambda r: compare.convergence_matrix(r.convergence_a, r.convergence_b),
    'SELECT count(*) FILTER (WHERE a.converged AND b.converged) AS "both", count(*) FILTER (WHERE NOT a.converged AND NOT b.converged) AS neither, count(*) FILTER (WHERE a.converged AND NOT b.converged) AS a_only, count(*) FILTER (WHERE NOT a.converged AND b.converged) AS b_only, 1e2 * count(*) FILTER (WHERE a.converged = b.converged) / count(*) AS agreement_percent FROM {convergence_a} a JOIN {convergence_b} b ON b.name = a.name AND b.type = a.type',
    "agreement_percent",
)
_register(
    "convergence_metrics",
    lambda r: compare.convergence_metrics(r.convergence_a, r.convergence_b),
    f"""fj AS (SELECT a.iterations AS ia, b.iterations AS ib, a.final_tolerance AS ta, b.final_tolerance AS tb, TRUE AS ina, TRUE AS inb FROM {{convergence_a}} a JOIN {{convergence_b}} b ON b.name = a.name AND b.type = a.type
 WHERE a.converged AND b.converged AND a.status_code = 'OK' AND b.status_code = 'OK')
FINALLY {_metric_sql('iterations', 'ia', 'ib', 'ia - ib')} UNION ALL {_metric_sql('final_tolerance', 'ta', 'tb', 'ta - tb')}""",
    "mean_a mean_b mean_diff mean_abs_diff rms_diff max_abs_diff mean_percent mean_symmetric_percent",
)
_register(
    "assert_close_converged",
    lambda r: compare.assert_close(r.convergence_a, r.convergence_b, ["name", "type", "converged", "status_code"], ["final_tolerance"], 1e-6, 1e-6, "converged"),
    """ca AS (SELECT name, type, converged, status_code, CASE WHEN converged THEN final_tolerance END AS x FROM {convergence_a}), cb AS (SELECT name, type, converged, status_code, CASE WHEN converged THEN final_tolerance END AS y FROM {convergence_b}),
cj AS (SELECT a.name AS na, b.name AS nb, x, y FROM ca a FULL JOIN cb b ON b.name = a.name AND b.type = a.type AND b.converged = a.converged AND b.status_code = a.status_code)
FINALLY SELECT count(*) FILTER (WHERE nb IS NULL) AS only_golden, count(*) FILTER (WHERE na IS NULL) AS only_candidate, count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL AND x IS NOT NULL AND abs(x - y) > 1e-6 + 1e-6 * abs(y)) AS final_tolerance_bad FROM cj""",
)
_register("status_transitions", lambda r: compare.status_transitions(r.convergence_a, r.convergence_b), "SELECT a.status_code AS status_a, b.status_code AS status_b, count(*) AS n FROM {convergence_a} a JOIN {convergence_b} b ON b.name = a.name AND b.type = a.type GROUP BY 1, 2")
_register("series_stats", lambda r: compare.series_stats(_dealt_flat(r, "a"), "p", ["event_idx"]), 'SELECT event_idx, count(p) AS "count", avg(p) AS mean, quantile_cont(p, 5e-1) AS median, quantile_cont(p, 95e-2) AS p95, min(p) AS "min", max(p) AS "max" FROM {flat_a} GROUP BY 1', "mean median p95 min max")
_register(
    "annotate_coverage",
    lambda r: compare.annotate_coverage(compare.unmatched_by(_run(r, "a"), _run(r, "b"), _KEYS, ["event_idx"]), r.convergence_a, r.convergence_b),
    f"{_BOTH}, un AS (SELECT event_idx, count(*) FILTER (WHERE NOT inb) AS only_a, count(*) FILTER (WHERE NOT ina) AS only_b FROM fj GROUP BY 1 HAVING count(*) FILTER (WHERE NOT (ina AND inb)) > 0)\nFINALLY SELECT un.event_idx, only_a, only_b, a.converged AS converged_a, a.status_code AS status_a, b.converged AS converged_b, b.status_code AS status_b FROM un LEFT JOIN {{convergence_a}} a ON a.event_idx = un.event_idx LEFT JOIN {{convergence_b}} b ON b.event_idx = un.event_idx",
)
_register(
    "compare_buses",
    lambda r: compare.compare_buses(r.bus, r.bus.where("bus_id % 31 <> 0").withColumns({"base_kv": F.col("base_kv") + F.col("bus_id") % 2, "area": F.when(F.col("bus_id") % 10 == 0, 9).otherwise(F.col("area"))})),
    """SELECT count(*) FILTER (WHERE bus_id % 31 <> 0) AS matched, count(*) FILTER (WHERE bus_id % 31 = 0) AS only_a, CAST(0 AS BIGINT) AS only_b, avg(CASE WHEN bus_id % 31 <> 0 THEN CAST(bus_id % 2 AS DOUBLE) END) AS mean_kv_diff, max(CASE WHEN bus_id % 31 <> 0 THEN CAST(bus_id % 2 AS DOUBLE) END) AS max_kv_diff,
 CAST(0 AS BIGINT) AS name_mismatch, count(*) FILTER (WHERE bus_id % 31 <> 0 AND bus_id % 10 = 0) AS area_mismatch, CAST(0 AS BIGINT) AS zone_mismatch, CAST(0 AS BIGINT) AS owner_mismatch FROM {bus}""",
    "mean_kv_diff max_kv_diff",
)
_register(
    "timer_comparison",
    lambda r: compare.timer_comparison(_timers(r).groupBy("timer").agg(F.sum("seconds").alias("seconds")), _timers(r).where("rank < 10 AND timer < 'R'").groupBy("timer").agg(F.sum("seconds").alias("seconds"))),
    f"{_TIMER}, ta AS (SELECT timer, sum(seconds) AS s FROM tim GROUP BY 1), tb AS (SELECT timer, sum(seconds) AS s FROM tim WHERE rank < 10 AND timer < 'R' GROUP BY 1)\nFINALLY SELECT ta.timer, ta.s AS seconds_a, tb.s AS seconds_b, ta.s / tb.s AS speedup, 100 * (1 - tb.s / ta.s) AS reduction_percent FROM ta LEFT JOIN tb ON tb.timer = ta.timer",
    "seconds_a seconds_b speedup reduction_percent",
)
_register(
    "assert_close",
    lambda r: compare.assert_close(_run(r, "a"), _run(r, "b"), _KEYS, ["p", "q"], 1e-6, 1e-5),
    f"{_BOTH}\nFINALLY SELECT count(*) FILTER (WHERE NOT inb) AS only_golden, count(*) FILTER (WHERE NOT ina) AS only_candidate, count(*) FILTER (WHERE ina AND inb AND abs(pa - pb) > 1e-6 + 1e-5 * abs(pb)) AS p_bad, count(*) FILTER (WHERE ina AND inb AND abs(qa - qb) > 1e-6 + 1e-5 * abs(qb)) AS q_bad FROM fj",
)

# --- coordinate algebra ---------------------------------------------------------------------------------------------

_UNION = "SELECT i, j, sum(re) AS re, sum(im) AS im FROM ({}) AS u GROUP BY 1, 2"
_register("coo_merge", lambda r: coo.merge(r.coo, coo.transpose(r.coo)), _UNION.format("SELECT i, j, re, im FROM {coo} UNION ALL SELECT j, i, re, im FROM {coo}"), "re im")
_register(
    "coo_overwrite",
    lambda r: coo.overwrite(r.lineitem.select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 50).alias("j"), F.col("l_quantity").alias("re"), F.col("l_tax").alias("im"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax").alias("seq"))),
    "SELECT i, j, re, im FROM (SELECT l_suppkey AS i, l_partkey % 50 AS j, l_quantity AS re, l_tax AS im, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_tax DESC) AS n FROM {lineitem}) AS k WHERE n = 1",
)
_register("coo_add", lambda r: coo.add(r.coo, r.coo.where("i < j")), _UNION.format("SELECT i, j, re, im FROM {coo} UNION ALL SELECT i, j, re, im FROM {coo} WHERE i < j"), "re im")
_register("coo_scale", lambda r: coo.scale(r.coo, 2.0, -0.5), "SELECT i, j, re * 2 + im * 5e-1 AS re, im * 2 - re * 5e-1 AS im FROM {coo}", "re im")
_register("add_diagonal", lambda r: coo.add_diagonal(r.deal(lineitem=("l_suppkey", "l_partkey")).coo, _vector(r)), f"{_VEC}\nFINALLY " + _UNION.format("SELECT i, j, re, im FROM {coo} UNION ALL SELECT i, i, re, im FROM vec"), "re im")
_register("multiply_diagonal", lambda r: coo.multiply_diagonal(r.coo, _vector(r)), f"{_VEC}\nFINALLY SELECT c.i, j, CASE WHEN c.i = j THEN c.re * v.re - c.im * v.im ELSE c.re END AS re, CASE WHEN c.i = j THEN c.re * v.im + c.im * v.re ELSE c.im END AS im FROM {{coo}} c JOIN vec v ON v.i = c.i", "re im")
_register("spmv", lambda r: coo.spmv(r.coo, _vector(r)), f"{_VEC}\nFINALLY SELECT c.i, sum(c.re * v.re - c.im * v.im) AS re, sum(c.re * v.im + c.im * v.re) AS im FROM {{coo}} c JOIN vec v ON v.i = c.j GROUP BY 1", "re im")
_register("spmv_transpose", lambda r: coo.spmv_transpose(r.coo, _vector(r)), f"{_VEC}\nFINALLY SELECT c.j AS i, sum(c.re * v.re - c.im * v.im) AS re, sum(c.re * v.im + c.im * v.re) AS im FROM {{coo}} c JOIN vec v ON v.i = c.i GROUP BY 1", "re im")
_register("spgemm", lambda r: coo.spgemm(r.coo, r.coo), "SELECT a.i, b.j, sum(a.re * b.re - a.im * b.im) AS re, sum(a.re * b.im + a.im * b.re) AS im FROM {coo} a JOIN {coo} b ON b.i = a.j GROUP BY 1, 2", "re im")
_register("transpose", lambda r: coo.transpose(r.coo), "SELECT j AS i, i AS j, re, im FROM {coo}", "re im")
_register("diagonal", lambda r: coo.diagonal(r.coo), "SELECT i, re, im FROM {coo} WHERE i = j", "re im")
_register("column", lambda r: coo.column(r.coo, 7), "SELECT i, re, im FROM {coo} WHERE j = 7", "re im")
_register("identity", lambda r: coo.identity(r.coo), "SELECT DISTINCT i, i AS j, 1e0 AS re, 0e0 AS im FROM {coo}")
_register("norms", lambda r: coo.norms(r.coo), "SELECT sum(sqrt(re * re + im * im)) AS norm1, sqrt(sum(re * re + im * im)) AS norm2, max(sqrt(re * re + im * im)) AS norm_inf FROM {coo}", "norm1 norm2 norm_inf")
_register("conjugate", lambda r: coo.conjugate(r.coo), "SELECT i, j, re, -im AS im FROM {coo}", "re im")
_register("real_and_imaginary", lambda r: coo.real(r.coo).union(coo.imaginary(r.coo)), "SELECT i, j, re, 0e0 AS im FROM {coo} UNION ALL SELECT i, j, im, 0e0 FROM {coo}", "re im")
_register("vector_add", lambda r: coo.vector_add(_vector(r), coo.diagonal(r.coo)), f"{_VEC}\nFINALLY SELECT i, sum(re) AS re, sum(im) AS im FROM (SELECT i, re, im FROM vec UNION ALL SELECT i, re, im FROM {{coo}} WHERE i = j) AS u GROUP BY 1", "re im")
_register("element_multiply", lambda r: coo.element_multiply(_vector(r), coo.diagonal(r.coo)), f"{_VEC}, dg AS (SELECT i, re, im FROM {{coo}} WHERE i = j)\nFINALLY SELECT v.i, v.re * coalesce(d.re, 0e0) - v.im * coalesce(d.im, 0e0) AS re, v.re * coalesce(d.im, 0e0) + v.im * coalesce(d.re, 0e0) AS im FROM vec v LEFT JOIN dg d ON d.i = v.i", "re im")
_register("element_divide", lambda r: coo.element_divide(coo.diagonal(r.coo), _vector(r)), f"{_VEC}, dg AS (SELECT i, re, im FROM {{coo}} WHERE i = j)\nFINALLY SELECT v.i, (coalesce(d.re, 0e0) * v.re + coalesce(d.im, 0e0) * v.im) / (v.re * v.re + v.im * v.im) AS re, (coalesce(d.im, 0e0) * v.re - coalesce(d.re, 0e0) * v.im) / (v.re * v.re + v.im * v.im) AS im FROM vec v LEFT JOIN dg d ON d.i = v.i", "re im")

# --- sinks and streams ----------------------------------------------------------------------------------------------

_register("convergence_rows", lambda r: sinks.convergence_rows(r.convergence_a), "SELECT * FROM {convergence_a}")
def _exported(r: Roles) -> DataFrame:
    """All 15 columns, written in buckets of events and read back."""
    path, rows = f"{_folder(r)}/flat", _flat(r)
    sinks.write_flat(rows, path)
    return r.spark.read.parquet(path).select(*rows.columns)


_register(
    "flat_export",
    lambda r: _exported(r),
    f"{_FLAT}\nFINALLY SELECT event_idx, contingency, from_bus, to_bus, ckt, round(p, 4) AS p, round(q, 4) AS q, round(mva, 4) AS mva, round(rate, 4) AS rate, round(loading, 2) AS loading, viol, round(v_from_pu, 6) AS v_from_pu, round(v_to_pu, 6) AS v_to_pu, round(ang_from_deg, 6) AS ang_from_deg, round(ang_to_deg, 6) AS ang_to_deg FROM flat",
)


# --- files: written from the tables, read back by the readers ---------------------------------------------------------


def _folder(r: Roles) -> str:
    return f"{shared_folder(r.spark)}/gridlake-files-{uuid.uuid4().hex}"


def _as_text(r: Roles, rows: DataFrame) -> str:
    """Folder of text files from rows (part, value): a folder per part."""
    path = _folder(r)
    rows.write.partitionBy("part").text(path)
    return path


def _csv(*fields: str) -> F.Column:
    """A comma-joined line; names in quotes are quoted in the line too."""
    return F.concat_ws(",", *[F.concat(F.lit("'"), F.col(f.strip("'")).cast("string"), F.lit("'")) if f.startswith("'") else F.expr(f).cast("string") for f in fields])


def _archive(r: Roles, name: str) -> dict[str, DataFrame]:
    """A section of case files of the network, one a zone, with buses and what stands at them; a circuit is filed at its from bus. Files are written
    line by line, sorted on disk if need be, and read by ranges, so no task holds a file."""
    place = r.bus.select("bus_id", F.col("area").alias("_area"), F.col("zone").alias("_zone"))
    at = lambda f, section, *fields: f.join(place, "bus_id").select(F.col("_zone").alias("part"), F.lit(section).alias("section"), _csv(*fields).alias("line"))
    lines = at(r.bus, 0, "bus_id", "'name'", "base_kv", "type", "area", "zone", "owner", "v_pu", "angle_deg")
    lines = lines.union(at(r.load, 1, "bus_id", "'load_id'", "status", "_area", "_zone", "pl", "ql", "ip", "iq", "yp", "yq"))
    lines = lines.union(at(r.shunt, 2, "bus_id", "'shunt_id'", "status", "gl", "bl"))
    lines = lines.union(at(r.generator, 3, "bus_id", "'gen_id'", "pg", "qg", "qmax", "qmin", "1.0", "0", "100.0", "0", "1", "0", "0", "1", "status", "100.0", "pmax", "pmin"))
    branch = r.circuit.withColumn("bus_id", F.col("from_bus"))
    lines = lines.union(at(branch, 4, "from_bus", "to_bus", "'ckt'", "r", "x", "b", "rate_a", "rate_b", "rate_c", "0", "0", "0", "0", "status"))
    last = len(archives.SECTIONS)
    marks = [(-1, n, text) for n, text in enumerate(("0, 100.0, 33", "case", "of a zone"))] + [(k, 1, "0 / end") for k in range(last)] + [(last, 0, "Q")]
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit(n).alias("nth"), F.lit(text).alias("line")) for k, n, text in marks])).alias("m")
    around = r.bus.select(F.col("zone").alias("part")).distinct().select("part", marks).select("part", "m.*")
    rows = lines.select("part", "section", F.lit(0).alias("nth"), "line").unionByName(around)
    path = _folder(r)
    rows.repartition("part").sortWithinPartitions("part", "section", "nth", "line").select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)
    return ranges.read_case_sections(r.spark, path, [name])


def _case_section(name: str) -> Callable[[Roles], DataFrame]:
    return lambda r: archives.typed_section(_archive(r, name), name).drop("file")


_register("read_case_buses", _case_section("bus"), "SELECT * FROM {bus}", "v_pu")
_register("read_case_loads", _case_section("load"), "SELECT l.bus_id, load_id, status, area, zone, pl, ql, ip, iq, yp, yq FROM {load} l JOIN {bus} b ON b.bus_id = l.bus_id", "pl ql ip iq yp yq")
_register("read_case_shunts", _case_section("fixed_shunt"), "SELECT bus_id, shunt_id, status, gl, bl FROM {shunt}", "gl bl")
_register("read_case_generators", _case_section("generator"), "SELECT bus_id, gen_id, pg, qg, qmax, qmin, 1e0 AS vs, 0 AS ireg, 1e2 AS mbase, status, 1e2 AS rmpct, pmax, pmin FROM {generator}", "pg qg qmax qmin pmax pmin")
_register("read_case_branches", _case_section("branch"), "SELECT from_bus, to_bus, ckt, r, x, b, rate_a, rate_b, rate_c, status FROM {circuit}", "r x b rate_a rate_b rate_c")


def _windings(r: Roles) -> DataFrame:
    """A three-winding transformer between every bus and the next two."""
    z = lambda k: (F.col("bus_id") % k + 1) / 100
    parts = {f"{q}{p}": z(k) for q, p, k in (("r", "12", 7), ("x", "12", 11), ("r", "23", 13), ("x", "23", 17), ("r", "31", 19), ("x", "31", 23))}
    bases = {f"sb{p}": F.lit(v) for p, v in (("12", 50.0), ("23", 100.0), ("31", 0.0))}
    bases |= {"stat": (F.col("bus_id") % 5).cast("int"), "b1": F.col("bus_id") % 4 / 100.0} | {f"{n}{i}": F.col("bus_id") % k + i / 8 for i in (1, 2, 3) for n, k in (("tap", 3), ("shift_deg", 30), ("rate_a", 90))}
    return r.bus.select(F.col("bus_id").alias("bus_i"), (F.col("bus_id") + 1).alias("bus_j"), (F.col("bus_id") + 2).alias("bus_k"), F.lit("1").alias("ckt"), *[v.alias(k) for k, v in (parts | bases).items()])


_WINDINGS = """w AS (SELECT *, (SELECT max(bus_id) FROM {bus}) + row_number() OVER (ORDER BY i) AS star FROM (SELECT bus_id AS i, bus_id + 1 AS j, bus_id + 2 AS k, bus_id % 5 AS s, 2e0 * (bus_id % 7 + 1) / 100 AS r12, 2e0 * (bus_id % 11 + 1) / 100 AS x12, (bus_id % 13 + 1) / 1e2 AS r23, (bus_id % 17 + 1) / 1e2 AS x23, (bus_id % 19 + 1) / 1e2 AS r31, (bus_id % 23 + 1) / 1e2 AS x31 FROM {bus} WHERE bus_id % 5 <> 0) AS live)"""
_register(
    "expand_three_winding",
    lambda r: archives.expand_three_winding(_windings(r), r.bus)[1],
    f"""{_WINDINGS}
FINALLY SELECT i AS from_bus, star AS to_bus, '1' AS ckt, (r12 + r31 - r23) / 2 AS r, (x12 + x31 - x23) / 2 AS x, i % 3 + 125e-3 AS tap, i % 30 + 125e-3 AS shift_deg, i % 90 + 125e-3 AS rate_a, 0e0 AS rate_b, 0e0 AS rate_c, 0e0 AS g1, i % 4 / 1e2 AS b1, CAST(CASE WHEN s IN (1, 2, 3) THEN 1 ELSE 0 END AS INT) AS status FROM w
 UNION ALL SELECT j, star, '1', (r12 + r23 - r31) / 2, (x12 + x23 - x31) / 2, i % 3 + 25e-2, i % 30 + 25e-2, i % 90 + 25e-2, 0e0, 0e0, 0e0, 0e0, CASE WHEN s IN (1, 3, 4) THEN 1 ELSE 0 END FROM w
 UNION ALL SELECT k, star, '1', (r23 + r31 - r12) / 2, (x23 + x31 - x12) / 2, i % 3 + 375e-3, i % 30 + 375e-3, i % 90 + 375e-3, 0e0, 0e0, 0e0, 0e0, CASE WHEN s IN (1, 2, 4) THEN 1 ELSE 0 END FROM w""",
    "r x tap shift_deg rate_a rate_b rate_c g1 b1",
)
_register("star_buses", lambda r: archives.expand_three_winding(_windings(r), r.bus)[0], f"{_WINDINGS}\nFINALLY SELECT star AS bus_id, concat('DUMMY_BUS-', i, '-', j, '-', k) AS name, area, owner, 1e0 AS v_pu, 0e0 AS angle_deg FROM w JOIN {{bus}} ON bus_id = i", "v_pu angle_deg")


def _transformers(r: Roles) -> DataFrame:
    """Case files whose transformer section has every circuit with a tap: four lines each, with the unit codes that from and to bus choose."""
    c = r.circuit.where("tap <> 0").withColumns({"cw": F.col("from_bus") % 2 + 1, "cz": F.col("to_bus") % 2 + 1})
    kv = F.when(F.col("cw") == 2, 110.0).otherwise(1.0)
    lines = [F.concat_ws(",", "from_bus", "to_bus", F.lit(0), F.concat(F.lit("'"), "ckt", F.lit("'")), "cw", "cz", F.lit("1,0,0,2,'NAME'"), "status"), F.concat_ws(",", "r", "x", F.lit(25 + 5 * 10)), F.concat_ws(",", F.col("tap") * kv, F.lit(110.0), "shift_deg", "rate_a", "rate_b", "rate_c"), F.concat_ws(",", F.lit(1.02) * kv, F.lit(110.0))]
    key = ["part", "o", "from_bus", "to_bus", "ckt", "nth"]
    body = c.select((F.col("from_bus") % 16).alias("part"), F.lit(1).alias("o"), "from_bus", "to_bus", "ckt", F.posexplode(F.array(*lines)).alias("nth", "value"))
    head = ["0, 100.0, 33", "one", "two", *["0 / empty section"] * archives.SECTIONS.index("transformer")]
    none = [F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string")]
    around = r.spark.range(16).select(F.col("id").alias("part"), F.posexplode(F.array(*map(F.lit, [*head, "0 / end", "Q"]))).alias("nth", "value"))
    around = around.select("part", F.when(F.col("nth") < len(head), 0).otherwise(2), *none, "nth", "value")
    path = _folder(r)
    body.union(around).repartition("part").sortWithinPartitions(*key).select("part", "value").write.partitionBy("part").text(path)
    return archives.transformer_tables_of(ranges.read_case_sections(r.spark, path, ["transformer"])["transformer"])[0].drop("file")


_register(
    "read_case_transformers",
    _transformers,
    """t AS (SELECT *, 102e-2 * 102e-2 * CASE WHEN to_bus % 2 = 0 THEN 1e0 ELSE 1e2 / 75 END AS onto FROM {circuit} WHERE tap <> 0)
FINALLY SELECT from_bus, to_bus, ckt, r * onto AS r, x * onto AS x, rate_a, rate_b, rate_c, tap / 102e-2 AS tap, shift_deg, status FROM t""",
    "r x rate_a rate_b rate_c tap shift_deg",
)
_register(
    "read_dynamic_archive",
    lambda r: archives.read_dynamic_archive(r.spark, _as_text(r, r.generator.select((F.col("bus_id") % 16).alias("part"), F.concat(F.concat_ws(" ", "bus_id", F.lit("'GENROU'"), F.concat(F.lit("'"), "gen_id", F.lit(" '")), F.col("pg").cast("string")), F.lit("\n  "), F.col("pmax").cast("string"), F.lit(" /")).alias("value")))).select("bus_id", "model", "tag", F.col("params")[0].alias("pg"), F.col("params")[1].alias("pmax"), F.size("params").alias("n")),
    "SELECT bus_id, 'GENROU' AS model, gen_id AS tag, pg, pmax, 2 AS n FROM {generator}",
    "pg pmax",
)
_register(
    "read_bus_table",
    lambda r: archives.read_bus_table(r.spark, _as_text(r, r.voltage.groupBy("bus_id").agg(F.array_sort(F.collect_list(F.struct("event_idx", "v_pu"))).alias("v")).select((F.col("bus_id") % 16).alias("part"), F.concat_ws(" ", "bus_id", F.lit("T1"), F.array_join(F.transform("v", lambda x: x["v_pu"].cast("string")), " ")).alias("value")))),
    "SELECT bus_id, 'T1' AS tag, event_idx AS scenario_idx, v_pu AS value FROM {voltage}",
    "value",
)


def _series_file(r: Roles) -> str:
    wide = r.customer.groupBy((F.col("c_custkey") % 40).cast("double").alias("time-40")).pivot("c_nationkey", list(range(25))).agg(F.sum("c_acctbal"))
    path = _folder(r)
    wide.toDF("time-40", *[f"balance-{i}" for i in range(25)]).write.csv(path, header=True)
    return path


_register(
    "read_series_wide",
    lambda r: archives.read_series_wide(r.spark, _series_file(r))[0],
    "SELECT n_nationkey AS bus_id, t, sum(c_acctbal) AS value FROM {nation} CROSS JOIN (SELECT DISTINCT CAST(c_custkey % 40 AS DOUBLE) AS t FROM {customer}) AS g LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_custkey % 40 = t GROUP BY 1, 2",
    "value",
)


def _xml(r: Roles, rows: DataFrame, part: F.Column, top: str, tag: str, **fields: F.Column) -> str:
    """Folder of lists, LISTS parts, each in files that have some DEALT_ROWS rows at most where there are many. Fields are shuffled, and files written line by
    line, sorted on disk if need be, so no task holds a list."""
    files = max(1, r.lines // LISTS)
    rows = rows.select(part.alias("part"), F.pmod(F.xxhash64(*fields.values()), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("nth"), *[value.cast("string").alias(name) for name, value in fields.items()])
    whole = r.spark.range(LISTS * files).select((F.col("id") % LISTS).alias("part"), F.floor(F.col("id") / LISTS).cast("int").alias("file"), F.explode(F.array(F.lit(0), F.lit(2))).alias("nth"))
    dealt = rows.unionByName(whole, allowMissingColumns=True).repartition(r.lines, "part", "file").sortWithinPartitions("part", "file", "nth")
    line = F.concat(F.lit(f"<{tag}>"), *[x for name in fields for x in (F.lit(f"<{name}>"), F.col(name), F.lit(f"</{name}>"))], F.lit(f"</{tag}>"))
    text = F.when(F.col("nth") == 0, f"<{top}>").when(F.col("nth") == 2, f"</{top}>").otherwise(line)
    path = _folder(r)
    dealt.select("part", "file", text.alias("value")).where("value IS NOT NULL").write.partitionBy("part", "file").text(path)
    return path


_register(
    "read_measurements",
    lambda r: lists.read_measurements(r.spark, _xml(r, r.measurement, F.col("bus_id") % LISTS, "Measurements", "Measurement", Type=F.col("type"), Bus=F.col("bus_id"), Value=F.col("value"), Deviation=F.col("deviation"))).select("type", "bus_id", "value", "deviation"),
    "SELECT type, bus_id, value, deviation FROM {measurement}",
    "value deviation",
)
_register(
    "read_contingencies",
    lambda r: lists.read_contingencies(r.spark, _xml(r, scenarios.n1_branches(r.circuit), F.col("from_bus") % LISTS, "Contingencies", "Contingency", contingencyType=F.col("type"), contingencyName=F.col("scenario"), contingencyLineBuses=F.concat_ws(" ", "from_bus", "to_bus"), CKT=F.col("ckt"))).select("name", "type", "pos", "from_bus", "to_bus", "ckt"),
    "SELECT 'BR_' || from_bus || '_' || to_bus || '_' || ckt AS name, 'Line' AS type, 0 AS pos, from_bus, to_bus, ckt FROM {circuit}",
)
_register(
    "read_monitor_list",
    lambda r: lists.read_monitor_list(r.spark, _as_text(r, r.circuit.select((F.col("from_bus") % 16).alias("part"), F.concat_ws(",", "from_bus", "to_bus", F.concat(F.lit("'"), "ckt", F.lit(" '"))).alias("value")))),
    "SELECT from_bus, to_bus, ckt FROM {circuit}",
)
_register(
    "read_fault_events",
    lambda r: lists.read_fault_events(r.spark, _xml(r, r.circuit, F.col("from_bus") % LISTS, "Faults", "faultEvent", beginFault=F.col("r"), endFault=F.col("r") + 1, faultBranch=F.concat_ws(" ", "from_bus", "to_bus"), timeStep=F.lit(0.005))),
    "SELECT r AS begin, r + 1 AS \"end\", from_bus, to_bus, 5e-3 AS step FROM {circuit}",
    "begin end",
)


def _logs(r: Roles) -> str:
    lines = r.lineitem.groupBy((F.col("l_suppkey") % 8).alias("part"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most"))
    text = F.concat(F.lit("Timing statistics for: T"), F.col("l_suppkey").cast("string"), F.lit("\n   Maximum time:    "), F.col("most").cast("double").cast("string"), F.lit("\nNumber of tasks executed on process "), F.col("l_suppkey").cast("string"), F.lit(": "), F.col("n").cast("string"))
    return _as_text(r, lines.select("part", text.alias("value")))


_register("read_run_timers", lambda r: archives.read_run_logs(r.spark, _logs(r))[0].select("timer", "stat", "seconds"), "SELECT 'T' || l_suppkey AS timer, 'maximum' AS stat, CAST(max(l_quantity) AS DOUBLE) AS seconds FROM {lineitem} GROUP BY l_suppkey")
_register("read_run_tasks", lambda r: archives.read_run_logs(r.spark, _logs(r))[1].select("rank", "tasks"), "SELECT CAST(l_suppkey AS INT) AS rank, CAST(count(*) AS INT) AS tasks FROM {lineitem} GROUP BY l_suppkey")


def _written_delta(r: Roles) -> DataFrame:
    path = _folder(r)
    sinks.write_delta(_delta(r), path)
    return r.spark.read.parquet(path).select("event_idx", "contingency", "type", "from_bus", "to_bus", "ckt", "base_mva", "cont_mva", "v_from_base", "v_to_cont", "cont_event_facility", "event_bucket")


_register(
    "write_delta",
    _written_delta,
    f"{_DELTA}\nFINALLY SELECT event_idx, contingency, type, from_bus, to_bus, ckt, round(base_mva, 4) AS base_mva, round(cont_mva, 4) AS cont_mva, round(v_from_base, 6) AS v_from_base, round(v_to_cont, 6) AS v_to_cont, cont_event_facility, CAST(event_idx // 256 AS INT) AS event_bucket FROM delta",
)


def _written_results(r: Roles) -> DataFrame:
    path = _folder(r)
    sinks.write_results({"generators": electrical.generator_result(r.generator)}, path)
    return r.spark.read.csv(f"{path}/generators", header=True, schema="bus_id long, gen_id string, p double, q double, qmax double, qmin double, v_set double, status int")


_register("write_results", _written_results, "SELECT bus_id, gen_id, CASE WHEN status = 1 THEN pg ELSE 0e0 END AS p, CASE WHEN status = 1 THEN qg ELSE 0e0 END AS q, qmax, qmin, CAST(NULL AS DOUBLE) AS v_set, status FROM {generator}", "p q qmax qmin")
def _result_set(r: Roles) -> DataFrame:
    """The five tables of a result set, written and read back, as rows (table, event_idx, bus, other, tag, a, b)."""
    flow, path = _flow(r), f"{_folder(r)}/set"
    tables = {
        "buses": electrical.bus_result(r.bus, r.generator, r.load, r.voltage).select("event_idx", "bus_id", "v_pu", "p_net"),
        "branches": electrical.branch_result(flow).select("event_idx", "from_bus", "to_bus", "ckt", "p_from", "loading"),
        "generators": electrical.generator_result(r.generator),
        "convergence": _cases(r).select("event_idx", "name", "iterations", "final_tolerance"),
        "summary": limits.scenario_summary(_cases(r), _voltage_bad(r), _overloads(r)).select("event_idx", "type", "has_voltage_violation", "has_branch_violation"),
    }
    sinks.write_results(tables, path)
    t = {name: r.spark.read.csv(f"{path}/{name}", header=True, schema=table.schema) for name, table in tables.items()}
    no, flag = (lambda kind: F.lit(None).cast(kind)), (lambda c: F.col(c).cast("int").cast("double"))
    return (
        t["buses"].select(F.lit("buses").alias("table"), "event_idx", F.col("bus_id").alias("bus"), no("long").alias("other"), no("string").alias("tag"), F.col("v_pu").alias("a"), F.col("p_net").alias("b"))
        .union(t["branches"].select(F.lit("branches"), "event_idx", "from_bus", "to_bus", "ckt", "p_from", "loading"))
        .union(t["generators"].select(F.lit("generators"), no("int"), "bus_id", no("long"), "gen_id", "p", "qmax"))
        .union(t["convergence"].select(F.lit("convergence"), "event_idx", no("long"), no("long"), "name", F.col("iterations").cast("double"), "final_tolerance"))
        .union(t["summary"].select(F.lit("summary"), "event_idx", no("long"), no("long"), "type", flag("has_voltage_violation"), flag("has_branch_violation")))
    )


_register(
    "result_set",
    _result_set,
    f"""{_VV}, {_OVER}, cas AS (SELECT c.* FROM {{convergence_a}} c JOIN {{scenario}} s ON s.event_idx = c.event_idx)
FINALLY SELECT 'buses' AS "table", v.event_idx, v.bus_id AS bus, CAST(NULL AS BIGINT) AS other, CAST(NULL AS VARCHAR) AS tag, v.v_pu AS a, coalesce(p_gen, 0e0) - coalesce(p_load, 0e0) AS b FROM {{voltage}} v LEFT JOIN (SELECT bus_id, sum(pg) AS p_gen FROM {{generator}} WHERE status = 1 GROUP BY 1) AS g ON g.bus_id = v.bus_id LEFT JOIN (SELECT bus_id, sum(pl) AS p_load FROM {{load}} WHERE status = 1 GROUP BY 1) AS d ON d.bus_id = v.bus_id
 UNION ALL SELECT 'branches', event_idx, from_bus, to_bus, ckt, p_from, CASE WHEN rate_a > 0 THEN 100 * greatest(sqrt(p_from * p_from + q_from * q_from), sqrt(p_to * p_to + q_to * q_to)) / rate_a ELSE 0e0 END FROM flow WHERE status = 1
 UNION ALL SELECT 'generators', NULL, bus_id, NULL, gen_id, CASE WHEN status = 1 THEN pg ELSE 0e0 END, qmax FROM {{generator}}
 UNION ALL SELECT 'convergence', CAST(event_idx AS INT), NULL, NULL, name, CAST(iterations AS DOUBLE), final_tolerance FROM cas
 UNION ALL SELECT 'summary', CAST(event_idx AS INT), NULL, NULL, type, CASE WHEN event_idx IN (SELECT event_idx FROM vv) THEN 1e0 ELSE 0e0 END, CASE WHEN event_idx IN (SELECT event_idx FROM ov WHERE ckt <> '5') THEN 1e0 ELSE 0e0 END FROM cas""",
    "a b",
)


def _written_cases(r: Roles) -> str:
    """Folder of the nested cases of all scenarios: their buses, circuits in service and generators."""
    _flow(r)
    summary = limits.scenario_summary(_cases(r), _voltage_bad(r), _overloads(r))
    events = r.scenario.select("event_idx")
    tables = {
        "buses": (electrical.bus_result(r.bus, r.generator, r.load, r.voltage).select("event_idx", "bus_id", "v_pu", "angle_deg", "p_net", "q_net"), ["bus_id", None, None]),
        "branches": (electrical.branch_result(_flow(r)).select("event_idx", "from_bus", "to_bus", "ckt", "p_from", "q_from", "p_to", "q_to", "loading"), ["from_bus", "to_bus", "ckt"]),
        "generators": (electrical.generator_result(r.generator).crossJoin(F.broadcast(events)), ["bus_id", None, "gen_id"]),
    }
    path = f"{_folder(r)}/cases"
    nested.write_cases(summary, tables, path)
    return path


_register(
    "nested_case_json",  # lines as they were written, those above CASE_BYTES in pieces (nth); nested_case_rows compares what they hold
    lambda r: nested.read_lines(r.spark, _written_cases(r), CASE_BYTES),
    None,
)
def _case_rows(r: Roles) -> DataFrame:
    """The written cases, read back and taken apart: section, keys and some values of every item."""
    path, no = _written_cases(r), lambda kind: F.lit(None).cast(kind)
    cases = nested.read_items(r.spark, path, 0, "event_idx long, name string, has_voltage_violation boolean, has_branch_violation boolean, solution struct<convergence: struct<converged: boolean, iterations: int>>")
    buses = nested.read_items(r.spark, path, 1, "bus_id: long, v_pu: double, p_net: double")
    branches = nested.read_items(r.spark, path, 2, "from_bus: long, to_bus: long, ckt: string, p_from: double, q_to: double, loading: double")
    generators = nested.read_items(r.spark, path, 3, "bus_id: long, gen_id: string, p: double, status: int")
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    heads = cases.select("event_idx", F.lit("case").alias("section"), no("long").alias("bus"), no("long").alias("other"), F.col("name").alias("tag"), F.col("solution.convergence.iterations").cast("double").alias("a"), flag("has_voltage_violation").alias("b"), flag("has_branch_violation").alias("c"))
    return (
        heads.union(buses.select("event_idx", F.lit("bus"), "bus_id", no("long"), no("string"), "v_pu", "p_net", no("double")))
        .union(branches.select("event_idx", F.lit("branch"), "from_bus", "to_bus", "ckt", "p_from", "q_to", "loading"))
        .union(generators.select("event_idx", F.lit("generator"), "bus_id", no("long"), "gen_id", "p", F.col("status").cast("double"), no("double")))
    )


_register(
    "nested_case_rows",
    _case_rows,
    f"""{_VV}, {_OVER}, cas AS (SELECT c.event_idx, name, iterations FROM {{convergence_a}} c JOIN {{scenario}} s ON s.event_idx = c.event_idx)
FINALLY SELECT event_idx, 'case' AS section, CAST(NULL AS BIGINT) AS bus, CAST(NULL AS BIGINT) AS other, name AS tag, CAST(iterations AS DOUBLE) AS a, CASE WHEN event_idx IN (SELECT event_idx FROM vv) THEN 1e0 ELSE 0e0 END AS b, CASE WHEN event_idx IN (SELECT event_idx FROM ov WHERE ckt <> '5') THEN 1e0 ELSE 0e0 END AS c FROM cas
 UNION ALL SELECT v.event_idx, 'bus', v.bus_id, NULL, NULL, v.v_pu, coalesce(p_gen, 0e0) - coalesce(p_load, 0e0), NULL FROM {{voltage}} v JOIN cas ON cas.event_idx = v.event_idx LEFT JOIN (SELECT bus_id, sum(pg) AS p_gen FROM {{generator}} WHERE status = 1 GROUP BY 1) AS g ON g.bus_id = v.bus_id LEFT JOIN (SELECT bus_id, sum(pl) AS p_load FROM {{load}} WHERE status = 1 GROUP BY 1) AS d ON d.bus_id = v.bus_id
 UNION ALL SELECT f.event_idx, 'branch', from_bus, to_bus, ckt, p_from, q_to, CASE WHEN rate_a > 0 THEN 100 * greatest(sqrt(p_from * p_from + q_from * q_from), sqrt(p_to * p_to + q_to * q_to)) / rate_a ELSE 0e0 END FROM flow f JOIN cas ON cas.event_idx = f.event_idx WHERE status = 1
 UNION ALL SELECT cas.event_idx, 'generator', bus_id, NULL, gen_id, CASE WHEN status = 1 THEN pg ELSE 0e0 END, CAST(status AS DOUBLE), NULL FROM {{generator}} CROSS JOIN cas""",
    "a b c",
)


def _stream(r: Roles, name: str) -> DataFrame:
    """A given table as a stream of its files (a pattern, as the table may be a single file)."""
    table = getattr(r, name)
    return r.spark.readStream.schema(table.schema).parquet(f"{r.sf_dir}/{name}.parque[t]")


_register(
    "stream_excursion",
    lambda r: streams.drained(streams.stream_excursion(r.spark.sql(roles.SQL["series"], events=_stream(r, "events")), start=5.0)),
    f"{_EXCURSION}\nFINALLY SELECT o.machine, t, value, 'up' AS side FROM up JOIN ord o ON o.machine = up.machine AND o.n = up.n WHERE hit UNION ALL SELECT o.machine, t, value, 'down' FROM down JOIN ord o ON o.machine = down.machine AND o.n = down.n WHERE hit",
    "t value",
)


_register(
    "stream_excursion_in_order",
    lambda r: streams.drained(streams.stream_excursion_in_order(r.spark.sql(roles.SQL["series"], events=_stream(r, "events")).withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long"))), "100 seconds", start=5.0), streams.ROCKSDB),
    f"{_EXCURSION}, mark AS (SELECT max(CAST(t * 1000 AS BIGINT)) - 100000 AS ms FROM ord)\nFINALLY SELECT o.machine, t, value, 'up' AS side FROM up JOIN ord o ON o.machine = up.machine AND o.n = up.n JOIN mark ON CAST(t * 1000 AS BIGINT) < ms WHERE hit UNION ALL SELECT o.machine, t, value, 'down' FROM down JOIN ord o ON o.machine = down.machine AND o.n = down.n JOIN mark ON CAST(t * 1000 AS BIGINT) < ms WHERE hit",
    "t value",
)


def _arriving(frame: DataFrame) -> DataFrame:
    return frame.select((F.col("l_orderkey") % 50).alias("event_idx"), F.col("l_suppkey").alias("from_bus"), F.col("l_partkey").alias("to_bus"), F.col("l_linenumber").cast("string").alias("ckt"), (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("q"))


_register(
    "stream_violations",
    lambda r: streams.drained(streams.stream_violations(_arriving(_stream(r, "lineitem")), _arriving(r.lineitem).groupBy("from_bus", "to_bus", "ckt").agg((F.avg("p") + 5).alias("rate_a"), F.lit(0.0).alias("rate_b"), F.lit(0.0).alias("rate_c")))).select("event_idx", "from_bus", "to_bus", "ckt", "mva", "rate"),
    "arr AS (SELECT l_orderkey % 50 AS event_idx, l_suppkey AS from_bus, l_partkey AS to_bus, CAST(l_linenumber AS VARCHAR) AS ckt, l_extendedprice / 1000 AS p, l_quantity AS q FROM {lineitem}), rat AS (SELECT from_bus, to_bus, ckt, avg(p) + 5 AS rate FROM arr GROUP BY 1, 2, 3)\nFINALLY SELECT event_idx, arr.from_bus, arr.to_bus, arr.ckt, sqrt(p * p + q * q) AS mva, rate FROM arr JOIN rat ON rat.from_bus = arr.from_bus AND rat.to_bus = arr.to_bus AND rat.ckt = arr.ckt WHERE sqrt(p * p + q * q) > rate",
    "mva rate",
)
_register(
    "stream_watch",
    lambda r: streams.drained(streams.stream_watch(_stream(r, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("bus_id"), F.lit(None).cast("string").alias("tag"), "event_id", "value"), r.customer.where("c_custkey % 3 = 0").select(F.lit("CLICK ").alias("type"), F.col("c_custkey").alias("bus_id"), F.lit("").alias("tag")))),
    "SELECT event_type AS type, user_id AS bus_id, '' AS tag, event_id, value FROM {events} WHERE event_type = 'click' AND user_id IN (SELECT c_custkey FROM {customer} WHERE c_custkey % 3 = 0)",
)
