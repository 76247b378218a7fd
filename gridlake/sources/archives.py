"""Readers of archives of many files: sectioned case files, device parameters, bus tables, series, logs.

Each file is one row of the text source; everything after that is split and exploded by expressions, so a
directory of many files is read by many tasks. A single file is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridlake.functions.ordering import number

#: Fixed order of the sections of version 33 case files.
SECTIONS = (
    "bus", "load", "fixed_shunt", "generator", "branch", "transformer", "area", "two_terminal", "vsc", "impedance_correction",
    "multi_terminal", "multi_section", "zone", "inter_area", "owner", "facts", "switched_shunt",
)
#: Lines before the first section: the case line and two titles.
HEADER_LINES = 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all files below ``path``; line numbers start at 0."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def fields_of(line: Column) -> Column:
    """Trimmed fields of a line; quoted ones keep their commas."""
    return F.transform(F.split(line, r""",(?=(?:[^']*'[^']*')*[^']*$)"""), lambda field: F.trim(field))


def read_case_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Section name -> (file, line_no, fields array<string>) for all case files below ``path``.

    A line whose first field is 0 (alone or before a comment after ``/``) ends a section, Q ends the file. Quoted fields keep their commas;
    blanks around fields and trailing comments are trimmed. The running count of ends in a file names the section.
    """
    lines = _lines(spark, path).where(f"line_no >= {HEADER_LINES}")
    bare = F.trim(F.regexp_replace("line", r"""^((?:[^'"/]|'[^']*'|"[^"]*")*)/.*$""", "$1"))
    lines = lines.withColumn("line", bare)
    is_end = F.col("line").rlike(r"^0\s*(,.*)?$") & ~F.col("line").rlike(r"^0\s*,\s*\S")
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0))
    quit_line = F.upper("line") == "Q"
    rows = lines.withColumns({"_end": is_end, "_section": ended, "_quit": F.coalesce(F.max(quit_line.cast("int")).over(before), F.lit(0))})
    rows = rows.where(~F.col("_end") & (F.col("_quit") == 0) & ~quit_line & (F.col("line") != ""))
    rows = rows.select("file", "line_no", "_section", fields_of(F.col("line")).alias("fields"))
    return {name: rows.where(F.col("_section") == i).select("file", "line_no", "fields") for i, name in enumerate(SECTIONS)}


def bus_table_of(section: DataFrame) -> DataFrame:
    """Typed bus rows of the bus section."""
    f = lambda i, t: F.expr(f"try_cast(get(fields, {i}) AS {t})")
    return section.select("file", f(0, "bigint").alias("bus_id"), F.trim(F.regexp_replace(F.expr("get(fields, 1)"), "'", "")).alias("name"), f(2, "double").alias("base_kv"), f(3, "int").alias("type"), f(4, "int").alias("area"), f(5, "int").alias("zone"), f(6, "int").alias("owner"), f(7, "double").alias("v_pu"), f(8, "double").alias("angle_deg"))


def branch_table_of(section: DataFrame) -> DataFrame:
    """Typed circuit rows of the branch section; a missing status is on."""
    f = lambda i, t: F.expr(f"try_cast(get(fields, {i}) AS {t})")
    tag = F.trim(F.regexp_replace(F.expr("get(fields, 2)"), "'", ""))
    return section.select("file", f(0, "bigint").alias("from_bus"), f(1, "bigint").alias("to_bus"), tag.alias("ckt"), f(3, "double").alias("r"), f(4, "double").alias("x"), f(5, "double").alias("b"), f(6, "double").alias("rate_a"), f(7, "double").alias("rate_b"), f(8, "double").alias("rate_c"), F.coalesce(f(13, "int"), F.lit(1)).alias("status"))


#: Fields of the other sections that are read: name, type, place in the line.
_FIELDS = {
    "load": "bus_id bigint 0, load_id string 1, status int 2, area int 3, zone int 4, pl double 5, ql double 6, ip double 7, iq double 8, yp double 9, yq double 10",
    "fixed_shunt": "bus_id bigint 0, shunt_id string 1, status int 2, gl double 3, bl double 4",
    "generator": "bus_id bigint 0, gen_id string 1, pg double 2, qg double 3, qmax double 4, qmin double 5, vs double 6, ireg bigint 7, mbase double 8, status int 14, rmpct double 15, pmax double 16, pmin double 17",
    "area": "number int 0, isw bigint 1, pdes double 2, ptol double 3, name string 4",
    "zone": "number int 0, name string 1",
    "owner": "number int 0, name string 1",
    "inter_area": "from_area int 0, to_area int 1, tag string 2, transfer double 3",
    "switched_shunt": "bus_id bigint 0, modsw int 1, status int 3, vswhi double 4, vswlo double 5, swrem bigint 6, binit double 9",
}


def _field(line: str, place: int, kind: str) -> Column:
    if kind == "string":
        return F.trim(F.regexp_replace(F.expr(f"get({line}, {place})"), "['\"]", ""))
    return F.expr(f"try_cast(get({line}, {place}) AS {kind})")


def typed_section(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Typed rows, with their file, of any section but transformers; fields that are missing or no numbers are null. Switched shunts have
    ``steps``, an array of (n, b), from the tenth field on."""
    if name in ("bus", "branch"):
        return (bus_table_of if name == "bus" else branch_table_of)(tables[name])
    fields = [f.split() for f in _FIELDS[name].split(", ")]
    columns = [_field("fields", int(place), kind).alias(column) for column, kind, place in fields]
    if name == "switched_shunt":
        pair = "named_struct('n', try_cast(get(fields, 10 + 2 * k) AS int), 'b', try_cast(get(fields, 11 + 2 * k) AS double))"
        columns.append(F.expr(f"filter(transform(sequence(0, 7), k -> {pair}), s -> s.n > 0)").alias("steps"))
    return tables[name].select("file", *columns)


def transformer_tables_of(section: DataFrame, sbase: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(two-winding, three-winding) transformers of a transformer section.

    A record spans four lines, five with a third bus; its first line is the one that has a quoted field, so records are told
    apart by a running count in their file. Two windings: (file, from_bus, to_bus, ckt, r, x, rate_a, rate_b, rate_c, tap, shift_deg, status). tap is the ratio of
    both windings' ratios, each over its nominal voltage where the unit code CW is 2; r and x are times the square of the second winding's
    ratio and, unless CZ is 1 (system base already), taken from the winding's base to the system's. Three windings: what
    ``expand_three_winding`` takes.
    """
    opens = F.exists("fields", lambda f: f.contains("'") | f.contains('"')).cast("int")
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = section.withColumn("_record", F.sum(opens).over(so_far))
    records = numbered.groupBy("file", "_record").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "fields"))), lambda x: x["fields"]).alias("lines"))
    f = lambda line, place, kind, name: _field(f"get(lines, {line})", place, kind).alias(name)
    tag = f(0, 3, "string", "ckt")
    third = F.coalesce(F.expr("try_cast(get(get(lines, 0), 2) AS bigint)"), F.lit(0))
    value = lambda line, place: F.expr(f"try_cast(get(get(lines, {line}), {place}) AS double)")
    base, cw, cz = value(1, 2), value(0, 4), value(0, 5)
    windings = [F.when(cw == 2, value(line, 0) / value(line, 1)).otherwise(value(line, 0)) for line in (2, 3)]
    onto = F.when((cz == 1) | (F.coalesce(base, F.lit(0.0)) == 0), 1.0).otherwise(sbase / base) * windings[1] * windings[1]
    rates = [f(2, 3 + i, "double", f"rate_{c}") for i, c in enumerate("abc")]
    tap = (windings[0] / windings[1]).alias("tap")
    impedance = [(f(1, i, "double", c) * onto).alias(c) for i, c in enumerate("rx")]
    two = records.where(third == 0).select("file", f(0, 0, "bigint", "from_bus"), f(0, 1, "bigint", "to_bus"), tag, *impedance, *rates, tap, f(2, 2, "double", "shift_deg"), F.coalesce(f(0, 11, "int", "s"), F.lit(1)).alias("status"))
    names = ("r12", "x12", "sb12", "r23", "x23", "sb23", "r31", "x31", "sb31", "v_star", "ang_star")
    buses = [f(0, i, "bigint", f"bus_{c}") for i, c in enumerate("ijk")]
    ends = [f(line, place, "double", f"{name}{i}") for i, line in enumerate((2, 3, 4), 1) for place, name in ((0, "tap"), (2, "shift_deg"), (3, "rate_a"), (4, "rate_b"), (5, "rate_c"))]
    more = [f(0, 11, "int", "stat"), f(0, 7, "double", "g1"), f(0, 8, "double", "b1"), *ends]
    three = records.where(third != 0).select("file", *buses, tag, *[f(1, i, "double", name) for i, name in enumerate(names)], *more)
    return two, three


def expand_three_winding(transformers: DataFrame, bus: DataFrame, sbase: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(star buses, branches) of three-winding transformers (bus_i, bus_j, bus_k, ckt, r12, x12, sb12, r23, x23, sb23, r31, x31, sb31[, v_star, ang_star]).

    Pairwise impedances are taken to the system base (times sbase / sb, unless sb is 0); each winding gets half the sum of its two pairs minus the
    third. The star bus is named DUMMY_BUS-i-j-k, takes area and owner of the first winding's bus, and has an id above all others in its
    network: of its file, if the tables have one, else of the whole bus table. Branches have tap, shift_deg, rate_a, rate_b and rate_c of their winding
    (tap1 to rate_c3; default 1 and 0), the magnetising admittance g1 and b1 on the first one, and status: ``stat`` 1 (default) is all windings in
    service, 2, 3 and 4 all but the second, third and first; transformers of stat 0 are left out.
    """
    if "stat" in transformers.columns:
        transformers = transformers.where(F.coalesce("stat", F.lit(1)) != 0)
    keys = ["file"] if "file" in transformers.columns and "file" in bus.columns else []
    on_base = lambda p: F.when(F.col("sb" + p[1:]) != 0, F.col(p) * sbase / F.col("sb" + p[1:])).otherwise(F.col(p))
    z = {p: on_base(p) for p in ("r12", "x12", "r23", "x23", "r31", "x31")}
    half = lambda a, b, c: (z[a] + z[b] - z[c]) / 2
    order = ["bus_i", "bus_j", "bus_k", "ckt"]
    top = bus.groupBy(*keys).agg(F.max("bus_id").alias("_top"))
    if keys:
        t = transformers.withColumn("_nth", F.row_number().over(Window.partitionBy("file").orderBy(*order))).join(top, "file")
    else:
        t = number(transformers, order, "_nth", start=1).crossJoin(F.broadcast(top))  # top is one row
    t = t.withColumn("star", F.col("_top") + F.col("_nth"))
    first = bus.select(*keys, F.col("bus_id").alias("bus_i"), "area", "owner")
    state = [F.col(c) if c in t.columns else F.lit(v).alias(c) for c, v in (("v_star", 1.0), ("ang_star", 0.0))]
    stars = t.join(first, [*keys, "bus_i"]).select(*keys, F.col("star").alias("bus_id"), F.concat_ws("-", F.lit("DUMMY_BUS"), "bus_i", "bus_j", "bus_k").alias("name"), "area", "owner", *state)
    stars = stars.withColumnsRenamed({"v_star": "v_pu", "ang_star": "angle_deg"})
    given = lambda name, default: F.coalesce(name, F.lit(default)) if name in t.columns else F.lit(default)
    stat = given("stat", 1)
    wind = []
    for n, (e, a, b, c, out) in enumerate((("bus_i", "12", "31", "23", 4), ("bus_j", "12", "23", "31", 2), ("bus_k", "23", "31", "12", 3)), 1):
        own = [given(f"{name}{n}", 1.0 if name == "tap" else 0.0).alias(name) for name in ("tap", "shift_deg", "rate_a", "rate_b", "rate_c")]
        shunt = [(given(name, 0.0) if n == 1 else F.lit(0.0)).alias(name) for name in ("g1", "b1")]
        status = (stat.between(1, 4) & (stat != out)).cast("int").alias("status")
        wind.append(F.struct(F.col(e).alias("from_bus"), half(f"r{a}", f"r{b}", f"r{c}").alias("r"), half(f"x{a}", f"x{b}", f"x{c}").alias("x"), *own, *shunt, status))
    rows = t.select(*keys, "star", "ckt", F.explode(F.array(*wind)).alias("w"))
    return stars, rows.select(*keys, "w.from_bus", F.col("star").alias("to_bus"), "ckt", *[f"w.{c}" for c in ("r", "x", "tap", "shift_deg", "rate_a", "rate_b", "rate_c", "g1", "b1", "status")])


def read_dynamic_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, bus_id, model, tag, params array<double>) of device records, which end at ``/`` and may span lines; ``//`` lines are comments."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"(?m)^\s*//.*$", "").alias("value"))
    records = text.select("file", F.explode(F.split("value", "/[^\\r\\n]*")).alias("record")).where(F.trim(F.regexp_replace("record", r"\s+", " ")) != "")
    parts = F.expr(r"regexp_extract_all(record, '\'[^\']*\'|[^\\s,]+', 0)")
    tag = lambda i: F.trim(F.regexp_replace(F.expr(f"get(parts, {i})"), "'", ""))
    rows = records.withColumn("parts", parts).where("size(parts) >= 3")
    return rows.select("file", F.expr("try_cast(parts[0] AS bigint)").alias("bus_id"), tag(1).alias("model"), tag(2).alias("tag"), F.expr("transform(slice(parts, 4, greatest(size(parts) - 3, 0)), x -> try_cast(x AS double))").alias("params"))


def read_bus_table(spark: SparkSession, path: str) -> DataFrame:
    """(bus_id, tag, scenario_idx, value) of blank-separated lines ``bus tag v1 .. vn``; leading ``#`` lines are headers. Scenarios count from 0."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = parts.select(F.expr("try_cast(p[0] AS bigint)").alias("bus_id"), F.expr("get(p, 1)").alias("tag"), F.posexplode(F.expr("slice(p, 3, greatest(size(p) - 2, 0))")).alias("scenario_idx", "text"))
    return rows.select("bus_id", "tag", "scenario_idx", F.expr("try_cast(text AS double)").alias("value"))


def read_series_wide(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((bus_id, t, value), (n, t_first, t_last, delta_t)) of a CSV whose header is ``name-<steps>,name-<bus>,...``; the first column is time."""
    wide = spark.read.csv(path, header=True)
    time, *rest = wide.columns
    long = wide.unpivot([F.col(f"`{time}`").alias("t")], [F.col(f"`{c}`") for c in rest], "_name", "value")
    rows = long.select(F.regexp_extract("_name", r"-(\d+)\s*$", 1).cast("long").alias("bus_id"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    stats = wide.select(F.col(f"`{time}`").cast("double").alias("t")).agg(F.count("t").alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    return rows, stats.withColumn("delta_t", (F.col("t_last") - F.col("t_first")) / F.when(F.col("n") > 1, F.col("n") - 1))


def read_run_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, timer, stat, seconds), (file, rank, tasks)) of text logs. A line ``Timing statistics for: NAME`` heads the value lines below it, such
    as ``Average time: 1.5``; ``Number of tasks executed on process R: N`` gives a rank's tasks."""
    lines = _lines(spark, path)
    name = F.regexp_extract("line", r"Timing statistics for:\s*(.+?)\s*$", 1)
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("timer", F.last(F.when(name != "", name), ignorenulls=True).over(so_far))
    stat = F.regexp_extract("line", r"^\s*(Average|Maximum|Minimum|RMS deviation|Standard deviation)[^:]*:\s*([-+0-9.eE]+)\s*$", 1)
    timers = rows.where((stat != "") & F.col("timer").isNotNull()).select("file", "timer", F.lower(stat).alias("stat"), F.expr("try_cast(regexp_extract(line, ':\\\\s*([-+0-9.eE]+)\\\\s*$', 1) AS double)").alias("seconds"))
    rank = r"tasks executed on process\s+(\d+)\s*:\s*(\d+)"
    tasks = lines.where(F.col("line").rlike(rank)).select("file", F.regexp_extract("line", rank, 1).cast("int").alias("rank"), F.regexp_extract("line", rank, 2).cast("int").alias("tasks"))
    return timers, tasks
