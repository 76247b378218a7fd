"""Electrical quantities of given voltages and parameters: admittances, flows, injections, loads and generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.functions.exprs import Complex, columns, named, polar

SBASE = 100.0
BROADCAST_ROWS = 1_000_000
#: Buses in blocks: their number where nothing is counted, the least number where voltages are, and the voltages of a block that a task may hold (some 240 MB).
BLOCKS, LEAST_BLOCKS, BLOCK_VOLTAGES = 8, 6, 12_000_000
#: The column, if asked for, that tells by what rows are dealt: the same for all rows of a circuit, so that joins that have it as a key leave them there.
CELL = "cell"
#: Whether joins insist on a partitioning by all of their keys.
CO_PARTITIONING = "spark.sql.requireAllClusterKeysForCoPartition"


def _parts(circuit_status: Column | None = None) -> tuple[Complex, Complex, Complex, Column, Complex]:
    """(series admittance, tap, half charging, is-transformer, 1/|tap|^2 as a pair) of circuit columns."""
    y = Complex(F.lit(1.0), F.lit(0.0)).over(Complex(F.col("r"), F.col("x")))
    is_tap = F.col("tap") != 0
    shift = F.when(F.col("switched"), -F.col("shift_deg")).otherwise(F.col("shift_deg"))
    tap = polar(F.when(is_tap, F.col("tap")).otherwise(1.0), F.when(is_tap, shift).otherwise(0.0))
    half = Complex(F.lit(0.0), F.col("b") / 2)
    if circuit_status is not None:
        y, half = y.where(circuit_status), half.where(circuit_status)
    return y, tap, half, is_tap, Complex(1 / (tap.re * tap.re + tap.im * tap.im), F.lit(0.0))


def branch_elements(circuit: DataFrame) -> DataFrame:
    """Adds the four admittances of each circuit seen from its ends: yff, yft, ytf, ytt (re and im); zero when out of service.

    r and x must not both be zero (then null). A tap of 0 is a plain line; ``switched`` turns the sign of the phase shift.
    """
    y, tap, half, _, scale = _parts(F.col("status") == 1)
    own = y + half
    return circuit.withColumns(
        {
            **columns("yff", own.scaled(scale.re)),
            **columns("yft", (-y).over(tap.conj())),
            **columns("ytf", (-y).over(tap)),
            **columns("ytt", own),
        }
    )


def branch_admittance(circuit: DataFrame) -> DataFrame:
    """(from_bus, to_bus, fwd, rev): summed mutual admittances of the circuits of each branch, -1/z with taps; out of service 0."""
    e = branch_elements(circuit)
    total = [F.sum(f"{a}_{p}").alias(f"{b}_{p}") for a, b in (("yft", "fwd"), ("ytf", "rev")) for p in ("re", "im")]
    return e.groupBy("from_bus", "to_bus").agg(*total)


def bus_shunt(bus: DataFrame, fixed: DataFrame, switched: DataFrame, sbase: float = SBASE) -> DataFrame:
    """(bus_id, g, b): in-service fixed shunts plus the initial step of switched ones, over sbase. A missing status means on."""
    on = F.coalesce("status", F.lit(1)) == 1
    a = fixed.where(on).groupBy("bus_id").agg(F.sum("gl").alias("gl"), F.sum("bl").alias("bl"))
    s = switched.where(on).groupBy("bus_id").agg(F.sum("binit").alias("binit"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return bus.select("bus_id").join(a, "bus_id", "left").join(s, "bus_id", "left").select("bus_id", (z("gl") / sbase).alias("g"), ((z("bl") + z("binit")) / sbase).alias("b"))


def ybus_coo(circuit: DataFrame, shunt: DataFrame) -> DataFrame:
    """(i, j, re, im): nodal admittance matrix from circuits and bus shunts (bus_id, g, b).

    Circuits are read once and their entries shuffled once. Of circuits with CELL (``pair_cell``) entries of two buses are summed where the circuits are, and
    only own admittances are shuffled, summed up by cell."""
    e = branch_elements(circuit)
    put = lambda i, j, p: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(f"{p}_re").alias("re"), F.col(f"{p}_im").alias("im"))
    made = F.array(put("from_bus", "from_bus", "yff"), put("from_bus", "to_bus", "yft"), put("to_bus", "from_bus", "ytf"), put("to_bus", "to_bus", "ytt"))
    own = shunt.select(F.col("bus_id").alias("i"), F.col("bus_id").alias("j"), F.col("g").alias("re"), F.col("b").alias("im"))
    total = F.sum("re").alias("re"), F.sum("im").alias("im")
    if CELL not in circuit.columns:
        return e.select(F.inline(made)).union(own).groupBy("i", "j").agg(*total)
    # both halves take all entries, so that they share one exchange of the circuits
    parts = e.select(CELL, F.inline(made))
    same = F.col("i").eqNullSafe(F.col("j"))
    between = parts.where(~same).groupBy(CELL, "i", "j").agg(*total).drop(CELL)
    at_bus = parts.where(same).drop(CELL).union(own).groupBy("i").agg(*total)
    return between.union(at_bus.select("i", F.col("i").alias("j"), "re", "im"))


def block_of(bus: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(bus), F.lit(blocks)).cast("int")


def pair_cell(a: Column, b: Column, blocks: int) -> Column:
    """The cell of two blocks, whichever comes first: a value of CELL, the same for all circuits between two buses in either direction."""
    return F.least(a, b) * blocks + F.greatest(a, b)


def _at(voltage: DataFrame, end: str, p: str) -> DataFrame:
    isolated = F.col("isolated") if "isolated" in voltage.columns else F.lit(False)
    shown = [F.col("v_pu").alias(f"v_{p}_pu"), F.col("angle_deg").alias(f"ang_{p}_deg"), isolated.alias(f"_iso_{p}")]
    # sines and cosines once a voltage, not once a circuit and event
    return voltage.select("event_idx", F.col("bus_id").alias(end), *shown, *[c.alias(f"_{p}_{n}") for n, c in columns("v", polar(F.col("v_pu"), F.col("angle_deg"))).items()])


def _sized(voltage: DataFrame) -> tuple[DataFrame, bool]:
    """(voltages, whether they are broadcast): so marked if counting finds no more than BROADCAST_ROWS of them (some 60 MB); joins shuffle them otherwise."""
    small = fits(voltage)
    return (F.broadcast(voltage) if small else voltage), small


def fits(frame: DataFrame) -> bool:
    """Whether counting finds at most BROADCAST_ROWS rows."""
    return frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def flow_layout(circuit: DataFrame, voltage: DataFrame) -> str:
    """The way of ``line_flow`` that counting suggests: "broadcast" if there are at most BROADCAST_ROWS voltages; else "by_event" if there are no more
    circuits than that (or they have events too) and events enough to keep all tasks busy; else "by_bus"."""
    if fits(voltage):
        return "broadcast"
    if "event_idx" not in circuit.columns and not fits(circuit):
        return "by_bus"
    events = voltage.select(F.approx_count_distinct("event_idx")).first()[0]
    return "by_event" if events >= 2 * voltage.sparkSession.sparkContext.defaultParallelism else "by_bus"


def at_least(frame: DataFrame, cells: int) -> int:
    """So many partitions, or as many as shuffles have: joins deal anew what has fewer."""
    return max(cells, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def apart(spark: SparkSession, cells: int, parts: int) -> list[int]:
    """Numbers for so many cells that a repartition into ``parts`` (at least as many) puts into different partitions: a task that meets two cells holds twice as much."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = spark.range(40 * parts).groupBy(at.alias("at")).agg(F.min("id").alias("id")).orderBy("id").limit(cells).collect()
    return [r["id"] for r in found]


def _packed(voltage: DataFrame, end: str, p: str) -> DataFrame:
    """A row a bus: arrays of its events, in order, and of the voltages there, and whether no event comes twice."""
    own = [c for c in ("v_pu", "angle_deg", "isolated") if c in voltage.columns]
    rows = voltage.where("event_idx IS NOT NULL AND bus_id IS NOT NULL").groupBy(F.col("bus_id").alias(end)).agg(F.array_sort(F.collect_list(F.struct("event_idx", *own))).alias("all"))
    rows = rows.select(end, *[F.col(f"all.{c}").alias(f"_{p}_{c}") for c in ("event_idx", *own)])
    return rows.withColumn(f"_{p}_once", F.size(F.array_distinct(f"_{p}_event_idx")) == F.size(f"_{p}_event_idx"))


def _in_blocks(rows: DataFrame, voltage: DataFrame, ends: tuple[str, str], blocks: tuple[int, int]) -> DataFrame:
    """``rows`` with the packed voltages (_from_ and _to_) of the buses in both columns ``ends``, and _pairs, the places of the same event in both.

    Buses are dealt into blocks, rows into cells, one for each pair of blocks, and a bus's voltages go to the cells of its block. So rows are shuffled
    once, without voltages, voltages as often as there are blocks, and a task holds the voltages of two blocks, as no two cells share one. Joins keep
    the partitioning by cells if they needn't have all keys, so this sets CO_PARTITIONING."""
    rows.sparkSession.conf.set(CO_PARTITIONING, "false")
    parts = at_least(rows, blocks[0] * blocks[1])
    numbers = F.array(*[F.lit(n).cast("int") for n in apart(rows.sparkSession, blocks[0] * blocks[1], parts)])
    cell = lambda a, b: F.get(numbers, (a * blocks[1] + b).cast("int"))
    block = lambda c, n: block_of(F.col(c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("_cell", cell(block(ends[0], blocks[0]), block(ends[1], blocks[1]))).repartition(parts, "_cell")
    first = _packed(voltage, ends[0], "from").withColumn("_y", every(blocks[1])).withColumn("_cell", cell(block(ends[0], blocks[0]), F.col("_y"))).drop("_y")
    second = _packed(voltage, ends[1], "to").withColumn("_x", every(blocks[0])).withColumn("_cell", cell(F.col("_x"), block(ends[1], blocks[1]))).drop("_x")
    for packed, end in ((first, ends[0]), (second, ends[1])):
        dealt = dealt.join(packed.repartition(parts, "_cell").hint("shuffle_hash"), ["_cell", end])
    same = F.col("_from_once") & F.col("_to_once") & (F.col("_from_event_idx") == F.col("_to_event_idx"))
    last = (F.size("_from_event_idx") - 1).cast("long") * _PLACE
    places = lambda c: F.sequence(F.lit(0), F.size(c) - 1)
    met = F.filter(
        F.flatten(F.transform(places("_from_event_idx"), lambda f: F.transform(places("_to_event_idx"), lambda t: F.when(F.get("_from_event_idx", f) == F.get("_to_event_idx", t), f.cast("long") * (_PLACE - 1) + t)))),
        lambda k: k.isNotNull(),
    )
    dealt = dealt.withColumn("_pairs", F.when(same, F.sequence(F.lit(0).cast("long"), last, F.lit(_PLACE))).otherwise(met))
    return dealt.withColumnRenamed("_cell", CELL).drop("_from_once", "_to_once")


#: A pair of places as one number: the first times 2**32, and the second. A pair of equal places is a multiple of this.
_PLACE = (1 << 32) + 1


def packed_columns(rows: DataFrame) -> list[str]:
    """The columns that ``_in_blocks`` has added."""
    return [c for c in rows.columns if c.startswith(("_from_", "_to_")) or c == "_pairs"]


def _event_at(k: Column) -> Column:
    return F.get("_from_event_idx", F.shiftright(k, 32).cast("int"))


def _unpacked(rows: DataFrame, base: bool = False) -> DataFrame:
    """A row for each pair of places: event_idx, and v_pu, angle_deg and isolated of both ends. With ``base`` only for event 0, beside what is
    needed to unpack the other events."""
    packed = [c for c in packed_columns(rows) if c != "_pairs"]
    own = [c for c in rows.columns if c not in packed and c != "_pairs"]
    own += [*packed, F.filter("_pairs", lambda k: _event_at(k) != 0).alias("_pairs")] if base else []
    rows = rows.select(*own, *([] if base else packed), F.explode(F.filter("_pairs", lambda k: _event_at(k) == 0) if base else "_pairs").alias("_pair"))
    own = [c for c in rows.columns if c != "_pair" and (base or c not in packed)]
    place = {"from": F.shiftright("_pair", 32).cast("int"), "to": F.col("_pair").bitwiseAND(0xFFFFFFFF).cast("int")}
    at = lambda p, c: F.get(f"_{p}_{c}", place[p])
    iso = lambda p: at(p, "isolated") if f"_{p}_isolated" in packed else F.lit(False)
    seen = [c for p in place for c in (at(p, "v_pu").alias(f"v_{p}_pu"), at(p, "angle_deg").alias(f"ang_{p}_deg"), iso(p).alias(f"_iso_{p}"))]
    return rows.select(at("from", "event_idx").alias("event_idx"), *own, *seen)


def in_blocks(circuit: DataFrame, voltage: DataFrame, blocks: int | None = None) -> DataFrame:
    """Circuits beside the packed voltages of both ends, for ``flow_of_blocks``; without ``blocks``, so many as counted voltages need."""
    voltage = voltage.select("event_idx", "bus_id", "v_pu", "angle_deg", *(["isolated"] if "isolated" in voltage.columns else []))
    n = blocks or max(LEAST_BLOCKS, -(-voltage.count() // BLOCK_VOLTAGES))
    if "event_idx" not in circuit.columns:
        return _in_blocks(circuit, voltage, ("from_bus", "to_bus"), (n, n))
    met = _in_blocks(circuit.withColumnRenamed("event_idx", "_event"), voltage, ("from_bus", "to_bus"), (n, n))
    return met.withColumn("_pairs", F.filter("_pairs", lambda k: _event_at(k) == F.col("_event"))).drop("_event")


def flow_of_blocks(met: DataFrame, sbase: float = SBASE, base: bool = False) -> DataFrame:
    """``line_flow`` of what ``in_blocks`` has put together. With ``base`` the flow of event 0 alone, beside the packed voltages of the other events,
    of which this gives the flow again."""
    rows = _unpacked(branch_elements(met), base)
    rows = rows.withColumns({f"_{p}_{n}": c for p in ("from", "to") for n, c in columns("v", polar(F.col(f"v_{p}_pu"), F.col(f"ang_{p}_deg"))).items()})
    return _flows(rows, sbase)


def line_flow(circuit: DataFrame, voltage: DataFrame, sbase: float = SBASE, layout: str | None = None, cells: bool = False) -> DataFrame:
    """Flow into each circuit from both ends, per event of ``voltage``: p_from, q_from, p_to, q_to and both ends' voltages. With ``cells``, rows
    made in blocks of buses also have CELL.

    Zero when the circuit is out of service or an end is isolated. Circuits with an event_idx join only that event. ``layout`` says how
    rows meet; without one, ``flow_layout`` counts (a few Spark jobs while the plan is built, none if it is given, as it must be for streams):

    - "broadcast": voltages are broadcast, so the rows of circuits and events are made where the circuits are and never shuffled, and
      admittances are worked out once a circuit;
    - "by_event": voltages are dealt by event alone, once for both ends, and circuits broadcast, or dealt by event as well if they have
      one. Both joins keep this partitioning, so the rows of circuits and events aren't shuffled either; a task holds the voltages of its
      events. Spark keeps a partitioning by some of a join's keys only if the session allows it, so this sets CO_PARTITIONING there;
    - "by_bus": circuits are dealt by pairs of blocks of buses and meet there the voltages of both blocks, packed by bus (``_in_blocks``), so the rows of
      circuits and events are made where they stay; of circuits with an event_idx only that event's. Streams are joined by (event, bus) and shuffled for each
      end; admittances are only worked out behind both joins, as they would widen them.
    """
    keys = ["event_idx"] if "event_idx" in circuit.columns else []
    voltage = voltage.select("event_idx", "bus_id", "v_pu", "angle_deg", *(["isolated"] if "isolated" in voltage.columns else []))
    counted, layout = layout is None, layout or flow_layout(circuit, voltage)
    if layout == "by_event":
        voltage.sparkSession.conf.set(CO_PARTITIONING, "false")
        dealt = voltage.repartition("event_idx")
        lines = branch_elements(circuit)
        lines = lines.repartition("event_idx") if keys else F.broadcast(lines)
        rows = _at(dealt, "from_bus", "from").join(lines, [*keys, "from_bus"]).join(_at(dealt, "to_bus", "to").hint("shuffle_hash"), ["event_idx", "to_bus"])
    elif layout == "by_bus" and not (circuit.isStreaming or voltage.isStreaming):
        met = in_blocks(circuit, voltage, None if counted else BLOCKS)
        return flow_of_blocks(met if cells else met.drop(CELL), sbase)
    else:
        sent = layout == "broadcast"
        small = F.broadcast(voltage) if sent else voltage
        rows = branch_elements(circuit) if sent else circuit
        rows = rows.join(_at(small, "from_bus", "from"), [*keys, "from_bus"]).join(_at(small, "to_bus", "to"), ["event_idx", "to_bus"])
        rows = rows if sent else branch_elements(rows)
    return _flows(rows, sbase)


def _flows(rows: DataFrame, sbase: float) -> DataFrame:
    vi, vj = named("_from_v"), named("_to_v")
    live = (F.col("status") == 1) & ~F.col("_iso_from") & ~F.col("_iso_to")
    s_from = vi.times((named("yff").times(vi) + named("yft").times(vj)).conj()).scaled(sbase).where(live)
    s_to = vj.times((named("ytf").times(vi) + named("ytt").times(vj)).conj()).scaled(sbase).where(live)
    out = rows.withColumns({"p_from": s_from.re, "q_from": s_from.im, "p_to": s_to.re, "q_to": s_to.im})
    return out.drop("_iso_from", "_iso_to", *[f"{a}_{b}" for a in ("_from_v", "_to_v", "yff", "yft", "ytf", "ytt") for b in ("re", "im")])


def bus_injection(ybus: DataFrame, voltage: DataFrame) -> DataFrame:
    """(event_idx, bus_id, p, q) in per unit: P = sum v1 v2 (G cos + B sin), Q = sum v1 v2 (G sin - B cos), own terms included.

    With voltages of a checked size broadcast, only the sums of an event and bus are shuffled. Else entries are dealt by pairs of blocks of buses, with
    few blocks of columns, so that what is shuffled are a few partial sums of an event and bus; these are dealt by bus alone, as what is joined to them is."""
    voltage = voltage.select("event_idx", "bus_id", "v_pu", "angle_deg")
    small, sent = _sized(voltage)
    if sent or ybus.isStreaming or voltage.isStreaming:
        a = small.select("event_idx", F.col("bus_id").alias("i"), F.col("v_pu").alias("vi"), F.radians("angle_deg").alias("ti"))
        b = small.select("event_idx", F.col("bus_id").alias("j"), F.col("v_pu").alias("vj"), F.radians("angle_deg").alias("tj"))
        rows = ybus.join(a, "i").join(b, ["event_idx", "j"])
    else:
        n = max(LEAST_BLOCKS, -(-voltage.count() // BLOCK_VOLTAGES))
        rows = _unpacked(_in_blocks(ybus, voltage, ("i", "j"), (2 * n, -(-n // 2))))
        rows = rows.select(CELL, "event_idx", "i", "re", "im", *[c for p, k in (("from", "i"), ("to", "j")) for c in (F.col(f"v_{p}_pu").alias(f"v{k}"), F.radians(f"ang_{p}_deg").alias(f"t{k}"))])
    t, vv = F.col("ti") - F.col("tj"), F.col("vi") * F.col("vj")
    p = vv * (F.col("re") * F.cos(t) + F.col("im") * F.sin(t))
    q = vv * (F.col("re") * F.sin(t) - F.col("im") * F.cos(t))
    if CELL in rows.columns:
        parts = rows.groupBy(CELL, "event_idx", F.col("i").alias("bus_id")).agg(F.sum(p).alias("p"), F.sum(q).alias("q")).drop(CELL)
        return parts.repartition("bus_id").groupBy("event_idx", "bus_id").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return rows.groupBy("event_idx", F.col("i").alias("bus_id")).agg(F.sum(p).alias("p"), F.sum(q).alias("q"))


def scheduled_injection(generator: DataFrame, load: DataFrame, sbase: float = SBASE) -> DataFrame:
    """(bus_id, p, q): (online generation - load in service) / sbase; buses that have either."""
    g = generator.where("status = 1").groupBy("bus_id").agg(F.sum("pg").alias("pg"), F.sum("qg").alias("qg"))
    d = load.where("status = 1").groupBy("bus_id").agg(F.sum("pl").alias("pl"), F.sum("ql").alias("ql"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return g.join(d, "bus_id", "full").select("bus_id", ((z("pg") - z("pl")) / sbase).alias("p"), ((z("qg") - z("ql")) / sbase).alias("q"))


def zip_load(load: DataFrame, voltage: DataFrame) -> DataFrame:
    """(event_idx, bus_id, p, q) of voltage-dependent load: p = sum IP v + YP v^2, q = sum IQ v - YQ v^2, loads in service."""
    sums = load.where("status = 1").groupBy("bus_id").agg(*[F.sum(c).alias(c) for c in ("ip", "iq", "yp", "yq")])
    v = F.col("v_pu")
    rows = sums.join(voltage, "bus_id")
    return rows.select("event_idx", "bus_id", (F.col("ip") * v + F.col("yp") * v * v).alias("p"), (F.col("iq") * v - F.col("yq") * v * v).alias("q"))


def generator_output(bus: DataFrame, generator: DataFrame, load: DataFrame, injection: DataFrame, voltage: DataFrame, sbase: float = SBASE) -> DataFrame:
    """(event_idx, bus_id, p): at the reference bus injection * sbase + load + voltage-dependent load, elsewhere the sum of online pg. What a bus alone
    decides is put together before events multiply it, and voltages are only looked at for reference buses."""
    online = generator.where("status = 1").groupBy("bus_id").agg(F.sum("pg").alias("pg"))
    fixed = load.where("status = 1").groupBy("bus_id").agg(F.sum("pl").alias("pl"))
    reference = bus.where("type = 3").select("bus_id").distinct()
    small = (lambda f: f) if voltage.isStreaming or not fits(reference) else F.broadcast
    at_reference = voltage.join(small(reference), "bus_id", "left_semi")
    var = zip_load(load.join(small(reference), "bus_id", "left_semi"), at_reference).select("event_idx", "bus_id", F.col("p").alias("zip_p"))
    of_bus = bus.select("bus_id", "type").join(online, "bus_id", "left").join(fixed, "bus_id", "left")
    rows = injection.join(of_bus, "bus_id").join(var, ["event_idx", "bus_id"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select("event_idx", "bus_id", F.when(F.col("type") == 3, F.col("p") * sbase + z("pl") + z("zip_p")).otherwise(z("pg")).alias("p"))


def bus_result(bus: DataFrame, generator: DataFrame, load: DataFrame, voltage: DataFrame, shunt: DataFrame | None = None, star_prefix: str = "DUMMY_BUS", sbase: float = SBASE) -> DataFrame:
    """(event_idx, bus_id, type, area, zone, base_kv, v_pu, angle_deg, p_gen, q_gen, p_load, q_load, p_net, q_net, shunt_mvar); star buses of
    transformers are left out. ``shunt`` (bus_id, g, b in per unit) gives b * v^2 * sbase."""
    g = generator.where("status = 1").groupBy("bus_id").agg(F.sum("pg").alias("p_gen"), F.sum("qg").alias("q_gen"))
    d = load.where("status = 1").groupBy("bus_id").agg(F.sum("pl").alias("p_load"), F.sum("ql").alias("q_load"))
    real = bus.where(~F.col("name").startswith(star_prefix)).select("bus_id", "type", "area", "zone", "base_kv")
    fixed = real.join(g, "bus_id", "left").join(d, "bus_id", "left")  # per bus, before events multiply the rows
    fixed = fixed.join(shunt.select("bus_id", F.col("b").alias("_b")), "bus_id", "left") if shunt is not None else fixed.withColumn("_b", F.lit(0.0))
    fixed = fixed.fillna(0.0, ["p_gen", "q_gen", "p_load", "q_load", "_b"])
    rows = voltage.select("event_idx", "bus_id", "v_pu", "angle_deg").join(fixed, "bus_id")
    net = [(F.col("p_gen") - F.col("p_load")).alias("p_net"), (F.col("q_gen") - F.col("q_load")).alias("q_net"), (F.col("_b") * F.col("v_pu") * F.col("v_pu") * sbase).alias("shunt_mvar")]
    return rows.select("event_idx", "bus_id", "type", "area", "zone", "base_kv", "v_pu", "angle_deg", "p_gen", "q_gen", "p_load", "q_load", *net)


def branch_result(flow: DataFrame) -> DataFrame:
    """Per circuit in service: flows, apparent power at both ends, loss, rate_a and loading (0 if rate_a <= 0)."""
    s_from, s_to = F.hypot("p_from", "q_from"), F.hypot("p_to", "q_to")
    loading = F.when(F.col("rate_a") > 0, F.greatest(s_from, s_to) / F.col("rate_a") * 100).otherwise(0.0)
    on = flow.where("status = 1")
    loss = [(F.col("p_from") + F.col("p_to")).alias("p_loss"), (F.col("q_from") + F.col("q_to")).alias("q_loss")]
    return on.select("event_idx", "from_bus", "to_bus", "ckt", "p_from", "q_from", "p_to", "q_to", s_from.alias("s_from"), s_to.alias("s_to"), *loss, "rate_a", loading.alias("loading"))


def generator_result(generator: DataFrame) -> DataFrame:
    """(bus_id, gen_id, p, q, qmax, qmin, v_set, status): generators with their output, zero when out of service. ``vs`` is the set-point, null if absent."""
    on = F.col("status") == 1
    power = [F.when(on, F.col(c)).otherwise(0.0).alias(name) for c, name in (("pg", "p"), ("qg", "q"))]
    setpoint = F.col("vs") if "vs" in generator.columns else F.lit(None).cast("double")
    return generator.select("bus_id", "gen_id", *power, "qmax", "qmin", setpoint.alias("v_set"), "status")


def mismatch_summary(scheduled: DataFrame, injection: DataFrame) -> DataFrame:
    """Per event the buses with the largest absolute P and Q mismatch (ties: smallest bus) and these values, rounded to 6 places."""
    rows = injection.join(scheduled.select("bus_id", F.col("p").alias("sp"), F.col("q").alias("sq")), "bus_id")
    dp, dq = F.round(F.abs(F.col("p") - F.col("sp")), 6), F.round(F.abs(F.col("q") - F.col("sq")), 6)
    rows = rows.select("event_idx", "bus_id", dp.alias("dp"), dq.alias("dq"))
    worst = lambda d: F.max_by("bus_id", F.struct(F.col(d), -F.col("bus_id")))
    return rows.groupBy("event_idx").agg(worst("dp").alias("max_p_bus"), F.max("dp").alias("max_p"), worst("dq").alias("max_q_bus"), F.max("dq").alias("max_q"))


def _inside(bus: DataFrame, area: int, zone: int) -> DataFrame:
    return bus.where((F.col("area") == area) & (F.lit(zone <= 0) | (F.col("zone") == zone))).select("bus_id", F.lit(True).alias("_in"))


def scale_load(load: DataFrame, bus: DataFrame, area: int, zone: int, factor: float) -> DataFrame:
    """Loads in service of an area (zone > 0: and zone) with all six components multiplied by ``factor``; others unchanged."""
    rows = load.join(_inside(bus, area, zone), "bus_id", "left")
    hit = F.coalesce("_in", F.lit(False)) & (F.col("status") == 1)
    scaled = {c: F.when(hit, F.col(c) * factor).otherwise(F.col(c)) for c in ("pl", "ql", "ip", "iq", "yp", "yq")}
    return rows.withColumns(scaled).select(*load.columns)


def scale_generation(generator: DataFrame, bus: DataFrame, area: int, zone: int, factor: float) -> DataFrame:
    """Online units of an area: a positive factor goes that part of the way to pmax, a negative one towards pmin."""
    rows = generator.join(_inside(bus, area, zone), "bus_id", "left")
    hit = F.coalesce("_in", F.lit(False)) & (F.col("status") == 1)
    room = (F.col("pmax") - F.col("pg")) if factor > 0 else (F.col("pg") - F.col("pmin"))
    return rows.withColumn("pg", F.when(hit, F.col("pg") + factor * room).otherwise(F.col("pg"))).select(*generator.columns)


def rating_to_scale(ratings: DataFrame) -> DataFrame:
    """Per row (rating, load_total, gen, pmin, pmax): the load rating that generation can follow and its scale.

    The extra load is (rating - 1) * load_total. Within pmin - gen .. pmax - gen it is met: scale = extra / (pmax - gen) upwards or
    extra / (gen - pmin) downwards, ``feasible`` true; beyond, the extra is capped at the margin (scale 1 or -1), false.
    """
    extra = (F.col("rating") - 1) * F.col("load_total")
    up, down = F.col("pmax") - F.col("gen"), F.col("gen") - F.col("pmin")
    fits = (extra <= up) & (extra >= -down)
    used = F.greatest(F.least(extra, up), -down)
    scale = F.when(used > 0, used / F.when(up > 0, up)).when(used < 0, used / F.when(down > 0, down)).otherwise(0.0)
    return ratings.withColumns({"load_rating": 1 + used / F.col("load_total"), "scale": F.coalesce(scale, F.lit(0.0)), "feasible": fits})


def allocate_reactive(generator: DataFrame, required: DataFrame, deadband: float = 0.1, rounds: int = 20) -> DataFrame:
    """(bus_id, gen_id, q, clamped, to_pq): reactive power of each online unit for a bus's requirement (bus_id, q_required).

    In each round the units not clamped yet share what the clamped ones leave, by rmpct, or by qmax if theirs have no positive sum; a share
    beyond qmin..qmax is clamped and the rest is shared again, at most ``rounds`` times. Without a positive basis shares stay. Beyond sum qmax +
    deadband (or below sum qmin - deadband) the bus turns from PV to PQ and all units sit at the limit. A bus's units fold in one
    expression; a bus has a handful.
    """
    unit = F.struct("gen_id", F.coalesce("rmpct", F.lit(0.0)).alias("w"), "qmax", "qmin", F.lit(0.0).alias("q"), F.lit(False).alias("clamped"))
    per_bus = generator.where("status = 1").groupBy("bus_id").agg(F.array_sort(F.collect_list(unit)).alias("units"), F.sum("qmax").alias("top"), F.sum("qmin").alias("low"))
    per_bus = per_bus.join(required.select("bus_id", "q_required"), "bus_id")
    total = lambda value: f"aggregate(s.us, 0.0D, (t, u) -> t + {value})"
    basis = f"named_struct('us', s.us, 'rest', q_required - {total('if(u.clamped, u.q, 0.0D)')}, 'w', {total('if(u.clamped, 0.0D, u.w)')}, 'm', {total('if(u.clamped, 0.0D, u.qmax)')})"
    part = "if(k.w > 0, u.w, u.qmax)"
    whole = "if(k.w > 0, k.w, k.m)"
    share = f"if(u.clamped OR {whole} <= 0, u.q, k.rest * {part} / {whole})"
    new = f"named_struct('gen_id', u.gen_id, 'w', u.w, 'qmax', u.qmax, 'qmin', u.qmin, 'q', greatest(least({share}, u.qmax), u.qmin), 'clamped', u.clamped OR {share} > u.qmax OR {share} < u.qmin)"
    step = f"element_at(transform(array({basis}), k -> named_struct('us', transform(k.us, u -> {new}))), 1)"
    folded = F.expr(f"aggregate(sequence(1, {rounds}), named_struct('us', units), (s, i) -> {step}).us")
    over, under = F.col("q_required") > F.col("top") + deadband, F.col("q_required") < F.col("low") - deadband
    rows = per_bus.select("bus_id", over.alias("over"), under.alias("under"), F.explode(folded).alias("u"))
    q = F.when(F.col("over"), F.col("u.qmax")).when(F.col("under"), F.col("u.qmin")).otherwise(F.col("u.q"))
    to_pq = F.col("over") | F.col("under")
    return rows.select("bus_id", F.col("u.gen_id").alias("gen_id"), q.alias("q"), (to_pq | F.col("u.clamped")).alias("clamped"), to_pq.alias("to_pq"))
