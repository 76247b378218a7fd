"""Topology: lone buses, islands, outage screening, tie lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridlake.functions.durable import Workspace
from gridlake.functions.ordering import number
from gridlake.operators.components import connected_components, spanning_forest

ISOLATED = 4


def _ends(circuit: DataFrame, *more: str) -> DataFrame:
    a = circuit.select(*more, F.col("from_bus").alias("bus_id"))
    return a.union(circuit.select(*more, F.col("to_bus").alias("bus_id")))


def lone_buses(bus: DataFrame, circuit: DataFrame) -> DataFrame:
    """Buses that aren't isolated already and touch no circuit in service. With an event_idx on circuits, per scenario."""
    live = bus.where(F.col("type") != ISOLATED)
    if "event_idx" in circuit.columns:
        every = live.crossJoin(F.broadcast(circuit.select("event_idx").distinct()))
        return every.join(_ends(circuit.where("status = 1"), "event_idx").distinct(), ["event_idx", "bus_id"], "left_anti")
    return live.join(_ends(circuit.where("status = 1")).distinct(), "bus_id", "left_anti")


def islands(bus: DataFrame, circuit: DataFrame) -> DataFrame:
    """(keys, bus_id, island, n_buses, main): components of non-isolated buses over circuits in service.

    ``island`` is its smallest bus; the main island has most buses, ties go to the smallest. With an event_idx on circuits all
    scenarios are worked out together.
    """
    keys = ["event_idx"] if "event_idx" in circuit.columns else []
    live = bus.where(F.col("type") != ISOLATED).select("bus_id")
    if keys:
        live = live.crossJoin(F.broadcast(circuit.select(*keys).distinct()))
    on = circuit.where("status = 1").select(*keys, "from_bus", "to_bus")
    on = on.join(live.withColumnRenamed("bus_id", "from_bus"), [*keys, "from_bus"], "left_semi").join(live.withColumnRenamed("bus_id", "to_bus"), [*keys, "to_bus"], "left_semi")
    found = connected_components(on, tuple(keys), "from_bus", "to_bus").withColumnRenamed("node", "bus_id")
    labelled = live.join(found, [*keys, "bus_id"], "left").select(*keys, "bus_id", F.coalesce("component", "bus_id").alias("island"))
    sizes = labelled.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n_buses"))
    best = F.max_by("island", F.struct(F.col("n_buses"), -F.col("island"))).alias("_main")
    if keys:
        sizes = sizes.join(sizes.groupBy(*keys).agg(best), keys)
    else:
        sizes = sizes.crossJoin(sizes.agg(best))
    sizes = sizes.select(*keys, "island", "n_buses", (F.col("island") == F.col("_main")).alias("main"))
    return labelled.join(sizes, [*keys, "island"]).select(*keys, "bus_id", "island", "n_buses", "main")


def screen_outages(bus: DataFrame, circuit: DataFrame) -> DataFrame:
    """(from_bus, to_bus, ckt, bridge, components): for every circuit in service the number of components without it.

    Cycle-space sampling: edges outside a spanning forest get random 128-bit labels; a forest edge is a bridge iff the XOR of the labels
    that leave one side of it is zero (wrong with probability 2**-128 an edge). The forest comes from the hooks of the components. A
    bus bears the XOR of its edges' labels at one place of its tree's Euler tour, so a side's XOR is that of the part of the tour
    between the edge's two arcs; sums to the end of all tours take log2(arcs) rounds of pointer doubling, so a chain of n buses takes
    about 2 log2 n joins. Parallel circuits and self loops are never bridges; isolated buses count as components.
    """
    on = circuit.where("status = 1").select("from_bus", "to_bus", "ckt")
    edges = on.where("from_bus <> to_bus").select(F.least("from_bus", "to_bus").alias("u"), F.greatest("from_bus", "to_bus").alias("v"))
    with Workspace(circuit.sparkSession) as tables:
        pairs = tables.durable(edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")))
        label, tree = spanning_forest(pairs)
        n_base = bus.join(label.select(F.col("node").alias("bus_id")), "bus_id", "left_anti").count() + label.select("component").distinct().count()
        in_tree = tree.withColumn("tree", F.lit(True))
        spare = pairs.join(in_tree, ["u", "v"], "left").where("tree IS NULL OR n > 1")  # parallels of a forest edge are spare edges too
        # labels are made where they are added up: a shuffled end is two numbers, and its edge told by them
        ends = spare.select(F.col("u").alias("v"), F.col("v").alias("w")).union(spare.select("v", F.col("u").alias("w"))).repartition("v")
        tag = ends.select("v", F.xxhash64(F.least("v", "w"), F.greatest("v", "w"), F.lit(1)).alias("a"), F.xxhash64(F.greatest("v", "w"), F.least("v", "w"), F.lit(2)).alias("b"))
        mine = tag.groupBy("v").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        arcs = _euler_tour(tree, label.select(F.col("node").alias("v"), "component"), tables)
        own = lambda c: F.when(F.col("opens"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0))
        arcs = tables.durable(arcs.join(mine, "v", "left").select("id", "v", "w", "next", own("a").alias("a"), own("b").alias("b")))
        state = arcs.select("id", F.col("next").alias("to"), F.col("a").alias("sa"), F.col("b").alias("sb"))
        while True:
            ahead = state.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("sa").alias("ta"), F.col("sb").alias("tb"))
            both = state.join(ahead, "to", "left").select("id", F.col("further").alias("to"), *[F.col(f"s{c}").bitwiseXOR(F.coalesce(f"t{c}", F.lit(0))).alias(f"s{c}") for c in "ab"])
            old, state = state, tables.durable(both)
            tables.drop(old)
            if state.where("to IS NOT NULL").isEmpty():
                break
        rest = arcs.join(state, "id").select("v", "w", F.col("sa").bitwiseXOR(F.col("a")).alias("a"), F.col("sb").bitwiseXOR(F.col("b")).alias("b"))
        sides = rest.groupBy(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v")).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        cut = tables.keep(tables.durable(sides.where("a = 0 AND b = 0").select("u", "v", F.lit(True).alias("bridge"))))
    keyed = on.withColumn("u", F.least("from_bus", "to_bus")).withColumn("v", F.greatest("from_bus", "to_bus")).join(cut, ["u", "v"], "left")
    bridge = F.coalesce("bridge", F.lit(False))
    return keyed.select("from_bus", "to_bus", "ckt", bridge.alias("bridge"), (F.lit(n_base) + bridge.cast("int")).cast("long").alias("components"))


def _euler_tour(tree: DataFrame, label: DataFrame, tables: Workspace) -> DataFrame:
    """(id, v, w, next, opens): both arcs of every tree edge with the arc that follows on the tour of its tree, null at the tour's end; ``opens``
    marks one arc out of every node. From an arc (v, w) a tour goes on with the arc out of w that follows (w, v) in w's list, which is circular.
    A tour is opened before the first arc out of the tree's label."""
    out = tree.select(F.col("u").alias("v"), F.col("v").alias("w")).union(tree.select("v", F.col("u").alias("w")))
    placed = number(out, ["v", "w"], "id")
    lists = placed.groupBy("v").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    placed = tables.durable(placed.join(lists, "v").join(label, "v").withColumn("follows", F.when(F.col("id") == F.col("last"), F.col("first")).otherwise(F.col("id") + 1)))
    starts = (F.col("v") == F.col("component")) & (F.col("follows") == F.col("first"))
    after = placed.select(F.col("w").alias("v"), F.col("v").alias("w"), F.when(~starts, F.col("follows")).alias("next"))  # of the arc into v that is the reverse
    return placed.join(after, ["v", "w"]).select("id", "v", "w", "next", (F.col("id") == F.col("first")).alias("opens"))


def outage_candidates_by_degree(circuit: DataFrame) -> DataFrame:
    """Lines in service whose both ends have at least two lines in service."""
    on = circuit.where("status = 1")
    enough = _ends(on).groupBy("bus_id").agg(F.count(F.lit(1)).alias("d")).where("d >= 2")
    for end in ("from_bus", "to_bus"):
        on = on.join(enough.select(F.col("bus_id").alias(end)), end, "left_semi")
    return on.select(*circuit.columns)


def transfer_slack(bus: DataFrame, generator: DataFrame) -> DataFrame:
    """(slack_bus, transferred): the reference bus if it has an online generator; else the non-isolated bus with the largest sum of
    pmax of online generators (ties: the smallest bus), null when none is positive. With an event_idx on generators, per scenario."""
    keys = ["event_idx"] if "event_idx" in generator.columns else []
    capacity = generator.where("status = 1").groupBy(*keys, "bus_id").agg(F.sum("pmax").alias("pmax"))
    capacity = capacity.join(bus.where(F.col("type") != ISOLATED).select("bus_id", (F.col("type") == 3).alias("reference")), "bus_id")
    own = F.min(F.when(F.col("reference"), F.col("bus_id")))
    other = F.max_by(F.when(F.col("pmax") > 0, F.col("bus_id")), F.when(F.col("pmax") > 0, F.struct(F.round("pmax", 6), -F.col("bus_id"))))
    return capacity.groupBy(*keys).agg(F.coalesce(own, other).alias("slack_bus"), own.isNull().alias("transferred"))


def tie_lines(circuit: DataFrame, bus: DataFrame, area1: int, zone1: int, area2: int, zone2: int) -> DataFrame:
    """Circuits between (area1, zone1) and (area2, zone2), in either direction; a zone of 0 or less means any."""
    place = lambda end, p: bus.select(F.col("bus_id").alias(end), F.col("area").alias(f"{p}_area"), F.col("zone").alias(f"{p}_zone"))
    inside = lambda p, area, zone: (F.col(f"{p}_area") == area) & (F.lit(zone <= 0) | (F.col(f"{p}_zone") == zone))
    joined = circuit.join(place("from_bus", "f"), "from_bus").join(place("to_bus", "t"), "to_bus")
    there, back = inside("f", area1, zone1) & inside("t", area2, zone2), inside("f", area2, zone2) & inside("t", area1, zone1)
    return joined.where(there | back).select(*circuit.columns)


def rank_islands(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, island, n_buses, rank): islands by size, ties by label."""
    sizes = found.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n_buses"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n_buses").desc(), "island")))
