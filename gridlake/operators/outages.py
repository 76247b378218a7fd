"""Islands of all outage scenarios at once, without rows of network times scenarios.

What no scenario touches is contracted once: the blocks that stay connected whatever scenario happens are the nodes of a
quotient graph, the circuits that some scenario takes out its edges. All scenarios share a spanning forest of it, laid out as Euler tours. Taking
forest edges out cuts a tour into nested intervals, the pieces; what joins pieces again are edges outside the forest.
These have random 128-bit labels, and a set of pieces is cut off if and only if the labels leaving it cancel (wrong with probability
2**-128 for a set): labels of intervals are differences of suffix sums of the tour, and the removed labels are added where their ends lie. So a
scenario of k circuits costs a solution of k equations over bits, wherever in the network they are. Sizes of pieces are suffix sums as well,
and their smallest buses are range minima, looked up in the rounds of pointer doubling that made the sums.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridlake.functions.durable import Workspace
from gridlake.operators.components import connected_components, spanning_forest
from gridlake.operators.keyed import apply_scenarios
from gridlake.operators.topology import ISOLATED, _euler_tour, islands

CIRCUIT = ("from_bus", "to_bus", "ckt")
#: A scenario of more circuits isn't solved in one row, but by components of its own network.
MOST_CIRCUITS = 2_000


class _Shared(NamedTuple):
    """What all scenarios have in common, as durable tables."""

    blocks: DataFrame  # bus_id, block
    base: DataFrame  # island, n_buses: the islands without outages
    places: DataFrame  # block, component, d: the place on its tour, counted from the end, of a block on a tree
    parts: DataFrame  # event_idx, component, part, n_buses, ranges, island: of the islands that scenarios split
    large: DataFrame  # event_idx of scenarios over MOST_CIRCUITS


def split(items: list[dict], length: int, total: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The parts (size, ranges of places) into which the removed edges split a tree's component.

    An item is a forest edge (places lo up to hi beyond it, labels a, b, n buses) or a spare one (places lo and hi of its ends)."""
    cuts = sorted((x for x in items if not x["spare"]), key=lambda x: x["lo"])
    label = lambda x: (x["a"] & (1 << 64) - 1) << 64 | x["b"] & (1 << 64) - 1
    values, sizes, ranges = [0, *map(label, cuts)], [total, *[x["n"] for x in cuts]], [[] for _ in range(len(cuts) + 1)]
    starts, owners, open_ = [1], [0], [0]
    ends = [length + 1, *[x["hi"] for x in cuts]]

    def close(before: int) -> None:
        while len(open_) > 1 and ends[open_[-1]] <= before:
            starts.append(ends[open_.pop()])
            owners.append(open_[-1])

    own = list(zip(values, sizes, strict=True))
    for i, x in enumerate(cuts, 1):
        close(x["lo"])
        values[open_[-1]] ^= own[i][0]
        sizes[open_[-1]] -= own[i][1]
        open_.append(i)
        starts.append(x["lo"])
        owners.append(i)
    close(length + 1)
    for i, (lo, hi) in enumerate(zip(starts, [*starts[1:], length + 1], strict=True)):
        if lo < hi:
            ranges[owners[i]].append((lo, hi))
    for x in items:
        if x["spare"]:
            for at in (x["lo"], x["hi"]):
                values[owners[bisect_right(starts, at) - 1]] ^= label(x)
    basis: dict[int, tuple[int, int]] = {}
    closed: list[int] = []  # sets of pieces whose labels cancel, as bits; each has a highest piece of its own
    for p, value in enumerate(values):
        members = 1 << p
        while value and value.bit_length() in basis:
            other, with_ = basis[value.bit_length()]
            value, members = value ^ other, members ^ with_
        if value:
            basis[value.bit_length()] = value, members
        else:
            closed.append(members)
    for i, one in enumerate(closed):  # disjoint sets are what is left when no set contains the highest piece of another
        for j in range(len(closed)):
            if j != i and closed[j] >> (one.bit_length() - 1) & 1:
                closed[j] ^= closed[i]
    out = []
    for members in closed:
        mine = [p for p in range(len(values)) if members >> p & 1]
        out.append((sum(sizes[p] for p in mine), sorted(r for p in mine for r in ranges[p])))
    return out


_ITEM = "struct<spare: boolean, lo: long, hi: long, a: long, b: long, n: long>"
_PARTS = "event_idx {event}, component long, part int, n_buses long, ranges array<struct<lo: long, hi: long>>"


def _split_rows(groups: DataFrame, event: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = split(r["items"], r["length"], r["total"])
                if len(found) > 1:
                    out += [{"event_idx": r["event_idx"], "component": r["component"], "part": i, "n_buses": n, "ranges": [{"lo": lo, "hi": hi} for lo, hi in ranges]} for i, (n, ranges) in enumerate(found)]
            kinds = {"event_idx": batch.schema.field("event_idx").type, "component": pa.int64(), "part": pa.int32(), "n_buses": pa.int64(), "ranges": pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))}
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))

    return groups.mapInArrow(run, _PARTS.format(event=event))


def _doubled(arcs: DataFrame, tables: Workspace) -> list[DataFrame]:
    """Rounds of pointer doubling over tours (id, next, a, b, n, m): round j sums 2**j arcs from each on (fewer at the end of a tour) as
    (id, to, a, b, n, m, d): the arc after them, labels, buses, smallest block and number of arcs."""
    rounds = [tables.durable(arcs.select("id", F.col("next").alias("to"), "a", "b", "n", "m", F.lit(1).cast("long").alias("d")))]
    while not rounds[-1].where("to IS NOT NULL").isEmpty():
        state = rounds[-1]
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("further"), *[F.col(c).alias(f"t{c}") for c in "abnmd"])
        nothing = F.lit(0).cast("long")
        xor = [F.col(c).bitwiseXOR(F.coalesce(f"t{c}", nothing)).alias(c) for c in "ab"]
        added = {c: (F.col(c) + F.coalesce(f"t{c}", nothing)).alias(c) for c in "nd"}
        rounds.append(tables.durable(state.join(ahead, "to", "left").select("id", F.col("further").alias("to"), *xor, added["n"], F.least("m", "tm").alias("m"), added["d"])))
    return rounds


def _shared(bus: DataFrame, circuit: DataFrame, outages: DataFrame, tables: Workspace) -> _Shared:
    live = bus.where(F.col("type") != ISOLATED).select("bus_id").distinct()
    on = circuit.where("status = 1 AND from_bus <> to_bus").select(*CIRCUIT)
    for end in ("from_bus", "to_bus"):
        on = on.join(live.withColumnRenamed("bus_id", end), end, "left_semi")
    out = tables.durable(outages.select("event_idx", *CIRCUIT).distinct())
    several = tables.durable(out.groupBy("event_idx").count().where("count > 1"))
    large = tables.durable(several.where(F.col("count") > MOST_CIRCUITS).select("event_idx"))
    marks = out.select(*CIRCUIT).distinct().withColumn("touched", F.lit(True))
    on = tables.durable(on.join(marks, list(CIRCUIT), "left").select(*CIRCUIT, F.col("touched").isNotNull().alias("touched")).distinct())
    touched = on.where("touched").select(*CIRCUIT)
    whole = connected_components(on.where("NOT touched"), (), "from_bus", "to_bus").select(F.col("node").alias("bus_id"), F.col("component").alias("block"))
    blocks = tables.keep(tables.durable(live.join(whole, "bus_id", "left").select("bus_id", F.coalesce("block", "bus_id").alias("block"))))
    sizes = tables.durable(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    renamed = tables.durable(blocks.where("bus_id <> block"))  # few or none if scenarios touch most of the network: then nothing is shuffled
    of = lambda end, name: renamed.select(F.col("bus_id").alias(end), F.col("block").alias(name))
    edges = touched.join(of("from_bus", "p"), "from_bus", "left").join(of("to_bus", "q"), "to_bus", "left")
    edges = edges.withColumns({"p": F.coalesce("p", "from_bus"), "q": F.coalesce("q", "to_bus")}).where("p <> q")
    edges = tables.durable(edges.select(*CIRCUIT, F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")))
    label, tree = spanning_forest(edges.select("u", "v").distinct())
    label = label.select(F.col("node").alias("block"), "component")
    base = sizes.join(label, "block", "left").groupBy(F.coalesce("component", "block").alias("island")).agg(F.sum("n").alias("n_buses"))
    base = tables.keep(tables.durable(base))
    event = outages.schema["event_idx"].dataType.simpleString()
    if edges.isEmpty():
        nothing = bus.sparkSession.createDataFrame([], _PARTS.format(event=event) + ", island long")
        return _Shared(blocks, base, label.select("block", "component", F.lit(0).cast("long").alias("d")), nothing, tables.keep(large))
    first = edges.join(tree, ["u", "v"], "left_semi").groupBy("u", "v").agg(F.min(F.struct(*CIRCUIT)).alias("one")).select("one.*", "u", "v")
    first = tables.durable(first)  # of parallel circuits one is the forest's, the others are spare
    labels = {c: F.xxhash64(*CIRCUIT, F.lit(i)) for i, c in enumerate("ab")}
    spare = tables.durable(edges.join(first, list(CIRCUIT), "left_anti").select(*CIRCUIT, "u", "v"))
    # labels are made where they are added up, so that shuffles don't carry them
    ends = spare.select(F.col("u").alias("v"), *CIRCUIT).union(spare.select("v", *CIRCUIT)).repartition("v")
    mine = ends.select("v", *[labels[c].alias(c) for c in "ab"]).groupBy("v").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    arcs = _euler_tour(tree, label.withColumnRenamed("block", "v"), tables).join(mine, "v", "left").join(sizes.withColumnRenamed("block", "v"), "v")
    own = lambda c: F.when(F.col("opens"), F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias(c)
    arcs = tables.durable(arcs.select("id", "v", "w", "next", "opens", own("a"), own("b"), own("n"), F.when(F.col("opens"), F.col("v")).alias("m")))
    rounds = _doubled(arcs, tables)
    rest = rounds[-1].select("id", "d", *[F.col(c).alias(f"s{c}") for c in "abn"])
    tour = arcs.join(rest, "id").join(label.withColumnRenamed("block", "v"), "v")
    tour = tour.select("id", "v", "w", "component", "opens", "d", F.col("sa").bitwiseXOR(F.col("a")).alias("a"), F.col("sb").bitwiseXOR(F.col("b")).alias("b"), (F.col("sn") - F.col("n")).alias("n"), F.col("sn").alias("all"))
    tour = tables.durable(tour)
    lengths = tour.groupBy("component").agg(F.max("d").alias("length"), F.max("all").alias("total"))
    sides = tour.groupBy(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v"), "component").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), (F.max("n") - F.min("n")).alias("n")
    )
    places = tables.keep(tables.durable(tour.where("opens").select(F.col("v").alias("block"), "component", "d")))
    at = lambda end, name: places.select(F.col("block").alias(end), F.col("d").alias(name), *(["component"] if end == "u" else []))
    item = lambda spare: F.struct(F.lit(spare).alias("spare"), "lo", "hi", "a", "b", F.col("n").cast("long").alias("n")).cast(_ITEM).alias("item")
    forest = tables.durable(first.join(sides, ["u", "v"]).select(*CIRCUIT, "component", item(False)))
    # a circuit that goes alone splits something only if it is a forest edge whose labels cancel: no other is looked for
    bridges = tables.durable(forest.where("item.a = 0 AND item.b = 0"))
    removed = out.join(bridges, list(CIRCUIT)).join(several, "event_idx", "left_anti").select("event_idx", "component", "item")
    if not several.isEmpty():
        others = spare.withColumns(labels).join(at("u", "lo"), "u").join(at("v", "hi"), "v").withColumn("n", F.lit(0)).select(*CIRCUIT, "component", item(True))
        more = out.join(several.select("event_idx"), "event_idx", "left_semi").join(large, "event_idx", "left_anti")
        removed = removed.union(more.join(forest.union(others), list(CIRCUIT)).select("event_idx", "component", "item"))
    groups = removed.groupBy("event_idx", "component").agg(F.collect_list("item").alias("items"), F.count(F.when(~F.col("item.spare"), 1)).alias("cuts"))
    # one forest edge whose labels don't cancel, or spare edges only, split nothing
    alone = (F.size("items") == 1) & ((F.col("items")[0]["a"] != 0) | (F.col("items")[0]["b"] != 0))
    parts = tables.durable(_split_rows(groups.where((F.col("cuts") > 0) & ~alone).join(lengths, "component").select("event_idx", "component", "items", "length", "total"), event))
    ranges = parts.select("event_idx", "component", "part", F.explode("ranges").alias("r")).select("event_idx", "component", "part", "r.*")
    ranges = ranges.withColumn("j", F.length(F.bin(F.col("hi") - F.col("lo"))) - 1)  # two runs of 2**j arcs cover a range
    looks = ranges.withColumn("d", F.explode(F.array(F.col("hi") - 1, F.col("lo") + F.expr("shiftleft(1L, j)") - 1))).select("event_idx", "component", "part", "j", "d")
    least = None
    for j, some in enumerate(rounds):
        some = some.select(F.lit(j).alias("j"), "id", "m")
        least = some if least is None else least.union(some)
    least = looks.join(tour.select("component", "d", "id"), ["component", "d"]).join(least, ["j", "id"]).groupBy("event_idx", "component", "part").agg(F.min("m").alias("island"))
    parts = tables.keep(tables.durable(parts.join(least, ["event_idx", "component", "part"]).select("event_idx", "component", "part", "n_buses", "ranges", "island")))
    return _Shared(blocks, base, places, parts, tables.keep(large))


def _size(n: str, island: str):
    return F.struct(F.col(n).alias("n"), (-F.col(island)).alias("i"))


def scenario_islands(bus: DataFrame, circuit: DataFrame, outages: DataFrame) -> DataFrame:
    """(event_idx, islands, main_island, main_buses, isolated_buses) of every scenario of ``outages`` (event_idx, from_bus, to_bus, ckt).

    Islands are components of non-isolated buses over circuits in service that the scenario doesn't take out; an island is named by its
    smallest bus, the main one has most buses (ties: the smallest name), all other buses count as isolated. Circuits that don't
    exist, are out already or repeat take nothing out. Scenarios of up to MOST_CIRCUITS circuits are solved on shared tables, larger ones each by the components of
    its own network. Per scenario a row leaves the tasks only for islands that it splits.
    """
    with Workspace(bus.sparkSession) as tables:
        return _summed(bus, circuit, outages, _shared(bus, circuit, outages, tables), tables)


def _summed(bus: DataFrame, circuit: DataFrame, outages: DataFrame, shared: _Shared, tables: Workspace) -> DataFrame:
    counts = shared.base.agg(F.count(F.lit(1)).alias("islands"), F.coalesce(F.sum("n_buses"), F.lit(0)).alias("buses")).first()
    split_up = shared.parts.groupBy("event_idx").agg((F.count(F.lit(1)) - F.countDistinct("component")).alias("more"), F.collect_set("component").alias("gone"), F.max(_size("n_buses", "island")).alias("part"))
    split_up = tables.keep(tables.durable(split_up))
    most = split_up.agg(F.coalesce(F.max(F.size("gone")), F.lit(0))).first()[0]
    # the largest island that a scenario leaves whole is among the first most + 1
    top = shared.base.orderBy(F.desc("n_buses"), "island").limit(most + 1)
    top = tables.keep(tables.durable(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_buses"), "island")))))
    gone = split_up.select("event_idx", F.explode("gone").alias("island")).join(F.broadcast(top.select("island", "rank")), "island")
    gone = gone.groupBy("event_idx").agg(F.collect_set("rank").alias("ranks"))
    events = outages.select("event_idx").distinct().join(shared.large, "event_idx", "left_anti").join(split_up, "event_idx", "left").join(gone, "event_idx", "left")
    ranks = F.coalesce("ranks", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(1), F.size(ranks) + 1), ranks)[0].alias("rank")
    best = events.select("event_idx", "more", "part", free).join(F.broadcast(top.select("rank", _size("n_buses", "island").alias("whole"))), "rank", "left").withColumn("main", F.greatest("part", "whole"))
    out = best.select("event_idx", (F.lit(counts["islands"]) + F.coalesce("more", F.lit(0))).alias("islands"), (-F.col("main.i")).alias("main_island"), F.coalesce("main.n", F.lit(0)).alias("main_buses"))
    if not shared.large.isEmpty():
        out = out.unionByName(tables.keep(tables.durable(_large(bus, circuit, outages, shared.large))))
    return out.withColumn("isolated_buses", F.lit(counts["buses"]) - F.col("main_buses"))


def _large(bus: DataFrame, circuit: DataFrame, outages: DataFrame, large: DataFrame) -> DataFrame:
    """The same columns for scenarios that take out very much, by components of their own networks."""
    found = islands(bus, apply_scenarios(circuit, outages.join(large, "event_idx", "left_semi")))
    return found.groupBy("event_idx").agg(F.countDistinct("island").alias("islands"), F.max(F.when(F.col("main"), F.col("island"))).alias("main_island"), F.max("n_buses").alias("main_buses"))


def scenario_bus_islands(bus: DataFrame, circuit: DataFrame, outages: DataFrame) -> DataFrame:
    """(event_idx, bus_id, island, n_buses, main) of every non-isolated bus in every scenario, as ``islands`` gives them for circuits with an event_idx.

    The result is buses times scenarios; what is worked out for it isn't. Scenarios over MOST_CIRCUITS go the way of ``islands``."""
    with Workspace(bus.sparkSession) as tables:
        shared = _shared(bus, circuit, outages, tables)
        main = _summed(bus, circuit, outages, shared, tables).select("event_idx", "main_island")
        few = outages.select("event_idx").distinct().join(shared.large, "event_idx", "left_anti")
        big = outages.join(shared.large, "event_idx", "left_semi")
    parts = shared.parts.select("event_idx", "component", "island", "n_buses", F.explode("ranges").alias("r")).select("event_idx", "component", F.col("island").alias("_island"), F.col("n_buses").alias("_n"), "r.lo", "r.hi")
    homes = shared.blocks.join(shared.places, "block", "left").select("bus_id", F.coalesce("component", "block").alias("component"), "d")
    homes = homes.join(shared.base.withColumnRenamed("island", "component"), "component")
    every = homes.crossJoin(F.broadcast(few))
    inside = (every["event_idx"] == parts["event_idx"]) & (every["component"] == parts["component"]) & (F.col("d") >= F.col("lo")) & (F.col("d") < F.col("hi"))
    rows = every.join(parts, inside, "left").select(every["event_idx"], "bus_id", F.coalesce("_island", every["component"]).alias("island"), F.coalesce("_n", "n_buses").alias("n_buses"))
    rows = rows.join(main, "event_idx").select("event_idx", "bus_id", "island", "n_buses", (F.col("island") == F.col("main_island")).alias("main"))
    return rows if shared.large.isEmpty() else rows.unionByName(islands(bus, apply_scenarios(circuit, big)))
