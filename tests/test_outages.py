"""Islands of scenarios on shared tables against a search of every scenario's own network."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import outages, topology

CIRCUIT = "from_bus long, to_bus long, ckt string, status int"


def searched(buses, circuits, gone):
    """Sizes by smallest bus of the components over circuits in service that aren't gone."""
    live = {b for b, kind in buses if kind != 4}
    near = collections.defaultdict(set)
    for a, b, ckt, status in circuits:
        if status == 1 and (a, b, ckt) not in gone and a in live and b in live:
            near[a].add(b)
            near[b].add(a)
    left, out = set(live), {}
    while left:
        root = min(left)
        seen, todo = {root}, [root]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        left -= seen
        out[root] = seen
    return out


def network(seed, n=24, m=30):
    rng = random.Random(seed)
    buses = [(i * 7 - 20, 4 if rng.random() < 0.08 else 1) for i in range(n)]
    ids = [b for b, _ in buses]
    circuits = {}
    for i in range(n - 1):  # a tree, some of it parallel, and a few loops
        if rng.random() < 0.9:
            a, b = ids[rng.randrange(i + 1)], ids[i + 1]
            for ckt in "12"[: rng.choice([1, 1, 1, 2])]:
                circuits[(a, b, ckt) if rng.random() < 0.5 else (b, a, ckt)] = int(rng.random() < 0.9)
    while len(circuits) < m:
        circuits[rng.choice(ids), rng.choice(ids), rng.choice("123")] = int(rng.random() < 0.8)
    circuits = [(*k, s) for k, s in circuits.items()]
    events = [(e, *c[:3]) for e in range(40) for c in rng.sample(circuits, rng.choice([1, 1, 2, 3, 5, 9, 20]))]
    events += [(40, 999, 998, "1"), (41, *circuits[0][:3]), (41, *circuits[0][:3]), (41, 999, 998, "1")]
    events += [(42, *c[:3]) for c in circuits]
    return buses, circuits, events


@pytest.mark.parametrize(("seed", "most"), [(3, 2000), (4, 4)])
def test_scenarios_against_a_search_of_each(spark, monkeypatch, seed, most):
    monkeypatch.setattr(outages, "MOST_CIRCUITS", most)
    buses, circuits, events = network(seed, n=24 + 3 * seed, m=26 + 5 * seed)
    tables = spark.createDataFrame(buses, "bus_id long, type int"), spark.createDataFrame(circuits, CIRCUIT), spark.createDataFrame(events, "event_idx int, from_bus long, to_bus long, ckt string")
    found = {r.event_idx: r for r in outages.scenario_islands(*tables).collect()}
    each = collections.defaultdict(dict)
    for r in outages.scenario_bus_islands(*tables).collect():
        assert r.bus_id not in each[r.event_idx]
        each[r.event_idx][r.bus_id] = (r.island, r.n_buses, r.main)
    gone = collections.defaultdict(set)
    for e, *c in events:
        gone[e].add(tuple(c))
    assert set(found) == set(gone) == set(each)
    for e, out in gone.items():
        parts = searched(buses, circuits, out)
        main = max(parts, key=lambda p: (len(parts[p]), -p))
        r = found[e]
        assert (r.islands, r.main_island, r.main_buses, r.isolated_buses) == (len(parts), main, len(parts[main]), sum(map(len, parts.values())) - len(parts[main]))
        assert each[e] == {b: (p, len(m), p == main) for p, m in parts.items() for b in m}


def test_all_single_outages_agree_with_screening(spark):
    buses, circuits, _ = network(9, 60, 70)
    bus, circuit = spark.createDataFrame(buses, "bus_id long, type int").where("type <> 4"), spark.createDataFrame(circuits, CIRCUIT)
    live = {b for b, kind in buses if kind != 4}
    circuit = circuit.where(F.col("from_bus").isin(*live) & F.col("to_bus").isin(*live))
    events = circuit.where("status = 1").select(F.xxhash64("from_bus", "to_bus", "ckt").alias("event_idx"), "from_bus", "to_bus", "ckt")
    found = {r.event_idx: r.islands for r in outages.scenario_islands(bus, circuit, events).collect()}
    screened = topology.screen_outages(bus, circuit).select(F.xxhash64("from_bus", "to_bus", "ckt").alias("event_idx"), "components").collect()
    assert found == {r.event_idx: r.components for r in screened}


def test_nothing_to_take_out(spark):
    bus = spark.createDataFrame([(1, 1), (2, 1), (3, 4)], "bus_id long, type int")
    circuit = spark.createDataFrame([(1, 2, "1", 1)], CIRCUIT)
    none = spark.createDataFrame([], "event_idx int, from_bus long, to_bus long, ckt string")
    assert outages.scenario_islands(bus, circuit, none).count() == 0
    one = spark.createDataFrame([(5, 8, 9, "1")], none.schema)
    assert [tuple(r) for r in outages.scenario_islands(bus, circuit, one).collect()] == [(5, 1, 1, 2, 0)]
    assert [tuple(r) for r in outages.scenario_islands(bus.where("false"), circuit, one).collect()] == [(5, 0, None, 0, 0)]


def test_split_against_counting_on_random_trees():
    """Nested intervals, spare edges and cancelling labels, against components of the graph itself."""
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(2, 14)
        parent = {i: rng.randrange(i) for i in range(1, n)}
        children = collections.defaultdict(list)
        for c, p in parent.items():
            children[p].append(c)
        tour = []

        def walk(v):
            for c in children[v]:  # noqa: B023
                tour.append((v, c))  # noqa: B023
                walk(c)
                tour.append((c, v))  # noqa: B023

        walk(0)
        place = {arc: len(tour) - i for i, arc in enumerate(tour)}  # counted from the end, as the operator does
        home = {v: next(place[a] for a in tour if a[0] == v) for v in range(n)}
        spare = [(rng.randrange(n), rng.randrange(n), rng.getrandbits(63), rng.getrandbits(63)) for _ in range(rng.randrange(6))]
        items, forest_out, spare_out = [], [], []
        for c, p in parent.items():
            if rng.random() < 0.5:
                lo, hi = place[c, p], place[p, c]
                inside = {v for v in range(n) if lo <= home[v] < hi}
                a = b = 0
                for u, v, x, y in spare:
                    if (u in inside) != (v in inside):
                        a, b = a ^ x, b ^ y
                items.append({"spare": False, "lo": lo, "hi": hi, "a": a, "b": b, "n": len(inside)})
                forest_out.append((c, p))
        for s in spare:
            if rng.random() < 0.5:
                items.append({"spare": True, "lo": home[s[0]], "hi": home[s[1]], "a": s[2], "b": s[3], "n": 0})
                spare_out.append(s)
        buses = [(v, 1) for v in range(n)]
        circuits = [(c, p, "t", 1) for c, p in parent.items() if (c, p) not in forest_out] + [(u, v, "s", 1) for u, v, x, y in spare if (u, v, x, y) not in spare_out]
        wanted = sorted(sorted(m) for m in searched(buses, circuits, set()).values())
        found = outages.split(items, len(tour), n)
        parts = sorted(sorted(v for v in range(n) if any(lo <= home[v] < hi for lo, hi in ranges)) for _, ranges in found)
        assert parts == wanted and sorted(size for size, _ in found) == sorted(map(len, wanted))
