"""Pairs by their numbers, list rules with repeated elements, products with heavy inner indices, and the search for ratings."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import coo, limits, scenarios


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "m", "caps"), [(7, 5, {}), (1, 0, {}), (0, 4, {}), (9, 9, {"GG": 0, "LL": 4, "GL": None}), (40, 3, {"GG": 100, "GL": 50, "LL": 60}), (3, 50, {"GL": 49, "LL": 51})])
def test_pairs_by_number(spark, n, m, caps):
    rng = random.Random(n)
    singles = [(i, "Generator") for i in rng.sample(range(1000), n)] + [(i, "Line") for i in rng.sample(range(1000), m)]
    found = scenarios.n2_pairs(spark.createDataFrame(singles, "idx long, type string"), caps)
    g, line = (sorted(i for i, t in singles if t == kind) for kind in ("Generator", "Line"))
    wanted = []
    for kind, pairs in (("GG", itertools.combinations(g, 2)), ("GL", itertools.product(g, line)), ("LL", itertools.combinations(line, 2))):
        wanted += [(kind, *p) for p in list(pairs)[: caps.get(kind)]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_all_pairs_without_products_of_lists(spark):
    singles = spark.range(5000).select((F.col("id") * 3).alias("idx"), F.lit("Line").alias("type"))
    found = scenarios.n2_pairs(singles)
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
    row = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") < F.col("b")).alias("up"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    n = 5000
    assert (row.n, row.up) == (n * (n - 1) // 2,) * 2 and row.a == sum(3 * i * (n - 1 - i) for i in range(n)) and row.b == sum(3 * i * i for i in range(n))


ELEMENT = "event_idx long, type string, pos int, from_bus long, to_bus long, ckt string, bus_id long, gen_id string"


def elements(lists):
    return [(e, kind, p, x, x, "1", None, None) if kind == "Line" else (e, kind, p, None, None, None, x, "g") for e, kind, xs in lists for p, x in enumerate(xs)]


def repeats(new, old):
    """The rule read literally: same type, same number of elements, each one found."""
    return any(kind == new[1] and len(xs) == len(new[2]) and all(x in xs for x in new[2]) for _, kind, xs in old)


def test_lists_with_repeats(spark):
    rng = random.Random(5)
    make = lambda start, n: [(start + i, rng.choice(["Line", "Generator"]), [rng.randrange(4) for _ in range(rng.randrange(1, 4))]) for i in range(n)]
    auto, file = make(0, 25), make(100, 60)
    frames = [spark.createDataFrame(elements(x), ELEMENT) for x in (auto, file)]
    kept = scenarios.dedup_scenarios(frames[1], frames[0])
    assert {r.event_idx for r in kept.collect()} == {x[0] for x in file if not repeats(x, auto)} and kept.columns == frames[1].columns
    whole, added = list(auto), []
    for x in file:
        if not repeats(x, whole):
            whole.append(x)
            added.append(x)
    combined, counts = scenarios.combine(*frames)
    assert tuple(counts.first()) == (len(auto), len(added), len(file) - len(added)) and 0 < len(added) < len(file)
    wanted = [(i, p, x) for i, (_, kind, xs) in enumerate([*auto, *added], 1) for p, x in enumerate(xs)]
    assert sorted((r.event_idx, r.pos, r.from_bus if r.type == "Line" else r.bus_id) for r in combined.collect()) == sorted(wanted)


@pytest.mark.parametrize("block", [2, 7, 20_000])
def test_products_with_heavy_indices(spark, block):
    rng = random.Random(2)
    entries = lambda hot: {(rng.randrange(25), 3 if rng.random() < hot else rng.randrange(25)): (rng.randrange(9) - 4.0, rng.randrange(5) * 1.0) for _ in range(150)}
    a, b = entries(0.4), {(j, i): z for (i, j), z in entries(0.4).items()}
    frame = lambda m: spark.createDataFrame([(i, j, *z) for (i, j), z in m.items()], "i long, j long, re double, im double")
    wanted = collections.defaultdict(complex)
    for (i, k), x in a.items():
        for (q, j), y in b.items():
            if k == q:
                wanted[i, j] += complex(*x) * complex(*y)
    found = {(r.i, r.j): complex(r.re, r.im) for r in coo.spgemm(frame(a), frame(b), block).collect()}
    assert found == dict(wanted)
    assert coo.spgemm(frame(a).where("false"), frame(b), block).count() == 0


def test_products_are_not_shuffled(spark):
    ones = spark.range(40).select((F.col("id") % 8).alias("i"), F.floor(F.col("id") / 8).alias("j"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    plan = coo.spgemm(ones, ones, 50)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "HashAggregate" in above and "Exchange" not in above  # sums are made where the products are


def search(m):
    """The search step by step: m is code by hundredths: 1 secure, 0 insecure, -1 (or absent) beyond capacity."""
    at = lambda k: m.get(k, -1)
    k = 100
    if at(k) == 1:
        for step in (5, 1):
            while at(k + step) == 1:
                k += step
        return k / 100, at(k + 1) == -1
    secure = False
    while not secure and k >= 0:
        k -= 5
        if at(k) == -1 and k >= 0:
            k += 5
            break
        secure = at(k) == 1
        if secure:
            k += 5
    if k < 0:
        return None
    secure = False
    while not secure and k >= 0:
        k -= 1
        if at(k) == -1 and k >= 0:
            return (k + 1) / 100, True
        secure = at(k) == 1
    return (k / 100, False) if secure else None


def test_rating_search_against_steps(spark):
    rng = random.Random(6)
    cases, rows = {}, []
    for tie in range(120):
        low, high = rng.choice([0, 40, 70, 83]), rng.choice([100, 112, 126, 140])
        m = {k: rng.choice([-1, 0, 1, 1, 1] if rng.random() < 0.5 else [0, 0, 0, 1]) if rng.random() < 0.5 else int(k < rng.choice([80, 104, 120])) for k in range(low, high + 1)}
        cases[tie] = m
        for k, code in m.items():
            rows += [(tie, k / 100, True, code >= 0), (tie, k / 100, code == 1, True)]
    found = {r.tie: r for r in limits.rating_search(spark.createDataFrame(rows, "tie int, rating double, ok boolean, feasible boolean")).collect()}
    for tie, m in cases.items():
        if m[100] == -1:
            m[100] = 0  # the start is judged by its outcome alone
        wanted = search(m)
        r = found[tie]
        assert (r.rating if wanted is None else (round(r.rating, 9), r.limited)) == wanted, (tie, m)
    few = [(1, k / 100, k <= 85 or k == 87) for k in range(50, 131)]
    assert [r.rating for r in limits.rating_search(spark.createDataFrame(few, "tie int, rating double, ok boolean")).collect()] == [0.87]


def test_taps_stop_at_their_limits(spark):
    devices = [(1, 1, 0, 1.0, 1.1, "tap", 0.9, 0.00625, 0.9, 1.1, True), (2, 1, 0, 1.0, 1.1, "tap", 0.903, 0.00625, 0.9, 1.1, True), (3, 1, 9, 1.02, 1.1, "tap", 1.0, 0.00625, 0.9, 1.1, False), (4, 1, 9, 1.0, 1.1, "shunt", None, None, None, None, None), (5, 1, 2, 1.0, 1.001, "shunt", None, None, None, None, None), (6, 1, 2, 0.9, 1.04, "tap", 1.1, 0.00625, 0.9, 1.1, True)]
    voltage = spark.createDataFrame([(0, 1, 0.95), (0, 2, 1.05)], "event_idx int, bus_id long, v_pu double")
    frame = spark.createDataFrame(devices, "device int, own_bus long, remote_bus long, low double, high double, kind string, tap double, step double, rmi double, rma double, to_side boolean")
    found = {r.device: (r.v_pu, r.direction, r.new_tap) for r in limits.deadband_screen(frame, voltage).collect()}
    assert found == {2: (0.95, 1, 0.9), 3: (1.0, 1, 1.00625), 4: (0.95, 1, None), 5: (1.05, -1, None)}
