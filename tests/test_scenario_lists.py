"""Lists of scenarios: repeated ones by brute force, and how often their elements are grouped."""

import random

import pytest

from gridlake.operators import keyed, scenarios
from gridlake.plans import catalog
from tests.checks import assert_same, connection

SF = "/root/testdata/sf0.001"
ELEMENT = "event_idx long, type string, pos int, from_bus long, to_bus long, ckt string, bus_id long, gen_id string"


def listed(spark, lists):
    return spark.createDataFrame([(e, kind, i, *x, None, None) for e, kind, xs in lists for i, x in enumerate(xs)], ELEMENT)


def repeats(one, other):
    return one[1] == other[1] and len(one[2]) == len(other[2]) and set(one[2]) <= set(other[2])


@pytest.mark.parametrize("several", [False, True])
def test_f13_repeated_scenarios(spark, several):
    rng = random.Random(4)
    pool = [(1, 2, "1"), (12, None, "1"), (1, 2, "1:1"), (1, 21, "")]  # alike if their columns were only strung together

    def make(e):
        n = rng.randrange(1, 4)
        xs = [rng.choice(pool) for _ in range(n)] if several else rng.choice([rng.sample(pool, n), [rng.choice(pool)] * n])
        return e, rng.choice("LG"), xs

    auto, file = [make(e) for e in range(12)], [make(e) for e in range(20, 60)]
    kept = [x for i, x in enumerate(file) if not any(repeats(x, y) for y in auto + file[:i])]
    combined, counts = scenarios.combine(listed(spark, auto), listed(spark, file))
    assert counts.first().asDict() == {"auto": 12, "added": len(kept), "skipped": 40 - len(kept)} and 0 < len(kept) < 40
    assert combined.count() == sum(len(x[2]) for x in auto + kept)
    fresh = {x[0] for x in file if not any(repeats(x, y) for y in auto)}
    assert {r.event_idx for r in scenarios.dedup_scenarios(listed(spark, file), listed(spark, auto)).collect()} == fresh


def test_f13_contents_are_grouped_once(spark, monkeypatch):
    made = []
    own = scenarios._content
    monkeypatch.setattr(scenarios, "_content", lambda *a: made.append(own(*a)) or made[-1])
    frame = catalog.queries()["combined_scenarios"](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 2 and "collect_set" not in plan and "lineitem" not in plan  # neither contents nor circuits are worked out again
    assert_same(frame.toPandas(), connection(SF).sql(catalog.oracle_sql()["combined_scenarios"]).df())


def test_f34_scenarios_multiply_circuits_last(spark):
    circuit = spark.createDataFrame([(1, 2, "1", 1), (1, 2, "2", 1), (2, 3, "1", 0), (3, 1, None, 1)], "from_bus long, to_bus long, ckt string, status int")
    out = spark.createDataFrame([(1, 1, 2, "1"), (1, 1, 2, "1"), (1, 1, 2, "2"), (2, 1, 2, "2"), (3, 9, 9, "1"), (None, 2, 3, "1"), (4, 3, 1, None)], "event_idx int, from_bus long, to_bus long, ckt string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = keyed.apply_scenarios(circuit, out)
        head = found._jdf.queryExecution().executedPlan().toString().partition("BroadcastNestedLoopJoin")[0]
        assert "Exchange" not in head and found.columns == ["event_idx", "from_bus", "to_bus", "ckt", "status"]
        gone = {(1, 1, 2, "1"), (1, 1, 2, "2"), (2, 1, 2, "2")}
        wanted = {(e, *c[:3], 0 if (e, *c[:3]) in gone else c[3]) for e in (1, 2, 3, None, 4) for c in circuit.collect()}
        assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
