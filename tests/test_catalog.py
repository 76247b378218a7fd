import re

import pytest
from pyspark.sql import functions as F

from gridlake.plans import catalog, roles
from tests.checks import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    assert_same(catalog.queries()[name](spark, SF).toPandas(), tables.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(roles.SQL))
def test_roles_agree(spark, tables, name):
    assert roles.frame(spark, SF, name).count() == len(tables.sql(roles.check_sql("SELECT 1 FROM {%s}" % name)).df())


def test_flagship_and_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nested_json_has_every_part(spark):
    import json

    rows = [json.loads(r.json) for r in catalog.queries()["nested_case_json"](spark, SF).collect()]
    one = next(r for r in rows if r["event_idx"] == 1)
    assert [b["bus_id"] for b in one["solution"]["buses"]] == list(range(150))
    assert {one["has_voltage_violation"], one["has_branch_violation"]} <= {True, False}
    assert one["solution"]["generators"] and one["solution"]["branches"] and "iterations" in one["solution"]["convergence"]


@pytest.mark.parametrize("name", ["islands_by_scenario", "islands_of_outages", "screen_outages"])
def test_circuits_are_worked_out_once(spark, monkeypatch, name):
    made, frame = [], roles.frame

    def watched(spark, sf_dir, role, fixed=None):
        made.append(role) if role == "circuit" and not (fixed and role in fixed) else None
        return frame(spark, sf_dir, role, fixed)

    monkeypatch.setattr(roles, "frame", watched)
    monkeypatch.setattr(catalog.outages, "scenario_islands", lambda bus, circuit, outages: bus.crossJoin(circuit.limit(1)).crossJoin(outages.limit(1)).select(outages["event_idx"], F.lit(1).alias("islands"), F.lit(1).alias("main_buses")))
    monkeypatch.setattr(catalog.topology, "screen_outages", lambda bus, circuit: circuit.union(circuit))
    catalog.queries()[name](spark, SF)
    assert made == ["circuit"]


@pytest.mark.parametrize("blocks", [1, 3, None])
def test_circuits_in_cells_are_the_role(spark, blocks):
    found, wanted = roles.circuit_in_cells(spark, SF, blocks), roles.frame(spark, SF, "circuit")
    assert sorted(found.drop("cell").collect()) == sorted(wanted.collect())
    pairs = found.select(F.least("from_bus", "to_bus").alias("a"), F.greatest("from_bus", "to_bus").alias("b"), "cell").distinct()
    assert pairs.count() == pairs.select("a", "b").distinct().count()


def test_ybus_shuffles_circuits_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = catalog.queries()["ybus_coo"](spark, SF)
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(i#" in plan and not re.search(r"hashpartitioning\((i#\w+, j#|l_partkey.*ENSURE|from_bus|.*l_linenumber)", plan)
    # lines and parts in cells, both of which the other half of the query uses again
    made, again = (len(re.findall(p + r"Exchange hashpartitioning\(cell#", plan)) for p in (r"(?<!\], )", r"ReusedExchange \[.*\], "))
    assert (made, again) == (2, 2)
