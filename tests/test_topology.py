import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import components, topology
from gridlake.operators.components import connected_components


def network(spark, edges, n):
    bus = spark.range(n).select(F.col("id").alias("bus_id"), F.lit(1).alias("type"))
    circuit = spark.createDataFrame([(a, b, str(i), 1) for i, (a, b) in enumerate(edges)], "from_bus long, to_bus long, ckt string, status int")
    return bus, circuit


def screened(spark, edges, n):
    return None, {int(r.ckt): r.components for r in topology.screen_outages(*network(spark, edges, n)).collect()}


def brute(edges, n):
    def count(skip):
        label = list(range(n))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for i, (a, b) in enumerate(edges):
            if i != skip:
                label[root(a)] = root(b)
        return len({root(x) for x in range(n)})

    return {i: count(i) for i in range(len(edges))}


def test_cycle_with_tail(spark):
    assert screened(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], 4)[1] == {0: 1, 1: 1, 2: 1, 3: 2}


def test_parallel_circuits(spark):
    assert screened(spark, [(0, 1), (0, 1), (1, 2)], 3)[1] == {0: 1, 1: 1, 2: 2}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_against_removal(spark, seed):
    rng = random.Random(seed)
    n = 12
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(13)]
    assert screened(spark, edges, n)[1] == brute(edges, n)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A circuit of a chain is a bridge; so is none of a ring. Rounds are counted by the durable tables that are written."""
    from gridlake.functions import durable

    written = []
    plain = durable._written
    monkeypatch.setattr(durable, "_written", lambda frame: written.append(1) or plain(frame))
    chain = spark.range(999).select(F.col("id").alias("from_bus"), (F.col("id") + 1).alias("to_bus"), F.lit("1").alias("ckt"), F.lit(1).alias("status"))
    ring = spark.range(2000, 2300).select(F.col("id").alias("from_bus"), (F.when(F.col("id") == 2299, 2000).otherwise(F.col("id") + 1)).alias("to_bus"), F.lit("1").alias("ckt"), F.lit(1).alias("status"))
    bus = spark.range(1000).union(spark.range(2000, 2300)).select(F.col("id").alias("bus_id"), F.lit(1).alias("type"))
    found = topology.screen_outages(bus, chain.union(ring)).collect()
    assert {(r.from_bus < 2000, r.bridge, r.components) for r in found} == {(True, True, 3), (False, False, 2)} and len(found) == 1299
    assert len(written) < 60


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(1001, 1400).select(F.lit(1000).cast("long").alias("u"), F.col("id").alias("v"))
    found = {r.node: r.component for r in connected_components(chain.union(star)).collect()}
    assert set(found.values()) == {0, 1000} and len(found) == 301 + 400


def test_components_of_a_very_long_chain(spark):
    chain = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = connected_components(chain).collect()
    assert len(found) == 2001 and {r.component for r in found} == {0}
    bus, circuit = spark.range(2001).select(F.col("id").alias("bus_id"), F.lit(1).alias("type")), chain.select(F.col("u").alias("from_bus"), F.col("v").alias("to_bus"), F.lit("1").alias("ckt"), F.lit(1).alias("status"))
    assert {(r.island, r.n_buses, r.main) for r in topology.islands(bus, circuit).collect()} == {(0, 2001, True)}


def test_components_of_random_graphs_with_keys(spark):
    import collections

    rng = random.Random(7)
    edges = [(k, rng.randrange(60), rng.randrange(60)) for k in range(4) for _ in range(20 + 10 * k)]
    found = {(r.k, r.node): r.component for r in connected_components(spark.createDataFrame(edges, "k int, u long, v long"), ("k",)).collect()}
    near = collections.defaultdict(set)
    for k, a, b in edges:
        near[k, a].add(b)
        near[k, b].add(a)
    assert set(found) == set(near)
    for k, node in near:
        seen, todo = {node}, [node]
        while todo:
            new = near[k, todo.pop()] - seen
            seen |= new
            todo += new
        assert found[k, node] == min(seen)


def test_components_keep_keys_apart_and_self_loops(spark):
    edges = spark.createDataFrame([(1, 5, 6), (2, 6, 7), (2, 8, 8), (1, None, 3)], "k int, u long, v long")
    assert sorted(tuple(r) for r in connected_components(edges, ("k",)).collect()) == [(1, 5, 5), (1, 6, 5), (2, 6, 6), (2, 7, 6), (2, 8, 8)]


def test_no_edges(spark):
    empty = spark.createDataFrame([], "u long, v long")
    assert connected_components(empty).count() == 0
    bus, circuit = network(spark, [(0, 1)], 3)
    assert {r.bus_id: r.island for r in topology.islands(bus, circuit.where("false")).collect()} == {0: 0, 1: 1, 2: 2}


def test_edges_are_worked_out_once(spark):
    """Roles behind the edges are costly: neither components nor a forest come back to them."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (6, 7), (7, 7)], "u long, v long").mapInArrow(look, "u long, v long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6} and seen.value == 6
    label, tree = components.spanning_forest(edges)
    assert {r.node: r.component for r in label.collect()} == found and seen.value == 12
    assert tree.count() == 3 and all(r.u < r.v for r in tree.collect())
