"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlake.functions.durable import Workspace


def spanning_forest(edges: DataFrame, u: str = "u", v: str = "v") -> tuple[DataFrame, DataFrame]:
    """((node, component), (u, v)): components as below, and the edges, u < v, of a spanning forest: one for each root that got another one."""
    return _contracted(edges, (), u, v, forest=True)


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), u: str = "u", v: str = "v") -> DataFrame:
    """(keys..., node, component): the smallest node that each node of an edge can reach.

    ``keys`` (say a scenario) separate independent graphs, which all advance together. Each round every node points
    at its smallest neighbour if that is smaller, pointers are joined with themselves until each names its root (so
    a path of n pointers takes log2 n joins), and the edges are rewritten between the roots that remain; edges inside
    a root vanish. A root has either taken in all its neighbours or gets a smaller one, and then is no root in the
    next round, so two rounds at least halve the nodes that have edges: at most 2 log2 n rounds for any numbering.
    Aggregates combine on the map side and joins are equi-joins, so nodes of any degree are handled. Only whether a
    table is empty reaches the driver. Nodes without edges aren't returned; self loops are. Durable tables of the
    labels outlive the call; the edges given are worked out once.
    """
    return _contracted(edges, tuple(keys), u, v)[0]


def _contracted(edges: DataFrame, keys: tuple[str, ...], u: str, v: str, forest: bool = False) -> tuple[DataFrame, DataFrame | None]:
    edges = edges.select(*keys, F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    with Workspace(edges.sparkSession) as tables:
        base = tables.durable(edges.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())  # the only look at the edges given
        loops = tables.durable(base.where("u = v").select(*keys, F.col("u").alias("node")))
        live = base.where("u <> v")
        label, hooks = None, []
        # the edge of the graph that an edge between roots stands for: at first itself
        carry = [F.col("u").alias("eu"), F.col("v").alias("ev")] if forest else []
        while not live.isEmpty():
            both = live.select(*keys, F.col("u").alias("node"), F.col("v").alias("other")).union(live.select(*keys, F.col("v").alias("node"), F.col("u").alias("other")))
            point = tables.durable(both.groupBy(*keys, "node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
            if forest:
                hook = point.where("root < node").select(F.col("root").alias("u"), F.col("node").alias("v"))
                hooks.append(tables.durable(hook.join(live, ["u", "v"]).select(F.col("eu").alias("u"), F.col("ev").alias("v")) if hooks else hook))
            while True:
                far = point.select(*keys, F.col("node").alias("root"), F.col("root").alias("further"))
                old, point = point, tables.durable(point.join(far, [*keys, "root"]).select(*keys, "node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
                tables.drop(old)
                if point.where("moved").isEmpty():
                    break
            if label is None:
                label = tables.durable(point.drop("moved"))
            else:
                far = point.select(*keys, F.col("node").alias("root"), F.col("root").alias("further"))
                old, label = label, tables.durable(label.join(far, [*keys, "root"], "left").select(*keys, "node", F.coalesce("further", "root").alias("root")))
                tables.drop(old)
            of_u = point.select(*keys, F.col("node").alias("u"), F.col("root").alias("ru"))
            of_v = point.select(*keys, F.col("node").alias("v"), F.col("root").alias("rv"))
            moved = live.join(of_u, [*keys, "u"]).join(of_v, [*keys, "v"]).where("ru <> rv")
            ends = moved.select(*keys, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"), *carry)
            old, live = base, tables.durable(ends.dropDuplicates([*keys, "u", "v"]))
            base, carry = live, ["eu", "ev"] if forest else []
            tables.drop(old)
            tables.drop(point)
        alone = loops.select(*keys, "node", F.col("node").alias("component"))
        if label is None:
            tables.keep(loops)
            return alone, edges.select("u", "v").limit(0) if forest else None
        tree = None
        for hook in hooks:
            tree = hook if tree is None else tree.union(hook)
        tree = tables.keep(tables.durable(tree)) if forest else None
        found = tables.keep(label).select(*keys, "node", F.col("root").alias("component"))
        if not loops.isEmpty():
            tables.keep(loops)
            found = found.union(alone.join(label.select(*keys, "node"), [*keys, "node"], "left_anti"))
    return found, tree
