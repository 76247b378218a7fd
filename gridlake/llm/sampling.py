"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def bounded_ids(rows: DataFrame, key: str, by: str, per_class: int, max_classes: int = 1000) -> dict[object, list[int]]:
    """At most ``per_class`` keys of each value of ``by``, the smallest by a hash of the key.

    Rows are thinned on the executors to about twice the bound, so the driver gets at most some
    2 * per_class keys a class, whatever the size of the table. Null keys or classes are left out; repeated keys
    count once. Of over ``max_classes`` values only the most frequent ones are learned (a documented bound of the sample).
    """
    rows = rows.select(F.col(key).alias("key"), F.col(by).alias("by")).where("key IS NOT NULL AND by IS NOT NULL")
    counts = rows.groupBy("by").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "by").limit(max_classes).collect()
    if not counts:
        return {}
    shares = [(r["by"], int(min(1.0, (2 * per_class + 50) / r["n"]) * (1 << 30))) for r in counts]
    limits = rows.sparkSession.createDataFrame(shares, T.StructType([T.StructField("by", rows.schema["by"].dataType), T.StructField("below", T.LongType())]))
    rank = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    out: dict[object, set] = {r["by"]: set() for r in counts}
    for r in rows.withColumn("rank", rank).join(F.broadcast(limits), "by").where("rank < below").select("key", "by", "rank").collect():
        out[r["by"]].add((r["rank"], r["key"]))
    return {value: [key for _, key in sorted(found)[:per_class]] for value, found in sorted(out.items(), key=str)}


def texts_of(documents: DataFrame, ids: list[int], key: str = "doc_id", text: str = "text", max_chars: int = 20_000, whole: bool = False) -> dict[int, str]:
    """The heads of at most ``max_chars`` characters of the texts of a bounded list of keys; with ``whole``, longer texts are left out instead.

    The list is broadcast, so documents are scanned without a shuffle. Of repeated keys the smallest text counts. Null texts are left out.
    """
    if not ids:
        return {}
    wanted = documents.sparkSession.createDataFrame([(i,) for i in ids], f"key {documents.schema[key].dataType.simpleString()}")
    found = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(wanted), "key")
    found = found.where(F.length("text") <= max_chars) if whole else found.withColumn("text", F.substring("text", 1, max_chars))
    out: dict[int, str] = {}
    for r in found.collect():
        out[r["key"]] = min(out.get(r["key"], r["text"]), r["text"])
    return dict(sorted(out.items()))
