"""Comparison of stored runs that reads only what differs.

A run is stored in folders of BUCKET events, with a digest of each: number of rows, order-free sums of two hashes of keys and of whole
rows, and the sums that metrics need of rows that are the same in both runs. A comparison joins the digests, one row a bucket, and reads the
buckets whose digests differ, by partition pruning; equal buckets are answered by their digests. Equal digests of unequal buckets
have a chance of about 2**-128.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.operators import compare

BUCKET = 256
#: Reference values below this have no percent difference.
ZERO = 1e-9


def store_run(rows: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], angles: Sequence[str] = (), bucket: int = BUCKET, event: str = "event_idx", tasks: int | None = None) -> None:
    """Writes ``rows``, one for each of ``keys`` (which hold ``event``), to path/rows in folders of ``bucket`` events, and their digests to path/digests.
    Eight tasks at most write a folder, or, where ``tasks`` in all are asked for, up to as many as these."""
    bucketed = rows.withColumn("event_bucket", F.floor(F.col(event) / bucket).cast("long"))
    files = max(8, (tasks or 0) // 8)
    place = ("event_bucket", F.pmod(F.xxhash64(*keys), F.lit(files)))
    dealt = bucketed.repartition(tasks, *place) if tasks else bucketed.repartition(*place)
    dealt.write.partitionBy("event_bucket").mode("overwrite").parquet(f"{path}/rows")
    stored = read_run(rows.sparkSession, path)
    digest_rows(stored, keys, values, angles).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def _hash(columns: Sequence[str], seed: int) -> Column:
    return F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))


def digest_rows(rows: DataFrame, keys: Sequence[str], values: Sequence[str], angles: Sequence[str] = ()) -> DataFrame:
    """(event_bucket, n, keys_a, keys_b, rows_a, rows_b, same): ``same`` has per numeric column what equal rows contribute to metrics.

    Numbers of equal value but different type or zeros of different sign hash differently: such buckets are read, which costs time only. Null
    columns are marked, as hashes pass over them."""
    all_columns = sorted(c for c in rows.columns if c != "event_bucket")
    marks = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in all_columns])
    rows = rows.withColumn("_nulls", marks)
    ordered = sorted(keys)
    same = []
    for c in (*values, *angles):
        v = F.col(c).cast("double")
        finite = v.isNull() | ~(F.isnan(v) | (F.abs(v) == float("inf")))
        same.append(F.struct(F.count(v).alias("n"), F.coalesce(F.sum(F.when(finite, v)), F.lit(0.0)).alias("total"), F.count_if(F.abs(v) > ZERO).alias("over"), F.count_if(2 * F.abs(v) > ZERO).alias("either"), F.bool_and(finite).alias("finite")).alias(c))
    aggs = [_hash(ordered, 1).alias("keys_a"), _hash(ordered, 2).alias("keys_b"), _hash([*all_columns, "_nulls"], 3).alias("rows_a"), _hash([*all_columns, "_nulls"], 4).alias("rows_b")]
    return rows.groupBy("event_bucket").agg(F.count(F.lit(1)).alias("n"), *aggs, *([F.struct(*same).alias("same")] if same else []))


def read_run(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows of a stored run with their event_bucket; of some buckets only if these are given."""
    rows = spark.read.parquet(f"{path}/rows").withColumn("event_bucket", F.col("event_bucket").cast("long"))
    return rows if buckets is None else rows.where(F.col("event_bucket").isin(list(buckets)) if buckets else F.lit(False))


def _digests(spark: SparkSession, a: str, b: str) -> DataFrame:
    x, y = spark.read.parquet(f"{a}/digests"), spark.read.parquet(f"{b}/digests")
    x = x.select("event_bucket", *[F.col(c).alias(f"{c}_x") for c in x.columns if c != "event_bucket"])
    y = y.select("event_bucket", *[F.col(c).alias(f"{c}_y") for c in y.columns if c not in ("event_bucket", "same")])
    equal = lambda *names: F.coalesce((F.col("n_x") == F.col("n_y")) & (F.col(f"{names[0]}_x") == F.col(f"{names[0]}_y")) & (F.col(f"{names[1]}_x") == F.col(f"{names[1]}_y")), F.lit(False))
    return x.join(y, "event_bucket", "full").withColumns({"same_keys": equal("keys_a", "keys_b"), "same_rows": equal("rows_a", "rows_b")})


def changed_buckets(spark: SparkSession, a: str, b: str, keys_only: bool = False) -> list[int]:
    """Buckets whose rows (or, with ``keys_only``, keys) aren't the same in both runs, those that only one has among them: a number for each."""
    found = _digests(spark, a, b).where(~F.col("same_keys" if keys_only else "same_rows"))
    return sorted(r["event_bucket"] for r in found.select("event_bucket").collect())


def coverage_of_runs(spark: SparkSession, a: str, b: str, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """``compare.coverage`` of two stored runs: matched, only_a, only_b, match_percent and mismatches of the columns of ``same``."""
    changed = changed_buckets(spark, a, b)
    read = compare.coverage(read_run(spark, a, changed).drop("event_bucket"), read_run(spark, b, changed).drop("event_bucket"), keys, same)
    whole = _digests(spark, a, b).where("same_rows").agg(F.coalesce(F.sum("n_x"), F.lit(0)).alias("_equal"))
    matched, n = F.col("matched") + F.col("_equal"), F.col("matched") + F.col("_equal") + F.col("only_a") + F.col("only_b")
    return read.crossJoin(whole).select(matched.alias("matched"), "only_a", "only_b", F.try_divide(100.0 * matched, n).alias("match_percent"), *[f"{c}_mismatch" for c in same])


def unmatched_of_runs(spark: SparkSession, a: str, b: str, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``compare.unmatched_by`` of two stored runs; buckets with the same keys have nothing unmatched and aren't read."""
    changed = changed_buckets(spark, a, b, keys_only=True)
    return compare.unmatched_by(read_run(spark, a, changed), read_run(spark, b, changed), keys, by)


def close_runs(spark: SparkSession, golden: str, candidate: str, exact: Sequence[str], floats: Sequence[str], **how: object) -> DataFrame:
    """``compare.assert_close`` of two stored runs; equal buckets are close. ``exact`` has the event, so rows never pair across buckets."""
    changed = changed_buckets(spark, golden, candidate)
    return compare.assert_close(read_run(spark, golden, changed), read_run(spark, candidate, changed), exact, floats, **how)


def metrics_of_runs(spark: SparkSession, a: str, b: str, keys: Sequence[str], values: Sequence[str], angles: Sequence[str] = (), atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """``compare.numeric_metrics`` of two stored runs whose digests have these columns. Buckets with infinite or NaN values are read, too."""
    columns = (*values, *angles)
    both = _digests(spark, a, b)
    answered = F.col("same_rows")
    for c in columns:
        answered = answered & F.col(f"same_x.{c}.finite")
    both = both.withColumn("answered", answered)
    changed = sorted(r["event_bucket"] for r in both.where("NOT answered").select("event_bucket").collect())
    read = compare.numeric_sums(read_run(spark, a, changed), read_run(spark, b, changed), keys, values, angles, atol, rtol, ZERO)
    part = []
    for c in columns:
        s = lambda name: F.coalesce(F.sum(f"same_x.{c}.{name}"), F.lit(0))  # noqa: B023, E731
        none, total = F.lit(0.0), F.coalesce(F.sum(f"same_x.{c}.total"), F.lit(0.0))
        part.append(F.struct(F.lit(c).alias("column"), s("n").alias("n"), s("n").alias("n_a"), s("n").alias("n_b"), total.alias("sum_a"), total.alias("sum_b"), *[none.alias(n) for n in ("sum_diff", "sum_abs_diff", "sum_squares", "max_abs_diff", "sum_percent", "sum_symmetric")], s("over").alias("n_percent"), s("either").alias("n_symmetric"), s("n").alias("within")))
    equal = both.where("answered").agg(F.array(*part).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    return compare.metrics_of_sums(read.unionByName(equal))
