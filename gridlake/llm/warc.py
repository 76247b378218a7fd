"""WARC records of web pages and their Merkle fixity audit.

A replica is a table of records (file, offset, length, digest). Digests of a file's records are hashed in order of offset
over ranges of bytes; ranges are hashed in groups of 2**FAN_OUT_BITS, and so on up to a root per file. Two replicas compare
their roots, and only below nodes that differ the next level is joined, down to the records that are corrupt or missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridlake.functions.durable import durable

RANGE_BYTES = 1 << 16
FAN_OUT_BITS = 6
LEVELS = 3


def record(url: Column, body: Column, record_id: Column) -> Column:
    """One WARC/1.1 resource record as text; null parts are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def to_records(pages: DataFrame, ids_per_file: int = 512) -> DataFrame:
    """(file, page_id, record) of every page; a file takes ``ids_per_file`` consecutive ids, null ids go to file -1."""
    file = F.coalesce(F.floor(F.col("page_id") / ids_per_file).cast("long"), F.lit(-1).cast("long"))
    return pages.select(file.alias("file"), "page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))


def manifest(records: DataFrame, order: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(file, order..., offset, length, digest) of records laid out in a file by ``order`` (ties: by digest). Records are hashed
    where they are read; only lengths and digests are shuffled."""
    slim = records.select("file", *order, F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    before = Window.partitionBy("file").orderBy(*order, "digest").rowsBetween(Window.unboundedPreceding, -1)
    return slim.select("file", *order, F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "digest")


def _joined(content: Column) -> Column:
    """Hash of a group's (order, text) structs in their order."""
    return F.sha2(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(content)), lambda x: x["text"])), 256).alias("digest")


def tree(entries: DataFrame) -> list[DataFrame]:
    """Node tables (file, node, digest): byte ranges (level 0), then groups of 2**FAN_OUT_BITS, last a root per file (node 0).

    Node k of level l covers the records that begin in bytes [k, k + 1) * RANGE_BYTES * 2**(FAN_OUT_BITS * l), so a
    group is bounded by the range or the fan-out; the root joins the nodes of the last level.
    """
    leaf = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    node = F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node")
    levels = [durable(entries.groupBy("file", node).agg(_joined(F.struct("offset", leaf.alias("text")))))]
    for level in range(1, LEVELS + 1):
        up = (F.shiftright("node", FAN_OUT_BITS) if level < LEVELS else F.lit(0).cast("long")).alias("node")
        levels.append(levels[-1].groupBy("file", up).agg(_joined(F.struct("node", F.col("digest").alias("text")))))
    return levels


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, offset, status, digest_a, digest_b) of records that differ: ``corrupt``, ``missing`` (only in a) or ``extra`` (only in b).

    a and b are manifests (file, offset, length, digest). The roots are compared first; the nodes that differ are
    written down, and on the next level only their children are read. Records with one offset in a file are compared as a sorted list.
    """
    a, b = durable(a), durable(b)
    trees = [tree(a), tree(b)]
    bad = None
    for level in range(LEVELS, -1, -1):
        sides = [t[level].withColumnRenamed("digest", f"digest_{i}") for i, t in enumerate(trees)]
        if bad is not None:
            parent = F.shiftright("node", FAN_OUT_BITS) if level < LEVELS - 1 else F.lit(0).cast("long")
            sides = [t.withColumn("parent", parent).join(bad, ["file", "parent"], "left_semi").drop("parent") for t in sides]
        differ = sides[0].join(sides[1], ["file", "node"], "full").where("NOT (digest_0 <=> digest_1)")
        bad = durable(differ.select("file", F.col("node").alias("parent")))

    def records(entries: DataFrame, name: str) -> DataFrame:
        below = entries.withColumn("parent", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(bad, ["file", "parent"], "left_semi")
        same_place = F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", F.col("length").cast("string"), "digest"))))
        return below.groupBy("file", "offset").agg(same_place.alias(name))

    both = records(a, "digest_a").join(records(b, "digest_b"), ["file", "offset"], "full").where("NOT (digest_a <=> digest_b)")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "offset", status.alias("status"), "digest_a", "digest_b")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one folder file=N each, in order of page_id."""
    laid = records.repartition(F.col("file")).sortWithinPartitions("file", "page_id", F.sha2("record", 256))
    whole = F.expr("substring(record, 1, char_length(record) - 1)").alias("value")  # the writer adds the last line feed
    laid.select(whole, "file").write.partitionBy("file").text(path, lineSep="\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, digest, url, body) of every record below ``path``, found by Content-Length. A WARC file is
    one task's work. Bytes after a broken header are one last record without url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, out = 0, []
                while at < len(content):
                    head = content.find(b"\r\n\r\n", at)
                    fields = dict(x.split(b": ", 1) for x in content[at:head].split(b"\r\n")[1:] if b": " in x) if head >= 0 else {}
                    n = fields.get(b"Content-Length", b"")
                    end = head + 8 + int(n) if n.isdigit() and content.startswith(b"WARC/", at) else len(content)
                    end = min(end, len(content))
                    body = content[head + 4 : end - 4] if n.isdigit() else content[at:end]
                    out.append((name, at, end - at, hashlib.sha256(content[at:end]).hexdigest(), fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), body))
                    at = end
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["file", "offset", "length", "digest", "url", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, offset long, length long, digest string, url string, body binary")
