"""Packing texts into fixed-size bins by conflict-constrained best fit.

Pieces go, largest first, into the open bin that they fill most tightly and don't conflict with. Open bins are kept in order
of their residual room; each carries a bitmap of its sources and one of its duplicate clusters. The search for a piece begins
at the tightest bin with room and goes on to its successors until a compatible one is found; without one a bin opens.
Pieces of one source, or of one duplicate cluster, never share a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK_PIECES = 4096


def best_fit(sizes: list[int], sources: list[object], clusters: list[object], capacity: int) -> list[int]:
    """Bin of each piece (0 to capacity in size), bins numbered as they open. Nulls conflict with nothing."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    residual: list[tuple[int, int]] = []  # (room, bin), sorted
    held: list[list[int]] = []  # bitmaps of sources and clusters
    out = [0] * len(sizes)
    for i in order:
        size, s, c = sizes[i], source_bit.get(sources[i], 0), cluster_bit.get(clusters[i], 0)
        if size > capacity:
            raise ValueError("a piece is larger than a bin")
        for at in range(bisect_left(residual, (size, -1)), len(residual)):
            room, b = residual[at]
            if not (held[b][0] & s or held[b][1] & c):
                del residual[at]
                break
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        if room > size:
            insort(residual, (room - size, b))
        out[i] = b
    return out


def pack(documents: DataFrame, capacity: int = 2048, expected_rows: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, source, cluster, block, bin, fill.

    Size is the number of words (runs without white space). A text of more than ``capacity`` words is cut into whole bins,
    which need no search, and a last piece; texts without words (null ones too) are one piece of size 0. The duplicate
    cluster is the hash of the text; null and wordless texts have none. Documents are dealt into blocks of about BLOCK_PIECES by a hash of doc_id
    and text, only slim rows are shuffled, and each block is packed alone, in runs of at most 2 * BLOCK_PIECES rows, so that
    even many equal rows use bounded memory. ``bin`` is unique over the whole result; ``fill`` is the bin's words.
    """
    rows = expected_rows if expected_rows is not None else documents.count()
    blocks = max(1, -(-rows // BLOCK_PIECES))
    n_words = F.expr("size(regexp_extract_all(text, '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+', 0))")
    slim = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.select("doc_id", "source", n_words.cast("long").alias("words"), F.xxhash64("text").alias("hash"))
    slim = slim.withColumn("cluster", F.expr("if(words = 0, null, hash)"))
    full = F.greatest(F.ceil(F.col("words") / capacity).cast("int"), F.lit(1))
    pieces = slim.withColumn("piece", F.explode(F.sequence(F.lit(0), full - 1)))
    first = (F.col("piece").cast("long") * capacity).alias("first_word")
    pieces = pieces.select("doc_id", "piece", first, F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece").cast("long") * capacity).alias("n_words"), "source", "cluster", "hash")
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(blocks)).cast("long")).drop("hash")
    dealt = pieces.repartition(F.col("block")).sortWithinPartitions("block", "doc_id", "piece", "cluster", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        part = 0

        def close() -> pa.RecordBatch:
            bins = best_fit([r["n_words"] for r in waiting], [r["source"] for r in waiting], [r["cluster"] for r in waiting], capacity)
            fill = [0] * (max(bins, default=0) + 1)
            for r, b in zip(waiting, bins, strict=True):
                fill[b] += r["n_words"]
            for r, b in zip(waiting, bins, strict=True):
                r |= {"bin": (r["block"] * 4096 + part) * 4 * BLOCK_PIECES + b, "fill": fill[b]}
            return pa.RecordBatch.from_pylist(waiting, schema=out_schema)

        for batch in batches:
            out_schema = pa.schema([*batch.schema, pa.field("bin", pa.int64()), pa.field("fill", pa.int64())])
            for r in batch.to_pylist():
                if waiting and (r["block"] != waiting[0]["block"] or len(waiting) >= 2 * BLOCK_PIECES):
                    yield close()
                    part = part + 1 if r["block"] == waiting[0]["block"] else 0
                    waiting = []
                waiting.append(r)
        if waiting:
            yield close()

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("bin", T.LongType()), T.StructField("fill", T.LongType())]))
