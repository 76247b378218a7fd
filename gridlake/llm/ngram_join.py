"""N-gram Jaccard join: groups of texts that reach a Jaccard similarity of word shingles, by T-occurrence search.

Texts with equal shingle sets form a class; only one text of a class goes on. A class is searched for only if it shares
one of several hashed min-wise keys with another (``exact=True`` leaves this out). Shingles of these classes are ordered by
rarity: a linked pair shares one of each other's few rarest ones, its prefix. Candidates are paired in two rounds. First,
around each prefix shingle, all classes are paired with its hub, the class whose shingles are the most common ones (of a
text and its edited copies that is the text itself). Then only classes whose components still differ are paired, if the
places of the shared shingle leave room for the required overlap. So a group of n copies makes about n pairs, not n * n.

A class and its candidates are one T-occurrence search by DivideSkip: from the candidates' inverted lists the short ones are
merged by a heap, the long ones only probed by bisection for what the merge left, and those that reach the overlap are
retained. Candidates of one class are dealt over as many tasks as their size needs, so no key decides a task's load.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridlake.functions.durable import Workspace
from gridlake.llm.text import chunks, fresh, mix, shingle_sets
from gridlake.operators.components import connected_components

ROWS_PER_KEY = 4
#: Shingles of the candidates in one search.
TASK_SHINGLES = 10_000
#: Cells by which keys are counted first, and rows of a cell (as a multiple of the mean) from which its keys count as hot.
CELLS, HOT_CELL, LEAST_HOT, SPREAD = 1 << 16, 8, 64, 64
#: A key with over 1 / HOT_KEYS of all rows is looked up by broadcast; there can't be more than HOT_KEYS of them.
HOT_KEYS = 20_000
LIST_BLOCK = 2_000
FILTER_BITS = 1 << 25
_MU = 0.0085
_MERGE = 1024


def keys_needed(percent: int, miss: float = 1e-12) -> int:
    """Min-wise keys after which a pair of exactly ``percent`` similarity shares none with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** ROWS_PER_KEY))) if percent < 100 else 1


def _slopes(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def min_keys(row: np.ndarray, shingle: np.ndarray, rows: int, keys: int) -> np.ndarray:
    """(rows x keys) min-wise keys of sorted (row, shingle) sets; rows without shingles get zeros."""
    out = np.zeros((rows, keys), np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    slopes = _slopes(keys * ROWS_PER_KEY)
    for k in range(keys):
        h = np.full(len(first), k, np.uint64)
        for j in range(ROWS_PER_KEY):
            h = mix(h + np.minimum.reduceat(shingle * slopes[k * ROWS_PER_KEY + j], first))
        out[row[first], k] = h
    return out


def signatures(row: np.ndarray, shingle: np.ndarray, rows: int) -> tuple[np.ndarray, list[bytes | None]]:
    """(set sizes, 128-bit signature of each set; None for an empty one)."""
    size = np.bincount(row, minlength=rows)
    a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.add.at(a, row, mix(shingle))
    np.bitwise_xor.at(b, row, mix(shingle ^ np.uint64(0x5851F42D4C957F2D)))
    both = np.stack([mix(a + size.astype(np.uint64)), mix(b ^ np.uint64(0x2545F4914F6CDD1D))], axis=1).tobytes()
    return size, [both[16 * i : 16 * i + 16] if n else None for i, n in enumerate(size.tolist())]


def divide_skip(places: np.ndarray, owners: np.ndarray, size: int, sizes: list[int], percent: int) -> list[int]:
    """Candidates that link with a query set of ``size`` tokens.

    ``places`` (sorted) and ``owners`` (sorted within a place) are the inverted lists of the query's tokens: the token's
    place in the query and a candidate that has it. ``sizes`` are the candidates' whole set sizes.
    """
    need = -(-percent * size // 100)  # a linked set shares at least this much
    starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.zeros(0, int)
    if need < 1 or len(starts) < need:
        return []
    stops = np.append(starts[1:], len(places))
    order = np.argsort(stops - starts, kind="stable")
    lists = list(zip(starts[order].tolist(), stops[order].tolist(), strict=True))
    longest = lists[-1][1] - lists[-1][0]
    n_long = min(need - 1, int(need / (_MU * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    entries = owners.tolist()
    count = [0] * len(sizes)
    for at in range(0, len(short), _MERGE):  # heaps of bounded width
        for d in heapq.merge(*(entries[a:b] for a, b in short[at : at + _MERGE])):
            count[d] += 1
    out = []
    for d, shared in enumerate(count):
        total = size + sizes[d]
        wanted = -(-percent * total // (100 + percent))
        if shared < need - n_long or min(size, sizes[d]) < wanted:
            continue
        for left, (a, b) in zip(range(len(long), 0, -1), long, strict=True):
            if shared + left < wanted:
                break
            at = bisect_left(entries, d, a, b)
            shared += at < b and entries[at] == d
        if 100 * shared >= percent * (total - shared):
            out.append(d)
    return out


def search(query: np.ndarray, candidates: list[np.ndarray], percent: int) -> list[int]:
    """Candidates (by place in the list) whose sorted sets link with the sorted query set."""
    flat = np.concatenate(candidates) if candidates else np.zeros(0, query.dtype)
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    place = np.searchsorted(query, flat)
    hit = place < len(query)
    hit[hit] = query[place[hit]] == flat[hit]
    place, owner = place[hit], owner[hit]
    order = np.argsort(place, kind="stable")  # owners come in order already
    return divide_skip(place[order], owner[order], len(query), [len(c) for c in candidates], percent)


def _described(texts: list[bytes], words_each: int, keys: int) -> tuple[np.ndarray, list[bytes | None], pa.Array]:
    row, shingle = shingle_sets(texts, words_each)
    size, v = signatures(row, shingle, len(texts))
    flat = min_keys(row, shingle, len(texts), keys).view(np.int64)[size > 0].ravel()
    offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, keys, 0))]).astype(np.int32)
    return size, v, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _describe(documents: DataFrame, words_each: int, keys: int) -> DataFrame:
    """doc_id, n_shingles, v (signature; null for an empty set) and min-wise keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                size, v, found = _described(texts, words_each, keys)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(size.astype(np.int64)), pa.array(v, pa.binary()), found], names=["doc_id", "n_shingles", "v", "keys"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, v binary, keys array<long>")


def _likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose doc_id is in ``ids``, and few others: a bitmap of hashed ids (FILTER_BITS bits, so 4 MB at most) is broadcast
    in buckets, and most texts that no search needs are dropped before the shuffle of the exact join."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    byte = "cast(conv(hex(substring(bits, cast(bit div 8 AS int) + 1, 1)), 16, 10) AS int)"
    rows = texts.where("doc_id IS NOT NULL").withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
    return rows.join(F.broadcast(bits), "bucket").where(F.expr(f"(shiftright({byte}, cast(bit % 8 AS int)) & 1) = 1")).select("doc_id", "text")


def _sets(texts: DataFrame, words_each: int) -> DataFrame:
    """(v, doc_id, tokens): the sorted shingle set of every text that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(batch.column("text")):
                row, shingle = shingle_sets(some, words_each)
                _, v = signatures(row, shingle, len(some))
                shingle = shingle.view(np.int64)
                order = np.lexsort((shingle, row))  # signed, as SQL sees them
                cut = np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(some)), pa.array(v, pa.binary()), pa.ListArray.from_arrays(pa.array(cut), pa.array(shingle[order]))], names=["doc_id", "v", "tokens"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, v binary, tokens array<long>").where("v IS NOT NULL")


def _lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with ``table`` on ``key``; ``weight`` says how many rows have the key, ``total`` is their sum. Keys with a large
    share are few by counting, so they are broadcast and their rows stay where they are; the rest joins by shuffle."""
    hot, cold = table.where(F.col(weight) * HOT_KEYS > total), table.where(F.col(weight) * HOT_KEYS <= total)
    few = rows.join(F.broadcast(hot), key)
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """rows (id, key) with ``times``, how many rows have the key. Keys are first counted by CELLS cells of their hash; at most one cell in
    HOT_CELL can be hot, so the hot ones are broadcast. Keys of a hot cell get the cell's count, which is no less, and their rows are
    spread over SPREAD tasks; no other key has more than a small share of all rows. So ``times`` is a function of the key."""
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")
    cells = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("cell_rows"))
    counts = cells.agg(F.coalesce(F.sum("cell_rows"), F.lit(0)).alias("total")).first()
    hot = cells.where(F.col("cell_rows") > max(LEAST_HOT, HOT_CELL * counts["total"] // CELLS))
    spread = F.when(F.col("cell_rows").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(-1)
    marked = rows.withColumn("cell", cell).join(F.broadcast(hot), "cell", "left").withColumn("spread", spread)
    times = F.coalesce("cell_rows", F.count(F.lit(1)).over(Window.partitionBy(key, "spread")))
    return marked.select(*rows.columns, times.alias("times"))


def components(documents: DataFrame, words_each: int = 4, percent: int = 85, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents.

    Words are runs without ASCII white space, A-Z lower-cased. A set is a text's distinct shingles of ``words_each`` words (fewer
    words: the whole sequence; none or null: empty, linked with nothing, component_id its own doc_id). Two sets link when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links. Equal texts always
    link. Rows are kept, repeated ones too; a null doc_id never names a component unless nothing else could (then null).
    Sets are told apart by 128-bit signatures, shingles by 64-bit hashes. With ``exact`` every class is searched for; without
    it a class whose every link is missed by all min-wise keys (probability under 1e-12 for each link) isn't.
    """
    described, names = _rooted(documents, words_each, percent, exact)
    names = names.join(names.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("v", "component_id")
    return described.select("doc_id", "n_shingles", "v").join(names, "v", "left").select("doc_id", "n_shingles", F.expr("if(v is null, doc_id, component_id)").alias("component_id"))


def _rooted(documents: DataFrame, words_each: int, percent: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The described rows, and (v, least, unnamed, root): every class with its smallest doc_id, whether a row of it has none,
    and a class that stands for its component. Two durable tables and the components' labels outlive the call."""
    with Workspace(documents.sparkSession) as tables:
        described = tables.keep(tables.durable(_describe(documents, words_each, 0 if exact else keys_needed(percent))))
        some = described.where("v IS NOT NULL")
        classes = some.groupBy("v").agg(F.min("doc_id").alias("least"), F.bool_or(F.col("doc_id").isNull()).alias("unnamed"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        classes = tables.keep(tables.durable(classes.withColumn("id", F.monotonically_increasing_id())))  # the ids are fixed by being written
        live = classes.select("id", "v", "least")
        if not exact:
            shared = _counted(classes.select("id", F.explode("keys").alias("key")), "key").where("times > 1")
            live = tables.durable(live.join(shared.select("id").distinct(), "id", "left_semi"))
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        named = live.where("least IS NOT NULL").select("id", "v", F.col("least").alias("doc_id"))
        sets = _sets(_likely(texts, named.select("doc_id")), words_each).join(named, ["v", "doc_id"]).select("id", "tokens")
        if not live.where("least IS NULL").isEmpty():  # classes known only by rows without an id
            sets = sets.union(_sets(texts.where("doc_id IS NULL"), words_each).join(live.where("least IS NULL"), "v").select("id", "tokens"))
        sets = tables.durable(sets.dropDuplicates(["id"]))
        links = tables.durable(_links(sets.select("id", F.size("tokens").alias("n"), "tokens"), percent, tables))
        linked = connected_components(links).select(F.col("node").alias("id"), "component")
        roots = tables.keep(tables.durable(live.select("id", "v").join(linked, "id").join(live.select(F.col("v").alias("root"), F.col("id").alias("component")), "component").select("v", "root")))
    return described, classes.select("v", "least", "unnamed").join(roots, "v", "left").select("v", "least", "unnamed", F.coalesce("root", "v").alias("root"))


def _links(sets: DataFrame, percent: int, tables: Workspace) -> DataFrame:
    """(u, v): links between sets (id, n, tokens) that join the same components as all links do."""
    prefix = tables.durable(_prefixes(sets, percent))
    lists = prefix.groupBy("t").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("central", "id", "n")).alias("hub")).where("members > 1")
    lists = tables.durable(lists.select("t", "members", F.col("hub.id").alias("q"), F.col("hub.n").alias("q_n")))
    total = lists.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    alike = 100 * F.least("n", "q_n") >= percent * F.greatest("n", "q_n")
    stars = _lookup(prefix.select("t", "id", "n"), lists, "t", "members", total).where(F.col("id") != F.col("q")).where(alike).select("q", F.col("id").alias("c"), F.col("n").alias("c_n")).distinct()
    first = tables.durable(_searched(tables.durable(stars), sets, percent, tables))
    label = connected_components(first).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    placed = tables.durable(prefix.join(label, "id", "left").select("t", "id", "n", "most", F.coalesce("comp", "id").alias("comp")))
    second = tables.durable(_searched(tables.durable(_crossing(placed, percent)), sets, percent, tables))
    return first.union(second)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(t, id, n, most, central): the tokens of each set that a linked one may have as the rarest in common.

    A token that no other set has comes first in the order of rarity, those of hot cells come last. Sets with under ``percent`` of shared tokens link with
    nothing. ``most`` is the largest set that the token's place leaves room to link with: with r tokens from there on, a set of m
    needs r >= percent * (n + m) / (100 + percent). ``central`` is about the mean number of sets that have one of the set's tokens.
    """
    counted = _counted(sets.select("id", F.explode("tokens").alias("t")), "t").where("times > 1")
    own = Window.partitionBy("id")
    ranked = counted.select("id", "t", F.row_number().over(own.orderBy("times", "t")).alias("nth"), F.count(F.lit(1)).over(own).alias("shared"), F.sum("times").over(own).alias("weight"))
    ranked = ranked.where(F.col("nth") <= (100 - percent) * F.col("shared") / 100 + 1)  # no token beyond can pass below, as n is no less than shared
    ranked = ranked.join(sets.select("id", "n"), "id").withColumn("central", F.col("weight") / F.col("n"))
    rest = F.col("shared") - F.col("nth") + 1  # tokens from this one on
    ranked = ranked.withColumn("most", (F.floor(rest * (100 + percent) / F.lit(percent)) - F.col("n")).cast("long"))
    return ranked.where(F.lit(100) * F.col("most") >= percent * F.col("n")).select("t", "id", "n", "most", "central")


def _crossing(placed: DataFrame, percent: int) -> DataFrame:
    """(q, c, c_n): sets of different components with a common prefix token whose places leave room for a link.

    One set of a pair has ``most`` >= n, which few sets of a common token have. Lists are joined by size class, long ones in blocks.
    """
    lists = placed.groupBy("t").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("t", "members")
    total = lists.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    rows = _lookup(placed, lists, "t", "members", total)
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1.0
    rows = rows.withColumns({"class": F.floor(F.log("n") / width), "blocks": F.ceil(F.col("members") / LIST_BLOCK)})
    a = rows.where("most >= n").withColumn("class", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)))
    a = a.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("t", "class", "block", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "most", "comp")])
    b = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("t", "class", "block", "id", "n", "most", "comp")
    both = a.join(b, ["t", "class", "block"]).where("comp <> a_comp AND n <= a_most AND a_n <= most AND (most < n OR a_id < id)")
    return both.select(F.greatest("a_id", "id").alias("q"), F.least("a_id", "id").alias("c"), F.expr("if(a_id < id, a_n, n)").alias("c_n")).distinct()


def _searched(pairs: DataFrame, sets: DataFrame, percent: int, tables: Workspace) -> DataFrame:
    """(u, v) of the candidate pairs (q, c, c_n) that link. The candidates of a q are dealt into parts of about TASK_SHINGLES."""
    loads = tables.durable(pairs.groupBy("q").agg(F.count(F.lit(1)).alias("times"), F.ceil(F.sum("c_n") / TASK_SHINGLES).alias("parts")))
    total = loads.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    part: Column = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part")
    dealt = tables.durable(_lookup(pairs, loads, "q", "times", total).select("q", "c", part))
    mine = sets.select("id", "tokens")
    candidates = dealt.join(mine, dealt["c"] == mine["id"]).select("q", "part", F.col("c").alias("who"), "tokens")
    asked = dealt.select("q", "part").distinct()
    queries = asked.join(mine, asked["q"] == mine["id"]).select("q", "part", F.col("q").alias("who"), "tokens")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q = int(rows["q"].iloc[0])
        own = rows["who"] == q
        others = rows[~own]
        found = search(np.asarray(rows["tokens"][own].iloc[0]), [np.asarray(x) for x in others["tokens"]], percent)
        return pd.DataFrame({"u": q, "v": others["who"].to_numpy()[found]}, dtype="int64")

    return candidates.union(queries).groupBy("q", "part").applyInPandas(run, "u long, v long")


def keep_one(documents: DataFrame, words_each: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """The rows of documents, with all their columns, that stand for their component: one row each.

    It is a row of the component's smallest doc_id; where texts under that id differ, one of the smallest signature. So
    different texts under a repeated id are decided each by its own component. Rows without a doc_id can't stand for
    named ones; of those in a component a single one stays. Texts without words stay, one for each doc_id that isn't null.
    """
    described, names = _rooted(documents, words_each, percent, exact)
    i, v, some = fresh(documents.columns, "id", "v", "some")
    with Workspace(documents.sparkSession) as tables:
        best = tables.keep(
            tables.durable(
                names.groupBy("root").agg(F.min(F.when(F.col("least").isNotNull(), F.struct(F.col("least").alias(i), F.col("v").alias(v)))).alias("named"), F.min(F.when(F.col("unnamed"), F.col("v"))).alias(v))
            )
        )
    empty = described.where("v IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias(i), F.lit(b"").alias(v), F.lit(False).alias(some)).distinct()
    ids = best.where("named IS NOT NULL").select("named.*", F.lit(True).alias(some)).union(empty)
    key = [i, v, some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                size, signed = signatures(*shingle_sets(texts, words_each), len(texts))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x or b"" for x in signed], pa.binary()), pa.array(size > 0)], names=[*part.schema.names, v, some])

    rows = documents.withColumn(i, F.col("doc_id").cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField(v, T.BinaryType()), T.StructField(some, T.BooleanType())])
    named = rows.where("doc_id IS NOT NULL").mapInArrow(run, schema).join(ids, key, "left_semi").dropDuplicates(key)
    unnamed = rows.where("doc_id IS NULL").mapInArrow(run, schema)
    single = unnamed.where(F.col(some)).join(best.where(F.col(v).isNotNull()).select(v), v, "left_semi").dropDuplicates([v])
    out = [part.select(*documents.columns) for part in (named, single, unnamed.where(~F.col(some)))]
    return out[0].unionByName(out[1]).unionByName(out[2])
