"""MinHash near-duplicate classes with sequential Bayesian verification.

Texts with equal shingle sets form a class. Bands of min-wise hashes (the join's keys of four hashes) bring classes together;
each band's classes are paired with its hub, the one whose bands are the most common, so a group of n copies gives about n
pairs. A pair's signatures (hashes of their own, not those of the bands) are then compared batch by batch. With a uniform prior the
similarity after m matches of n is Beta(m + 1, n - m + 1), so the posterior chance of reaching the threshold t is that of at most
m successes in n + 1 trials of t: a pair goes as soon as this falls below the chosen miss probability. What is left is verified
exactly on the full sets. Classes still apart after the hubs get a second round: pairs whose rarest shingles leave room for a
link, a necessary condition that needs no hash, go the same way through batches and exact verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlake.functions.durable import Workspace
from gridlake.llm.ngram_join import _counted, _crossing, _describe, _likely, _lookup, _prefixes, _searched, _sets, keys_needed
from gridlake.llm.text import mix
from gridlake.operators.components import connected_components

HASHES, BATCH, MISS = 128, 32, 1e-9
_STEP = 2048  # pairs that are compared at once


def least_matches(percent: int, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, least m): after n hashes a pair with fewer than m matches reaches ``percent`` similarity with a posterior chance under ``miss``."""
    t, out = percent / 100, []
    for n in [*range(batch, hashes, batch), hashes]:
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def signature(tokens: np.ndarray, first: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(sets x hashes) min-wise hashes, 16 bits each, of the non-empty token runs that begin at ``first``."""
    seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return np.stack([mix(np.minimum.reduceat(mix(tokens ^ s), first)).astype(np.uint16) for s in seeds], axis=1)


def unpruned(a: np.ndarray, b: np.ndarray, percent: int, miss: float = MISS, batch: int = BATCH) -> np.ndarray:
    """Places of the pairs (rows of two signature arrays) that no batch of hashes rules out."""
    left, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(percent, miss, a.shape[1], batch):
        matches = matches + (a[left, at:n] == b[left, at:n]).sum(axis=1)
        keep = matches >= least
        left, matches, at = left[keep], matches[keep], n
    return left


def _signed(sets: DataFrame) -> DataFrame:
    """(id, n, sig) of sets (id, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            cut = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            while at < len(batch):  # sets of some 2**17 tokens together
                to = max(at + 1, int(np.searchsorted(cut, cut[at] + (1 << 17), "right")) - 1)
                found = signature(flat[cut[at] : cut[to]], cut[at:to] - cut[at])
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "n", "sig"])
                at = to

    return sets.where("n > 0").select("id", "n", "tokens").mapInArrow(run, "id long, n long, sig binary")


def _plausible(pairs: DataFrame, signed: DataFrame, percent: int, miss: float, tables: Workspace) -> DataFrame:
    """The pairs (q, c, c_n) that the batches of hashes leave. A q of very many pairs is looked up by broadcast."""
    times = tables.durable(pairs.groupBy("q").agg(F.count(F.lit(1)).alias("times")))
    total = times.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    asked = times.join(signed.select(F.col("id").alias("q"), F.col("sig").alias("q_sig")), "q")
    both = _lookup(pairs.join(signed.select(F.col("id").alias("c"), F.col("sig").alias("c_sig")), "c"), asked, "q", "times", total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _STEP):
                some = batch.slice(at, _STEP)
                a, b = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint16).reshape(len(some), -1) for c in ("q_sig", "c_sig"))
                yield some.select(["q", "c", "c_n"]).take(pa.array(unpruned(a, b, percent, miss)))

    return both.select("q", "c", "c_n", "q_sig", "c_sig").mapInArrow(run, "q long, c long, c_n long")


def _links(sets: DataFrame, bands: DataFrame, percent: int, miss: float, tables: Workspace) -> DataFrame:
    """(u, v): verified links between sets (id, n, tokens) that join the same components as all links do; bands are (id, key, times)."""
    signed = tables.durable(_signed(sets))
    central = bands.groupBy("id").agg(F.sum("times").alias("central"))
    placed = bands.join(central, "id").join(signed.select("id", "n"), "id").select("key", "id", "n", "central")
    placed = tables.durable(placed)
    lists = placed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("central", "id", "n")).alias("hub")).where("members > 1")
    lists = tables.durable(lists.select("key", "members", F.col("hub.id").alias("q"), F.col("hub.n").alias("q_n")))
    total = lists.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    alike = 100 * F.least("n", "q_n") >= percent * F.greatest("n", "q_n")
    stars = _lookup(placed.select("key", "id", "n"), lists, "key", "members", total).where(F.col("id") != F.col("q")).where(alike)
    stars = tables.durable(stars.select("q", F.col("id").alias("c"), F.col("n").alias("c_n")).distinct())
    first = tables.durable(_searched(tables.durable(_plausible(stars, signed, percent, miss, tables)), sets, percent, tables))
    label = connected_components(first).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    apart = tables.durable(_prefixes(sets, percent).join(label, "id", "left").select("t", "id", "n", "most", F.coalesce("comp", "id").alias("comp")))
    crossing = tables.durable(_crossing(apart, percent))
    second = tables.durable(_searched(tables.durable(_plausible(crossing, signed, percent, miss, tables)), sets, percent, tables))
    return first.union(second)


def deduplicate(documents: DataFrame, words_each: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents.

    Words are runs without ASCII white space, A-Z lower-cased. A set is a text's distinct shingles of ``words_each`` words (fewer words: the
    whole sequence; none or null: empty, linked with nothing, component_id its own doc_id). Two sets link when 100 * intersection >=
    percent * union; component_id is the smallest doc_id reachable by links and kept says whether it is the row's own (so repeated rows
    of one id share their fate). Equal texts always link. Rows without a doc_id never name a component unless nothing else could (then
    null, and they are kept). Texts of any length are read whole; an empty table gives an empty one; other columns don't matter. A class
    whose links are missed by all bands (probability under 1e-12 for each link), or a link ruled out by its batches (about ``miss`` for
    each batch at exactly ``percent``), isn't found unless another path of links joins the same documents. Sets are told apart by 128-bit
    signatures, shingles by 64-bit hashes.
    """
    with Workspace(documents.sparkSession) as tables:
        described = tables.keep(tables.durable(_describe(documents, words_each, keys_needed(percent))))
        classes = described.where("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
        classes = tables.keep(tables.durable(classes.withColumn("id", F.monotonically_increasing_id())))  # the ids are fixed by being written
        bands = tables.durable(_counted(classes.select("id", F.explode("keys").alias("key")), "key").where("times > 1"))
        live = tables.durable(classes.select("id", "v", "least").join(bands.select("id").distinct(), "id", "left_semi"))
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        named = live.where("least IS NOT NULL").select("id", "v", F.col("least").alias("doc_id"))
        sets = _sets(_likely(texts, named.select("doc_id")), words_each).join(named, ["v", "doc_id"]).select("id", "tokens")
        if not live.where("least IS NULL").isEmpty():  # classes known only by rows without an id
            sets = sets.union(_sets(texts.where("doc_id IS NULL"), words_each).join(live.where("least IS NULL"), "v").select("id", "tokens"))
        sets = tables.durable(sets.dropDuplicates(["id"])).select("id", F.size("tokens").cast("long").alias("n"), "tokens")
        linked = connected_components(tables.durable(_links(sets, bands, percent, miss, tables)))
        roots = linked.select(F.col("node").alias("id"), F.col("component").alias("root"))
        names = tables.durable(classes.select("id", "v", "least").join(roots, "id", "left").select("v", "least", F.coalesce("root", "id").alias("root")))
        names = tables.keep(tables.durable(names.join(names.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("v", "component_id")))
    out = described.select("doc_id", "n_shingles", "v").join(names, "v", "left")
    out = out.select("doc_id", "n_shingles", F.expr("if(v is null, doc_id, component_id)").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
