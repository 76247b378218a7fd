"""Document fingerprints by Order MinHash, in Spark SQL expressions only.

A text's words (runs without white space, cut after 12 characters) give k-word k-mers; equal k-mers are told apart
by their occurrence number. A hash of k-mer and number orders them. Its upper bits deal them into ``slots`` slots; in
each slot the ``tuple_size`` smallest are selected, put back into the order of the text and hashed as a tuple. Two
texts agree in a slot only if the same k-mers were selected there in the same order, so unlike plain MinHash the
likeness (share of agreeing slots) falls when passages are moved, which makes it follow edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlake.functions.ordering import number

SLOT_BITS = 6


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sketch(text: str, k: int = 3, tuple_size: int = 2) -> Column:
    """array<int> of at most 64 signatures of the SQL string expression ``text``; the low 6 bits are the slot.

    Null and blank texts give an empty array; texts of fewer than k words are one k-mer. A k-mer is held as one long,
    40 bits of hash above 24 bits of position, so that sorting stays on primitive longs; texts of over 2**24 words
    (100 MB and more) keep whole contents, but order inside a tuple then follows positions modulo 2**24.
    """
    if tuple_size not in (1, 2):
        raise ValueError("tuple_size must be 1 or 2")
    top, low = -(1 << 24), (1 << 24) - 1
    parts = ", ".join(f"w[i + {j}]" for j in range(k))
    kmers = (
        f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> (xxhash64({parts}) & {top}L) | (i & {low})) "
        f"ELSE array(xxhash64(w) & {top}L) END"
    )
    # o: (k-mer, occurrence number) hashed, above its position. Without repeats all numbers are 0.
    once = f"transform(g, v -> (xxhash64(v & {top}L, 0) & {top}L) | (v & {low}))"
    starts = f"filter(sequence(0, size(s) - 1), i -> i = 0 OR (s[i] & {top}L) <> (s[greatest(i - 1, 0)] & {top}L))"
    number = f"(xxhash64(s[i] & {top}L, i - a) & {top}L) | (s[i] & {low})"
    end = "if(j + 1 < size(b), b[j + 1], size(s))"
    numbered = f"flatten(transform(b, (a, j) -> if({end} = a + 1, transform(array(a), i -> {number}), transform(sequence(a, {end} - 1), i -> {number}))))"
    repeats = f"size(array_distinct(transform(g, v -> v & {top}L))) < size(g)"
    occurrences = f"if({repeats}, {_let('s', 'sort_array(g)', _let('b', starts, numbered))}, {once})"
    slot = lambda i: f"shiftrightunsigned(o[{i}], {64 - SLOT_BITS})"
    opens = f"filter(sequence(0, size(o) - 1), i -> i = 0 OR {slot('i')} <> {slot('greatest(i - 1, 0)')})"
    x = lambda i: f"o[{i}] & {top}L"
    if tuple_size == 1:
        joined = f"xxhash64({x('i')})"
    else:
        joined = (
            f"CASE WHEN i + 1 >= size(o) THEN xxhash64({x('i')}) WHEN {slot('i + 1')} <> {slot('i')} THEN xxhash64({x('i')}) "
            f"WHEN (o[i] & {low}) < (o[i + 1] & {low}) THEN xxhash64({x('i')}, {x('i + 1')}) ELSE xxhash64({x('i + 1')}, {x('i')}) END"
        )
    mask = 0x7FFFFFFF - ((1 << SLOT_BITS) - 1)
    signed = f"transform({opens}, i -> CAST((({joined}) & {mask}L) | {slot('i')} AS int))"
    full = _let("g", kmers, _let("o", f"sort_array({occurrences})", signed))
    empty = "CAST(array() AS array<int>)"
    return F.expr(_let("w", f"transform(regexp_extract_all(coalesce({text}, ''), '\\\\S{{1,12}}', 0), t -> xxhash64(t))", f"if(size(w) = 0, {empty}, {full})"))


def render(sketch_column: str) -> Column:
    """The signatures as one string, eight hexadecimal digits each; empty for an empty sketch."""
    return F.expr(f"array_join(transform({sketch_column}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of slots used by either sketch in which both agree, 0 to 1; two empty sketches are alike (1)."""
    low = (1 << SLOT_BITS) - 1
    either = f"size(array_union(transform({a}, x -> x & {low}), transform({b}, x -> x & {low})))"
    return F.expr(f"if({either} = 0, 1.0D, size(array_intersect({a}, {b})) / CAST({either} AS double))")


def next_lower(ids: DataFrame) -> DataFrame:
    """(id, next_id) for a table of distinct ids: the greatest smaller id, after the least the greatest.

    Ids are numbered in ranges, so however they are spread no task holds more than its range; then each number's id is joined
    with that of the number below. One durable table outlives the call."""
    placed = number(ids.select("id"), ["id"], "place")
    total = placed.count()
    below = placed.select(F.col("id").alias("next_id"), F.expr(f"(place + 1) % {max(total, 1)}").alias("place"))
    return placed.join(below, "place").select("id", "next_id")


def fingerprint_with_edits(documents: DataFrame, k: int = 3, tuple_size: int = 2) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document.

    The next document is that of the greatest smaller doc_id (after the least: the greatest). The edited text has the
    last third of its code points replaced by as many of the next document's first ones. Null texts are empty; a null doc_id
    counts as the least id. Rows that share a doc_id are kept; as a next document the one whose text has the smallest
    hash stands for them; of equal hashes any, as the texts are equal. An empty table gives an empty one; other columns are left out. Whole texts
    are shuffled once, and then only the part that an edit can use.
    """
    least = -(1 << 63)
    own = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = own.groupBy("id").agg(F.max(F.char_length("text")).cast("long").alias("n"))
    after = next_lower(lengths.select("id"))
    before = after.join(lengths, "id").select(F.col("next_id").alias("id"), F.col("id").alias("previous_id"), F.col("n").alias("previous_n"))
    base = own.select("id", "text", sketch("text", k, tuple_size).alias("sketch"))
    placed = base.join(before, "id")
    head = F.expr("substring(text, 1, cast(previous_n div 3 as int))")
    offered = placed.select(F.col("previous_id").alias("id"), F.struct(F.xxhash64("text").alias("order"), head.alias("head"), F.col("sketch").alias("sketch")).alias("next"))
    offered = offered.groupBy("id").agg(F.min("next").alias("next"))
    rows = placed.join(offered, "id").select("id", "text", "sketch", F.char_length("text").cast("long").alias("n_chars"), "next")
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next.head, 1, cast(n_chars div 3 as int)))")
    rows = rows.select("id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = rows.select("id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch("edited", k, tuple_size).alias("edited_sketch"))
    return rows.select(
        F.expr(f"nullif(id, {least + 1} - 1)").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        render("sketch").alias("fingerprint"),
        render("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
