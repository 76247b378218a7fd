"""Algebra on coordinate tables: matrices (i, j, re, im) and vectors (i, re, im). Absent entries are zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlake.functions.exprs import Complex
from gridlake.operators.electrical import CO_PARTITIONING, at_least


def _sum(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _pair(p: str) -> Complex:
    return Complex(F.col(f"{p}re"), F.col(f"{p}im"))


def merge(*parts: DataFrame) -> DataFrame:
    """Contributions added up by position."""
    whole = parts[0].select("i", "j", "re", "im")
    for p in parts[1:]:
        whole = whole.union(p.select("i", "j", "re", "im"))
    return _sum(whole, "i", "j")


def overwrite(updates: DataFrame) -> DataFrame:
    """The last value written to each position, by ``seq``."""
    last = updates.groupBy("i", "j").agg(F.max_by(F.struct("re", "im"), "seq").alias("z"))
    return last.select("i", "j", "z.re", "z.im")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two matrices."""
    return merge(a, b)


def scale(a: DataFrame, re: float, im: float = 0.0) -> DataFrame:
    """Every entry times re + i im."""
    z = Complex(F.col("re"), F.col("im")).times(Complex(F.lit(re), F.lit(im)))
    return a.select("i", "j", z.re.alias("re"), z.im.alias("im"))


def add_diagonal(a: DataFrame, vector: DataFrame) -> DataFrame:
    """The vector's entries added to the diagonal."""
    return merge(a, vector.select("i", F.col("i").alias("j"), "re", "im"))


def multiply_diagonal(a: DataFrame, vector: DataFrame) -> DataFrame:
    """Diagonal entries times the vector's (absent: 1); others unchanged."""
    v = vector.select(F.col("i"), F.col("re").alias("v_re"), F.col("im").alias("v_im"))
    rows = a.join(v, "i", "left")
    z = _pair("").times(_pair("v_"))
    on = (F.col("i") == F.col("j")) & F.col("v_re").isNotNull()
    return rows.select("i", "j", F.when(on, z.re).otherwise(F.col("re")).alias("re"), F.when(on, z.im).otherwise(F.col("im")).alias("im"))


def _times(a: DataFrame, vector: DataFrame, across: str, keep: str) -> DataFrame:
    v = vector.select(F.col("i").alias(across), F.col("re").alias("v_re"), F.col("im").alias("v_im"))
    z = _pair("").times(_pair("v_"))
    return _sum(a.join(v, across).select(F.col(keep).alias("i"), z.re.alias("re"), z.im.alias("im")), "i")


def spmv(a: DataFrame, vector: DataFrame) -> DataFrame:
    """Matrix times vector: a join on j and one aggregate."""
    return _times(a, vector, "j", "i")


def spmv_transpose(a: DataFrame, vector: DataFrame) -> DataFrame:
    """Transposed matrix times vector, without conjugation: a join on i and one aggregate."""
    return _times(a, vector, "i", "j")


#: Products that a cell of the result is to have, and the most cells.
CELL_PRODUCTS, MOST_CELLS = 2_000_000, 4096


def spgemm(a: DataFrame, b: DataFrame, cell: int = CELL_PRODUCTS) -> DataFrame:
    """Matrix product, of which only the factors are shuffled: products are made and summed up where they stay.

    The result is cut into cells of about ``cell`` products, blocks of its rows by blocks of its columns. An entry of a goes to all cells of its row
    block, one of b to all of its column block; there they meet by the inner index, and a position's products are all in one cell. So the
    products of one inner index are dealt over the cells too, however large its share. A job counts the products first; entries
    without a partner are left out. The join keeps the partitioning by cells if it needn't have all keys, so this sets CO_PARTITIONING."""
    a.sparkSession.conf.set(CO_PARTITIONING, "false")
    count = lambda f, key, name: f.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(name))
    met = count(a, "j", "na").join(count(b, "i", "nb"), "k")
    products, left_rows, right_rows = met.agg(F.sum(F.col("na") * F.col("nb")), F.sum("na"), F.sum("nb")).first()
    cells = min(MOST_CELLS, -(-(products or 1) // cell))
    across = min(cells, max(1, round((cells * (right_rows or 1) / (left_rows or 1)) ** 0.5)))  # column blocks: the fewest copies
    down = -(-cells // across)
    parts = at_least(a, 2 * down * across)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = (F.col("x") * across + F.col("y")).alias("cell")
    left = a.select("i", F.col("j").alias("k"), "re", "im").join(b.select(F.col("i").alias("k")).distinct(), "k", "left_semi")
    left = left.select("*", block("i", down).alias("x"), every(across).alias("y")).select(place, "k", "i", "re", "im").repartition(parts, "cell")
    right = b.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    right = right.select("*", every(down).alias("x"), block("l", across).alias("y")).select(place, "k", "l", "b_re", "b_im").repartition(parts, "cell")
    z = _pair("").times(_pair("b_"))
    found = right.join(left.hint("shuffle_hash"), ["cell", "k"]).select("cell", "i", F.col("l").alias("j"), z.re.alias("re"), z.im.alias("im"))
    return _sum(found, "cell", "i", "j").drop("cell")


def transpose(a: DataFrame) -> DataFrame:
    """Rows and columns exchanged."""
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "re", "im")


def diagonal(a: DataFrame) -> DataFrame:
    """Stored diagonal entries as a vector."""
    return a.where("i = j").select("i", "re", "im")


def column(a: DataFrame, j: int) -> DataFrame:
    """Stored entries of column j as a vector."""
    return a.where(F.col("j") == j).select("i", "re", "im")


def identity(indices: DataFrame) -> DataFrame:
    """Ones on the diagonal for the distinct ``i`` of a table."""
    return indices.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))


def norms(frame: DataFrame) -> DataFrame:
    """One row: norm1, norm2 and norm_inf over all entries."""
    size = F.hypot("re", "im")
    return frame.agg(F.sum(size).alias("norm1"), F.sqrt(F.sum(size * size)).alias("norm2"), F.max(size).alias("norm_inf"))


def real(a: DataFrame) -> DataFrame:
    """Real parts; the imaginary ones become 0."""
    return a.withColumn("im", F.lit(0.0))


def imaginary(a: DataFrame) -> DataFrame:
    """Imaginary parts as real numbers."""
    return a.withColumns({"re": F.col("im"), "im": F.lit(0.0)})


def conjugate(a: DataFrame) -> DataFrame:
    """Complex conjugate of every entry."""
    return a.withColumn("im", -F.col("im"))


def vector_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two vectors; an absent entry is 0."""
    return _sum(a.select("i", "re", "im").union(b.select("i", "re", "im")), "i")


def _elementwise(a: DataFrame, b: DataFrame, divide: bool) -> DataFrame:
    right = b.select("i", F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    rows = a.join(right, "i", "full").fillna(0.0, ["re", "im", "b_re", "b_im"])
    z = _pair("").over(_pair("b_")) if divide else _pair("").times(_pair("b_"))
    return rows.select("i", z.re.alias("re"), z.im.alias("im"))


def element_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products entry by entry; an absent entry is 0."""
    return _elementwise(a, b, False)


def element_divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Quotients; null where b is zero or absent."""
    return _elementwise(a, b, True)


def element_map(vector: DataFrame, what: str) -> DataFrame:
    """exp, abs, reciprocal or conj of every entry."""
    z = Complex(F.col("re"), F.col("im"))
    done = {"exp": z.exp, "reciprocal": z.reciprocal, "conj": z.conj, "abs": lambda: Complex(z.abs(), F.lit(0.0))}[what]()
    return vector.select("i", done.re.alias("re"), done.im.alias("im"))
