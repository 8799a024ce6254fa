"""Exact Tanimoto joins of bit sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import bitblocks

# Seconds: of a pair of sets in a matrix product, more for each bit, and of a row that prefixes join.
CELL, CELL_BIT, JOINED_ROW = 5e-9, 7e-11, 2e-6


def tanimoto(common: Column, n: Column, m: Column) -> Column:
    return common / (n + m - common)


def bits_of(words: Column) -> Column:
    """The places of the bits set in an array of longs."""
    place = lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w, b) == 1), lambda b: i * 64 + b)
    return F.flatten(F.transform(words, place))


def identical(left: DataFrame, right: DataFrame, key: str = "bits") -> DataFrame:
    """Threshold 1: equal bit sets, an equi-join.  Sides have (a) and (b) with ``key``."""
    return left.join(right, key).select("a", "b")


def prefixes(left: DataFrame, right: DataFrame, threshold: float, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of each set the bits, rarest first, of which similar sets share one: the first n - ceil(threshold * n) + 1, with their places."""
    every = left.select(F.explode("bits").alias("bit")).union(right.select(F.explode("bits").alias("bit")))
    frequency = every.groupBy("bit").agg(F.count("*").alias("f"))

    def first(df: DataFrame, key: str, n: str, place: str) -> DataFrame:
        ranked = df.select(*within, key, F.size("bits").alias(n), F.explode("bits").alias("bit")).join(frequency, "bit")
        w = Window.partitionBy(*within, key).orderBy("f", "bit")
        ranked = ranked.withColumn(place, F.row_number().over(w) - 1)
        return ranked.where(F.col(place) < F.col(n) - F.ceil(F.lit(threshold) * F.col(n) - F.lit(1e-9)) + 1).select(*within, key, n, "bit", place)

    return first(left, "a", "n", "p"), first(right, "b", "m", "q")


def sharing(x: DataFrame, y: DataFrame, threshold: float, within: list[str]) -> DataFrame:
    """Ids (a, b) of sets that share a bit of their prefixes and whose sizes and places allow the threshold."""
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - F.lit(1e-9))
    fits = (F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m") - F.lit(1e-9)) & (F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= need)
    return x.join(y, [*within, "bit"]).where(fits).select(*within, "a", "b").distinct()


def candidates(left: DataFrame, right: DataFrame, threshold: float, within: list[str]) -> DataFrame:
    """Ids (a, b) of sets, equal in the columns ``within``, that may reach the threshold, by exact prefix filtering.

    With bits ordered rarest first, two sets that are similar enough share one of the first n - ceil(threshold * n) + 1; only pairs
    that do, and whose sizes and places allow it, are candidates.  Bits travel as single numbers, sets as ids.
    """
    return sharing(*prefixes(left, right, threshold, within), threshold, within)


def counted(pairs: DataFrame, left: DataFrame, right: DataFrame, within: list[str]) -> DataFrame:
    """Pairs with the sizes of their sets' intersection and union."""
    sets = pairs.join(left.select(*within, "a", F.col("bits").alias("x")), [*within, "a"]).join(right.select(*within, "b", F.col("bits").alias("y")), [*within, "b"])
    common = F.size(F.array_intersect("x", "y"))
    return sets.select(*within, "a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("union"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, route: str | None = None) -> DataFrame:
    """left (a, bits), right (b, bits: distinct, sorted) -> pairs (a, b) with common and union, similarity >= threshold.

    Two routes give the same rows: "prefix" looks rare bits up, "blocks" multiplies bit matrices.  Without a choice, the number of rows
    that the prefixes will join is measured and compared with the number of pairs whose sizes allow the threshold.  Sets over
    very many bits take the prefixes.  Threshold 0 asks for all pairs and gets them.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be from 0 to 1")
    left, right = (df.where(F.size("bits") > 0) for df in (left, right))
    width, sizes = (0, []) if route == "prefix" else bitblocks.shape(left, right)
    if not sizes and threshold == 0:
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        x = left.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(n)).cast("int"))
        y = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return counted(x.join(y.select("b", "part"), "part").select("a", "b"), left, right, [])
    if sizes and (route == "blocks" or threshold == 0):
        return bitblocks.similar(left, right, threshold, width)
    x, y = prefixes(left, right, threshold, [])
    if sizes:
        x, y = materialise(x), materialise(y)
        both = x.groupBy("bit").agg(F.count("*").alias("f")).join(y.groupBy("bit").agg(F.count("*").alias("g")), "bit")
        joined = both.agg(F.sum(F.col("f") * F.col("g"))).first()[0] or 0
        if bitblocks.cells(sizes, threshold) * (CELL + width * CELL_BIT) < joined * JOINED_ROW:
            return bitblocks.similar(left, right, threshold, width)
    return counted(sharing(x, y, threshold, []), left, right, []).where(F.col("common") / F.col("union") >= threshold)


def unmatched(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of left (a, ...) and right (b, ...), without those equal in one of ``keys``; null equals nothing.

    The columns of keys are called ``key_a`` on the left side and ``key_b`` on the right one.
    """
    joined = pairs.join(left, "a").join(right, "b")
    for k in keys:
        joined = joined.where(~F.coalesce(F.col(f"{k}_a") == F.col(f"{k}_b"), F.lit(False)))
    return joined
