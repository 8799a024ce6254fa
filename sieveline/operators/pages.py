"""Lists of rows as numbered pages, so that neither a list nor a task holds all rows of a hot value.

Rows are dealt by ranges of (keys, order), the more the more rows there are, and sorted there; a key with many rows covers several ranges.  Rows of a key and a range
are counted, running sums over the ranges of a key give each row its place in its list, and places give pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

PAGE = 10_000
RANGE = 1_000_000  # rows of a range, and of a task that makes pages


def tasks_for(rows: DataFrame) -> int:
    """Tasks of about a range of rows each, but not fewer than the session's setting."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE + 1)


def placed(rows: DataFrame, keys: list[str], order: str, tasks: int | None = None) -> DataFrame:
    """rows with ``place``: from 0 for the rows of equal keys (null equals null), by order; it tells rows apart where that is unique."""
    dealt = rows.repartitionByRange(tasks or tasks_for(rows), *keys, order).sortWithinPartitions(*keys, order)
    ordered = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()))
    ranged = ordered.withColumn("__part", F.shiftright("__at", 33))
    parts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    start = F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start")
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    starts = parts.select(*named, F.col("__part").alias("__range"), "__first", start)
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    joined = ranged.join(starts, [*same, F.col("__part") == F.col("__range")])
    return joined.select(*rows.columns, (F.col("__start") + F.col("__at") - F.col("__first")).alias("place"))


def paged(rows: DataFrame, keys: list[str], order: str, item: Column, size: int = PAGE, name: str = "rows") -> DataFrame:
    """keys, page (from 0), first (the place of its first row), and item of at most ``size`` rows in order."""
    page = F.floor(F.col("place") / size).cast("long").alias("page")
    rows = materialise(rows)  # counted, sampled for ranges, and dealt
    tasks = tasks_for(rows)
    items = placed(rows, keys, order, tasks).select(*keys, page, F.struct("place", item.alias("item")).alias("x"))
    found = items.repartition(tasks, *keys, "page").groupBy(*keys, "page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return found.select(*keys, "page", (F.col("page") * size).alias("first"), F.transform("x", lambda x: x["item"]).alias(name))
