"""The largest similarity of two members of a group, for all groups at once: a best-first search bounded by set sizes.

Equal sets settle a group at once.  For the others, members with the smallest hash in common give a first value from below.
Members are then put into blocks of about ``BLOCK`` in the order of their sizes; two blocks meet only if the smaller size over the
larger one exceeds that value.  A task takes a group's meetings by falling bound, remembers the best value it has seen, and leaves
out every meeting that cannot exceed it.  Meetings of a large group are dealt over tasks, each block's by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

BLOCK = 512
COLUMNS = 4096  # bits multiplied at once
SEEDS = 2


def similarity_of(x: Column, y: Column) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common / (F.size(x) + F.size(y) - common)


def seeds(rows: DataFrame, group: str) -> DataFrame:
    """(group, seed): the similarity of some two members that share a smallest hash.  Summed before it is shuffled, whatever a group's size."""
    hashes = F.array(*[F.struct(F.lit(k).alias("k"), F.array_min(F.transform("bits", lambda b, k=k: F.xxhash64(b, F.lit(k)))).alias("h")) for k in range(SEEDS)])
    met = rows.select(group, "bits", F.explode(hashes).alias("hash")).groupBy(group, "hash").agg(F.min("bits").alias("x"), F.max("bits").alias("y"))
    return met.where("x <> y").groupBy(group).agg(F.max(similarity_of(F.col("x"), F.col("y"))).alias("seed"))


def blocks(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (group, bits, n): blocks (group, block, low, high, sets), and (group, ends) with the last block of each size."""
    counts = rows.groupBy(group, "n").agg(F.count("*").alias("many"))
    before = F.sum("many").over(Window.partitionBy(group).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))  # a row a size
    counts = counts.select(group, "n", "many", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.col("start") + F.pmod(F.xxhash64("bits"), F.col("many"))
    dealt = rows.join(counts, [group, "n"]).withColumn("block", F.floor(place / BLOCK).cast("int"))
    made = dealt.groupBy(group, "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list("bits").alias("sets"))
    last = F.struct("n", F.floor((F.col("start") + F.col("many") - 1) / BLOCK).cast("int").alias("block"))
    return materialise(made), counts.groupBy(group).agg(F.collect_list(last).alias("ends"))


def meetings(made: DataFrame, ends: DataFrame, first: DataFrame, group: str) -> DataFrame:
    """(group, p, q, bound, seed): blocks p <= q of a group whose sizes allow more than the seed."""
    mine = made.select(group, F.col("block").alias("p"), F.col("low").alias("low_p"), F.col("high").alias("high_p")).join(ends, group).join(first, group, "left")
    mine = mine.withColumn("seed", F.coalesce("seed", F.lit(0.0)))
    reach = F.filter("ends", lambda e: (e["n"] <= F.col("high_p")) | (e["n"] * F.col("seed") < F.col("high_p")))
    mine = mine.withColumn("last", F.greatest(F.col("p"), F.array_max(F.transform(reach, lambda e: e["block"]))))
    met = mine.select(group, "p", "high_p", "seed", F.explode(F.sequence("p", "last")).alias("q"))
    met = met.join(made.select(group, F.col("block").alias("q"), F.col("low").alias("low_q")), [group, "q"])
    bound = F.least(F.lit(1.0), F.col("high_p") / F.col("low_q"))
    return met.select(group, "p", "q", bound.alias("bound"), "seed").where("bound > seed")


def best_of(x: pa.Array, y: pa.Array, same: bool) -> float:
    """The largest similarity of a set of x and a set of y; of two sets of x if both are one block."""
    a, b = x.flatten().to_numpy(), y.flatten().to_numpy()
    n, m = np.diff(x.offsets.to_numpy()), np.diff(y.offsets.to_numpy())
    shared = np.intersect1d(a, b)
    common = np.zeros((len(n), len(m)), np.float32)

    def matrix(bits: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), len(some)), np.float32)
        column = np.minimum(np.searchsorted(some, bits), len(some) - 1)
        hit = some[column] == bits
        out[np.repeat(np.arange(len(sizes)), sizes)[hit], column[hit]] = 1
        return out

    for k in range(0, len(shared), COLUMNS):
        some = shared[k : k + COLUMNS]
        left = matrix(a, n, some)
        common += left @ (left if same else matrix(b, m, some)).T
    if same:
        np.fill_diagonal(common, 0)
    c = common.astype(np.float64)
    return float((c / (n[:, None] + m - c)).max(initial=0.0)) if len(n) > 1 or not same else 0.0


def max_similarity(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, bits: distinct) -> (group, max_similarity): the largest similarity of two rows of a group.

    Rows without bits count for nothing; groups with fewer than two others, and null groups, give no row; groups that share no bits have 0.
    """
    some = rows.where((F.size("bits") > 0) & F.col(group).isNotNull()).select(group, F.sort_array("bits").alias("bits"))
    some = materialise(some.groupBy(group, "bits").agg(F.count("*").alias("copies")).withColumn("n", F.size("bits")))
    groups = some.groupBy(group).agg(F.sum("copies").alias("members"), F.max("copies").alias("most")).where("members > 1")
    groups = materialise(groups)
    settled = groups.where("most > 1").select(group, F.lit(1.0).alias("max_similarity"))
    left = groups.where("most = 1").select(group)
    rest = materialise(some.join(left, group, "left_semi").select(group, "bits", "n"))
    first = materialise(seeds(rest, group))
    made, ends = blocks(rest, group)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = meetings(made, ends, first, group).join(made.select(group, F.col("block").alias("p"), F.col("sets").alias("x")), [group, "p"])
    met = met.join(made.select(group, F.col("block").alias("q"), F.col("sets").alias("y")), [group, "q"])
    met = met.withColumn("same", F.col("p") == F.col("q")).repartition(tasks, group, "p").sortWithinPartitions(group, F.desc("bound")).select(group, "bound", "seed", "same", "x", "y")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best = None, 0.0
        for batch in batches:
            names, bounds, first_values, same = (batch.column(k).to_pylist() for k in range(4))
            found = np.zeros(batch.num_rows)
            for k, name in enumerate(names):
                if name != current:
                    current, best = name, first_values[k]
                if bounds[k] > best:
                    found[k] = best_of(batch.column(4)[k].values, batch.column(5)[k].values, same[k])
                    best = max(best, found[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[group, "found"])

    kind = rows.schema[group].dataType.simpleString()
    found = met.mapInArrow(search, f"`{group}` {kind}, found double").groupBy(group).agg(F.max("found").alias("found"))
    best = left.join(found, group, "left").join(first, group, "left")
    value = F.greatest(F.coalesce("found", F.lit(0.0)), F.coalesce("seed", F.lit(0.0)))
    return settled.unionByName(best.select(group, value.alias("max_similarity")))
