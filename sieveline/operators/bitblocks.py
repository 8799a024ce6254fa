"""Tanimoto pairs by products of bit matrices: sets of nearly equal size form blocks, and only blocks whose sizes can reach
the threshold together are multiplied.

Prefix filtering looks rare bits up; at low thresholds, or where all bits are frequent, it makes more candidates than there are
pairs of sets.  Here each pair of sets costs a few nanoseconds whatever their bits are.  A block has about ``BLOCK`` rows, also
where all sets have one size; it travels as packed bits, once for each block that it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

BLOCK = 4096
WIDEST = 16_384  # bits; sets over more bits are not made into matrices
STRIP = 512  # rows of a block multiplied at once


def shape(left: DataFrame, right: DataFrame) -> tuple[int, list[dict[int, int]]]:
    """The number of bits, and how many sets each side has by size.  Sizes are at most as many as bits."""
    sides = [df.select(F.size("bits").alias("n"), F.array_max("bits").alias("last"), F.array_min("bits").alias("first")).where("n > 0") for df in (left, right)]
    last, first = sides[0].union(sides[1]).agg(F.max("last"), F.min("first")).first()
    if last is None:
        return 0, [{}, {}]
    if first < 0 or last >= WIDEST:
        return int(last) + 1 if first >= 0 else 1 << 62, []
    return int(last) + 1, [{r["n"]: r["count"] for r in df.groupBy("n").count().collect()} for df in sides]


def cells(sizes: list[dict[int, int]], threshold: float) -> int:
    """How many pairs of sets have sizes that allow the threshold."""
    m = np.array(sorted(sizes[1]), np.int64)
    total = np.concatenate([[0], np.cumsum([sizes[1][k] for k in m.tolist()])])
    low = np.searchsorted(m, [threshold * n - 1e-9 for n in sizes[0]])
    high = np.searchsorted(m, [n / threshold + 1e-9 if threshold else math.inf for n in sizes[0]], "right")
    return sum(int(c) * int(total[h] - total[k]) for c, k, h in zip(sizes[0].values(), low, high, strict=True))


def packed(df: DataFrame, key: str, width: int) -> DataFrame:
    """Rows (piece, low, high, ids, sizes, body): sets of a block, ordered by size, as packed bits."""
    rows = df.select(F.col(key).alias("id"), "bits", F.size("bits").alias("n"))
    counts = rows.groupBy("n").agg(F.count("*").alias("many"))
    before = F.sum("many").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))  # a row a size: at most WIDEST
    starts = counts.select("n", "many", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.col("start") + F.pmod(F.xxhash64("id"), F.col("many"))
    rows = rows.join(F.broadcast(starts), "n").select("id", "n", "bits", F.floor(place / BLOCK).cast("long").alias("block"))
    kind = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state = {"block": None, "part": 0, "rows": 0}

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            n, bits = table["n"].to_numpy(), table["bits"].combine_chunks()
            dense = np.zeros((len(n), width), np.uint8)
            dense[np.repeat(np.arange(len(n)), n), bits.flatten().to_numpy(zero_copy_only=False)] = 1
            ids = table["id"].combine_chunks()
            one = pa.array([0, len(n)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([state["block"] << 20 | state["part"]], pa.int64()), pa.array([int(n.min())], pa.int32()), pa.array([int(n.max())], pa.int32()),
                 pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, pa.array(n, pa.int32())), pa.array([np.packbits(dense, axis=1).tobytes()], pa.binary())],
                names=["piece", "low", "high", "ids", "sizes", "body"])
            state["part"], state["rows"] = state["part"] + 1, 0

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if blocks[low] != state["block"] or state["rows"] >= BLOCK:
                    yield from close()
                    if blocks[low] != state["block"]:
                        state.update(block=int(blocks[low]), part=0, rows=0)
                held.append(batch.slice(low, high - low))
                state["rows"] += high - low
        yield from close()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "block").sortWithinPartitions("block")
    return materialise(dealt.mapInArrow(pack, f"piece long, low int, high int, ids array<{kind}>, sizes array<int>, body binary"))


def meeting(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of pieces (p, q) whose sizes allow the threshold.  Sizes within its ratio are in equal or neighbouring classes of a
    logarithmic scale, so pieces meet by equal classes."""
    step = -math.log(threshold) if 0 < threshold < 1 else 0.0
    place = lambda c: F.floor(F.ln(F.col(c).cast("double")) / step).cast("int") if step else F.lit(0)
    x = left.select(F.col("piece").alias("p"), F.col("low").alias("l"), F.col("high").alias("h"), F.explode(F.sequence(place("low"), place("high"))).alias("class"))
    y = right.select(F.col("piece").alias("q"), "low", "high", F.explode(F.sequence(place("low") - 1, place("high") + 1) if step else F.array(F.lit(0))).alias("class"))
    slack = 1e-6
    return x.join(y, "class").where((F.col("h") >= threshold * F.col("low") - slack) & (F.col("high") >= threshold * F.col("l") - slack)).select("p", "q").distinct()


def similar(left: DataFrame, right: DataFrame, threshold: float, width: int) -> DataFrame:
    """left (a, bits), right (b, bits), none empty, bits below width -> (a, b, common, union) with similarity >= threshold."""
    kinds = [left.schema["a"].dataType.simpleString(), right.schema["b"].dataType.simpleString()]
    x, y = packed(left, "a", width), packed(right, "b", width)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = meeting(x, y, threshold).repartition(n, "p", "q")
    mine = x.select(F.col("piece").alias("p"), F.col("ids").alias("ids_a"), F.col("sizes").alias("sizes_a"), F.col("body").alias("body_a"))
    theirs = y.select(F.col("piece").alias("q"), F.col("ids").alias("ids_b"), F.col("sizes").alias("sizes_b"), F.col("body").alias("body_b"))
    met = pairs.join(mine, "p").join(theirs, "q").select("ids_a", "sizes_a", "body_a", "ids_b", "sizes_b", "body_b")

    def matrix(body: pa.Scalar, rows: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(body.as_buffer(), np.uint8).reshape(rows, -1), axis=1, count=width).astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids_a, sizes_a, body_a, ids_b, sizes_b, body_b = (c[k] for c in batch.columns)
                ids_a, ids_b = ids_a.values, ids_b.values
                m = sizes_b.values.to_numpy().astype(np.float64)
                b = matrix(body_b, len(m)).T
                every, a = sizes_a.values.to_numpy().astype(np.float64), matrix(body_a, len(ids_a))
                for low in range(0, len(every), STRIP):
                    common = a[low : low + STRIP] @ b
                    some = every[low : low + STRIP, None] + m
                    i, j = np.nonzero(common * (1 + threshold) >= threshold * some - 0.01)
                    c = common[i, j].astype(np.float64)
                    union = some[i, j] - c
                    good = c / union >= threshold
                    i, j, c, union = i[good] + low, j[good], c[good], union[good]
                    yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(i)), ids_b.take(pa.array(j)), pa.array(c.astype(np.int32)), pa.array(union.astype(np.int32))], names=["a", "b", "common", "union"])

    return met.mapInArrow(multiply, f"a {kinds[0]}, b {kinds[1]}, common int, union int")
