"""What the operators of this subpackage share: tables, shared scratch space, hashing and components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sieveline

# Functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sieveline)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Only a local master may leave it unset and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sieveline-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, release: bool = True) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        if release:
            self.release()
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def release(self) -> None:
        """Lets Spark delete the shuffle files of jobs that are over; it does so when the driver's garbage is collected."""
        for _ in range(2):  # the second round finds what the first one has let go of
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *saved: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep_apart(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """Renames input columns that are called like result columns: ``name`` becomes ``name_input`` (with more _ if that is taken)."""
    taken = {c.lower() for c in docs.columns}
    for name in names:
        if name in docs.columns:
            new = f"{name}_input"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            docs = docs.withColumnRenamed(name, new)
    return docs


def parts_for(spark: SparkSession, size: float, each: float) -> int:
    """Partitions for ``size`` (of rows or bytes) at most about ``each`` a partition, but not fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / each) + 1)


def binary_list(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def worker_cache() -> dict:
    """What a Python worker process keeps from task to task; users bound what they put in."""
    import sys
    import types

    return sys.modules.setdefault("_sieveline_worker", types.ModuleType("_sieveline_worker")).__dict__


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word -> 64-bit hash; a cache of bounded size."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Numbers(dict):
    """Word -> number, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def hashes_of(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


SPACES = np.zeros(256, np.int8)
SPACES[[9, 10, 11, 12, 13, 32]] = 1
RADIX = 0x9E3779B97F4A7C15
LONG = 64  # bytes; polynomials modulo 2^64 of longer words can be equal by their form (Thue-Morse words of 1,024 letters are)
SEGMENT, SPACE = 1 << 20, re.compile(rb"[\t-\r ]")


def hashed_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a buffer (runs of anything but ASCII white space): 64-bit hashes, starts and ends.

    A word's hash is a mix of its polynomial in an odd radix modulo 2^64, from one running sum over the buffer; long words, which
    are few, are hashed one by one.
    Long buffers are taken in segments that end at white space, so memory does not grow with a text.
    """
    kept, n = worker_cache(), len(buffer)
    if n > 2 * SEGMENT:
        found, at = [], 0
        while at < n:
            space = SPACE.search(buffer, min(at + SEGMENT, n))
            end = space.end() if space else n
            h, s, e = segment_words(buffer[at:end], kept)
            found.append((h, s + at, e + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    return segment_words(buffer, kept)


def segment_words(buffer: bytes, kept: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buffer)
    if "powers" not in kept or len(kept["powers"]) < n:  # the first buffer of a worker may be empty
        size = max(n, 1 << 20)
        for name, base in (("powers", RADIX), ("inverse powers", pow(RADIX, -1, 1 << 64))):
            powers = np.full(size, base, np.uint64)
            powers[:1] = 1
            kept[name] = np.cumprod(powers)
    b = np.frombuffer(buffer, np.uint8)
    change = np.diff(SPACES[b], prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * kept["powers"][:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * kept["inverse powers"][starts] ^ (ends - starts).astype(np.uint64) << np.uint64(48))
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        import xxhash

        hashes[long] = [xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]]) for i in long]
    return hashes, starts, ends


def grouped_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, comp), comp the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al. 2014): each round is two group-bys of the edges that are
    left, and O(log^2 n) rounds suffice.  No group is collected: each star is a minimum joined back to its rows.
    """
    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", release=False)
    nodes = edges
    previous = None
    for _ in range(rounds):
        two = both(edges)
        least = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        following = scratch.save(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", release=False)
        state = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if edges is not nodes:
            scratch.drop(edges)
        edges = following
        if state == previous or (state[0] == state[2] and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").take(1)):
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Adds up arrays by block number: rows (block long, n array<double>), of which there are few blocks."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[block] = total.get(block, 0) + n.values.to_numpy()
        rows = sorted(total)
        yield pa.RecordBatch.from_pydict({"block": pa.array(rows, pa.int64()), "n": pa.array([total[b] for b in rows], pa.list_(pa.float64()))})

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = parts.repartition(n, "block").mapInArrow(add, "block long, n array<double>").toArrow()
    return {b: n.values.to_numpy() for b, n in zip(got["block"].to_pylist(), got["n"], strict=True)}
