"""Best-fit packing: documents of token ids into sequences of a fixed length, planned on their length histogram.

1. Each document becomes token ids and an end id.  Only a document longer than a sequence is cut, into pieces
   of the full length and a last, shorter one.
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) goes to the driver.
   Lengths are classed by their upper bound in steps of ``capacity / classes``; every multiset of at most
   ``depth`` classes that fills a sequence is a pattern, and non-negative least squares finds how often to use
   each one so that the patterns together meet the histogram.  The counts are rounded down.
3. What the patterns leave is packed best fit, longest first, on runs of equal lengths: first into the space left in
   pattern sequences, then into new ones.
4. The plan gives runs (length, rank from, rank to, first sequence, offset); a piece takes its place by its
   rank among the pieces of its length, which comes from counts by bucket and never needs one length in one task.

Null text is empty text; an empty document is one end id.  Equal texts are packed once each.  An empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, binary_list, worker_cache

LATIN = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,]?)")  # without characters that normal forms or lower case turn into several
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkIds:
    """Token ids of texts, through a bounded memory of white-space-free chunks.

    The vocabulary's pre-tokeniser never joins characters across white space, lower-cases, and parts a run of
    letters from punctuation; so lower case and one closing stop or comma can be peeled off.  A run of Latin letters is a
    single word, which goes straight to the model; all else takes the whole way.
    """

    LIMIT = 200_000

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[bytes, bytes] = {}
        self.model = tokenizer.model
        # The printable bytes stand for themselves in the vocabulary, the others for the characters from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.byte_names = {b: chr(b if b in printable else next(others)) for b in range(256)}
        self.marks = {c: self.compute(bytes([c])) for c in b".,"}

    def learn(self, chunks: set[bytes]) -> None:
        """Puts the ids of new chunks, and of what they are without a closing mark, into ``known``."""
        known, marks, compute = self.known, self.marks, self.compute
        if len(known) > self.LIMIT:
            known.clear()
        for chunk in chunks:
            if chunk[-1] in marks and chunk[-2:-1].isalnum() and b"<|" not in chunk:
                stem = chunk[:-1]
                if (ids := known.get(stem)) is None:
                    ids = known[stem] = compute(stem)
                known[chunk] = ids + marks[chunk[-1]]
            else:
                known[chunk] = compute(chunk)

    def compute(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters
            tokens = self.model.tokenize(chunk.lower().decode())
        elif word := LATIN.fullmatch(text := chunk.decode("utf-8", "replace")):
            tokens = self.model.tokenize("".join(map(self.byte_names.__getitem__, word[1].lower().encode())))
            if word[2]:
                tokens += self.model.tokenize(word[2])
        else:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 100):
            # Lower case is the tokenizer's own first step, but special tokens are found before it.
            split = [((t or b"") if b"<|" in (t or b"") else (t or b"").lower()).split() for t in texts[at : at + 100]]
            seen = set().union(*split)
            if new := seen.difference(self.known):
                self.learn(new)
                if len(self.known) < len(seen) + len(new):  # perhaps the memory was cleared
                    self.learn(seen.difference(self.known))
            get = self.known.__getitem__
            for chunks in split:
                yield b"".join(map(get, chunks))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row per piece; with_ids adds the ids themselves as an array."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept = worker_cache()
        if (name := f"chunk ids of {vocabulary}") not in kept:
            kept[name] = ChunkIds(Tokenizer.from_file(vocabulary))
        encode = kept[name]
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            ids_out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(binary_list(batch.column(1))), strict=True):
                ids += end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    rows.append((doc_id, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids_out.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """min |a x - b| over x >= 0, by projected gradients with momentum and restarts."""
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = y = np.zeros(a.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if (y - new) @ (new - x) > 0:
            following, y = 1.0, new
        else:
            y = new + (momentum - 1) / following * (new - x)
        if np.abs(new - x).max() < 1e-9 * max(1.0, b.max()):
            return new
        x, momentum = new, following
    return x


def patterns_of(classes: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of two to ``depth`` classes whose upper bounds fill a sequence exactly."""

    def parts(total, most, depth):
        if total == 0:
            yield ()
        elif depth:
            for first in range(min(total, most), 0, -1):
                for rest in parts(total - first, first, depth - 1):
                    yield (first, *rest)

    return [p for p in parts(classes, classes, depth) if len(p) > 1]


def plan(histogram: dict[int, int], capacity: int, classes: int = 64, depth: int = 4) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, rank from, rank to, first sequence, offset) that place every piece, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    space: dict[int, list[tuple[int, int]]] = {}  # space left -> runs of sequences (first, how many)
    sequences = 0

    def take(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + count, first, offset))
        used[length] += count
        left[length] -= count

    def room(free: int, first: int, count: int) -> None:
        if free and count:
            if free not in space:
                bisect.insort(sizes, free)
            space.setdefault(free, []).append((first, count))

    sizes: list[int] = []
    if full := left.get(capacity, 0):
        take(capacity, full, 0, 0)
        sequences = full
    step = capacity / classes
    members: dict[int, list[int]] = {}
    for n in sorted((n for n in left if left[n]), reverse=True):
        members.setdefault(int(np.ceil(n / step)), []).append(n)
    patterns = [p for p in patterns_of(classes, depth) if all(k in members for k in p)]
    if patterns:
        matrix = np.zeros((classes, len(patterns)))
        for j, p in enumerate(patterns):
            for k in p:
                matrix[k - 1, j] += 1
        want = np.array([sum(left[n] for n in members.get(k, ())) for k in range(1, classes + 1)], float)
        repeats = np.floor(nonnegative_least_squares(matrix, want) + 1e-6).astype(int)
        for j in np.argsort(-np.array([max(p) for p in patterns]), kind="stable"):
            p, todo = patterns[j], int(repeats[j])
            alive = [n for n in sorted(left) if left[n]] if todo else []
            while todo > 0:
                needs: dict[int, int] = {}
                lengths: list[int] = []
                free = capacity
                for at, k in enumerate(p):  # the longest left of each class; at last, what fits the space best
                    fitting = alive[bisect.bisect_right(alive, free) - 1 :: -1] if at == len(p) - 1 and alive and alive[0] <= free else members[k]
                    n = next((n for n in fitting if n <= free and left[n] > needs.get(n, 0)), 0)
                    if n:
                        needs[n] = needs.get(n, 0) + 1
                        lengths.append(n)
                        free -= n
                if len(lengths) < len(p) or not alive:
                    break
                count = min(todo, *(left[n] // c for n, c in needs.items()))
                offset = 0
                for n in lengths:
                    take(n, count, sequences, offset)
                    offset += n
                room(capacity - offset, sequences, count)
                sequences += count
                todo -= count
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at < len(sizes):
                free = sizes[at]
                first, count = space[free].pop()
                if not space[free]:
                    del space[free]
                    sizes.pop(at)
                some = min(count, left[n])
                take(n, some, first, capacity - free)
                room(free - n, first, some)
                room(free, first + some, count - some)
            else:
                each = capacity // n
                some = max(1, left[n] // each)
                fill = min(each, left[n])
                for k in range(fill):
                    take(n, some, sequences, k * n)
                room(capacity - fill * n, sequences, some)
                sequences += some
    return runs, sequences


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> pieces with sequence_id and offset."""
    scratch = Scratch(spark)
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).alias("bucket")
    pieces = scratch.save(token_pieces(docs, vocabulary, capacity, end_id, with_ids).withColumn("bucket", bucket), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("local", local).join(base, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("bucket", "base", "local")
    runs.sort()
    by_length = np.array([r[0] for r in runs], np.int64)
    low, high, first, offset = (np.array([r[k] for r in runs], np.int64) for k in (1, 2, 3, 4))
    starts = dict(zip(*(x.tolist() for x in np.unique(by_length, return_index=True)), strict=True))
    # The plan has a few runs per length, so its size is bounded by `capacity`, not by the corpus.
    shared = spark.sparkContext.broadcast((starts, by_length, low, first, offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, by_length, low, first, offset = shared.value
        ends = {n: int(np.searchsorted(by_length, n, "right")) for n in starts}
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                s, e = starts[int(length[group[0]])], ends[int(length[group[0]])]
                at[group] = s + np.searchsorted(low[s:e], rank[group], "right") - 1
            kept = [k for k in batch.schema.names if k != "rank"]
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(first[at] + rank - low[at]), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    kept = [f"{n} {t}" for n, t in ranked.dtypes if n != "rank"]
    return ranked.mapInArrow(place, ", ".join([*kept, "sequence_id long", "offset long"])).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")
