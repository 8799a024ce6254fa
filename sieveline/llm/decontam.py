"""Benchmark decontamination by latent semantic retrieval, with checks of common subsequences and answers.

1. Documents are cut into cells of ``cell`` words (in lower case, without ASCII punctuation); two adjacent cells are a passage.
   TF-IDF runs over the benchmark's words, with document frequencies counted over all cells.  Words in more than
   ``common`` of the cells (and in more than FEW) weigh nothing, unless they are among the RAREST words of an item: these weigh
   whatever their frequency, so an item that is leaked often is searched like any other.
2. A randomised SVD of all passages with at least two weighing words gives a latent space: Y = A'(A Q) is summed over
   partitions (words x rank numbers each), made orthonormal on the driver, and the top of Q'A'AQ gives the right singular vectors.
3. A passage is a candidate for an item if the cosine of their latent vectors is at least ``cosine``.  A space of fixed rank has no
   room for all of every item's few rare words, so as a safeguard a place with RUN words of an item in a row (all of them, if it
   has fewer) is one too, by an exact lookup of runs: every verbatim copy is judged, however common its words are.
4. A candidate counts if the longest common subsequence of the item's words and the passage with its surroundings covers
   ``exact`` of the item; or, as a paraphrase, ``loose`` of it when the item's answer (its last sentence with three words at least)
   is there too, to ``answer`` of its words.

Items are taken in blocks of at most ``block_items`` items and ``block_words`` words, so what is broadcast is bounded whatever the
benchmark's size.  Results: the rows of docs with item_ids (sorted), overlap (the largest share covered, 0 without a
hit) and contaminated.  Null or empty texts, and items without words, are in no hit.  Repeated rows are judged alike; input
columns of these three names get _input behind them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RADIX, Scratch, grouped_runs, hashed_words, keep_apart, summed

FEW = 16  # words in so few cells weigh in any corpus
RAREST = 8  # so many distinct words of each item weigh in any corpus
RUN = 8
SENTENCE = re.compile(r"[^.!?\n]+")
# ASCII letters, digits and all bytes of other characters are parts of words.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """Words in lower case between spaces."""
    return text.lower().encode("utf-8", "replace").translate(TABLE) if text else b""


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


class Items:
    """A block of benchmark items and its vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words = [words_of(r[1]) for r in rows]
        sentences = [[w for w in map(words_of, SENTENCE.findall(r[1])) if len(w) >= 3] for r in rows]
        self.answers = [s[-1] if s else w for s, w in zip(sentences, self.words, strict=True)]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for words in self.words for w in words}))}
        hashes = hashed_words(b" ".join(self.vocabulary))[0]  # one for each word, in the order of their numbers
        order = np.argsort(hashes)
        seen = np.zeros(1 << 20, bool)
        seen[hashes >> np.uint64(44)] = True
        self.hashed = (hashes[order], order.astype(np.int32), seen)
        self.answers = [[self.vocabulary[w] for w in words] for words in self.answers]
        self.numbers = [np.array([self.vocabulary[w] for w in words], np.int64) for words in self.words]


def cells_of(texts: list[str | None], hashed: tuple, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: ids (-1: not in the vocabulary) and cells; first cell and first word of each text."""
    known, numbers, seen = hashed
    parts = [plain(t) for t in texts]
    hashes, starts, _ = hashed_words(b"\n".join(parts))
    ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in parts]))
    sizes = np.diff(ends, prepend=0)
    ids = np.full(len(hashes), -1, np.int64)
    at = np.flatnonzero(seen[hashes >> np.uint64(44)])
    k = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
    hit = known[k] == hashes[at]
    ids[at[hit]] = numbers[k[hit]]
    first = np.concatenate(([0], np.cumsum(-(-sizes // cell))))
    begin = ends - sizes
    return ids, np.repeat(first[:-1], sizes) + (np.arange(len(ids)) - np.repeat(begin, sizes)) // cell, first, begin


def passages(ids: np.ndarray, cells: np.ndarray, first: np.ndarray, weight: np.ndarray):
    """Sparse passages with at least two weighing words: first cell, sizes, words and counts."""
    found = ids >= 0
    found[found] = weight[ids[found]] > 0
    w, c = ids[found], cells[found]
    starts = np.zeros(int(first[-1]) + 1, bool)
    starts[first] = True
    before = ~starts[c]  # also in the passage that starts a cell earlier
    packed, counts = np.unique(np.concatenate([c << 20 | w, (c[before] - 1) << 20 | w[before]]), return_counts=True)
    passage = packed >> 20
    at, sizes = grouped_runs(passage)
    keep = np.repeat(sizes >= 2, sizes)
    return passage[at][sizes >= 2], sizes[sizes >= 2], (packed & ((1 << 20) - 1))[keep], counts[keep]


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    h = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
    for k in range(n):
        h = (h + ids[k : k + len(h)].astype(np.uint64)) * np.uint64(RADIX)
    return h


def item_runs(items: Items) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By length of run: the length, a bitmap of hashes, the sorted hashes and their items."""
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i, w in enumerate(items.numbers):
        by_length.setdefault(min(RUN, len(w)), []).append((np.unique(run_hashes(w, min(RUN, len(w)))), i))
    out = []
    for n, found in by_length.items():
        hashes, item = np.concatenate([h for h, _ in found]), np.repeat([i for _, i in found], [len(h) for h, _ in found])
        order = np.argsort(hashes, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[hashes >> np.uint64(44)] = True
        out.append((n, seen, hashes[order], item[order]))
    return out


def places_of_runs(ids: np.ndarray, runs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """First words and items of all runs that stand in ``ids``; those across two texts are for the caller to refuse."""
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, seen, hashes, item in runs:
        h = run_hashes(ids, n)
        at = np.flatnonzero(seen[h >> np.uint64(44)])
        low, high = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
        size = high - low
        places.append(np.repeat(at, size))
        found.append(item[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())])
    return np.concatenate(places), np.concatenate(found)


def vectors(sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values of sparse rows."""
    x = (1 + np.log(counts)) * weight[words]
    norm = np.sqrt(np.add.reduceat(x * x, np.cumsum(sizes) - sizes))
    return x / np.repeat(norm, sizes)


def weighted_sums(x: np.ndarray, rows: np.ndarray, table: np.ndarray, sizes: np.ndarray, depth: int = 16) -> np.ndarray:
    """Sums of x[k] * table[rows[k]] over consecutive segments: place by place over all segments, and what is behind ``depth`` by segment."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    total = np.zeros((len(sizes), table.shape[1]), table.dtype)
    for k in range(min(depth, int(sizes[0])) if len(sizes) else 0):
        n = np.searchsorted(-sizes, -k)  # segments with more than k places
        at = starts[:n] + k
        total[:n] += x[at, None] * table[rows[at]]
    for i in range(np.searchsorted(-sizes, -depth)):
        rest = slice(starts[i] + depth, starts[i] + sizes[i])
        total[i] += x[rest] @ table[rows[rest]]
    out = np.empty_like(total)
    out[order] = total
    return out


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyro 2004)."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def weights(docs: DataFrame, items: Items, cell: int, common: float) -> np.ndarray:
    """Inverse document frequencies over all cells; 0 for words that are too common and not among the rarest of an item."""
    n, hashed = len(items.vocabulary), items.hashed

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 200):
                ids, cells, first, _ = cells_of(texts[at : at + 200], hashed, cell)
                total[n] += first[-1]
                found = ids >= 0
                packed = np.sort(cells[found] << 20 | ids[found])
                starts, _ = grouped_runs(packed)
                total[:n] += np.bincount(packed[starts] & ((1 << 20) - 1), minlength=n)
        yield pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int64()), "n": pa.array([total], pa.list_(pa.float64()))})

    total = summed(docs.select("text").mapInArrow(count, "block long, n array<double>")).get(0, np.zeros(n + 1))
    weighs = total[:n] <= np.maximum(common * total[n], FEW)
    for w in items.numbers:
        w = np.unique(w)
        weighs[w[np.argsort(total[w], kind="stable")[:RAREST]]] = True
    return np.where(weighs, np.log((total[n] + 1) / (total[:n] + 0.5)), 0)


def latent_space(spark: SparkSession, docs: DataFrame, items: Items, weight: np.ndarray, cell: int, rank: int, rounds: int = 2, extra: int = 8) -> np.ndarray:
    """The right singular vectors (words x rank) of the TF-IDF passages of all documents."""
    hashed = items.hashed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 500):
                ids, cells, first, _ = cells_of(texts[at : at + 500], hashed, cell)
                _, sizes, words, counts = passages(ids, cells, first, weight)
                if len(sizes):
                    yield pa.RecordBatch.from_pydict({"sizes": pa.array([sizes.astype(np.int16)], pa.list_(pa.int16())), "words": pa.array([words.astype(np.int32)], pa.list_(pa.int32())), "counts": pa.array([counts.astype(np.int16)], pa.list_(pa.int16()))})

    sparse = Scratch(spark).save(docs.select("text").mapInArrow(cut, "sizes array<short>, words array<int>, counts array<short>"), "passages")
    n = len(weight)
    size = min(n, rank + extra)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((n, size)))[0]
    for _ in range(rounds + 1):

        def multiply(batches: Iterator[pa.RecordBatch], q: np.ndarray = q.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for batch in batches:
                for sizes, words, counts in zip(*batch.columns, strict=True):
                    sizes, words, counts = (x.values.to_numpy().astype(np.int64) for x in (sizes, words, counts))
                    x = vectors(sizes, words, counts, weight).astype(np.float32)
                    y = weighted_sums(x, words, q, sizes)
                    order = np.argsort(words, kind="stable")
                    starts, runs = grouped_runs(words[order])
                    total[words[order][starts]] += weighted_sums(x[order], np.repeat(np.arange(len(sizes)), sizes)[order], y, runs)
            for at in range(0, n, 512):
                yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "n": pa.array([total[at : at + 512].ravel()], pa.list_(pa.float64()))})

        got = summed(sparse.mapInArrow(multiply, "block long, n array<double>"))
        y = np.zeros((n, size))
        for at, part in got.items():
            y[at : at + 512] = part.reshape(-1, size)
        last, q = q, np.linalg.qr(y)[0]
    values, small = np.linalg.eigh(last.T @ y)
    return (last @ small)[:, np.argsort(-values)[:rank]]


def decontaminate(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cell: int = 24, common: float = 0.001, rank: int = 96, cosine: float = 0.45,
    exact: float = 0.7, loose: float = 0.5, answer: float = 0.8, block_items: int = 2000, block_words: int = 200_000,
) -> DataFrame:
    """docs (doc_id, text, ...) -> its rows with item_ids, overlap and contaminated."""
    docs = keep_apart(docs, ["item_ids", "overlap", "contaminated"])
    found = docs.withColumn("item_ids", F.array().cast("array<long>")).withColumn("overlap", F.lit(0.0))
    rows, blocks, words = [], [], 0
    for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        size = len(words_of(r[1]))
        if rows and (len(rows) >= block_items or words + size > block_words):
            blocks.append(rows)
            rows, words = [], 0
        if size:
            rows.append((r[0], r[1]))
            words += size
    for block in [*blocks, rows]:
        if block:
            found = search(spark, docs, found, Items(block), cell, common, rank, cosine, exact, loose, answer)
    return found.withColumn("contaminated", F.size("item_ids") > 0)


def search(spark, docs, found, items: Items, cell, common, rank, cosine, exact, loose, answer) -> DataFrame:
    weight = weights(docs, items, cell, common)
    space = latent_space(spark, docs, items, weight, cell, rank).astype(np.float32)
    latent = np.zeros((len(items.ids), space.shape[1]), np.float32)
    for i in range(len(items.ids)):
        words, counts = np.unique(items.numbers[i], return_counts=True)
        latent[i] = ((1 + np.log(counts)) * weight[words]) @ space[words]
    norm = np.linalg.norm(latent, axis=1)
    latent /= np.maximum(norm, 1e-12)[:, None]
    shared = spark.sparkContext.broadcast((items.ids, [x.tolist() for x in items.numbers], items.answers, items.hashed, weight, space, latent, item_runs(items)))
    names = found.columns
    at_text, at_ids, at_overlap = (names.index(x) for x in ("text", "item_ids", "overlap"))

    def pairs_of(ids, cells, first, weight, space, latent) -> np.ndarray:
        passage, sizes, words, counts = passages(ids, cells, first, weight)
        if not len(sizes):
            return np.zeros(0, np.int64)
        x = vectors(sizes, words, counts, weight).astype(np.float32)
        y = np.empty((len(sizes), space.shape[1]), np.float32)
        ends = np.cumsum(sizes)
        for a in range(0, len(sizes), 20_000):
            b = min(a + 20_000, len(sizes))
            s, e = ends[a] - sizes[a], ends[b - 1]
            y[a:b] = weighted_sums(x[s:e], words[s:e], space, sizes[a:b])
        y /= np.maximum(np.linalg.norm(y, axis=1), 1e-12)[:, None]
        found = [np.zeros(0, np.int64)]
        for a in range(0, len(y), 20_000):
            hit, item = np.nonzero(y[a : a + 20_000] @ latent.T >= cosine)
            found.append(passage[a + hit] * len(latent) + item)
        return np.concatenate(found)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, numbers, answers, hashed, weight, space, latent, runs = shared.value
        counts = [Counter(x) for x in numbers]
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            ids_out, overlaps = batch.column(at_ids).to_pylist(), batch.column(at_overlap).to_pylist()
            for at in range(0, len(texts), 200):
                ids, cells, first, begin = cells_of(texts[at : at + 200], hashed, cell)
                ends = np.append(begin[1:], len(ids))
                place, item = places_of_runs(ids, runs)
                pair = np.union1d(cells[place] * len(latent) + item, pairs_of(ids, cells, first, weight, space, latent))
                hit, item = pair // len(latent), pair % len(latent)
                doc = np.searchsorted(first, hit, "right") - 1
                for d, i, c in zip(doc.tolist(), item.tolist(), hit.tolist(), strict=True):
                    if item_ids[i] in ids_out[at + d]:
                        continue
                    own, held = numbers[i], counts[i]
                    start = int(begin[d]) + (c - int(first[d])) * cell
                    around = ids[max(int(begin[d]), start - len(own)) : min(start + 2 * cell + len(own), int(ends[d]))].tolist()
                    around = [w for w in around if w in held]
                    if sum(map(held.__getitem__, set(around))) < loose * len(own):  # the common subsequence has no more words
                        continue
                    share = common_subsequence(own, around) / len(own)
                    if share < loose:
                        continue
                    if share >= exact or common_subsequence(answers[i], around) >= answer * len(answers[i]):
                        ids_out[at + d].append(item_ids[i])
                        overlaps[at + d] = max(overlaps[at + d], share)
            columns = list(batch.columns)
            columns[at_ids] = pa.array([sorted(x) for x in ids_out], pa.list_(pa.int64()))
            columns[at_overlap] = pa.array(overlaps, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(look, T.StructType(found.schema.fields))
