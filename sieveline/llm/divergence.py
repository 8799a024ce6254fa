"""How far the sources of a language differ in the words they use, from mergeable byte tries.

Each task counts the terms of its documents in radix tries over UTF-8 bytes, one a language, whose leaves hold the number of
documents and the occurrences by source.  There a trie is flat: its leaves in byte order, each with the depth at which it leaves
the path of the leaf before and the tail that it adds, from which the inner nodes follow.  Flat tries are cut into chunks, at
common bounds too, and dealt by prefix range; a task merges those of its range into one linked trie and, as chunks come by their
first term, passes on in byte order what no later chunk can change.  Terms in enough
documents stay.  A last walk over these gives, with the totals of all ranges, the sums for all pairs of sources and the
candidates of each source in order, ties by term.

A term is a run of ASCII letters and characters beyond ASCII; A-Z are lower-cased.  For a group (a language, or a source in it)
p(term) = 1 + floor(10^9 * (count + 5) / (N + 5 * V)): V kept terms of the language, N their occurrences in the group.  All
arithmetic is on whole numbers; where 64 bits do not hold it, Python's own are used.

Memory: a task's tries are sent on at ``TERMS`` terms, a merged one is emptied up to the next chunk's first term at ``LEAVES``, and
term by source tables are made for ``CELLS`` cells at a time.  A hot language or source is spread over tasks like its documents,
a hot prefix over ranges, whose bounds come from a sample of at most ``SAMPLE`` terms a range (the bounds decide only where
work is done).  The driver and every task hold the totals of the groups; pairs of groups are rows of the result, so groups
are fewer than the square root of twice its rows, plus the number of languages.

Defined results: null text, lang and source count as empty strings; a group without terms is compared all the same; each of repeated
rows is a document; ids play no part, nor do other columns.  A language of which no term is kept has the value 0 for all
pairs, and no terms.  No rows give no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbers, Scratch, parts_for

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))  # the rest: spaces
TERMS, BUFFER, LEAVES, CHUNK, SEGMENT = 400_000, 3_000_000, 150_000, 1024, 1 << 20
SOURCE_BITS = 31
RANGE, SAMPLE = 400_000, 20
CELLS = 4_000_000
SCALE, PRIOR = 1_000_000_000, 5
CHUNKS = "lang string, first binary, last binary, leaves long, sources array<string>, words array<long>, body binary"


class Node:
    """A node of a radix trie; the label is what its edge adds, leaf is None or [documents, {source: occurrences}]."""

    __slots__ = ("label", "kids", "leaf")

    def __init__(self, label: bytes):
        self.label, self.kids, self.leaf = label, {}, None


class Trie:
    def __init__(self):
        self.root, self.size = Node(b""), 0

    def leaf(self, term: bytes) -> list:
        """The leaf of a term, which is put in if it is not there."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            kid = node.kids.get(term[at])
            if kid is None:
                kid = node.kids[term[at]] = Node(term[at:])
                at = end
            elif term.startswith(kid.label, at):
                at += len(kid.label)
            else:
                same = shared(kid.label, term[at:])
                middle = node.kids[term[at]] = Node(kid.label[:same])
                kid.label = kid.label[same:]
                middle.kids[kid.label[0]] = kid
                kid, at = middle, at + same
            node = kid
        if node.leaf is None:
            node.leaf = [0, {}]
            self.size += 1
        return node.leaf

    def walk(self, node: Node | None = None, path: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Terms and leaves in byte order, below a node whose label is not yet in path."""
        todo = [(node or self.root, path)]
        while todo:
            node, path = todo.pop()
            path += node.label
            if node.leaf is not None:
                yield path, node.leaf
            todo += [(node.kids[b], path) for b in sorted(node.kids, reverse=True)]

    def drain(self, bound: bytes | None) -> Iterator[tuple[bytes, list]]:
        """Takes out the terms below a bound (None: all), in byte order."""
        if bound is None:
            yield from self.walk()
            self.__init__()
            return
        node, at = self.root, 0
        while True:
            if node.leaf is not None and at < len(bound):
                yield bound[:at], node.leaf
                node.leaf, self.size = None, self.size - 1
            for b in sorted(node.kids):
                kid = node.kids[b]
                if at < len(bound) and kid.label < bound[at : at + len(kid.label)]:
                    for found in self.walk(kid, bound[:at]):
                        yield found
                        self.size -= 1
                    del node.kids[b]
            kid = node.kids.get(bound[at]) if at < len(bound) else None
            if kid is None or not bound.startswith(kid.label, at):
                return
            node, at = kid, at + len(kid.label)


def shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:  # a[:low] == b[:low]
        half = (low + high + 1) // 2
        low, high = (half, high) if a[:half] == b[:half] else (low, half - 1)
    return low


def depths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sorted terms (their bytes, and where each begins, with the end last): the length that each shares with the one before."""
    size, out = np.diff(at), np.zeros(len(at) - 1, np.int64)
    live = np.arange(1, len(out))
    for j in range(64):
        live = live[(size[live] > j) & (size[live - 1] > j)]
        live = live[data[at[live] + j] == data[at[live - 1] + j]]
        if not len(live):
            return out
        out[live] = j + 1
    for k in live.tolist():
        out[k] = shared(data[at[k - 1] : at[k]].tobytes(), data[at[k] : at[k + 1]].tobytes())
    return out


class Flat:
    """The terms of one language in a task, by number; in the end a flat trie."""

    def __init__(self):
        self.known, self.sources = Numbers(), Numbers()
        self.total = np.zeros(0, np.int64)  # documents of each term, of those settled
        self.docs: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, source: str, text: bytes) -> None:
        """Counts a document, whose bytes outside terms are spaces."""
        pieces = [text] if len(text) <= SEGMENT else segments(text)
        found = [np.unique(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), return_counts=True) for words in map(bytes.split, pieces)]
        terms, counts = found[0] if len(found) == 1 else summed_keys([t for t, _ in found], [c for _, c in found])
        if len(terms):
            self.docs.append(terms)
            self.keys.append(terms << SOURCE_BITS | self.sources[source])
            self.counts.append(counts)
            self.held += len(terms)

    def settle(self) -> None:
        """Adds up what is held of each term and source."""
        if self.docs:
            docs, n = np.unique(np.concatenate(self.docs), return_counts=True)
            self.total = np.pad(self.total, (0, len(self.known) - len(self.total)))
            self.total[docs] += n
            keys, counts = summed_keys(self.keys, self.counts)
            self.docs, self.keys, self.counts, self.held = [], [keys], [counts], 0

    def chunks(self, lang: str) -> Iterator[tuple]:
        """Rows of CHUNKS, in byte order."""
        self.settle()
        if not self.known:
            return
        words = pa.array(list(self.known), pa.large_binary())
        order = pc.sort_indices(words).to_numpy()
        words = words.take(pa.array(order))
        at, data = (np.frombuffer(words.buffers()[k], kind) for k, kind in ((1, np.int64), (2, np.uint8)))
        at = at[: len(words) + 1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys = rank[self.keys[0] >> SOURCE_BITS] << SOURCE_BITS | self.keys[0] & ((1 << SOURCE_BITS) - 1)
        sort = np.argsort(keys)
        leaf, which, counts = keys[sort] >> SOURCE_BITS, keys[sort] & ((1 << SOURCE_BITS) - 1), self.counts[0][sort]
        yield from flat_chunks(lang, data, at, self.total[order], np.bincount(leaf, minlength=len(order)), which, counts, list(self.sources))


def summed_keys(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def flat_chunks(lang: str, data: np.ndarray, at: np.ndarray, docs: np.ndarray, many: np.ndarray, which: np.ndarray, counts: np.ndarray, names: list[str]) -> Iterator[tuple]:
    """A flat trie in chunks: terms as bytes and places, documents, number of sources, then source and occurrences of each."""
    same, size, first = depths(data, at), np.diff(at), np.concatenate([[0], np.cumsum(many)])
    todo = [(low, min(low + CHUNK, len(size))) for low in range(0, len(size), CHUNK)][::-1]
    while todo:
        low, high = todo.pop()
        if at[high] - at[low] > SEGMENT and high - low > 1:
            todo += [((low + high) // 2, high), (low, (low + high) // 2)]
            continue
        mine, sizes = same[low:high].copy(), size[low:high]
        mine[0] = 0
        tail = np.arange(at[low], at[high]) - np.repeat(at[low:high], sizes) >= np.repeat(mine, sizes)
        some, column = np.unique(which[first[low] : first[high]], return_inverse=True)
        n = counts[first[low] : first[high]]
        words = np.zeros(len(some), np.int64)
        np.add.at(words, column, n)
        head = np.array([mine, sizes - mine, docs[low:high], many[low:high]], np.int64)
        body = b"".join([head.tobytes(), column.astype(np.int64).tobytes(), n.tobytes(), data[at[low] : at[high]][tail].tobytes()])
        ends = [data[at[k] : at[k + 1]].tobytes() for k in (low, high - 1)]
        yield lang, *ends, high - low, [names[k] for k in some.tolist()], words.tolist(), body


def flattened(lang: str, leaves: list[tuple[bytes, list]]) -> Iterator[tuple]:
    """Chunks of leaves in byte order."""
    names = Numbers()
    at = np.cumsum([0, *(len(t) for t, _ in leaves)])
    data = np.frombuffer(b"".join(t for t, _ in leaves), np.uint8)
    which = np.array([names[s] for _, x in leaves for s in x[1]], np.int64)
    counts = np.array([n for _, x in leaves for n in x[1].values()], np.int64)
    return flat_chunks(lang, data, at, np.array([x[0] for _, x in leaves]), np.array([len(x[1]) for _, x in leaves]), which, counts, list(names))


def unpacked(leaves: int, body: memoryview) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, documents, number of sources, source numbers and occurrences of a chunk."""
    same, size, docs, many = np.frombuffer(body, np.int64, 4 * leaves).reshape(4, leaves)
    total = int(many.sum())
    which, counts = np.frombuffer(body, np.int64, 2 * total, 32 * leaves).reshape(2, total)
    tails = bytes(body[32 * leaves + 16 * total :])
    terms, before, at = [], b"", 0
    for k, n in zip(same.tolist(), size.tolist(), strict=True):
        before = before[:k] + tails[at : at + n]
        at += n
        terms.append(before)
    return terms, docs, many, which, counts


def chunked(lang: str, leaves: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
    """Chunks of a linked trie's leaves in byte order."""
    held = []
    for leaf in leaves:
        held.append(leaf)
        if len(held) >= CHUNK:
            yield from flattened(lang, held)
            held = []
    if held:
        yield from flattened(lang, held)


def parted(row: dict, numbers: list[int], terms: list[bytes]) -> Iterator[tuple]:
    """A chunk cut where the number of its leaves' range changes: rows of CHUNKS and that number."""
    _, docs, many, which, counts = unpacked(row["leaves"], memoryview(row["body"]))
    first = np.concatenate([[0], np.cumsum(many)])
    ends = [k for k in range(1, len(numbers)) if numbers[k] != numbers[k - 1]] + [len(numbers)]
    low = 0
    for high in ends:
        at = np.cumsum([0, *map(len, terms[low:high])])
        data = np.frombuffer(b"".join(terms[low:high]), np.uint8)
        part = slice(first[low], first[high])
        for found in flat_chunks(row["lang"], data, at, docs[low:high], many[low:high], which[part], counts[part], row["sources"]):
            yield (*found, numbers[low])
        low = high


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def arrow(*more: tuple[str, pa.DataType]) -> pa.Schema:
    binary, names = pa.binary(), pa.list_(pa.string())
    return pa.schema([("lang", pa.string()), ("first", binary), ("last", binary), ("leaves", pa.int64()), ("sources", names), ("words", pa.list_(pa.int64())), ("body", binary), *more])


def segments(text: bytes) -> Iterator[bytes]:
    """A text as pieces of bounded size, cut at spaces only."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SEGMENT) if len(text) - at > SEGMENT else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """Chunks of the tries of each task, and rows without leaves that name the sources of each language."""
    schema = arrow()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Flat] = {}
        seen: dict[str, set] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                for row in trie.chunks(lang):
                    yield batch_of([row], schema)
            tries.clear()

        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lang, source = lang or "", source or ""
                seen.setdefault(lang, set()).add(source)
                if text.is_valid:
                    tries.setdefault(lang, Flat()).add(source, text.as_buffer().to_pybytes().translate(LETTERS))
                    if tries[lang].held > BUFFER:
                        tries[lang].settle()
                    if sum(len(t.known) for t in tries.values()) > TERMS:
                        yield from send()
        yield from send()
        if seen:
            yield batch_of([(lang, None, None, 0, sorted(names), [], None) for lang, names in seen.items()], schema)

    empty = F.lit("")
    rows = docs.select(F.coalesce("text", empty).cast("binary").alias("text"), F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"))
    return rows.mapInArrow(count, CHUNKS)


def in_ranges(spark: SparkSession, chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks cut at the bounds of ranges of (lang, term), with the number of their range; and how many ranges there are."""
    n, leaves = chunks.agg(F.count("*"), F.sum("leaves")).first()
    parts = parts_for(spark, leaves or 0, RANGE)
    some = chunks.select("lang", F.substring("first", 1, 64).alias("first"))
    if n > SAMPLE * parts:
        some = some.sample(SAMPLE * parts / n, seed=1)
    firsts = sorted((lang.encode(), bytes(first)) for lang, first in some.limit(2 * SAMPLE * parts).collect())
    bounds = sorted({firsts[len(firsts) * k // parts] for k in range(1, parts)}) if firsts else []
    schema = arrow(("range", pa.int32()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lang = row["lang"].encode()
                low, high = bisect_right(bounds, (lang, row["first"])), bisect_right(bounds, (lang, row["last"]))
                if low == high:
                    yield batch_of([(*row.values(), low)], schema)
                    continue
                terms = unpacked(row["leaves"], memoryview(row["body"]))[0]
                numbers = [bisect_right(bounds, (lang, t)) for t in terms]
                for found in parted(row, numbers, terms):
                    yield batch_of([found], schema)

    return chunks.mapInArrow(cut, CHUNKS + ", range int"), len(bounds) + 1


def merge_chunk(trie: Trie, row: dict) -> None:
    terms, docs, many, which, counts = unpacked(row["leaves"], memoryview(row["body"]))
    pairs = zip(map(row["sources"].__getitem__, which.tolist()), counts.tolist(), strict=True)
    for term, n, k in zip(terms, docs.tolist(), many.tolist(), strict=True):
        leaf = trie.leaf(term)
        leaf[0] += n
        mine = leaf[1]
        for source, c in islice(pairs, k):
            mine[source] = mine.get(source, 0) + c


def merged(spark: SparkSession, chunks: DataFrame, least: int) -> DataFrame:
    """Chunks of the terms that at least ``least`` documents of their language hold."""
    rows, n = in_ranges(spark, chunks)
    schema = arrow()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, lang = Trie(), None

        def kept(bound: bytes | None) -> Iterator[pa.RecordBatch]:
            found = ((term, leaf) for term, leaf in trie.drain(bound) if leaf[0] >= least)
            for row in chunked(lang, found):
                yield batch_of([row], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["lang"] != lang:
                    yield from kept(None)
                    lang = row["lang"]
                if trie.size > LEAVES:
                    yield from kept(row["first"])
                merge_chunk(trie, row)
        yield from kept(None)

    dealt = rows.repartitionById(n, "range").sortWithinPartitions("range", "lang", "first")
    return dealt.select(*[c for c in dealt.columns if c != "range"]).mapInArrow(merge, CHUNKS)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / whole), exactly."""
    if counts.size and int(counts.max()) > (1 << 62) // SCALE:
        found = (SCALE * (counts.astype(object) + PRIOR)) // whole.astype(object) + 1
        return found.astype(np.int64)
    return SCALE * (counts + PRIOR) // whole + 1


def compared(kept: DataFrame, groups: dict[str, tuple[list[str], list[int], int]], top: int) -> DataFrame:
    """Sums for pairs of sources (item null: of one task) and each task's first ``top`` terms of each source.

    groups: language -> its sources, their N, and V.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("item", pa.binary()), ("value", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], list] = {}
        tables: dict[str, list] = {}

        def pairs(lang: str) -> Iterator[pa.RecordBatch]:
            names = groups[lang][0]
            p = np.concatenate(tables.pop(lang))
            for k in range(len(names) - 1):
                value = np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(axis=0)
                m = len(value)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([names[k]] * m), pa.array(names[k + 1 :]), pa.nulls(m, pa.binary()), pa.array(value)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                lang = row["lang"]
                names, n, v = groups[lang]
                whole = np.array(n, np.int64) + PRIOR * v
                place = {s: k for k, s in enumerate(names)}
                terms, _, many, which, counts = unpacked(row["leaves"], memoryview(row["body"]))
                at = np.repeat(np.arange(len(terms)), many)
                column = np.array([place[s] for s in row["sources"]], np.int64)[which]
                step = max(1, CELLS // len(names))
                for low in range(0, len(terms), step):
                    mine = (at >= low) & (at < low + step)
                    table = np.zeros((min(step, len(terms) - low), len(names)), np.int64)
                    table[at[mine] - low, column[mine]] = counts[mine]
                    p = shares(table, whole)
                    q = shares(table.sum(axis=1), whole.sum() - PRIOR * v * (len(names) - 1) + np.zeros(1, np.int64))
                    more = np.where(table > 0, p - q[:, None], 0)
                    for k in np.flatnonzero((more > 0).any(axis=0)).tolist():
                        order = np.argsort(-more[:, k], kind="stable")[:top]
                        order = order[more[order, k] > 0]
                        found = [(-int(more[i, k]), terms[low + i]) for i in order.tolist()]
                        best[lang, names[k]] = heapq.nsmallest(top, best.get((lang, names[k]), []) + found)
                    tables.setdefault(lang, []).append(p)
                    if sum(map(len, tables[lang])) * len(names) > CELLS:
                        yield from pairs(lang)
        for lang in list(tables):
            yield from pairs(lang)
        for (lang, source), found in best.items():
            m = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), pa.nulls(m, pa.string()), pa.array([t for _, t in found], pa.binary()), pa.array([-f for f, _ in found], pa.int64())], schema=schema)

    return kept.mapInArrow(compare, "lang string, source string, other string, item binary, value long")


def audit(spark: SparkSession, docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part, item, value, rank.

    Part "pair": item is each other source of the language, value the sum of |p - q| over its kept terms.  Part "term": item is a
    term that the source has and uses more than its language, value p - q; the first ``top`` of them.  Ranks are from 1 in each
    group and part, by value from the largest, then by item.
    """
    scratch = Scratch(spark)
    chunks = scratch.save(counted(docs), "tries")
    kept = scratch.save(merged(spark, chunks.where("leaves > 0"), least), "kept")
    named = chunks.where("leaves = 0").select("lang", F.explode("sources").alias("source")).distinct()
    words = kept.select("lang", F.explode(F.arrays_zip("sources", "words")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.words").alias("n"))
    terms = kept.groupBy("lang").agg(F.sum("leaves").alias("v"))
    totals = named.join(words, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0)
    groups: dict[str, tuple[list[str], list[int], int]] = {}
    for lang, source, n, v in sorted((r["lang"], r["source"], r["n"], r["v"]) for r in totals.collect()):
        mine = groups.setdefault(lang, ([], [], v))
        mine[0].append(source)
        mine[1].append(n)
    found = scratch.save(compared(kept, groups, top), "compared", release=False)
    some = found.where("other is not null").select("lang", "source", "other", "value")
    bare = [(lang, s, names[:k]) for lang, (names, _, v) in groups.items() if not v for k, s in enumerate(names) if k]
    if bare:  # languages without kept terms
        none = spark.createDataFrame(bare, "lang string, source string, others array<string>")
        some = some.union(none.select("lang", "source", F.explode("others").alias("other"), F.lit(0).cast("long")))
    both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = some.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")).select("lang", both, "value").select("lang", "x.source", "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    pairs = pairs.withColumn("rank", F.row_number().over(order)).select(columns("pair"))
    likely = found.where("item is not null").select("lang", "source", F.col("item").cast("string").alias("item"), "value")
    likely = likely.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(columns("term"))
    return pairs.unionByName(likely)
