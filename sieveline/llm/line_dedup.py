"""Line deduplication by an exact set-similarity join with prefix, positional and length filters.

A line is what stands between line feeds; its set is its distinct words (runs of anything but ASCII white space,
A-Z in lower case).  A line goes if an earlier line (by doc_id, then place in the text) has a Jaccard similarity of percent / 100
or more with it, whether or not that earlier line stays.  Lines with fewer than ``least`` distinct words (1: none but blank ones) stay.

1. A sketch of 2^20 counters gives each word an estimated frequency; words are ordered by it, rarest first, then by hash.
   Any fixed order gives exact results, so the sketch's size is the same for any corpus.
2. Lines are packed in arrays, some thousands a row.  Equal sets are merged, first within such a row, then by a shuffle of
   128-bit digests (of the words' 64-bit hashes): only the first occurrence goes on, later ones are removed.
3. Two sets that are similar enough share a word among the first n - ceil(n * percent / 100) + 1 of their order.  These prefix words
   are dealt to buckets, again packed.  A word that stands in very many prefixes is dealt out as pairs of blocks.  Sets that
   share such a word and pass the length, positional and bitmap filters (a 128-bit parity bitmap bounds the words they can have in
   common) are candidates; Jaccard is checked on the real words of both lines.
4. One earlier match suffices.  So sets that many share a word with are first compared with a few candidates.  Those of them
   that find no match then meet all their partners: a second pass over the packed lines takes only their words.

Results: ``removed_lines`` gives (doc_id, line_no); ``deduplicate`` the documents with the lines left, and n_lines and n_removed (input
columns of these names become n_lines_input and n_removed_input).  Null text stays null.  Rows with a null doc_id stay as they
are; rows that repeat a doc_id are one document, whose lines are told by their number.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, binary_list, grouped_runs, hashed_words, keep_apart, mix64, parts_for, summed

CELLS, BLOCK = 1 << 20, 1 << 12
PACKED = "chunk long, n long, doc binary, line binary, size binary, prefix binary, keys binary, even binary, odd binary, low binary, high binary, gone_doc binary, gone_line binary"
ENTRIES = "bucket long, kind int, key binary, block binary, doc binary, line binary, size binary, pos binary, even binary, odd binary"
KINDS = {"doc": "<i8", "line": "<i4", "size": "<i4", "prefix": "<i4", "keys": "<u8", "even": "<u8", "odd": "<u8", "low": "<u8", "high": "<u8", "gone_doc": "<i8", "gone_line": "<i4", "key": "<u8", "block": "<i4", "pos": "<i4", "place": "<i4"}


def packed(rows: list[dict], schema: str) -> pa.RecordBatch:
    """Rows of numbers and arrays, these as bytes."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n].astype(KINDS[n]).tobytes() if t == "binary" else r[n] for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields])


def unpacked(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict]:
    """The rows of a batch, with arrays for what is packed."""
    columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
    for row in zip(*columns, strict=True):
        yield {n: np.frombuffer(x, KINDS[n]) if isinstance(x, bytes) else x for n, x in zip(names, row, strict=True)}


def blocks_of(total: np.ndarray) -> pa.RecordBatch:
    """Counters as rows (block, n) for ``summed``."""
    ends = pa.array(np.arange(0, CELLS + 1, BLOCK), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS // BLOCK)), pa.ListArray.from_arrays(ends, pa.array(total.astype(np.float64)))], ["block", "n"])


def sketch_of(parts: DataFrame) -> np.ndarray:
    sketch = np.zeros(CELLS)
    for block, counts in summed(parts).items():
        sketch[block * BLOCK : (block + 1) * BLOCK] = counts
    return sketch


def frequencies(docs: DataFrame) -> np.ndarray:
    """The sketch: how many words fall on each counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for texts in buffers(binary_list(batch.column(0))):
                total += np.bincount(cell_of(hashed_words(b"\n".join(texts).lower())[0]), minlength=CELLS)
        yield blocks_of(total)

    return sketch_of(docs.select("text").mapInArrow(count, "block long, n array<double>"))


def ranks_of(sketch: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.log2(sketch + 1.0) * 6).astype(np.uint8)  # one byte a counter


def buffers(texts: list[bytes | None], size: int = 1_000_000) -> Iterator[list[bytes]]:
    """Texts in turn, in lists of about ``size`` bytes."""
    held, n = [], 0
    for text in texts:
        held.append(text or b"")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def keys_of(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort keys of words: 8 bits of frequency, 44 of hash (with those that give the cell)."""
    return rank[cell_of(words)].astype(np.uint64) << np.uint64(44) | words & np.uint64((1 << 44) - 1)


def sets_of(hashes: np.ndarray, line: np.ndarray, rank: np.ndarray, least: int, percent: int) -> dict[str, np.ndarray]:
    """Of words (by line, at most 4096 lines): the sets of lines that are long enough."""
    order = np.argsort(line << np.uint64(52) | hashes >> np.uint64(12))
    line, word = line[order], hashes[order]
    keep = np.concatenate(([True], (word[1:] != word[:-1]) | (line[1:] != line[:-1])))
    line, word = line[keep], word[keep]
    starts, sizes = grouped_runs(line)
    long = sizes >= least
    keep = np.repeat(long, sizes)
    line, word, sizes = line[keep], word[keep], sizes[long]
    starts = np.cumsum(sizes) - sizes
    if not len(sizes):
        return {}
    keys = np.sort(line << np.uint64(52) | keys_of(word, rank)) & np.uint64((1 << 52) - 1)
    prefix = sizes - (sizes * percent + 99) // 100 + 1
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    # Parity bitmaps: two sets differ in at least as many words as their bitmaps in bits.
    bit, half = np.uint64(1) << (word >> np.uint64(44) & np.uint64(63)), word >> np.uint64(50) & np.uint64(1)
    even, odd = (np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), starts) for k in (0, 1))
    low, high = (np.add.reduceat(mix64(word ^ np.uint64(salt)), starts) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
    return {"at": line[starts].astype(np.int64), "size": sizes, "prefix": prefix, "keys": keys[place < np.repeat(prefix, sizes)], "even": even, "odd": odd, "low": low, "high": high}


def only(rows: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
    """Some of the sets."""
    return {k: v[np.repeat(keep, rows["prefix"])] if k == "keys" else v[keep] for k, v in rows.items()}


def firsts_of(low, high, doc, line) -> np.ndarray:
    """For each set the index of its first occurrence among equal ones."""
    order = np.lexsort((line, doc, high, low))
    new = np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def line_sets(docs: DataFrame, sketch: np.ndarray, least: int, percent: int, chunk_bytes: int = 6_000_000) -> DataFrame:
    """Packed rows of sets that are different within a row, and the lines (gone_doc, gone_line) that repeat one of these."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks_of(sketch))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, held, size, chunk = shared.value, [], 0, TaskContext.get().partitionId() << 32

        def chunk_of() -> pa.RecordBatch:
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            first = firsts_of(rows["low"], rows["high"], rows["doc"], rows["line"])
            stays = first == np.arange(len(first))
            later = ~stays & ((rows["doc"] != rows["doc"][first]) | (rows["line"] != rows["line"][first]))
            gone = {"gone_doc": rows["doc"][later], "gone_line": rows["line"][later]}
            return packed([{"chunk": chunk, "n": int(rows["prefix"][stays].sum()), **only(rows, stays), **gone}], PACKED)

        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            for texts in buffers(binary_list(batch.column(1))):
                buffer = b"\n".join(texts).lower()
                hashes, starts, _ = hashed_words(buffer)
                line = np.cumsum(np.frombuffer(buffer, np.uint8) == 10, dtype=np.int32)[starts] if buffer else np.zeros(0, np.int32)
                sizes = np.array([t.count(b"\n") + 1 for t in texts])
                doc = np.repeat(ids[at : at + len(texts)], sizes)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at += len(texts)
                for first in range(0, len(doc), 4096):
                    a, b = np.searchsorted(line, [first, first + 4096])
                    if b > a and (found := sets_of(hashes[a:b], (line[a:b] - first).astype(np.uint64), rank, least, percent)):
                        place = found.pop("at") + first
                        held.append({"doc": doc[place], "line": number[place], **found})
                        size += sum(x.nbytes for x in found.values())
                        if size >= chunk_bytes:
                            yield chunk_of()
                            held, size, chunk = [], 0, chunk + 1
        if held:
            yield chunk_of()

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, PACKED)


def repeats(lines: DataFrame, buckets: int) -> DataFrame:
    """(chunk, place, doc, line), packed: the sets of a row that occur earlier in another one."""
    schema = "bucket long, chunk long, place binary, low binary, high binary, doc binary, line binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in unpacked(batch, ["chunk", "doc", "line", "low", "high"]):
                bucket = (row["high"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                starts, sizes = grouped_runs(bucket[order])
                parts = [order[s : s + z] for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)]
                if parts:
                    yield packed([{"bucket": int(bucket[p[0]]), "chunk": row["chunk"], "place": p, **{k: row[k][p] for k in ("low", "high", "doc", "line")}} for p in parts], schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucket_rows(batches, ["bucket", "chunk", "place", "low", "high", "doc", "line"]):
            chunk = np.repeat([r["chunk"] for r in rows], [len(r["doc"]) for r in rows])
            place, low, high, doc, line = (np.concatenate([r[k] for r in rows]) for k in ("place", "low", "high", "doc", "line"))
            first = firsts_of(low, high, doc, line)
            later = np.flatnonzero((doc != doc[first]) | (line != line[first]))
            later = later[np.argsort(chunk[later], kind="stable")]
            starts, sizes = grouped_runs(chunk[later])
            parts = [later[s : s + z] for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)]
            if parts:
                yield packed([{"chunk": int(chunk[p[0]]), "place": place[p], "doc": doc[p], "line": line[p]} for p in parts], "chunk long, place binary, doc binary, line binary")

    dealt = lines.select("chunk", "doc", "line", "low", "high").mapInArrow(deal, schema)
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(find, "chunk long, place binary, doc binary, line binary")


def bucket_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """The rows of each value of the first column, by which they come sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in unpacked(batch, names):
            if held and row[names[0]] != held[0][names[0]]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def places_of(keys: np.ndarray, owner: np.ndarray, hot: dict[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where prefix words go: index into ``keys``, bucket, group (a word, or a word and a pair of blocks), own block of the group.

    hot: blocks that the words of a counter are dealt out in; owner: a hash of the line that picks its block.
    """
    index, low, high = np.arange(len(keys)), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    own = low
    if hot:
        cells = np.array(sorted(hot))
        cell = cell_of(keys)
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        times = np.where(cells[at] == cell, np.array([hot[c] for c in cells.tolist()])[at], 1)
        index = np.repeat(index, times)
        other = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
        own = (owner[index] % times[index].astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(own, other), np.maximum(own, other)
    group = mix64(keys[index] + (low * 1_000_003 + high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return index, (group % np.uint64(buckets)).astype(np.int64), group, np.where(low == high, 0, 1 + (own == high))


def owner_of(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(mix64(doc.astype(np.uint64)) + line.astype(np.uint64))


def entries(lines: DataFrame, dups: DataFrame, hot: dict[int, int], buckets: int, asked: np.ndarray | None = None) -> DataFrame:
    """The prefix words of all first occurrences, packed by bucket; asked: a map of the counters of words that matter."""
    shared = lines.sparkSession.sparkContext.broadcast((hot, asked))  # few counters are hot: at most all words / HOT
    names = ["doc", "line", "size", "prefix", "keys", "even", "odd"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, asked = shared.value
        for rows in bucket_rows(batches, ["chunk", "kind", "place", *names]):
            x = {k: rows[0][k] for k in names}
            keep = np.ones(len(x["doc"]), bool)
            for r in rows[1:]:
                keep[r["place"]] = False
            x = only(x, keep)
            ends = np.cumsum(x["prefix"], dtype=np.int64)
            row = np.repeat(np.arange(len(ends)), x["prefix"])
            pos = np.arange(len(row)) - (ends - x["prefix"])[row]
            keys = x["keys"]
            if asked is not None:
                some = asked[cell_of(keys)]
                keys, row, pos = keys[some], row[some], pos[some]
            index, bucket, group, block = places_of(keys, owner_of(x["doc"], x["line"])[row], hot, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            index, bucket, group, block = index[order], bucket[order], group[order], block[order]
            row, pos = row[index], pos[index]
            starts, sizes = grouped_runs(bucket)
            for at in range(0, len(starts), 64):
                out = []
                for s, z in zip(starts[at : at + 64].tolist(), sizes[at : at + 64].tolist(), strict=True):
                    r = row[s : s + z]
                    out.append({"bucket": int(bucket[s]), "kind": 0, "key": group[s : s + z], "block": block[s : s + z], "pos": pos[s : s + z], **{k: x[k][r] for k in ("doc", "line", "size", "even", "odd")}})
                yield packed(out, ENTRIES)

    none = [F.lit(None).cast("binary").alias(k) for k in names]
    rows = lines.select("chunk", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("place"), *names).union(dups.select("chunk", F.lit(1).alias("kind"), "place", *none))
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(make, ENTRIES)


def candidates(rows: DataFrame, percent: int, buckets: int, most: int | None, small: int = 64) -> DataFrame:
    """Packed entries -> pairs (a, b) of a line and an earlier one (doc, line each) that pass all filters, and whether b may have more.

    A group of more than ``small`` entries gives each ``most`` earlier partners.  Where ``most`` is None, rows of kind 1 name the lines
    whose partners are all asked for, and nothing else comes out.
    """
    out_schema = "a_doc long, a_line int, b_doc long, b_line int, more boolean"
    names = ["bucket", "kind", "key", "block", "doc", "line", "size", "pos", "even", "odd"]

    def fits(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs pass, cheap filters first; index arrays of the same size."""
        n, m = x["size"][i], x["size"][j]
        at = np.flatnonzero((100 + percent) * np.minimum(n - x["pos"][i], m - x["pos"][j]) >= percent * (n + m))
        i, j, n, m = i[at], j[at], n[at], m[at]
        differ = sum(np.bitwise_count(x[k][i] ^ x[k][j]).astype(np.int64) for k in ("even", "odd"))
        ok = ((100 + percent) * (n + m - differ) >= 2 * percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        at, i, j = at[ok], i[ok], j[ok]
        ok = (x["block"][i] == 0) | (x["block"][i] != x["block"][j])
        return at[ok & ((x["doc"][i] != x["doc"][j]) | (x["line"][i] != x["line"][j]))]

    def earlier(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (x["doc"][i] < x["doc"][j]) | (x["doc"][i] == x["doc"][j]) & (x["line"][i] < x["line"][j])

    def pairs_of(x: dict, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """x sorted by key, then size."""
        starts, sizes = grouped_runs(x["key"])
        place = np.arange(len(x["key"])) - np.repeat(starts, sizes)
        few = np.flatnonzero(np.repeat(sizes, sizes) <= small)
        for d in range(1, small):  # all pairs of small groups, by distance; beyond a shorter set there are only shorter ones
            few = few[place[few] >= d]
            few = few[100 * x["size"][few - d] >= percent * x["size"][few]]
            if not len(few):
                break
            at = fits(x, few - d, few)
            i, j = few[at] - d, few[at]
            early = earlier(x, i, j)
            i, j = np.where(early, i, j), np.where(early, j, i)
            if wanted is not None:
                i, j = i[wanted[j]], j[wanted[j]]
            yield i, j, np.zeros(len(i), bool)
        for s, z in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            n = x["size"][s : s + z]
            rows = np.arange(s, s + z) if wanted is None else s + np.flatnonzero(wanted[s : s + z])
            for at in range(0, len(rows), 256):
                j = rows[at : at + 256]
                count = np.zeros(len(j), np.int64)
                own = x["size"][j]
                first, last = np.searchsorted(n, -(-percent * own.min() // 100)), np.searchsorted(n, 100 * own.max() // percent, "right")
                for low in range(s + int(first), s + int(last), 4096):
                    i = np.arange(low, min(low + 4096, s + int(last)))
                    r, c = np.nonzero(np.broadcast_to(True if most is None else (count < most)[:, None], (len(j), len(i))))
                    good = fits(x, i[c], j[r])
                    r, c = r[good], c[good]
                    good = earlier(x, i[c], j[r])
                    r, c = r[good], c[good]
                    if most is None:
                        yield i[c], j[r], np.zeros(len(r), bool)
                        continue
                    nth = np.arange(len(r)) - np.searchsorted(r, r) + count[r]
                    count += np.bincount(r, minlength=len(j))
                    take = nth < most
                    yield i[c[take]], j[r[take]], np.ones(int(take.sum()), bool)
                    if (count >= most).all():
                        break

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in bucket_rows(batches, names):
            asked = [r for r in found if r["kind"]]
            if most is None and not asked:
                continue
            found = [r for r in found if not r["kind"]]
            if not found:
                continue
            x = {k: np.concatenate([r[k] for r in found]) for k in names[2:]}
            # Sorted by group and size at once: 48 bits of the group's hash are enough, since candidates are verified.
            x["key"] = x["key"] >> np.uint64(16) << np.uint64(16)
            order = np.argsort(x["key"] | np.minimum(x["size"], 65535).astype(np.uint64))
            x = {k: v[order] for k, v in x.items()}
            x["size"] = x["size"].astype(np.int64)
            wanted = None
            if most is None:
                wanted = np.isin(owner_of(x["doc"], x["line"]), owner_of(*(np.concatenate([r[k] for r in asked]) for k in ("doc", "line"))))
            for i, j, more in pairs_of(x, wanted):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x["doc"][i]), pa.array(x["line"][i]), pa.array(x["doc"][j]), pa.array(x["line"][j]), pa.array(more)], ["a_doc", "a_line", "b_doc", "b_line", "more"])

    found = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(make, out_schema)
    return found.groupBy("a_doc", "a_line", "b_doc", "b_line").agg(F.max("more").alias("more"))


def lines_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, line, words) of the lines asked for by (doc, line); texts move once, and only these lines come back."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, number, words = [], [], []
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), binary_list(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                for k in asked:
                    if k < len(lines):
                        doc.append(doc_id)
                        number.append(k)
                        words.append(lines[k].lower())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(words, pa.binary())], ["doc", "line", "words"])

    grouped = asked.groupBy("doc").agg(F.collect_set("line").alias("asked"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return texts.join(grouped, "doc").select("doc", "text", "asked").mapInArrow(find, "doc long, line int, words binary")


def similar(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The lines b (doc, line) of pairs whose whole sets of words are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = {*a.split()}, {*b.split()}
                both = len(x & y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc", "line"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: lines.select(F.col("doc").alias(f"{k}_doc"), F.col("line").alias(f"{k}_line"), F.col("words").alias(k))
    joined = pairs.join(side("a"), ["a_doc", "a_line"]).join(side("b"), ["b_doc", "b_line"])
    return joined.select("b_doc", "b_line", "a", "b").mapInArrow(check, "doc long, line int").distinct()


def both_sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).union(pairs.select("b_doc", "b_line")).distinct()


def cells_of(lines: DataFrame) -> np.ndarray:
    """A map of the counters that the words of some lines fall on."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS)
        for batch in batches:
            total[cell_of(hashed_words(b" ".join(batch.column(0).to_pylist()))[0])] = 1
        yield blocks_of(total)

    return sketch_of(lines.select("words").mapInArrow(make, "block long, n array<double>")) > 0


def questions(lines: DataFrame, sketch: np.ndarray, hot: dict[int, int], buckets: int) -> DataFrame:
    """Rows of kind 1 that name lines (doc, line, words) in all buckets of their words."""
    shared = lines.sparkSession.sparkContext.broadcast((ranks_of(sketch), hot))
    empty = {k: np.zeros(0) for k in ("key", "block", "size", "pos", "even", "odd")}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot = shared.value
        for batch in batches:
            for doc, line, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.unique(keys_of(hashed_words(words)[0], rank))
                doc, line = np.array([doc]), np.array([line])
                places = np.unique(places_of(keys, np.repeat(owner_of(doc, line), len(keys)), hot, buckets)[1])
                if len(places):
                    yield packed([{"bucket": k, "kind": 1, "doc": doc, "line": line, **empty} for k in places.tolist()], ENTRIES)

    return lines.select("doc", "line", "words").mapInArrow(make, ENTRIES)


def hot_cells(lines: DataFrame, total: int, hot: int) -> dict[int, int]:
    """Blocks for the counters on which more than ``hot`` prefix words fall."""
    if total <= hot:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for batch in batches:
            for row in unpacked(batch, ["keys"]):
                sums += np.bincount(cell_of(row["keys"]), minlength=CELLS)
        yield blocks_of(sums)

    sketch = sketch_of(lines.select("keys").mapInArrow(count, "block long, n array<double>"))
    return {int(c): int(sketch[c] // hot) + 1 for c in np.flatnonzero(sketch > hot)}


def spread(rows: DataFrame, doc: str, line: str) -> DataFrame:
    """Packed lines as rows (doc, line)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in unpacked(batch, [doc, line]):
                yield pa.RecordBatch.from_arrays([pa.array(row[doc]), pa.array(row[line])], ["doc", "line"])

    return rows.select(doc, line).mapInArrow(make, "doc long, line int")


def removed_lines(spark: SparkSession, docs: DataFrame, least: int = 1, percent: int = 80, most: int = 4, hot: int = 50_000) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, line_no) of the lines to remove; line numbers start at 0."""
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    sketch = frequencies(docs)
    lines = scratch.save(line_sets(docs, sketch, max(1, least), percent), "lines")
    total = lines.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(spark, total, 500_000)
    dups = scratch.save(repeats(lines, buckets), "repeats")
    blocks = hot_cells(lines, total, hot)
    pairs = scratch.save(candidates(entries(lines, dups, blocks, buckets), percent, buckets, most), "pairs")
    found = scratch.save(lines_of(docs, both_sides(pairs)), "words")
    matched = scratch.save(similar(pairs, found, percent), "matched")
    open_lines = pairs.where("more").select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")).distinct().join(matched, ["doc", "line"], "left_anti")
    asked = scratch.save(found.join(open_lines, ["doc", "line"], "left_semi"), "open")
    if asked.take(1):
        # Lines with many candidates of which the first few did not match: all their partners.
        again = entries(lines, dups, blocks, buckets, cells_of(asked)).union(questions(asked, sketch, blocks, buckets))
        rest = scratch.save(candidates(again, percent, buckets, None).join(pairs, ["a_doc", "a_line", "b_doc", "b_line"], "left_anti"), "rest")
        matched = matched.union(similar(rest, scratch.save(lines_of(docs, both_sides(rest)), "words"), percent))
    gone = spread(lines, "gone_doc", "gone_line").union(spread(dups, "doc", "line")).union(matched).distinct()
    gone = scratch.save(gone.select(F.col("doc").alias("doc_id"), F.col("line").alias("line_no")), "gone")
    scratch.drop(lines)
    return gone


def deduplicate(spark: SparkSession, docs: DataFrame, least: int = 1, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns with the lines left in text, and n_lines, n_removed."""
    docs = keep_apart(docs, ["n_lines", "n_removed"])
    lists = removed_lines(spark, docs, least, percent).groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = [], [], []
            for text, gone in zip(binary_list(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = text.split(b"\n") if text is not None else []
                gone = {*(gone or ())}
                left = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
                texts.append(b"\n".join(left) if text is not None else None)
                n.append(len(lines))
                removed.append(len(lines) - len(left))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_removed"])

    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no input column is called like the list
    joined = docs.toDF(*names).join(lists, F.col(names[docs.columns.index("doc_id")]) == lists["doc_id"], "left").drop("doc_id")
    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *extra]))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
