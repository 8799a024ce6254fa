"""Removal of repeated byte strings by suffix arrays that are built in shards with induced sorting.

A string of ``length`` bytes of a text goes if it also starts in a document with a smaller doc_id; all bytes that such strings
cover are removed.  Texts are UTF-8 bytes; matches never cross documents.

1. Equal texts are merged: only the smallest doc_id's goes on, all of a later copy is covered (if it has ``length`` bytes).
2. The minimiser of a window of ``length`` bytes is its ``anchor``-byte string of least hash, the leftmost of equals; equal
   windows have equal minimisers at equal places.  A window thus also has half of what may stand beside its minimiser: the bytes
   before it if it lies in the window's second half, those after it if in the first.  Minimisers with these bytes, packed in arrays
   by task and bucket, are counted; only those in two documents or more can have a repeated window.
3. A run of windows with one minimiser, as far as they have bytes that are repeated with it, is cut out and sent to the shard of
   the minimiser, so that all equal windows meet in one shard.  Equal cuts are merged there.  What a task has for a shard goes in
   few rows.
4. A shard's cuts are joined into one string, its suffix array is built by induced sorting (suffix_array.py), and the permuted common
   prefixes give the groups of windows that are equal.  A window goes if its group's smallest doc_id is smaller
   than its own.
5. Runs of windows that go are brought back to their documents, united, and cut from the texts.

Results, one row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.  Null text is empty.  Rows that repeat a doc_id
are one document: equal texts under one doc_id are not removed for each other.  Rows with a null doc_id stay whole and remove nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary_list, grouped_runs, mix64
from .suffix_array import permuted_common_prefixes, suffix_array

PIECE = 3_000_000
HELD = 32_000_000  # bytes of cuts that a task deals out at once


def pieces(doc_ids: list[int], texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Texts in buffers of about PIECE bytes: doc_ids, offsets in their texts, ends in the buffer, and the buffer.

    A longer text is cut into parts that overlap by length - 1 bytes, so every window is in one of them.
    """
    ids, offsets, parts, size = [], [], [], 0

    def made():
        return np.array(ids, np.int64), np.array(offsets, np.int64), np.cumsum([len(p) for p in parts]), b"".join(parts)

    for doc_id, text in zip(doc_ids, texts, strict=True):
        for at in range(0, max(0, len(text) - length) + 1, PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > PIECE and parts:
                yield made()
                ids, offsets, parts, size = [], [], [], 0
            ids.append(doc_id)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield made()


def cuts(buffer: bytes, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser on one side: text, first window (in the buffer), number of windows, the minimiser's hash,
    and the hash of the minimiser with what all these windows have before it (or after it, if it lies in their first half)."""
    n = len(buffer)
    words = np.ndarray((n - 7,), "<u8", buffer, strides=(1,))
    m = n - anchor + 1
    h = np.zeros(m, np.uint64)
    for at in [*range(0, anchor - 7, 8), anchor - 8]:
        h = (h ^ words[at : at + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(23)
    least = (h >> bits << bits) | np.arange(m, dtype=np.uint64)
    wide, width = length - anchor + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    at = (least & np.uint64((1 << 23) - 1)).astype(np.int32)  # the minimiser of each of n - length + 1 windows
    side = wide // 2
    late = at - np.arange(len(at), dtype=np.int32) >= side
    ok = np.ones(n - length + 1, bool)
    for k in range(1, length):
        crossing = ends[:-1] - k
        ok[crossing[(crossing >= 0) & (crossing < len(ok))]] = False
    new = np.ones(len(ok), bool)
    new[1:] = (at[1:] != at[:-1]) | (late[1:] != late[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new & ok)
    stops = np.flatnonzero(np.append((new | ~ok)[1:], True) & ok) + 1
    late, at = late[starts], at[starts]
    key, first = late.astype(np.uint64), np.where(late, at - side, at)
    for k in [*range(0, anchor + side - 7, 8), anchor + side - 8]:
        key = (key ^ words[first + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.searchsorted(ends, starts, "right"), starts, stops - starts, mix64(h[at]), mix64(key)


def packed(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if v and isinstance(v[0], bytes) else pa.int64()) for k, v in columns.items()})


def column(batch: pa.RecordBatch, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def anchors(texts: DataFrame, length: int, anchor: int, buckets: int) -> DataFrame:
    """(batch, bucket, doc, n, h): keys (of ``cuts``) of a buffer's texts that fall in a bucket; n of each doc, in its order."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, _, ends, buffer in pieces(batch.column(0).to_pylist(), binary_list(batch.column(1)), length):
                text, _, _, _, h = cuts(buffer, ends, length, anchor)
                bucket = (h % np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                text, h, bucket = text[order], (h[order] >> np.uint64(32)).astype(np.uint32), bucket[order]
                starts, sizes = grouped_runs(bucket)
                out: dict[str, list] = {"batch": [], "bucket": [], "doc": [], "n": [], "h": []}
                for s, z in zip(starts.tolist(), sizes.tolist(), strict=True):
                    at, n = grouped_runs(text[s : s + z])
                    out["batch"].append(number)
                    out["bucket"].append(int(bucket[s]))
                    out["doc"].append(ids[text[s + at]].tobytes())
                    out["n"].append(n.astype(np.uint32).tobytes())
                    out["h"].append(h[s : s + z].tobytes())
                number += 1
                yield packed(out)

    return texts.select("doc_id", "text").mapInArrow(make, "batch long, bucket long, doc binary, n binary, h binary")


def repeated(rows: DataFrame) -> DataFrame:
    """rows as of ``anchors``, all of a bucket in one task -> (batch, bucket, doc, n, h) of the keys in two texts or more."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for batch in batches:
            for number, bucket, doc, n, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column(batch, "doc", np.int64), column(batch, "n", np.uint32), column(batch, "h", np.uint32), strict=True):
                groups.setdefault(bucket, []).append((number, doc, n, h))
        for bucket, found in groups.items():
            h = np.concatenate([x[3] for x in found])
            doc = np.concatenate([np.repeat(x[1], x[2]) for x in found])
            order = np.argsort(h, kind="stable")
            starts, sizes = grouped_runs(h[order])
            sorted_doc = doc[order]
            shared = np.empty(len(h), bool)
            shared[order] = np.repeat(np.minimum.reduceat(sorted_doc, starts) != np.maximum.reduceat(sorted_doc, starts), sizes)
            out: dict[str, list] = {"batch": [], "bucket": [], "doc": [], "n": [], "h": []}
            at = 0
            for number, _, _, own in found:
                keep = shared[at : at + len(own)]
                d = doc[at : at + len(own)][keep]
                at += len(own)
                if len(d):
                    s, z = grouped_runs(d)
                    for name, value in zip(out, (number, bucket, d[s].tobytes(), z.astype(np.uint32).tobytes(), own[keep].tobytes()), strict=True):
                        out[name].append(value)
            if out["batch"]:
                yield packed(out)

    return rows.mapInArrow(make, "batch long, bucket long, doc binary, n binary, h binary")


def by_document(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of all buckets of a batch, in one task -> (id, shared): a document's repeated keys as bucket and hash."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for batch in batches:
            for number, bucket, doc, n, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column(batch, "doc", np.int64), column(batch, "n", np.uint32), column(batch, "h", np.uint32), strict=True):
                groups.setdefault(number, []).append((np.repeat(doc, n), np.uint64(bucket) << np.uint64(32) | h.astype(np.uint64)))
        for found in groups.values():
            doc, key = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(doc, kind="stable")
            doc, key = doc[order], key[order]
            starts, sizes = grouped_runs(doc)
            yield pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.array([np.unique(key[s : s + z]).tobytes() for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)], pa.binary())], ["id", "shared"])

    return rows.mapInArrow(make, "id long, shared binary")


def cut_out(texts: DataFrame, length: int, anchor: int, buckets: int, shards: int) -> DataFrame:
    """texts (doc_id, text, shared) -> (shard, doc, start, n, bytes): the cuts around repeated minimisers, packed by shard."""

    def gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        shard, doc, start, n, raw = (np.concatenate(x) for x in zip(*held, strict=True))
        size = n + length - 1
        order = np.argsort(shard, kind="stable")
        doc, start, n, size, at = doc[order], start[order], n[order], size[order], (np.cumsum(size) - size)[order]
        runs, sizes = grouped_runs(shard[order])
        out: dict[str, list] = {"shard": shard[order[runs]].tolist(), "doc": [], "start": [], "n": [], "bytes": []}
        for s, z in zip(runs.tolist(), sizes.tolist(), strict=True):
            row = (doc[s : s + z], start[s : s + z], n[s : s + z].astype(np.uint32), gathered(raw, at[s : s + z], size[s : s + z]))
            for name, value in zip(("doc", "start", "n", "bytes"), row, strict=True):
                out[name].append(value.tobytes())
        return packed(out)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            doc_ids, contents, keys = batch.column(0).to_pylist(), binary_list(batch.column(1)), column(batch, "shared", np.uint64)
            own: dict[int, np.ndarray] = {}
            for d, k in zip(doc_ids, keys, strict=True):
                own[d] = np.union1d(own[d], k) if d in own else k
            for ids, offsets, ends, buffer in pieces(doc_ids, contents, length):
                text, start, n, h, key = cuts(buffer, ends, length, anchor)
                key = (key % np.uint64(buckets)) << np.uint64(32) | key >> np.uint64(32)
                keep = np.zeros(len(h), bool)
                at, sizes = grouped_runs(text)
                for a, z in zip(at.tolist(), sizes.tolist(), strict=True):
                    known, asked = own[int(ids[text[a]])], key[a : a + z]
                    if len(known):
                        keep[a : a + z] = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
                text, start, n, h = text[keep], start[keep], n[keep], h[keep]
                if not len(text):
                    continue
                # Both sides of a minimiser are one cut.
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (text[1:] != text[:-1]))))
                text, start, n, h = text[new], start[new], np.add.reduceat(n, new), h[new]
                first = ends[text] - np.diff(ends, prepend=0)[text]
                held.append(((mix64(h) % np.uint64(shards)).astype(np.uint32), ids[text], start - first + offsets[text], n, gathered(np.frombuffer(buffer, np.uint8), start, n + length - 1)))
                total += len(held[-1][-1])
                if total >= HELD:
                    yield dealt(held)
                    held, total = [], 0
        if held:
            yield dealt(held)

    return texts.mapInArrow(make, "shard long, doc binary, start binary, n binary, bytes binary")


def least_documents(strings: list[bytes], documents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings, each with its smallest document -> of each window of each string (in order) the smallest document
    that has an equal window; and where each string's windows begin."""
    size = np.array([len(x) for x in strings])
    t = np.zeros(int(size.sum()) + len(strings) + 1, np.uint16)
    at = np.cumsum(size + 1) - size - 1
    joined = b"\x00".join(strings)
    t[: len(joined)] = np.frombuffer(joined, np.uint8).astype(np.uint16) + np.uint16(2)
    t[at[1:] - 1] = 1  # between strings
    t[len(joined)] = 1
    order = suffix_array(t, 258)
    common = permuted_common_prefixes(t, order, at, size - length + 1, length)
    window = np.full(len(t), -1, np.int64)  # the string of each position where a window starts
    index = np.repeat(at, size - length + 1) + np.arange((size - length + 1).sum()) - np.repeat(np.cumsum(size - length + 1) - (size - length + 1), size - length + 1)
    window[index] = np.repeat(np.arange(len(strings)), size - length + 1)
    order = order[window[order] >= 0]  # equal windows stand together
    new = common[order] < length
    new[0] = True
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(documents[window[order]], starts)
    out = np.empty(len(t), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return out[index], np.cumsum(size - length + 1) - (size - length + 1)


def removed(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Rows of ``cut_out``, all of a shard in one task -> (part, doc, start, n): runs of windows that go."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for batch in batches:
            for shard, doc, start, n, raw in zip(batch.column(0).to_pylist(), column(batch, "doc", np.int64), column(batch, "start", np.int64), column(batch, "n", np.uint32), batch.column(4).to_pylist(), strict=True):
                groups.setdefault(shard, []).append((doc, start, n, raw))
        for shard in list(groups):
            found = groups.pop(shard)
            number: dict[bytes, int] = {}
            which = []
            for _, _, n, raw in found:
                ends = np.cumsum(n.astype(np.int64) + length - 1).tolist()
                which += [number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends, strict=False)]
            doc, start, n = (np.concatenate([x[k] for x in found]) for k in range(3))
            del found
            which, n = np.array(which), n.astype(np.int64)
            documents = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(documents, which, doc)
            least, first = least_documents(list(number), documents, length)
            for a in range(0, len(doc), 100_000):
                d, s, z, f = doc[a : a + 100_000], start[a : a + 100_000], n[a : a + 100_000], first[which[a : a + 100_000]]
                row = np.repeat(np.arange(len(d)), z)
                place = np.arange(len(row)) - np.repeat(np.cumsum(z) - z, z)
                gone = np.flatnonzero(least[f[row] + place] < d[row])
                if not len(gone):
                    continue
                new = np.ones(len(gone), bool)
                new[1:] = (gone[1:] != gone[:-1] + 1) | (row[gone[1:]] != row[gone[:-1]])
                at = np.flatnonzero(new)
                run = np.diff(np.append(at, len(gone)))
                d, s = d[row[gone[at]]], s[row[gone[at]]] + place[gone[at]]
                part = (mix64(d.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                d, s, run, part = d[order], s[order], run[order], part[order]
                b, z = grouped_runs(part)
                yield packed({"part": part[b].tolist(), **{k: [x[i : i + j].tobytes() for i, j in zip(b.tolist(), z.tolist(), strict=True)] for k, x in (("doc", d), ("start", s), ("n", run))}})

    return rows.mapInArrow(make, "part long, doc binary, start binary, n binary")


def spans(rows: DataFrame, length: int) -> DataFrame:
    """Rows of ``removed``, all of a part in one task -> (id, spans): a document's removed spans as begin and end."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for batch in batches:
            for part, *x in zip(batch.column(0).to_pylist(), *(column(batch, k, np.int64) for k in ("doc", "start", "n")), strict=True):
                groups.setdefault(part, []).append(x)
        for part in list(groups):
            doc, start, n = (np.concatenate(x) for x in zip(*groups.pop(part), strict=True))
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], (start + n + length - 1)[order]
            far, _ = grouped_runs(doc)
            base = np.repeat(np.arange(len(far)), np.diff(np.append(far, len(doc)))) << 40  # keeps documents apart in the running maximum
            reached = np.maximum.accumulate(base + end)
            new = np.ones(len(doc), bool)
            new[1:] = (base + start)[1:] > reached[:-1]
            at = np.flatnonzero(new)
            stop = (reached - base)[np.append(at[1:], len(doc)) - 1]
            pairs = np.stack([start[at], stop], axis=1)
            s, z = grouped_runs(doc[at])
            yield pa.RecordBatch.from_arrays([pa.array(doc[at][s]), pa.array([pairs[i : i + j].tobytes() for i, j in zip(s.tolist(), z.tolist(), strict=True)], pa.binary())], ["id", "spans"])

    return rows.mapInArrow(make, "id long, spans binary")


def digest(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text, spans) -> (id, n_removed, n_spans, kept_sha256, kept)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(binary_list(batch.column(1)), column(batch, "spans", np.int64), strict=True):
                begin, end = pairs.reshape(-1, 2).T.tolist()
                kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))
                out.append((len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["id", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(make, "id long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(spark: SparkSession, scratch: Scratch, docs: DataFrame, length: int, anchor: int, shard_bytes: int = 3_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> all rows' digests, the merged texts, and the removed spans (id, spans) of these."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    named = scratch.save(named, "digests")
    first = named.where(F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first"))
    # Texts and the marks of first ones meet by doc_id in one exchange; a mark stands before its text.
    marks = first.select(F.col("first").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("sha"))
    rows = docs.where(f"doc_id is not null and octet_length(text) >= {length}").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("sha")).union(marks)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shas = None, set()
        for batch in batches:
            keep = []
            for doc_id, text, sha in zip(batch.column(0).to_pylist(), binary_list(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if doc_id != now:
                    now, shas = doc_id, set()
                if text is None:
                    shas.add(sha)
                    keep.append(False)
                else:
                    known = hashlib.sha256(text).hexdigest()
                    keep.append(known in shas)
                    shas.discard(known)
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep, pa.bool_()))

    kept = rows.repartition(n, "doc_id").sortWithinPartitions("doc_id", F.col("text").asc_nulls_first()).mapInArrow(marked, "doc_id long, text string")
    path, name = scratch.path("texts"), f"sieveline_{scratch.root[-32:]}"
    # Bucketed by doc_id, so that neither join below moves the texts again.
    kept.write.bucketBy(n, "doc_id").option("compression", "zstd").option("path", path).saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # leaves the catalog as it was; the files, which texts goes on reading, are the scratch folder's
    found = scratch.save(repeated(anchors(texts, length, anchor, buckets := 4 * n).repartition(n, "bucket")), "repeated")
    shared = scratch.save(by_document(found.repartition(n, "batch"), buckets), "shared")
    total = shared.agg(F.sum(F.octet_length("shared") / 8)).first()[0] or 0
    shards = max(n, int(total * length / shard_bytes) + 1)
    merged = shared.groupBy("id").agg(F.expr("collect_list(shared)").alias("x")).select("id", F.expr("aggregate(x, X'', (a, b) -> concat(a, b))").alias("shared"))
    joined = texts.join(merged, texts["doc_id"] == merged["id"]).select("doc_id", "text", "shared")
    cut = cut_out(with_sorted(joined), length, anchor, buckets, shards)
    gone = removed(cut.repartition(max(n, shards // 2), "shard"), length, n)
    return named, texts, scratch.save(spans(scratch.save(gone, "gone").repartition(n, "part"), length), "spans")


def with_sorted(joined: DataFrame) -> DataFrame:
    """Sorts each document's packed minimisers (a long text brings them in several parts)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.unique(x).tobytes() for x in column(batch, "shared", np.uint64)], pa.binary())], ["doc_id", "text", "shared"])

    return joined.mapInArrow(make, "doc_id long, text string, shared binary")


def deduplicate(spark: SparkSession, docs: DataFrame, length: int = 50, anchor: int = 16) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    scratch = Scratch(spark)
    named, texts, found = repeated_spans(spark, scratch, docs.select("doc_id", "text"), length, anchor)
    done = digest(texts.join(found, texts["doc_id"] == found["id"]).select("doc_id", "text", "spans"))
    first = named.where(F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first"))
    rows = named.join(first, "sha", "left").join(done, F.col("doc_id") == F.col("id"), "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    return rows.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"))
