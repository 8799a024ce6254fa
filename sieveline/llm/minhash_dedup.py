"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

1. A document's set is its distinct k-word shingles (words: runs of anything but ASCII white space, A-Z in lower
   case), or its whole word sequence if that is shorter; sets are handled as 64-bit hashes of shingles.  Equal word
   sequences are joined at once; what follows sees one row per distinct sequence.
2. A signature has ``symbols`` symbols of ``8`` bits, each of the least hash under a permutation.  It is split into
   ``chunks``; two signatures that differ in at most ``chunks * (errors + 1) - 1`` symbols agree, by the pigeonhole
   principle, in some chunk but for ``errors`` symbols.  So each chunk gives a key for each choice of ``errors``
   symbols left out, and all pairs under that distance share a key.  (120 symbols in 20 chunks of 6 with one error:
   all pairs up to distance 39; a pair of similarity 0.8 shares no key with probability 5e-10.)
3. Only components are asked for, so pairs within a group are not all made.  First each row is compared with the
   nearest of its keys' centres; then rows that keys hold together are compared as far as they are still in different
   components, nearest signatures first, until links join them.
4. Pairs within ``reach`` symbols (6 standard deviations beyond the mean at the threshold) are confirmed on
   full sets: 100 * |A and B| >= percent * |A or B|.

Results, one row per input row: doc_id, n_shingles, component_id, kept.  Null, empty or blank text has
an empty set, is linked with nothing and kept.  Repeated rows (same doc_id) share a class.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, binary_list, components, hashes_of, mix64


def shingle_hashes(words: list[bytes], k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, or of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes_of(words, cache)
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x100000001B3) ^ h[i : i + n])
    return np.unique(out)


class Signer:
    """b-bit MinHash signatures of fixed permutations."""

    def __init__(self, symbols: int):
        random = np.random.default_rng(20_240_229)
        self.a = (random.integers(0, 2**32, symbols, np.uint32) | np.uint32(1))[None, :]
        self.b = random.integers(0, 2**32, symbols, np.uint32)[None, :]

    def __call__(self, hashes: np.ndarray) -> bytes:
        least = None
        for at in range(0, len(hashes), 2048):
            h = (hashes[at : at + 2048] >> np.uint64(32)).astype(np.uint32)[:, None] ^ self.b
            h *= self.a
            h ^= h >> np.uint32(15)
            m = h.min(axis=0)
            least = m if least is None else np.minimum(least, m)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def features(docs: DataFrame, k: int, symbols: int) -> DataFrame:
    """doc_id, seq (128-bit hash of the word sequence), n_shingles, sig."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache, sign = WordHashes(), Signer(symbols)
        for batch in batches:
            seqs, sizes, sigs = [], [], []
            for text in binary_list(batch.column(1)):
                words = (text or b"").lower().split()
                found = shingle_hashes(words, k, cache)
                seqs.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(found))
                sigs.append(sign(found) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "seq", "n_shingles", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, seq binary, n_shingles long, sig binary")


def chunk_keys(reps: DataFrame, symbols: int, chunks: int, errors: int) -> DataFrame:
    """(key, rep, n) for each chunk and each choice of symbols left out."""
    width = symbols // chunks
    choices = list(combinations(range(width), width - errors))
    if symbols % chunks or 8 * (width - errors) + (chunks * len(choices)).bit_length() > 63:
        raise ValueError("keys must fit in a long")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, chunks, width).astype(np.int64)
                keys = []
                for c in range(chunks):
                    for j, kept in enumerate(choices):
                        key = np.full(len(sig), c * len(choices) + j, np.int64)
                        for i in kept:
                            key = key << 8 | sig[:, c, i]
                        keys.append(key)
                rep, n = (np.tile(part.column(i).to_numpy(), len(keys)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(rep), pa.array(n)], ["key", "rep", "n"])

    return reps.select("rep", "n", "sig").mapInArrow(make, "key long, rep long, n long")


def groups_of(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[tuple[tuple, dict[str, np.ndarray], bool]]:
    """Rows sorted by their first ``keys`` columns -> (key, columns, whether the key goes on) in parts of at most ``limit`` rows."""
    held: dict[str, np.ndarray] = {}

    def columns(batch):
        out = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names) if n != "sig"}
        out["sig"] = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        return out

    names = None
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            new = columns(batch.slice(at, limit))
            names = names or batch.schema.names[:keys]
            held = {n: np.concatenate([held[n], x]) for n, x in new.items()} if held else new
            change = np.zeros(len(held["sig"]), bool)
            for n in names:
                change[1:] |= held[n][1:] != held[n][:-1]
            starts = [0, *np.flatnonzero(change).tolist()]
            for s, e in zip(starts, starts[1:], strict=False):
                yield tuple(held[n][s] for n in names), {n: x[s:e] for n, x in held.items()}, False
            held = {n: x[starts[-1] :] for n, x in held.items()}
            while len(held["sig"]) > limit:
                yield tuple(held[n][0] for n in names), {n: x[:limit] for n, x in held.items()}, True
                held = {n: x[limit:] for n, x in held.items()}
    if held:
        yield tuple(held[n][0] for n in names), held, False


def star_pairs(members: DataFrame, reach: int, percent: int, limit: int = 4096) -> DataFrame:
    """Each row with the nearest of its keys' centres, as pairs (a, b); a key's centre is, of its first rows, that nearest to their
    commonest symbols.

    The source that copies were made from agrees with its copies more than they do with each other, so it becomes the centre.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, centre, last = [], 0, None, None
        for key, rows, _ in groups_of(batches, 1, limit):
            sig, rep, n = rows["sig"], rows["rep"], rows["n"]
            if key != last:
                if len(rep) > 2:
                    cells = sig.astype(np.int64) + 256 * np.arange(sig.shape[1])
                    common = np.bincount(cells.ravel(), minlength=256 * sig.shape[1]).reshape(-1, 256).argmax(axis=1)
                    k = int((sig != common).sum(axis=1).argmin())
                else:
                    k = 0
                last, centre = key, (sig[k], rep[k], n[k])
            distance = (sig != centre[0]).sum(axis=1)
            near = (distance <= reach) & (rep != centre[1]) & (100 * np.minimum(n, centre[2]) >= percent * np.maximum(n, centre[2]))
            if near.any():
                found.append((rep[near], distance[near], np.full(near.sum(), centre[1])))
                size += len(found[-1][1])
                if size > 50_000:
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["rep", "d", "centre"])

    near = members.select("key", "rep", "n", "sig").mapInArrow(make, "rep long, d long, centre long")
    best = near.groupBy("rep").agg(F.min(F.struct("d", "centre")).alias("best"))
    return best.select(F.least("rep", "best.centre").alias("a"), F.greatest("rep", "best.centre").alias("b"))


def links_between(rows: DataFrame, k: int, reach: int, percent: int, limit: int = 1000) -> DataFrame:
    """rows (cluster, rep, n, comp, sig, text) -> confirmed links (a, b) that join the components of each cluster.

    A large cluster is dealt out as pairs of blocks of ``limit`` rows.  Within a pair of blocks, pairs from different components
    within reach are confirmed on full sets, nearest signatures first; once a link joins two components, other pairs
    between them are not looked at, so a task gives fewer links than it has rows.
    """
    order = Window.partitionBy("cluster").orderBy("rep")
    blocks = rows.select("cluster", "rep").withColumn("block", F.floor((F.row_number().over(order) - 1) / limit).cast("int"))
    blocks = blocks.withColumn("most", F.max("block").over(Window.partitionBy("cluster"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("most"))))
    keys = ["cluster", "low", "high"]
    dealt = blocks.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep").join(rows.drop("cluster"), "rep")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(found: dict[str, list], cache: WordHashes) -> tuple[list[int], list[int]]:
        block, rep, n = (np.array(found[x]) for x in ("block", "rep", "n"))
        sig = np.frombuffer(b"".join(found["sig"]), np.uint8).reshape(len(rep), -1)
        names, comp = np.unique(found["comp"], return_inverse=True)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        candidates = []
        for at in range(0, len(left), 64):
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + 64], right, indexing="ij"))
            maybe = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            maybe &= rep[i] < rep[j] if block.min() == block.max() else True
            i, j = i[maybe], j[maybe]
            d = (sig[i] != sig[j]).sum(axis=1).astype(np.int16)
            near = d <= reach
            candidates.append((d[near], i[near].astype(np.int32), j[near].astype(np.int32)))
        d, i, j = (np.concatenate(x) for x in zip(*candidates, strict=True))
        nearest = np.argsort(d, kind="stable")
        parent, sets = list(range(len(names))), {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def full(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_hashes(found["text"][x].lower().split(), k, cache)
            return sets[x]

        a, b = [], []
        for x, y in zip(i[nearest].tolist(), j[nearest].tolist(), strict=True):
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q:
                both = len(np.intersect1d(full(x), full(y), assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    parent[p] = q
                    a.append(int(rep[x]))
                    b.append(int(rep[y]))
        return a, b

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, found, last = WordHashes(), {}, None
        for batch in batches:  # sorted by the keys
            columns = {x: (binary_list(c) if x == "text" else c.to_pylist()) for x, c in zip(batch.schema.names, batch.columns, strict=True)}
            for r in range(batch.num_rows):
                now = tuple(columns[x][r] for x in keys)
                if now != last:
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in join(found, cache)], ["a", "b"])
                    last, found = now, {x: [] for x in columns}
                for x, c in columns.items():
                    found[x].append(c[r])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in join(found, cache)], ["a", "b"])

    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(make, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full shingle sets have a Jaccard similarity of percent / 100 at least."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        last, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), binary_list(batch.column(2)), binary_list(batch.column(3)), strict=True):
                if a != last:  # rows come sorted by a
                    last, x = a, shingle_hashes(ta.lower().split(), k, cache)
                y = shingle_hashes(tb.lower().split(), k, cache)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, symbols: int = 120, chunks: int = 20, errors: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    mean = symbols * (1 - percent / 100)
    reach = max(chunks * (errors + 1) - 1, int(mean + 6 * (mean * percent / 100) ** 0.5 + 1))
    made = scratch.save(features(docs, k, symbols), "features")
    reps = scratch.save(
        made.where("n_shingles > 0 and doc_id is not null").groupBy("seq").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"))
        .select("seq", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig")), "reps")
    w = Window.partitionBy("key")
    keys = chunk_keys(reps, symbols, chunks, errors).withColumn("first", F.min("rep").over(w)).withColumn("last", F.max("rep").over(w))
    members = scratch.save(keys.where("first < last").drop("first", "last"), "members")
    signed = members.join(reps.select("rep", "sig"), "rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Round 1: every row of a key against the key's centre.
    star = star_pairs(signed.repartition(parts, "key").sortWithinPartitions("key", "rep"), reach, percent)
    star = scratch.save(star.distinct(), "star")
    links = scratch.save(confirmed(star, docs, k, percent), "links")
    comp = components(scratch, links)
    # Round 2: clusters of rows that keys hold together, as far as they are still in different components.
    placed = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = placed.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).withColumn("first", F.min("rep").over(w)).where("low < high")
    mixed = scratch.save(mixed.select("rep", "n", "comp", "first").distinct(), "mixed")
    cluster = components(scratch, mixed.select(F.col("first").alias("a"), F.col("rep").alias("b")))
    rows = mixed.select("rep", "n", "comp").distinct().join(cluster.select(F.col("node").alias("rep"), F.col("comp").alias("cluster")), "rep").join(reps.select("rep", "sig"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    more = scratch.save(links_between(scratch.save(rows.join(texts, "rep"), "rows"), k, reach, percent), "more")
    comp = components(scratch, links.union(more)) if more.take(1) else comp
    classes = reps.select("seq", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("seq", F.coalesce("comp", "rep").alias("comp"))
    found = made.drop("sig").join(classes, "seq", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
