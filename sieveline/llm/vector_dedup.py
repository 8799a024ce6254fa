"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of one label and one length are compared.  They are scaled to unit length, so a cosine of at least ``cosine`` is a squared
distance of at most 2 - 2 * cosine.  A fixed random rotation spreads the distance over all dimensions.  The dimensions are split into
blocks of ``width`` (4) dimensions, which form ``parts`` groups for dealing out.  If two vectors are within the budget, their squared
distance in some group, and in some block of that group, is within its proportional part, budget * (its dimensions) / (all
dimensions); so the union of the blocks' range joins has every pair.  A candidate then has to keep within its group's part
and within the whole budget, and is verified on whole vectors in double precision.

Dealing out goes by reference points in each group's dimensions, about one for ``cell_rows`` rows (drawn from a bounded sample): with r
the group's range, a vector at distance d from its nearest point lies within r of another cell's vectors only if d' - d <= 2 r
for that cell's point at distance d' (two triangle inequalities), so it visits just those cells.  A large cell is dealt out as
pairs of tiles by a hash of the id.  There, each block's range join goes over the leaves of two k-d trees: pairs of leaves whose boxes
are farther apart than the range are left out.  A pair is counted in the first block that finds it, in the home cell of its
smaller id, and so once; what leaves a pair of tiles is each row's number of links there and a link to its smallest partner
by steps, not the pairs.

Equal vectors of a label are merged first and counted by weight, so copies never meet as pairs.

Results, one row per input row: vec_id, n_links, component_id, kept.  Vectors that are null, empty, zero or hold null or
non-finite components, and rows without a label or an id, link with nothing.  Repeated rows with one vec_id are one vector each for
n_links.  Vectors of different lengths are never linked.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, grouped_runs, mix64, worker_cache

MOST_ROTATED = 2048  # longer vectors are split as they are: any rotation gives exact results


def rotated(v: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length and rotated."""
    v = v / np.abs(v).max(axis=1)[:, None]  # so that squares stay in range
    v = v / np.linalg.norm(v, axis=1)[:, None]
    n = v.shape[1]
    if n > MOST_ROTATED:
        return v
    kept, name = worker_cache(), f"rotation of {n}"
    if name not in kept:
        q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((n, n)))
        kept[name] = q * np.sign(np.diag(r))
    return v @ kept[name]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = (v / np.abs(v).max(axis=1)[:, None] for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def blocks_of(dimensions: int, parts: int, width: int) -> list[tuple[slice, list[slice]]]:
    """The groups of dimensions, each with its blocks."""

    def cut(first: int, last: int, n: int) -> list[slice]:
        ends = np.linspace(first, last, n + 1).astype(int).tolist()
        return [slice(i, j) for i, j in zip(ends, ends[1:], strict=False)]

    return [(g, cut(g.start, g.stop, -(-(g.stop - g.start) // width))) for g in cut(0, dimensions, min(parts, dimensions))]


def leaves(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x in the leaves of a k-d tree (-1: none), and the leaves' boxes."""
    n, d = x.shape
    levels = max(0, int(np.ceil(np.log2(n / leaf)))) if n else 0
    size = -(-n // (1 << levels))
    order = np.append(np.arange(n), np.full((size << levels) - n, -1))
    far = np.vstack([x, np.full((1, d), np.inf)])
    for level in range(levels):
        order = order.reshape(1 << level, -1)
        order = np.take_along_axis(order, np.argsort(far[order, level % d], axis=1), axis=1)
    order = order.reshape(1 << levels, size)
    low = far[order].min(axis=1)
    return order, low, np.where(order[:, :, None] < 0, -np.inf, far[order]).max(axis=1)


def range_join(x: np.ndarray, y: np.ndarray, share: float, leaf: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x and y, of few dimensions, whose squared distance is at most ``share``."""
    a, a_low, a_high = leaves(x, leaf)
    b, b_low, b_high = leaves(y, leaf)
    gap = np.maximum(0, np.maximum(a_low[:, None] - b_high[None], b_low[None] - a_high[:, None]))
    some, other = np.nonzero((gap * gap).sum(axis=2) <= share)
    for at in range(0, len(some), 64):
        p, q = a[some[at : at + 64]], b[other[at : at + 64]]
        u, v = x[p], y[q]
        d = (u * u).sum(axis=2)[:, :, None] + (v * v).sum(axis=2)[:, None, :] - 2 * u @ v.transpose(0, 2, 1)
        k, i, j = np.nonzero(d <= share)
        i, j = p[k, i], q[k, j]
        ok = (i >= 0) & (j >= 0)
        yield i[ok], j[ok]


def deal(classes: DataFrame, cosine: float, parts: int, width: int, points: dict) -> DataFrame:
    """classes (id, label, v, n) -> (label, length, part, cell, low, high, tile, home, id, v, n): each in its home cell and those
    that it must visit, there in all pairs of its tile with another one.

    points: by label and length, for each group of dimensions the points of its cells and the cells' tiles.
    """
    shared = classes.sparkSession.sparkContext.broadcast(points)  # no more points than a bounded sample has rows
    names = ["label", "length", "part", "cell", "low", "high", "tile", "home", "id", "v", "n"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, length = batch.column(0), batch.column(1).to_numpy(), pc.list_value_length(batch.column(2)).to_numpy()
            for label, size in sorted({*zip(labels.tolist(), length.tolist(), strict=True)}):
                rows = np.flatnonzero((labels == label) & (length == size))
                u = rotated(matrix(batch.column(2).take(pa.array(rows))))
                known = shared.value.get((label, size))
                for k, (s, _) in enumerate(blocks_of(size, parts, width)):
                    c, tiles = known[k] if known else (np.zeros((1, s.stop - s.start)), np.ones(1, np.int64))
                    x = u[:, s]
                    d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0))
                    home = d.argmin(axis=1)
                    reach = np.sqrt((2 - 2 * cosine) * (s.stop - s.start) / size + 2e-9)
                    row, cell = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * reach + 1e-9)
                    tile = (mix64(ids.take(pa.array(rows[row])).to_numpy().astype(np.uint64)) % tiles[cell].astype(np.uint64)).astype(np.int64)
                    other, _ = grouped_runs(np.repeat(np.arange(len(row)), tiles[cell]))
                    other = np.arange(int(tiles[cell].sum())) - np.repeat(other, tiles[cell])
                    row, cell, tile = (np.repeat(z, tiles[cell]) for z in (row, cell, tile))
                    for at in range(0, len(row), 4096):
                        r, c_, t, o = (z[at : at + 4096] for z in (row, cell, tile, other))
                        take, m = pa.array(rows[r]), len(r)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(m, label, np.int64)), pa.array(np.full(m, size, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(c_.astype(np.int32)), pa.array(np.minimum(t, o).astype(np.int32)), pa.array(np.maximum(t, o).astype(np.int32)),
                            pa.array(t.astype(np.int32)), pa.array(home[r] == c_), ids.take(take), batch.column(2).take(take), batch.column(3).take(take),
                        ], names)

    kind = dict(classes.dtypes)["v"]
    return classes.select("id", "label", "v", "n").mapInArrow(make, f"label long, length int, part int, cell int, low int, high int, tile int, home boolean, id long, v {kind}, n long")


def links(dealt: DataFrame, cosine: float, parts: int, width: int) -> DataFrame:
    """Of each pair of tiles, rows (id, root, degree): rows linked there, the smallest id reached there, copies linked."""
    keys = ["label", "length", "part", "cell", "low", "high"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
            size, part, low, high = (table[x][0].as_py() for x in ("length", "part", "low", "high"))
            at, home, ids, n = (table[x].to_numpy() for x in ("tile", "home", "id", "n"))
            groups = blocks_of(size, parts, width)
            budget = 2 - 2 * cosine
            share = lambda s: budget * (s.stop - s.start) / size + 1e-9
            degree, root = np.zeros(len(ids), np.int64), ids.copy()
            v = matrix(table["v"].combine_chunks())
            u = rotated(v)
            left, right = np.flatnonzero(at == low), np.flatnonzero(at == high)
            group, blocks = groups[part]
            distance = lambda i, j, s: ((u[i, s] - u[j, s]) ** 2).sum(axis=1)
            pairs = [(left[:0], left[:0])]
            for k, s in enumerate(blocks):
                for i, j in range_join(u[left, s], u[right, s], share(s) + 1e-9):
                    i, j = left[i], right[j]
                    ok = np.where(ids[i] < ids[j], home[i], home[j]) & ((ids[i] < ids[j]) if low == high else (ids[i] != ids[j]))
                    i, j = i[ok], j[ok]
                    sum_ = distance(i, j, s)
                    ok = sum_ <= share(s)
                    i, j, sum_ = i[ok], j[ok], sum_[ok]
                    for other in [*blocks[k + 1 :], *blocks[:k]]:  # within the group's part
                        sum_ += distance(i, j, other)
                        ok = sum_ <= share(group)
                        i, j, sum_ = i[ok], j[ok], sum_[ok]
                    ok = cosines(v[i], v[j]) >= cosine
                    i, j = i[ok], j[ok]
                    for other, earlier in [*zip(blocks[:k], [None] * k, strict=True), *groups[:part]]:  # not if an earlier block has it
                        found = distance(i, j, other) <= share(other)
                        if earlier:
                            found &= np.any([distance(i, j, e) <= share(e) for e in earlier], axis=0)
                        i, j = i[~found], j[~found]
                    degree += np.bincount(i, n[j], len(ids)).astype(np.int64) + np.bincount(j, n[i], len(ids)).astype(np.int64)
                    pairs.append((i, j))
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            while (root[i] != root[j]).any():
                low_id = np.minimum(root[i], root[j])
                np.minimum.at(root, i, low_id)
                np.minimum.at(root, j, low_id)
            some = degree > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some]), pa.array(degree[some])], ["id", "root", "degree"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # sorted by the keys
            if not batch.num_rows:
                continue
            columns = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys], axis=1)
            starts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), len(columns)]
            for s, e in zip(starts, starts[1:], strict=False):
                now = tuple(columns[s])
                if held and now != last:
                    yield from join(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
                last = now
        if held:
            yield from join(pa.Table.from_batches(held))

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(make, "id long, root long, degree long")


def reference_points(classes: DataFrame, total: int, parts: int, width: int, cell_rows: int, sample: int, tile: int, cosine: float) -> dict:
    """For labels and lengths in a sample of about ``sample`` rows: the points of each group's cells, and how many tiles a cell takes."""
    share = F.lit(min(1.0, sample / max(1, total)))
    drawn = classes.where(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) / 1_000_000 <= share).select("label", "v").limit(2 * sample).toArrow()
    length = pc.list_value_length(drawn["v"].combine_chunks()).to_numpy() if len(drawn) else []
    labels = drawn["label"].to_numpy() if len(drawn) else []
    points, random = {}, np.random.default_rng(5)
    for label, size in sorted({*zip(map(int, labels), map(int, length), strict=True)}):
        rows = np.flatnonzero((labels == label) & (length == size))
        u = rotated(matrix(drawn["v"].combine_chunks().take(pa.array(rows))))
        each = total / len(drawn)  # rows that a drawn one stands for
        chosen = u[random.permutation(len(u))[: max(1, min(int(each * len(u) / cell_rows), len(u) // 16))]]
        points[label, size] = []
        for s, _ in blocks_of(size, parts, width):
            x, c = u[:, s], chosen[:, s]
            d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0))
            visits = (d <= d.min(axis=1)[:, None] + 2 * np.sqrt((2 - 2 * cosine) * (s.stop - s.start) / size)).sum(axis=0)
            points[label, size].append((c, (each * visits // tile + 1).astype(np.int64)))
    return points


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.93, parts: int = 4, width: int = 4, cell_rows: int = 50_000, sample: int = 20_000, tile: int = 8192) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).withColumn("ok", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("digest", F.when(F.col("ok"), F.sha2(F.to_json("v").cast("binary"), 256)))
    classes = scratch.save(rows.where("ok").groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    points = reference_points(classes, classes.count(), parts, width, cell_rows, sample, tile, cosine)
    pairs = scratch.save(links(deal(classes, cosine, parts, width, points), cosine, parts, width), "links")
    degree = pairs.groupBy("id").agg(F.sum("degree").alias("degree"))
    comp = components(scratch, pairs.select(F.col("id").alias("a"), F.col("root").alias("b")))
    described = classes.drop("v").join(degree, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "digest", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "id").alias("comp"))
    found = rows.select("vec_id", "label", "digest").join(described, ["label", "digest"], "left")
    component = F.coalesce("comp", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
