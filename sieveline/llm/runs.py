"""Periodic runs: stretches of words that repeat with a period, four times or more, and texts with one copy of each left.

Texts are compared by the names of Karp, Miller and Rosenberg: words have numbers, and the stretch of 2^(k+1) words at a place
has the rank of the pair of names of its halves, so equal names are equal stretches.  How far two places agree, forward or
backward, follows by descending through the levels of names.

Candidates lie on grids: a run of period q has ``max(6, 4 * q)`` words at least, so some multiple x of 2 * q in it has more than q
words that equal those at x + q.  All grids are compared by names of four words first; texts without a hit, most of them, have
no run and need no more names.  In the others, hits must agree by the longest names within q, neighbours on a grid that agree
throughout are one chain, hits inside a known run whose period divides theirs are left out, and each chain is extended both
ways by names.  Of equal stretches the one of the smallest period is the run.

Texts are taken together up to ``TOGETHER`` bytes, with a separator after each that equals nothing; work is n log n in the words
of a text.  A text is whole in one task; it takes some 100 bytes a word there if it has a hit, a third of that otherwise.

Defined results: words are runs of anything but ASCII white space; null text has no words, no runs and collapses to the empty
string.  Ties, repeated rows and ids play no part: each row is judged by its text alone.  Input columns called like results keep
their values under ``_input``.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEGMENT, SPACE, Numbers, keep_apart

RESULTS = ["n_words", "runs", "collapsed"]
TOGETHER = 1 << 20
TOP = 12  # names are of 2^TOP words at most; longer stretches agree name by name
LEAST, TIMES = 6, 4
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def numbers_of(text: bytes, known: Numbers) -> np.ndarray:
    """The numbers of a text's words; a long text is split piece by piece."""
    found, at = [], 0
    while at < len(text):
        space = SPACE.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        end = space.end() if space else len(text)
        words = text[at:end].split()
        found.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def names_of(ids: np.ndarray, top: int) -> list[np.ndarray]:
    """names[k][i]: the name of the 2^k words at i, for every place that has so many."""
    names = [ids]
    for k in range(top):
        last, half = names[-1].astype(np.int64), 1 << k
        if len(last) <= half:
            break
        pair = last[:-half] * (int(last.max()) + 1) + last[half:]
        names.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
    return names


def grid_hits(name: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x and periods q where the names at x and x + q are equal, x on the grid of q; ordered by q, then x.

    With x < start + 2 * q in a run, more than q words from x on agree: four at least, but for q = 2, whose grid is finer.
    """
    places, periods = [], []
    for q in range(1, min(longest // TIMES, len(name) - 1) + 1):
        step = 2 if q == 2 else 2 * q
        x = np.flatnonzero(name[:-q:step] == name[q::step]) * step
        if len(x):
            places.append(x)
            periods.append(np.full(len(x), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def agreement(names: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from x < y on; with back, how many before them."""
    done = np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name, size = names[k], 1 << k
        live = np.arange(len(x))
        while len(live):
            if back:
                low = x[live] - done[live] - size
                live, low = live[low >= 0], low[low >= 0]
                same = name[low] == name[low + y[live] - x[live]]
            else:
                high = y[live] + done[live]
                live, high = live[high < len(name)], high[high < len(name)]
                same = name[high - y[live] + x[live]] == name[high]
            live = live[same]
            done[live] += size
            if k < len(names) - 1:
                break
    return done


def runs_in(ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs that the hits (x, q) lie in; every hit is within one text."""
    names = names_of(ids, min(TOP, int(len(ids)).bit_length() - 1))
    n = len(ids)
    inside, upto, length = (np.zeros(n, np.int32) for _ in range(3))  # period, end and length of the longest run known at a place
    found = []
    for octave in range(int(q.max()).bit_length() if len(q) else 0):
        mine = q >> octave == 1
        a, p = x[mine], q[mine]
        known = (inside[a] > 0) & (a + p < upto[a])
        known[known] = p[known] % inside[a[known]] == 0
        a, p = a[~known], p[~known]
        level = names[min(octave, len(names) - 1)]
        fits = a + p < len(level)
        a, p = a[fits], p[fits]
        agree = level[a] == level[a + p]
        a, p = a[agree], p[agree]
        if not len(a):
            continue
        linked = np.zeros(len(a), bool)  # to the hit before
        if octave + 1 < len(names):
            whole = names[octave + 1]
            step = np.where(p == 2, 2, 2 * p)
            near = np.flatnonzero((p[1:] == p[:-1]) & (np.diff(a) == step[1:])) + 1
            linked[near[p[near] == 2]] = True  # hits two apart agree for four words each
            near = near[p[near] != 2]
            b, r = a[near - 1], p[near]
            end = b + step[near] - (2 << octave)  # the last name that ends where the next hit begins
            ok = (end + r < len(whole)) & (b + r < len(whole)) & (end >= 0)
            near, b, r, end = near[ok], b[ok], r[ok], end[ok]
            linked[near] = (whole[b] == whole[b + r]) & (whole[end] == whole[end + r])
        head = np.flatnonzero(~linked)
        tail = np.append(head[1:], len(a)) - 1
        period = p[head]
        start = a[head] - agreement(names, a[head], a[head] + period, back=True)
        end = a[tail] + period + agreement(names, a[tail], a[tail] + period)
        good = end - start >= np.maximum(LEAST, TIMES * period)
        start, end, period = first_of(start[good], end[good], period[good])
        found.append((start, end, period))
        for s, e, r in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
            if e - s >= 2 * TIMES * r:
                longer = length[s:e] < e - s
                inside[s:e][longer], upto[s:e][longer], length[s:e][longer] = r, e, e - s
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return first_of(*map(np.concatenate, zip(*found, strict=True)))


def first_of(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches by start, end and period, each with its smallest period only."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def joined(texts: list[np.ndarray], separator: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each with a separator of its own behind it, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.int64)
    for k, (t, s) in enumerate(zip(texts, starts.tolist(), strict=True)):
        ids[s : s + len(t)] = t
        ids[s + len(t)] = separator + k
    return ids, starts


def runs_of(texts: list[np.ndarray], words: int) -> dict[int, list[tuple[int, int, int]]]:
    """Text number -> its runs (start, length, period) by start, then period; texts without runs are left out.  Words are below ``words``."""
    longest = max(map(len, texts), default=0)
    if longest < LEAST:
        return {}
    ids, starts = joined(texts, words)
    names = names_of(ids, 2)
    x, q = grid_hits(names[2], longest)
    text = np.searchsorted(starts, x, "right") - 1
    own = text == np.searchsorted(starts, x + q, "right") - 1
    x, q, text = x[own], q[own], text[own]
    some = np.unique(text)
    if not len(some):
        return {}
    if len(some) < len(texts):
        ids, moved = joined([texts[k] for k in some.tolist()], words)
        x = x - starts[text] + moved[np.searchsorted(some, text)]
        starts = moved
    # Grids began at the start of the first set; chains follow steps, not multiples, so moving a text whole keeps them.
    out: dict[int, list[tuple[int, int, int]]] = {}
    start, end, period = runs_in(ids, x, q)
    text = np.searchsorted(starts, start, "right") - 1
    for k, s, n, p in zip(some[text].tolist(), (start - starts[text]).tolist(), (end - start).tolist(), period.tolist(), strict=True):
        out.setdefault(k, []).append((s, n, p))
    for found in out.values():
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(ids: np.ndarray, runs: list[tuple[int, int, int]], table: list[bytes]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    keep = np.ones(len(ids), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(map(table.__getitem__, ids[keep].tolist()))


def judged(batch: pa.RecordBatch, column: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    texts = batch.column(column)
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
    low = 0
    while low < len(texts):
        high, size = low + 1, sizes[low]
        while high < len(texts) and size + sizes[high] <= TOGETHER:
            size += sizes[high]
            high += 1
        known = Numbers()
        ids = [numbers_of(t.as_buffer().to_pybytes(), known) if t.is_valid else np.zeros(0, np.int64) for t in texts[low:high]]
        table = list(known)
        found = runs_of(ids, len(known))
        mine = [found.get(k, []) for k in range(len(ids))]
        flat = np.array([r for rs in mine for r in rs], np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *map(len, mine)]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(schema.field("runs").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(ends), structs).cast(schema.field("runs").type)
        short = pa.array([collapsed(i, rs, table) for i, rs in zip(ids, mine, strict=True)], pa.binary()).cast(pa.string())
        rows = batch.slice(low, high - low)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([len(i) for i in ids], pa.int64()), lists, short], names=schema.names)
        low = high


def find_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (a list of start, length, period in words, by start, then period), and the collapsed text."""
    docs = keep_apart(docs, RESULTS)
    column = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    run = pa.struct([(c, pa.int64()) for c in RUN.names])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [*batch.schema, pa.field("n_words", pa.int64()), pa.field("runs", pa.list_(run)), pa.field("collapsed", pa.string())]
            yield from judged(batch, column, pa.schema(fields))

    return docs.mapInArrow(judge, out)


def strongest(runs: Column) -> Column:
    """The run of a sorted list that has the greatest length by period, the first of equals; null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """find_runs' rows as doc_id, n_runs, the strongest run, and digests of the list of runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.array_join(F.transform("runs", line), "").alias("runs"), "collapsed")
    milli = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """docs, of which every tenth by the checksum h of doc_id repeats a stretch up to its end: with n words, g = h div 10 and
    a = g % n, the 1 + (n - a) div (3 + g % 8) words from a on recur.  Texts with a null id stay as they are."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumn("__g", F.when(h % 10 == 0, F.call_function("div", h, F.lit(10)))).withColumn("__words", F.when(F.col("__g").isNotNull(), words))
    n = F.size("__words").cast("long")
    rows = rows.withColumn("__a", F.when(n > 0, F.col("__g") % n)).withColumn("__p", 1 + F.call_function("div", n - F.col("__a"), 3 + F.col("__g") % 8))
    part = lambda c, first, size: F.slice(c, first.cast("int"), size.cast("int"))
    cycle, left = part("__words", F.col("__a") + 1, F.col("__p")), n - F.col("__a")
    times = F.call_function("div", left, F.col("__p")).cast("int")
    whole = F.concat(part("__words", F.lit(1), F.col("__a")), F.flatten(F.array_repeat(cycle, times)), part(cycle, F.lit(1), left % F.col("__p")))
    text = F.when(F.col("__a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(docs.columns)
