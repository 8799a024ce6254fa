"""Language-model scores from a hierarchical Pitman-Yor process fitted on the whole training side of the corpus.

Tokens are words (runs of anything but ASCII white space, A-Z in lower case) and one end per text.  A token's context is the word
before it, or the text's start.  Each context word has a Chinese restaurant whose dishes are words; all of them share one parent
restaurant, whose base is uniform over the vocabulary and one unknown word.  Customers of word w in context u sit at tables, and
each table is a customer of w in the parent.

Fitting: pairs (context, word) are counted per task, then by word; frequent words (at least 1 / ``heavy`` of all tokens, so at most
about 4 / 3 of ``heavy``) are dealt out by pair.  A dish with one customer has one table.  All others are seated by Gibbs sampling: each
sweep takes all customers of each dish from their seats and seats them anew given everyone else (of other dishes, contexts' and the
parent's totals are those of the sweep before, since all words are worked on at once).  Only numbers of tables matter to anybody else, so
these are drawn with the sizes summed out: P(t) is in proportion to the generalised Stirling number S(c, t) times the weights of t - 1 new
tables; S comes from its recurrence up to 1,024 customers, and by contour integration beyond.  The parent's dishes are seated in the same
way.  After ``burn_in`` sweeps, tables and parent probabilities are averaged over ``samples`` further ones.
Discounts come from the counts of counts, n1 / (n1 + 2 n2); strengths are 1.

Predictions: P(w | u) = (c - d t) / (theta + c_u) + (theta + d t_u) / (theta + c_u) * P(w), with averages for t, t_u and P(w); they sum
to 1 over the vocabulary and the unknown word.

Scoring: pairs with at least 1 / ``often`` of all tokens (at most ``often`` many) are broadcast.  Tokens of all others go, packed, to the
bucket of their pair, which knows the pair, or else the word; a pair that was never seen in a rare context goes on to the bucket of
that context.  Only sums by document come back.  Documents are scored in ``slices``, all of the same model, so that the disk holds the
tokens of one slice at a time.

Results, one row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  Null text is empty: one end
token.  Very long texts are scored whole.  Rows with a null doc_id are trained on and scored; repeated rows count each.  Words and
contexts are told apart by 64-bit hashes, pairs by 64-bit hashes of these within a bucket.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import bucket_rows, in_buckets, packed, runs, unpacked
from .common import Scratch, binary_list, hashed_words, mix64, worker_cache

END = np.uint64(0x9D39247E33776D41)  # stands for the end as a word, and for the start as a context
THETA = 1.0
KINDS = {
    "word": "<u8", "ones": "<i8", "own": "<i4", "root": "<i8", "p0": "<f8", "row": "<i4", "context": "<u8", "count": "<i8", "tables": "<i8", "mean": "<f4",
    "asked": "<u8", "sum": "<f8", "new": "<f8", "total": "<f8", "frequent": "<i4", "frequent_sum": "<i8", "doc": "<i4", "w": "<u8", "u": "<u8", "known": "<i8", "base": "<f8", "score": "<f8", "lp": "<f4", "pair": "<u8", "often": "<u8", "often_lp": "<f4", "often_base": "<f8",
    "w_all": "<u8", "u_all": "<u8", "chunks": "<i8", "tokens": "<i8", "doc_id": "<i8", "no_id": "?", "held": "?",
}
MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(rows: list[dict], schema: str) -> pa.RecordBatch:
    return packed(rows, schema, KINDS)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and text number of all tokens of some texts."""
    parts, sizes = [], []
    for at in range(0, len(texts), 64):
        some = [(t or b"").lower() for t in texts[at : at + 64]]
        hashes, starts, _ = hashed_words(b"\n".join(some))
        ends = np.cumsum([len(t) + 1 for t in some])
        own = np.searchsorted(starts, ends)
        parts.append(np.insert(hashes, own, END))
        sizes.append(np.diff(own, prepend=0) + 1)
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    context = np.empty_like(words)
    context[1:] = words[:-1]
    context[:1] = END
    return words, context, np.repeat(np.arange(len(size)), size)


def scaled(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of hashes, so that what is sorted by hash is sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def place(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where asked values stand in sorted ones; -1 where they do not."""
    if not len(values):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return np.where(values[at] == asked, at, -1)


@dataclass
class Bins:
    """Which words are frequent (sorted), and how pairs are dealt to buckets."""

    frequent: np.ndarray
    buckets: int

    def of(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        by = np.where(place(self.frequent, word) >= 0, mix64(word ^ (context >> np.uint64(24)) * MIX), word)
        return scaled(by, self.buckets)


def frequent_words(docs: DataFrame, heavy: int) -> tuple[np.ndarray, int]:
    """Sorted words that have at least 1 / heavy of all tokens (and some with 3 / 4 of that), and the number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= n.sum() / (4 * heavy)  # what tasks leave out is less than a quarter of the bound
            return pa.RecordBatch.from_arrays([pa.array(np.append(words[some].view(np.int64), 0)), pa.array(np.append(n[some], n.sum())), pa.array(np.append(np.zeros(int(some.sum()), bool), True))], ["word", "n", "whole"])

        for batch in batches:
            texts = binary_list(batch.column(0))
            for at in range(0, len(texts), 512):
                held.append(tokens(texts[at : at + 512])[0])
                total += len(held[-1])
                if total > 3_000_000:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    found = Scratch(docs.sparkSession).save(docs.select("text").mapInArrow(count, "word long, n long, whole boolean").groupBy("word", "whole").agg(F.sum("n").alias("n")), "words")
    n = found.where("whole").agg(F.sum("n")).first()[0] or 0
    rows = found.where(~F.col("whole") & (F.col("n") >= 0.75 * n / heavy)).select("word").toArrow()
    return np.sort(rows["word"].to_numpy().view(np.uint64)) if n else np.zeros(0, np.uint64), int(n)


def pair_counts(docs: DataFrame, bins: Bins) -> DataFrame:
    """Packed (bucket, w, u, count): pairs by bucket, sorted by word."""
    schema = "bucket long, w binary, u binary, count binary"

    def sums(w: np.ndarray, u: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = w & ~np.uint64(0xFFFFFF) | u >> np.uint64(40)
        order = np.argsort(key)
        if n is not None:  # merging has to be exact where keys of different pairs are equal
            key = key[order]
            top, a, b = key >> np.uint64(24), w[order], u[order]
            # Words alike in their first 40 bits lie among each other by their contexts: all their rows are sorted anew.
            alike = np.flatnonzero((top[1:] == top[:-1]) & (a[1:] != a[:-1]))
            same = np.flatnonzero((key[1:] == key[:-1]) & (a[1:] == a[:-1]) & (b[1:] != b[:-1]))
            if len(alike) or len(same):
                mixed = np.flatnonzero(np.isin(top, top[alike]) | np.isin(key, key[same]))
                order[mixed] = order[mixed][np.lexsort((b[mixed], a[mixed]))]
        w, u = w[order], u[order]
        first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (u[1:] != u[:-1]))))
        return w[first], u[first], np.diff(np.append(first, len(w))) if n is None else np.add.reduceat(n[order], first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            w, u, n = sums(*(np.concatenate(x) for x in zip(*held, strict=True)), None)
            bucket = bins.of(w, u)
            order = in_buckets(bucket, bins.buckets)
            for at in runs(bucket[order]):
                o = order[at]
                yield pack([{"bucket": int(bucket[o[0]]), "w": w[o], "u": u[o], "count": n[o]}], schema)

        for batch in batches:
            texts = binary_list(batch.column(0))
            for at in range(0, len(texts), 512):
                held.append(tokens(texts[at : at + 512])[:2])
                total += len(held[-1][0])
                if total > 2_000_000:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucket_rows(batches, ["bucket", "w", "u", "count"], KINDS):
            w, u, n = sums(*(np.concatenate([r[k] for r in rows]) for k in ("w", "u", "count")))
            yield pack([{"bucket": rows[0]["bucket"], "w": w, "u": u, "count": n}], schema)

    dealt = docs.select("text").mapInArrow(count, schema).repartition(bins.buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, schema)


# Seating


def sequential(count: np.ndarray, fresh: np.ndarray, more: np.ndarray, d: float, random: np.random.Generator) -> np.ndarray:
    """A first number of tables: customers sit down in turn (beyond 64 in doubling blocks); fresh + more * tables weighs a new table."""
    order = np.argsort(-count, kind="stable")
    c, fresh, more = count[order], fresh[order], more[order]
    t, i = np.ones(len(c), np.int64), 1
    while n := int(np.searchsorted(-c, -i, "left")):
        a = fresh[:n] + more[:n] * t[:n]
        if i < 64:
            t[:n] += random.random(n) < a / (a + i - d * t[:n])
            i += 1
        else:
            block = np.minimum(2 * i, c[:n]) - i
            t[:n] += np.minimum(random.poisson(np.minimum(a * np.log1p(block / (a + i - d * t[:n])), block)), block)
            i *= 2
    out = np.empty_like(t)
    out[order] = t
    return out


SMALL = 1024  # customers up to which a dish's distribution is read from a table


def stirling_table(d: float) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers, at [c, t - 1]."""
    kept = worker_cache()
    if d not in kept.setdefault("stirling", {}):
        while len(kept["stirling"]) > 1:  # one for the contexts, one for the parent
            kept["stirling"].pop(next(iter(kept["stirling"])))
        table = np.full((SMALL + 1, SMALL), -np.inf)
        table[1, 0] = 0
        for c in range(2, SMALL + 1):
            table[c, :c] = np.logaddexp(np.append(-np.inf, table[c - 1, : c - 1]), np.append(np.log(c - 1 - d * np.arange(1, c)) + table[c - 1, : c - 1], -np.inf))
        kept["stirling"][d] = table
    return kept["stirling"][d]


def saddle(u: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log g, -(log g)' and -(log g)'' at u, where g = 1 - (1 - exp(-u)) ** d."""
    z = -np.expm1(-u)
    g = -np.expm1(d * np.log(z))
    a = d * z ** (d - 1) * np.exp(-u) / g
    return np.log(g), a, a * ((d - 1) * np.exp(-u) / z - 1 + a)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) without what depends on c alone, for large c.

    S(c, t) is c! / (t! d ** t) times the coefficient of x ** c in (1 - (1 - x) ** d) ** t, which is an integral along a hyperbola
    in u = -log x, through the saddle point or 1 / c if that is larger, here by the trapezoidal rule.
    """
    low, high = -np.log(c), np.full(len(c), np.log(40.0))
    for _ in range(40):
        middle = (low + high) / 2
        below = t * saddle(np.exp(middle), d)[1] > c
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    sigma = np.exp(low)
    lg, _, second = saddle(sigma, d)
    scale = np.minimum(1, 1 / (sigma * np.sqrt(np.maximum(-t * second, 1e-300))))
    integral, bend = np.empty(len(c)), 0.4
    for some, nodes in ((scale > 0.3, 65), (scale <= 0.3, 22)):  # few tables need more, as most of the integral cancels out
        step = np.minimum(7 * scale[some], 5.5) / (nodes - 1)
        theta = np.arange(nodes) * step[:, None]
        of = (sigma[some] / (1 - np.sin(bend)))[:, None]
        u = of * (1 - np.sin(bend) * np.cosh(theta) + 1j * np.cos(bend) * np.sinh(theta))
        du = of * (-np.sin(bend) * np.sinh(theta) + 1j * np.cos(bend) * np.cosh(theta))
        e = t[some, None] * (np.log(1 - (1 - np.exp(-u)) ** d) - lg[some, None]) + c[some, None] * (u - sigma[some, None])
        f = np.where(e.real > -700, np.exp(np.where(e.real > -700, e, 0)) * du, 0).imag
        integral[some] = (f.sum(axis=1) - f[:, 0] / 2) * step
    x = t + 9  # log t! by Stirling's series
    factorial = (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3) - np.log(t[:, None] + np.arange(1, 9)).sum(axis=1)
    return np.log(np.maximum(integral, 1e-300)) + t * lg + c * sigma - factorial - t * np.log(d)


def of_large(c: np.ndarray, fresh: np.ndarray, more: np.ndarray, d: float, random: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with many customers, drawn from where they have their mass."""
    low, high = np.full(len(c), -80.0), np.full(len(c), np.log(40.0))
    for _ in range(60):  # the mode, by the saddle point
        middle = (low + high) / 2
        lg, a, _ = saddle(np.exp(middle), d)
        t = c / a
        below = np.log(fresh + more * t) + lg - np.log(d) - np.log(t + 0.5) > 0
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    center = np.clip(np.rint(t), 1, c - 1)
    half = np.maximum(16, np.ceil(6 * np.sqrt(center)))
    for narrow in (False, True):
        at = np.linspace(-1, 1, 33 if narrow else 17)
        nodes = center[:, None] + half[:, None] * at
        inside = (nodes >= 1) & (nodes <= c[:, None] - 1)
        x = np.clip(nodes, 1, c[:, None] - 1)
        # log of prod(fresh + more k, 0 < k < t), by the Gamma function's series where it is smooth
        k = (fresh / more)[:, None]
        weight = x * np.log(more)[:, None] + log_gamma(k + x)
        f = np.full(x.shape, -np.inf)
        f[inside] = log_stirling(np.broadcast_to(c[:, None], x.shape)[inside], x[inside], d) + weight[inside]
        p = np.exp(f - f.max(axis=1, keepdims=True))
        if not narrow:
            p /= p.sum(axis=1, keepdims=True)
            mean = (p * x).sum(axis=1)
            deviation = np.sqrt(np.maximum((p * (x - mean[:, None]) ** 2).sum(axis=1), half**2 / 256))
            center, half = np.clip(np.rint(mean), 1, c - 1), np.maximum(16, np.ceil(6 * deviation))
    out = np.empty(len(c), np.int64)
    some = half == 16  # nodes are whole numbers
    cum = np.cumsum(p[some], axis=1)
    out[some] = nodes[some][np.arange(len(cum)), np.minimum((cum <= (random.random(len(cum)) * cum[:, -1])[:, None]).sum(axis=1), 32)]
    some = np.flatnonzero(~some)
    if len(some):
        # Between nodes: a parabola and what is left of it, which is close to linear.
        fine = np.linspace(0, 32, 513)
        left = np.minimum(fine.astype(np.int64), 31)
        part = fine - left
        parabola = lambda y: -18 * y**2  # noqa: E731  six deviations on each side
        rest = np.where(np.isfinite(f[some]), f[some] - f[some].max(axis=1, keepdims=True) - parabola(at), -np.inf)
        with np.errstate(invalid="ignore"):
            between = np.where(part > 0, rest[:, left] * (1 - part) + rest[:, left + 1] * part, rest[:, left])
        cum = np.cumsum(np.exp(np.nan_to_num(between, nan=-np.inf) + parabola(fine / 16 - 1)), axis=1)
        j = (cum <= (random.random(len(some)) * cum[:, -1])[:, None]).sum(axis=1)
        out[some] = np.rint(center[some] + half[some] * ((j + random.random(len(some)) - 0.5) / 256 - 1))
    return np.clip(out, 1, c.astype(np.int64))


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - sum(np.log(x + k) for k in range(8))


def seated_anew(count: np.ndarray, fresh: np.ndarray, more: np.ndarray, d: float, random: np.random.Generator) -> np.ndarray:
    """New numbers of tables of dishes all of whose customers are seated anew, given everything else.

    P(t) is in proportion to S(c, t) times the product of fresh + more * k, 0 < k < t.
    """
    out = np.ones(len(count), np.int64)
    kind = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    table = stirling_table(d)
    for k in np.unique(kind[(count > 1) & (count <= SMALL)]):
        those = np.flatnonzero((kind == k) & (count > 1))
        w = 1 << int(k)
        for rows in np.array_split(those, max(1, (len(those) << int(k)) // 100_000)):
            f = table[count[rows], :w]
            f[:, 1:] += np.cumsum(np.log(fresh[rows][:, None] + more[rows][:, None] * np.arange(1, w)), axis=1)
            cum = np.cumsum(np.exp(f - f.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (cum <= (random.random(len(rows)) * cum[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(count > SMALL)
    for rows in np.array_split(large, len(large) // 100 + 1):
        if len(rows):
            out[rows] = of_large(count[rows].astype(float), fresh[rows], more[rows], d, random)
    return out


@dataclass
class Parent:
    """The parent restaurant: totals, and the seating of frequent words."""

    d: float
    d0: float
    vocabulary: int
    customers: float
    tables: float
    count: np.ndarray  # of frequent words: customers, tables, and sums of probabilities over samples
    seated: np.ndarray
    p: np.ndarray
    samples: int = 0
    unseen_sum: float = 0.0

    def fresh(self) -> float:
        """The weight of a new table of any word."""
        return (THETA + self.d0 * self.tables) / (self.vocabulary + 1)

    def probability(self, count: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.maximum(count - self.d0 * tables, 0) / (THETA + self.customers) + self.unseen()

    def unseen(self) -> float:
        return self.fresh() / (THETA + self.customers)


STATE = "bucket long, kind int, part long, word binary, ones binary, own binary, root binary, p0 binary, row binary, context binary, count binary, tables binary, mean binary, frequent binary, frequent_sum binary, asked binary, new binary, total binary, s_customers double, s_tables double"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def state_row(bucket: int, **fields) -> dict:
    return {**dict.fromkeys(NAMES), "kind": 0, "part": 0, "bucket": bucket, **fields}


def first_state(counts: DataFrame, bins: Bins, d: float, d0: float) -> DataFrame:
    """A row for each bucket: its words with their parents' dishes, and all pairs with two customers or more.

    own: whether the word's parent dish is kept here (frequent words' are with the driver).
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch, ["bucket", "w", "u", "count"], KINDS):
                random = np.random.default_rng([1, x["bucket"]])
                first = np.flatnonzero(np.concatenate(([True], x["w"][1:] != x["w"][:-1])))
                row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x["w"]))))
                many = x["count"] > 1
                own = place(bins.frequent, x["w"][first]) < 0
                count = x["count"][many].astype(np.int64)
                tables = sequential(count, np.full(len(count), 0.5), np.zeros(len(count)), d, random)
                ones = np.bincount(row[~many], minlength=len(first))
                customers = ones + np.bincount(row[many], tables, len(first)).astype(np.int64)
                kept = customers[own]
                root = sequential(kept, np.full(len(kept), 0.01), np.zeros(len(kept)), d0, random)
                other = np.flatnonzero(~own)
                yield pack([state_row(
                    x["bucket"], word=x["w"][first], ones=ones, own=own, root=root, p0=np.zeros(len(kept)), row=row[many], context=x["u"][many], count=count, tables=tables, mean=np.zeros(len(count)), frequent=place(bins.frequent, x["w"][first][other]), frequent_sum=customers[other], s_customers=float(customers.sum()), s_tables=float(root.sum()))], STATE)

    return counts.mapInArrow(make, STATE)


def contexts_of(counts: DataFrame, buckets: int) -> DataFrame:
    """Packed (bucket, u, total, ones): customers and dishes with one customer of each context, by the context's bucket."""
    schema = "bucket long, part long, asked binary, total binary, new binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch, ["bucket", "u", "count"], KINDS):
                u, at = np.unique(x["u"], return_inverse=True)
                total, ones = np.bincount(at, x["count"], len(u)), np.bincount(at, x["count"] == 1, len(u))
                to = scaled(u, buckets)
                for s in runs(to):
                    yield pack([{"bucket": int(to[s.start]), "part": x["bucket"], "asked": u[s], "total": total[s], "new": ones[s]}], schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucket_rows(batches, ["bucket", "asked", "total", "new"], KINDS):
            u, at = np.unique(np.concatenate([r["asked"] for r in rows]), return_inverse=True)
            total, ones = (np.bincount(at, np.concatenate([r[k] for r in rows]), len(u)) for k in ("total", "new"))
            yield pack([{"bucket": rows[0]["bucket"], "part": -1, "asked": u, "total": total, "new": ones}], schema)

    kinds = counts.select("bucket", "u", "count").mapInArrow(send, schema)
    return kinds.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema)


def answers(asked: DataFrame, contexts: DataFrame, buckets: int, d: float) -> DataFrame:
    """asked (bucket, part, asked, sum): tables that pairs of a part have in contexts -> for each part, in the order of its contexts,
    the weight of a new table, theta + d * t_u, and theta + c_u."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucket_rows(batches, ["bucket", "part", "asked", "sum", "total", "new"], KINDS):
            known, rows = rows[0], rows[1:]  # the contexts' own row has part -1
            tables = known["new"].copy()
            at = [place(known["asked"], r["asked"]) for r in rows]
            for r, k in zip(rows, at, strict=True):
                tables += np.bincount(k, r["sum"], len(tables))
            for r, k in zip(rows, at, strict=True):
                yield pack([state_row(r["part"], kind=1, part=known["bucket"], new=THETA + d * tables[k], total=THETA + known["total"][k])], STATE)

    both = contexts.select("bucket", "part", "asked", F.lit(None).cast("binary").alias("sum"), "total", "new").union(
        asked.select("bucket", "part", "asked", "sum", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(make, STATE)


def questions(state: DataFrame, buckets: int, mean: bool = False) -> DataFrame:
    schema = "bucket long, part long, asked binary, sum binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch, ["bucket", "context", "tables", "mean"], KINDS):
                u, at = np.unique(x["context"], return_inverse=True)
                tables = np.bincount(at, x["mean" if mean else "tables"], len(u))
                to = scaled(u, buckets)
                for s in runs(to):
                    yield pack([{"bucket": int(to[s.start]), "part": x["bucket"], "asked": u[s], "sum": tables[s]}], schema)

    return state.where("kind = 0").mapInArrow(send, schema)


def with_answers(state: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    return state.where("kind = 0").union(replies.select(*NAMES)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "part")


def joined(rows: list[dict], name: str) -> np.ndarray:
    """What the buckets of contexts answered; they are in the order of contexts."""
    return np.concatenate([r[name] for r in rows[1:]]) if len(rows) > 1 else np.zeros(0)


def swept(rows: DataFrame, parent: Parent, k: int, sample: bool, samples: int) -> DataFrame:
    """One Gibbs sweep over all buckets."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in bucket_rows(batches, NAMES, KINDS):
            x = found[0]
            random = np.random.default_rng([2, k, x["bucket"]])
            own, row, tables, count = x["own"] > 0, x["row"], x["tables"].astype(np.int64), x["count"].astype(np.int64)
            n = len(own)
            mine = x["ones"] + np.bincount(row, tables, n).astype(np.int64)
            whole, seats = np.empty(n, np.int64), np.empty(n, np.int64)
            whole[own], seats[own] = mine[own], x["root"]
            whole[~own], seats[~own] = parent.count[x["frequent"]], parent.seated[x["frequent"]]
            _, at = np.unique(x["context"], return_inverse=True)
            others = np.maximum(whole[row] - tables, 0)  # a dish's own tables are none of the parent's customers while it is seated
            base, new = parent.probability(others, np.minimum(seats[row], others)), joined(found, "new")[at] if len(count) else np.zeros(0)
            fresh, more = np.maximum(new - parent.d * tables, THETA) * base, parent.d * base
            tables = seated_anew(count, fresh, more, parent.d, random)
            mine = x["ones"] + np.bincount(row, tables, n).astype(np.int64)
            kept = mine[own]
            flat = np.full(len(kept), parent.fresh())
            root = seated_anew(kept, flat, np.full(len(kept), parent.d0 / (parent.vocabulary + 1)), parent.d0, random)
            p0, mean = x["p0"], x["mean"]
            if sample:
                p0, mean = p0 + parent.probability(kept, root) / samples, mean + tables / samples
            yield pack([{**x, "root": root, "tables": tables, "p0": p0, "mean": mean, "frequent_sum": mine[~own], "s_customers": float(mine.sum()), "s_tables": float(root.sum())}], STATE)

    return rows.mapInArrow(make, STATE)


def totals(state: DataFrame, n_frequent: int) -> tuple[float, float, np.ndarray]:
    """Customers and tables of the parent, without the tables of frequent words, and these words' customers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, both = np.zeros(n_frequent, np.int64), np.zeros(2)
        for batch in batches:
            for x in unpacked(batch, ["frequent", "frequent_sum", "s_customers", "s_tables"], KINDS):
                np.add.at(sums, x["frequent"], x["frequent_sum"])
                both += x["s_customers"], x["s_tables"]
        yield pack([{"frequent_sum": sums, "s_customers": both[0], "s_tables": both[1]}], "frequent_sum binary, s_customers double, s_tables double")

    sums, customers, tables = np.zeros(n_frequent, np.int64), 0.0, 0.0
    for r in state.mapInArrow(add, "frequent_sum binary, s_customers double, s_tables double").toLocalIterator():
        sums += np.frombuffer(r[0], "<i8")
        customers, tables = customers + r[1], tables + r[2]
    return customers, tables, sums


MODEL = "bucket long, word binary, count binary, p0 binary, pair binary, lp binary, often binary, often_lp binary, often_base binary"


@dataclass
class Model:
    bins: Bins
    words: DataFrame  # packed, MODEL: words with their counts and log10 P(w), pairs with their log10 P(w | u), and the pairs met often
    contexts: DataFrame  # packed (bucket, asked, new): log10 of the share that a context leaves to the parent
    parent: Parent
    n: int
    counts: np.ndarray  # of frequent words
    lp0: np.ndarray
    common: np.ndarray  # frequent words and the start, as contexts, and what they leave
    back_off: np.ndarray
    unseen: float

    def lookup(self) -> Lookup:
        return Lookup(self.bins, self.n, self.n + 0.5 * (self.parent.vocabulary + 1), self.counts, self.lp0, self.common, self.back_off, self.unseen)


@dataclass
class Lookup:
    """What every task needs of the model, whatever the corpus."""

    bins: Bins
    n: int
    denominator: float
    counts: np.ndarray
    lp0: np.ndarray
    common: np.ndarray
    back_off: np.ndarray
    unseen: float

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / self.denominator)


def pair_keys(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs, from all bits of both; they are looked up within a bucket."""
    return mix64(word * MIX + mix64(context) * np.uint64(0xC2B2AE3D27D4EB4F))


def fit(spark: SparkSession, docs: DataFrame, heavy: int = 30_000, often: int = 1_000_000, burn_in: int = 2, samples: int = 3) -> Model:
    """docs (text) -> the model."""
    scratch = Scratch(spark)
    frequent, n = frequent_words(docs, heavy)
    buckets = 8 + n // 1_500_000  # by the data alone: buckets send each other messages
    bins = Bins(frequent, buckets)
    counts = scratch.save(pair_counts(docs, bins), "counts")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch, ["w", "count"], KINDS):
                _, dishes = np.unique(x["w"], return_counts=True)
                words = np.unique(x["w"])
                own = place(frequent, words) < 0
                at = place(frequent, x["w"])
                some = at >= 0
                yield pack([{"frequent_sum": np.bincount(at[some], x["count"][some], len(frequent)), "sum": [int((x["count"] == 1).sum()), int((x["count"] == 2).sum()), int((own & (dishes == 1)).sum()), int((own & (dishes == 2)).sum()), int(own.sum())]}], "frequent_sum binary, sum binary")

    tokens_of, sums = np.zeros(len(frequent), np.int64), np.zeros(5)
    for r in counts.mapInArrow(describe, "frequent_sum binary, sum binary").toLocalIterator():
        tokens_of += np.frombuffer(r[0], "<i8")
        sums += np.frombuffer(r[1], "<f8")
    discount = lambda n1, n2: float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.05, 0.95))
    d, d0 = discount(*sums[:2]), discount(*sums[2:4])
    vocabulary = int(sums[4] + (tokens_of > 0).sum())
    contexts = scratch.save(contexts_of(counts, buckets), "contexts")
    state = scratch.save(first_state(counts, bins, d, d0), "seats")
    customers, tables, of_frequent = totals(state, len(frequent))
    random = np.random.default_rng(3)
    seated = sequential(of_frequent, np.full(len(frequent), 0.01), np.zeros(len(frequent)), d0, random) if len(frequent) else np.zeros(0, np.int64)
    parent = Parent(d, d0, vocabulary, customers, tables + seated.sum(), of_frequent, seated, np.zeros(len(frequent)))
    for k in range(burn_in + samples):
        replies = answers(questions(state, buckets), contexts, buckets, d)
        sample = k >= burn_in
        following = scratch.save(swept(with_answers(state, replies, buckets), parent, k, sample, samples), "seats")
        scratch.drop(state)
        state = following
        customers, tables, of_frequent = totals(state, len(frequent))
        flat = np.full(len(frequent), parent.fresh())
        seated = seated_anew(of_frequent, flat, np.full(len(frequent), d0 / (vocabulary + 1)), d0, random)
        before = parent
        parent = Parent(d, d0, vocabulary, customers, tables + seated.sum(), of_frequent, seated, before.p, before.samples, before.unseen_sum)
        if sample:  # buckets' words were judged under the totals before
            parent.p = parent.p + before.probability(of_frequent, seated) / samples
            parent.unseen_sum += before.unseen() / samples
    return predictions(scratch, counts, state, contexts, parent, bins, n, tokens_of, often)


def predictions(scratch: Scratch, counts: DataFrame, state: DataFrame, contexts: DataFrame, parent: Parent, bins: Bins, n: int, tokens_of: np.ndarray, often: int) -> Model:
    """Averages, scaled to sum to 1, as a model to look words and pairs up in."""
    d, buckets, frequent = parent.d, bins.buckets, bins.frequent

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucket_rows(batches, ["bucket", "part", "asked", "sum", "total", "new"], KINDS):
            known = rows[0]
            tables = known["new"].copy()
            for r in rows[1:]:
                tables += np.bincount(place(known["asked"], r["asked"]), r["sum"], len(tables))
            yield pack([{"bucket": known["bucket"], "part": -1, "asked": known["asked"], "total": THETA + known["total"], "new": np.log10((THETA + d * tables) / (THETA + known["total"]))}], "bucket long, part long, asked binary, total binary, new binary")

    asked = questions(state, buckets, mean=True)
    both = contexts.select("bucket", "part", "asked", F.lit(None).cast("binary").alias("sum"), "total", "new").union(asked.select("bucket", "part", "asked", "sum", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    shares = scratch.save(both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(left, "bucket long, part long, asked binary, total binary, new binary"), "shares")

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((x["p0"].sum() for batch in batches for x in unpacked(batch, ["p0"], KINDS)), 0.0)
        yield pa.RecordBatch.from_pydict({"x": [float(total)]})

    whole = (state.mapInArrow(mass, "x double").agg(F.sum("x")).first()[0] or 0.0) + parent.p.sum() + parent.unseen_sum
    lp0 = np.log10(np.maximum(parent.p / whole, 1e-300))

    # All pairs ask for their contexts' shares and totals.
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch, ["bucket", "u"], KINDS):
                u = np.unique(x["u"])
                to = scaled(u, buckets)
                for s in runs(to):
                    yield pack([{"bucket": int(to[s.start]), "part": x["bucket"], "asked": u[s], "sum": np.zeros(0)}], "bucket long, part long, asked binary, sum binary")

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucket_rows(batches, ["bucket", "part", "asked", "total", "new"], KINDS):
            known = rows[0]
            for r in rows[1:]:
                k = place(known["asked"], r["asked"])
                yield pack([{"bucket": r["part"], "kind": 2, "part": known["bucket"], "new": known["new"][k], "total": known["total"][k]}], "bucket long, kind int, part long, new binary, total binary")

    asked = counts.select("bucket", "u").mapInArrow(ask, "bucket long, part long, asked binary, sum binary")
    none = F.lit(None).cast("binary")
    both = shares.select("bucket", "part", "asked", "total", "new").union(asked.select("bucket", "part", "asked", none, none))
    replies = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(reply, "bucket long, kind int, part long, new binary, total binary")
    rows = (
        counts.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), "w", "u", "count", none.alias("p0"), none.alias("mean"), none.alias("new"), none.alias("total"))
        .union(state.where("kind = 0").select("bucket", F.lit(1), F.lit(0).cast("long"), none, none, none, "p0", "mean", none, none))
        .union(replies.select("bucket", "kind", "part", none, none, none, none, none, "new", "total")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, *found in bucket_rows(batches, ["bucket", "kind", "part", "w", "u", "count", "p0", "mean", "new", "total"], KINDS):
            first = np.flatnonzero(np.concatenate(([True], x["w"][1:] != x["w"][:-1])))
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x["w"]))))
            word = x["w"][first]
            at = place(frequent, word)
            p = np.empty(len(word))
            p[at < 0], p[at >= 0] = y["p0"] / whole, 10 ** lp0[at[at >= 0]]
            tables = np.ones(len(row))
            tables[x["count"] > 1] = y["mean"]
            _, of = np.unique(x["u"], return_inverse=True)
            new, total = (np.concatenate([r[k] for r in found])[of] for k in ("new", "total"))
            lp = np.log10((x["count"] - d * tables) / total + 10**new * p[row])
            mine = at < 0
            total = np.add.reduceat(x["count"], first)
            total[~mine] = tokens_of[at[~mine]]
            keys = pair_keys(x["w"], x["u"])
            some = x["count"] >= n / often
            order = np.argsort(keys)
            base = np.log10((total + 0.5) / (n + 0.5 * (parent.vocabulary + 1)))
            yield pack([{"bucket": x["bucket"], "word": word[mine], "count": total[mine], "p0": np.log10(p[mine]), "pair": keys[order], "lp": lp[order],
                         "often": keys[some], "often_lp": lp[some], "often_base": base[row[some]]}], MODEL)

    model = scratch.save(rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "part").mapInArrow(finish, MODEL), "model")
    common = np.unique(np.append(frequent, END))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch, ["asked", "new"], KINDS):
                k = place(x["asked"], common)
                some = k >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(some)), pa.array(x["new"][k[some]])], ["k", "new"])

    back_off = np.zeros(len(common))
    got = shares.mapInArrow(pick, "k long, new double").toArrow()  # at most a row for each frequent word
    back_off[got["k"].to_numpy()] = got["new"].to_numpy()
    scratch.drop(state, counts, contexts)
    return Model(bins, model, shares, parent, n, tokens_of, lp0, common, back_off, float(np.log10(parent.unseen_sum / whole)) if n else 0.0)


# Scoring


def held_out(rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == rest, F.lit(False))


SUMS = "doc binary, known binary, base binary, score binary, tokens binary, doc_id binary, no_id binary, held binary"
TOKENS = "bucket long, part long, kind int, w_all binary, u_all binary, row binary, " + SUMS
LOOKED = "chunk long, bucket long, kind int, u_all binary, chunks binary, " + SUMS


def by_document(doc: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Documents, and sums of values by document."""
    docs, at = np.unique(doc, return_inverse=True)
    return docs, *(np.bincount(at, v, len(docs)) for v in values)


def scores(spark: SparkSession, docs: DataFrame, train: Column, heavy: int = 30_000, often: int = 1_000_000, chunk_tokens: int = 1_000_000, slices: int = 3) -> DataFrame:
    """docs (doc_id, text) -> one row each; the model learns from rows where ``train`` holds."""
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    model = fit(spark, docs.where("train"), heavy, often)
    bins, buckets, fixed = model.bins, model.bins.buckets, model.lookup()
    # The pairs met often (at most ``often``) and the frequent words: bounded whatever the corpus.
    met = model.words.select("often", "often_lp", "often_base").toArrow()
    keys, lp, base = (np.frombuffer(b"".join(met[c].to_pylist()), KINDS[c]) for c in ("often", "often_lp", "often_base"))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], lp[order], base[order]))

    def chunks(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple[int, list, list, list]]:
        """Parts of a task's rows: number (in one slice only), ids, train flags, texts."""
        from pyspark import TaskContext

        chunk, held, size = part << 56 | TaskContext.get().partitionId() << 32, ([], [], []), 0
        for batch in batches:
            texts = binary_list(batch.column(1))
            for a in range(0, len(texts), 256):
                some = texts[a : a + 256]
                for h, x in zip(held, (batch.column(0).slice(a, 256).to_pylist(), batch.column(2).slice(a, 256).to_pylist(), some), strict=True):
                    h.extend(x)
                size += sum(len(t or b"") // 6 + 1 for t in some)
                if size >= chunk_tokens:
                    yield chunk, *held
                    chunk, held, size = chunk + 1, ([], [], []), 0
        if held[0]:
            yield chunk, *held

    none = dict.fromkeys(x.split()[0] for x in TOKENS.split(", "))
    sums_of = [x.split()[0] for x in SUMS.split(", ")]

    def look(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        keys, lp, base = shared.value
        seen = np.zeros(1 << 22, bool)  # keeps most other pairs from being looked up
        seen[keys & np.uint64((1 << 22) - 1)] = True
        for chunk, ids, trained, texts in chunks(batches, part):
            w, u, doc = tokens(texts)
            asked = pair_keys(w, u)
            at = np.full(len(asked), -1, np.int64)
            maybe = np.flatnonzero(seen[asked & np.uint64((1 << 22) - 1)])
            at[maybe] = place(keys, asked[maybe])
            hit, m = at >= 0, len(ids)
            k = doc[hit]
            yield pack([{**none, "bucket": chunk % buckets, "part": chunk, "kind": 1, "doc": np.arange(m), "tokens": np.bincount(doc, minlength=m), "known": np.bincount(k, minlength=m), "base": np.bincount(k, base[at[hit]], m),
                         "score": np.bincount(k, lp[at[hit]], m), "doc_id": [i or 0 for i in ids], "no_id": [i is None for i in ids], "held": [not t for t in trained]}], TOKENS)
            w, u, doc = w[~hit], u[~hit], doc[~hit]
            bucket = bins.of(w, u)
            order = in_buckets(bucket, bins.buckets)
            rows = [order[s] for s in runs(bucket[order])]
            for a in range(0, len(rows), 64):
                yield pack([{**none, "bucket": int(bucket[o[0]]), "part": chunk, "kind": 2, "w_all": w[o], "u_all": u[o], "row": doc[o]} for o in rows[a : a + 64]], TOKENS)

    nothing = F.lit(None).cast("binary")
    lean = [nothing.alias(c) for c in ("w_all", "u_all", "row", *sums_of)]
    parts_of_model = ["word", "count", "p0", "pair", "lp"]
    known_rows = model.words.select("bucket", F.lit(-1).cast("long").alias("part"), F.lit(0).alias("kind"), *lean, *parts_of_model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, common, back_off = fixed.bins.frequent, fixed.common, fixed.back_off
        empty = {k: np.zeros(0, KINDS[k]) for k in parts_of_model}
        unsaid = dict.fromkeys(["u_all", "chunks", *sums_of])

        def judged(known: dict, words: np.ndarray, rows: list[dict]) -> pa.RecordBatch:
            w, u, doc = (np.concatenate([x[k] for x in rows]) for k in ("w_all", "u_all", "row"))
            place_of = np.repeat(np.arange(len(rows)), [len(x["row"]) for x in rows]) << 32 | doc  # row and document
            order = np.argsort(w)  # lookups in order go through memory in order
            w, u, place_of = w[order], u[order], place_of[order]
            f, at = place(frequent, w), place(words, w)
            count, lp0 = np.zeros(len(w), np.int64), np.full(len(w), fixed.unseen)
            for k, counts, values in ((f, fixed.counts, fixed.lp0), (at, known["count"], known["p0"])):
                count[k >= 0], lp0[k >= 0] = counts[k[k >= 0]], values[k[k >= 0]]
            keys = pair_keys(w, u)
            order = np.argsort(keys)
            pair = np.empty(len(keys), np.int64)
            pair[order] = place(known["pair"], keys[order])
            context = place(common, u)
            score = np.where(context >= 0, back_off[context], 0.0) + lp0
            score[pair >= 0] = known["lp"][pair[pair >= 0]]
            order = np.argsort(place_of)
            place_of = place_of[order]
            first = np.flatnonzero(np.concatenate(([True], place_of[1:] != place_of[:-1])))
            k, b, v = (np.add.reduceat(x[order], first) for x in ((count > 0).astype(np.int64), fixed.base(count), score))
            chunk = np.array([x["part"] for x in rows])
            line, doc = place_of[first] >> 32, place_of[first] & 0xFFFFFFFF
            out = [{**unsaid, "chunk": int(chunk[line[s.start]]), "bucket": -1, "kind": 1, "doc": doc[s], "known": k[s], "base": b[s], "score": v[s]} for s in runs(line)]
            more = np.flatnonzero(((pair < 0) & (context < 0))[order])
            u, place_of = u[order[more]], place_of[more]
            to = scaled(u, buckets)
            order = in_buckets(to, buckets)
            u, place_of, to = u[order], place_of[order], to[order]
            for s in runs(to):
                out.append({**unsaid, "chunk": -1, "bucket": int(to[s.start]), "kind": 1, "doc": place_of[s] & 0xFFFFFFFF, "chunks": chunk[place_of[s] >> 32], "u_all": u[s]})
            return pack(out, LOOKED)

        bucket, known, words, held, size = None, empty, empty["word"], [], 0
        for batch in batches:
            for x in unpacked(batch, ["bucket", "part", "kind", "w_all", "u_all", "row", *sums_of, *parts_of_model], KINDS):
                if held and (x["bucket"] != bucket or size > 1_000_000):
                    yield judged(known, words, held)
                    held, size = [], 0
                if x["bucket"] != bucket:
                    bucket, known, words = x["bucket"], empty, empty["word"]
                if x["kind"] == 0:
                    known, words = x, x["word"]
                elif x["kind"] == 1:  # what a chunk found by itself only passes through
                    yield pack([{**unsaid, "chunk": x["part"], "bucket": -1, "kind": 0, **{c: x[c] for c in sums_of}}], LOOKED)
                else:
                    held.append(x)
                    size += len(x["row"])
        if held:
            yield judged(known, words, held)

    looked = None
    for part in range(slices):  # the tokens of one slice of the documents are on their way at a time
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == part)
        asked = known_rows.union(some.mapInArrow(lambda batches, part=part: look(batches, part), TOKENS).select("*", *[nothing] * 5))
        done = scratch.save(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "part").mapInArrow(answer, LOOKED), "looked")
        looked = done if looked is None else looked.union(done)
    scratch.drop(model.words)
    rest = model.contexts.select("bucket", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("kind"), nothing.alias("doc"), nothing.alias("u_all"), nothing.alias("chunks"), "asked", F.col("new").alias("base")).union(
        looked.where("bucket >= 0").select("bucket", "chunk", "kind", "doc", "u_all", "chunks", nothing, nothing))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucket_rows(batches, ["bucket", "kind", "doc", "u_all", "chunks", "asked", "base"], KINDS):
            known = rows[0] if rows[0]["kind"] == 0 else None
            rows = rows[known is not None :]
            if not rows:
                continue
            asked = known["asked"] if known else np.zeros(0, np.uint64)
            u, doc, chunk = (np.concatenate([r[k] for r in rows]) for k in ("u_all", "doc", "chunks"))
            at = place(asked, u)
            share = np.where(at >= 0, known["base"][at], 0.0) if known else np.zeros(len(at))  # a context never seen leaves all
            order = np.argsort(chunk, kind="stable")
            out = []
            for s in runs(chunk[order]):
                docs, v = by_document(doc[order[s]], share[order[s]])
                zero = np.zeros(len(docs))
                out.append({**dict.fromkeys(["u_all", "chunks", *sums_of]), "chunk": int(chunk[order[s.start]]), "bucket": -1, "kind": 1, "doc": docs, "known": zero, "base": zero, "score": v})
            yield pack(out, LOOKED)

    heads, n = ["chunk", "kind", *sums_of], model.n
    rows = looked.where("bucket = -1").select(*heads).union(rest.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(shares, LOOKED).select(*heads))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, *more in bucket_rows(batches, heads, KINDS):
            known, base, score = x["known"].astype(np.int64), x["base"].copy(), x["score"].copy()
            for r in more:
                known[r["doc"]] += r["known"]
                base[r["doc"]] += r["base"]
                score[r["doc"]] += r["score"]
            size = len(known)
            yield pa.RecordBatch.from_arrays([
                pa.array(x["doc_id"], mask=x["no_id"]), pa.array(x["held"]), pa.array(x["tokens"]), pa.array(known), pa.array(np.full(size, n)), pa.array(base), pa.array(score),
            ], [f.split()[0] for f in result.split(", ")])

    return rows.repartition(buckets, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(sums, result)
