"""Mixing sources to target weights by thresholds on a hash of each document.

The sources, ordered by code point with null last, weigh ``weights``, repeating, and share as many words as the corpus has.
A source's target stops at ``ceiling`` times its words, and what is left over is shared again by weight.  A source then takes
every document a whole number of times, and for the rest once more those documents whose hash is below a threshold of its own.

The threshold is found without sorting documents: words are summed by source and by the leading bits of the hash, running sums
over these buckets give the bucket in which the budget ends, and only the documents of that bucket are summed again by the next
bits, until it holds one document or all bits are used.  Thresholds are nested: a greater budget takes the same documents and
more.  A large document at the threshold leaves part of the budget; ``fillers`` further thresholds, each over the documents not
taken that have at most a quarter of what is left, spend that.

Everything is built of DataFrame functions.  Sums are made before rows are shuffled, so a source with most of the rows is
no heavier than others.  Documents meet their source's thresholds by a broadcast while those are few (checked), else by a
salted join.

Defined results: null text has no words; null is a source of its own, as is the empty string; documents without words are
taken 0 words of; the hash is of doc_id and text, so it is the same in every run, and rows equal in both are taken alike
(copies under other ids are not); null ids count as empty.  Repeated rows each count.  No rows give no rows.  Input columns
called like results keep their values under ``_input``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, keep_apart

RESULTS = ["size", "source_size", "target", "taken"]
HASH_BITS = 60
STEP = 15  # bits of the hash by which one histogram is finer than the one before
FILL = 4  # a filler has at most this part of the budget that is left
BROADCAST_SOURCES, BROADCAST_BYTES, SALTS = 100_000, 16 << 20, 32
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The number of words; each word becomes one letter and white space goes, so that no list of words is made."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(letters, SPACES, "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs with __key (orders sources, null last), __size and __hash."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select(
        "*",
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("__key"),
        words_of(F.col("text")).alias("__size"),
        F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("long").alias("__hash"),
    )


def numbered(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """sources with ``place`` from 0 in the order of __key; partitions are sorted, and counts of them give where each begins."""
    rows = scratch.save(sources.orderBy("__key").withColumn("at", F.monotonically_increasing_id()), "sources", release=False)
    part = F.shiftright("at", 33).alias("part")
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    first = rows.groupBy(part).count().select("part", F.coalesce(before, F.lit(0)).alias("first"))
    placed = rows.withColumn("part", part).join(first, "part")
    return placed.withColumn("place", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "first", "at")


def targets(scratch: Scratch, sources: DataFrame, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """sources (__key, source_size, place) with target, copies (of all documents) and room (words beyond these).

    Each round shares among the sources that are not at their ceiling; the share of a unit of weight only grows, so a source at
    its ceiling stays there.  A round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = scratch.save(sources.withColumn("weight", weight).withColumn("most", ceiling * F.col("source_size")), "weights", release=False)
    words, free = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    words, free, capped = words or 0, free or 1, -1
    left = words
    while True:
        wide = lambda c: c.cast("decimal(38,0)")
        above = wide(F.col("most")) * wide(F.lit(free)) < wide(F.lit(left)) * wide(F.col("weight"))
        held, part, n = rows.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == capped or not part:
            break
        left, free, capped = words - (held or 0), part, n
    share = F.lit(left) * F.col("weight")
    target = F.when(above, F.col("most").cast("double")).otherwise(share.cast("double") / F.lit(free).cast("double"))
    budget = F.when(above, F.col("most")).otherwise(F.call_function("div", share, F.lit(free)))
    copies = F.least(F.lit(ceiling).cast("long"), F.coalesce(F.call_function("div", F.col("budget"), F.nullif("source_size", F.lit(0))), F.lit(0)))
    rows = rows.withColumn("target", target).withColumn("budget", budget).withColumn("copies", copies)
    return rows.select("__key", "source_size", "target", "copies", (F.col("budget") - F.col("copies") * F.col("source_size")).alias("room"))


def beside(rows: DataFrame, few: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of their source; a source with many rows is spread over tasks where no broadcast is made."""
    if small:
        return rows.join(F.broadcast(few), "__key")
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod("__hash", F.lit(SALTS)).cast("int")).join(salted, ["__key", "__salt"]).drop("__salt")


def extra(passes: int) -> Column:
    """Whether a document is taken once more, by the thresholds of some passes."""
    tests = [F.col("__hash") < F.col("cut_0")] if passes else [F.lit(False)]
    tests += [(FILL * F.col("__size") <= F.col(f"left_{k - 1}")) & (F.col("__hash") < F.col(f"cut_{k}")) for k in range(1, passes)]
    return (F.col("__size") > 0) & reduce(Column.__or__, tests)


def threshold(scratch: Scratch, rows: DataFrame, plan: DataFrame, k: int, small: bool) -> DataFrame:
    """plan with cut_k and left_k: documents with a hash below cut_k fit into what pass k may spend, left_k words stay unspent."""
    room = F.col("room") if k == 0 else F.col(f"left_{k - 1}")
    asked = (F.col("__size") > 0) & ~extra(k)
    if k:
        asked = asked & (FILL * F.col("__size") <= room)
    state = plan.withColumn("__prefix", F.lit(0).cast("long")).withColumn("__left", room).withColumn("__open", F.lit(True)).withColumn("__cut", F.lit(1 << HASH_BITS))
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        within = F.col("__open") & (F.shiftright("__hash", shift + STEP) == F.col("__prefix")) & asked
        sums = beside(rows, state, small).where(within).groupBy("__key", "__left", F.shiftright("__hash", shift).alias("bucket")).agg(F.sum("__size").alias("words"), F.count("*").alias("docs"))
        w = Window.partitionBy("__key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^STEP rows a source
        ended = F.col("reach") > F.col("__left")
        found = sums.withColumn("reach", F.sum("words").over(w)).groupBy("__key").agg(
            F.max(F.when(~ended, F.col("reach"))).alias("spent"), F.min(F.when(ended, F.struct("bucket", "docs"))).alias("end"))
        on = F.col("__open")
        next_cut = F.when(on & F.col("end").isNotNull(), F.shiftleft(F.col("end.bucket"), shift)).otherwise(F.col("__cut"))
        state = state.join(found, "__key", "left").select(
            *plan.columns,
            F.coalesce("end.bucket", "__prefix").alias("__prefix"),
            (F.col("__left") - F.when(on, F.coalesce("spent", F.lit(0))).otherwise(0)).alias("__left"),
            F.coalesce(on & (F.col("end.docs") > 1), F.lit(False)).alias("__open"),
            next_cut.alias("__cut"),
        )
        state = scratch.save(state, "thresholds", release=False)
        if not state.where("__open").take(1):
            break
    return state.select(*plan.columns, F.col("__cut").alias(f"cut_{k}"), F.col("__left").alias(f"left_{k}"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, fillers: int = 3) -> DataFrame:
    """docs with size, source_size, target (of the source), and taken: the words the mix takes, repeats counted.

    ``taken / size`` is how many times the mix holds a document.
    """
    scratch = Scratch(spark)
    docs = measured(keep_apart(docs, RESULTS))
    rows = scratch.save(docs.select("__key", "__size", "__hash"), "sizes", release=False)
    sources = numbered(scratch, rows.groupBy("__key").agg(F.sum("__size").alias("source_size")))
    plan = scratch.save(targets(scratch, sources, weights, ceiling), "targets", release=False)
    n, width = plan.agg(F.count("*"), F.sum(F.octet_length("__key") + 120)).first()
    small = n <= BROADCAST_SOURCES and (width or 0) <= BROADCAST_BYTES
    for k in range(1 + fillers):
        plan = threshold(scratch, rows, plan, k, small)
    times = F.col("copies") + extra(1 + fillers).cast("long")
    mixed = beside(docs, plan, small).withColumn("size", F.col("__size")).withColumn("taken", F.col("__size") * times)
    return mixed.select(*[c for c in docs.columns if not c.startswith("__")], *RESULTS)
