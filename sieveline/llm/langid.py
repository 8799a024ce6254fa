"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The likelihood of a word (a run of
letters, lower-cased, with the vocabulary's word mark before it) is the sum over all its segmentations into pieces,
which a forward recursion gives; a text's is the product over its words.  The piece probabilities come from expectation maximisation: each
round a forward-backward pass shares every word's count among its segmentations.

Fitting uses at most about ``sample_docs`` labelled documents per language (a documented bound; which ones follows from a
hash of doc_id); every text is then scored whole.  Characters without a piece have a fixed small probability.
Runs of letters may have any length: beyond ``PLAIN`` letters the recursions are rescaled as they go.

Results, one row per input row: its columns, lang_pred and score (the posterior of that language, 0 to 1); input columns of these two
names become lang_pred_input and score_input.  Null text, text without a
letter, or nothing to learn from: ``und``, score 0.  Ties go to the alphabetically first language.  Rows with a null doc_id are
scored like others; they are never learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, keep_apart, mix64, worker_cache

LETTERS = re.compile(r"[^\W\d_]+")
MARK, PLAIN, SCALE, UNKNOWN = "▁", 40, 30.0, 1e-7


def words_of(text: str | None) -> list[str]:
    """The words of a text with a letter, else none."""
    words = LETTERS.findall((text or "").lower())
    if not any(map(str.isalpha, words)) and not any(map(str.isalpha, "".join(words))):
        return []
    return words


class Pieces:
    """The vocabulary's pieces made of letters, found by hash in arrays of substrings."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.pieces = [p for p in found if p == MARK or LETTERS.fullmatch(p.removeprefix(MARK))]
        self.longest = max(map(len, self.pieces))
        self.n = len(self.pieces)
        self.unknown, self.none = self.n, self.n + 1  # rows of the probability table beyond the pieces
        hashes = np.zeros(self.n, np.uint64)
        for i, p in enumerate(self.pieces):
            h = 0
            for c in p:
                h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        mixed = mix64(hashes)
        self.hash = np.append(mixed, np.zeros(2, np.uint64))
        self.tables, left = [], np.arange(self.n)
        for bits in (21, 18, 18, 18):  # a slot holds one piece; those crowded out go to the next table
            slots = np.full(1 << bits, self.none, np.int32)
            at = (mixed[left] >> np.uint64(3 * len(self.tables))) & np.uint64((1 << bits) - 1)
            slots[at] = left
            self.tables.append(slots)
            left = left[slots[at] != left]
        if len(left):
            raise ValueError("the vocabulary does not fit its hash tables")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of polynomial hashes; ``none`` where there is no such piece."""
        m = mix64(h)
        out = np.full(len(h), self.none, np.int32)
        for k, slots in enumerate(self.tables):
            at = slots[(m >> np.uint64(3 * k)) & np.uint64(len(slots) - 1)]
            np.copyto(out, at, where=self.hash[at] == m)
            if k == 0 and (out != self.none).all():
                break
        return out

    @classmethod
    def kept(cls, vocabulary: str) -> Pieces:
        """The worker process's own copy."""
        cache, name = worker_cache(), f"pieces of {vocabulary}"
        if name not in cache:
            cache[name] = cls(vocabulary)
        return cache[name]

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[list[np.ndarray]]]]:
        """By word length: (which words, ids[end][l - 1] of the pieces of length l that stop at end)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            step = max(1, min(20_000, 2_000_000 // int(n)))
            for at in range(0, len(which), step):
                some = which[at : at + step]
                text = np.frombuffer("".join(MARK + words[i] for i in some).encode("utf-32-le"), "<u4").reshape(len(some), n + 1).astype(np.uint64) + np.uint64(1)
                ids: list[list[np.ndarray]] = [[] for _ in range(n + 2)]
                h = np.zeros((len(some), n + 1), np.uint64)
                for size in range(1, min(self.longest, n + 1) + 1):
                    h = h[:, : n + 2 - size] * np.uint64(0x100000001B3) + text[:, size - 1 :]
                    found = self.find(np.ascontiguousarray(h.T).ravel()).reshape(n + 2 - size, len(some))
                    if size == 1:
                        found[found == self.none] = self.unknown
                    for start in range(n + 2 - size):
                        ids[start + size].append(found[start])
                yield some, ids


def forward(ids: list[list[np.ndarray]], p: np.ndarray) -> list[np.ndarray]:
    """alpha[end]: the sum over all segmentations of the first ``end`` characters; p has a row per piece."""
    alpha = [np.ones((len(ids[1][0]), p.shape[1]))]
    for end in range(1, len(ids)):
        total = np.zeros_like(alpha[0])
        for size, found in enumerate(ids[end], 1):
            total += alpha[end - size] * p[found]
        alpha.append(total)
    return alpha


def scaled(p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Rows for unknown characters and for no piece, and a factor per character that keeps products in range."""
    size = np.array([len(x) for x in pieces.pieces], float)[:, None]
    return np.vstack([p * SCALE**size, np.full((1, p.shape[1]), UNKNOWN * SCALE), np.zeros((1, p.shape[1]))])


def passed(ids: list[list[np.ndarray]], weight, backward: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The forward sums alpha[end] (or backward ones), rescaled at each position, and the logs of what they were divided by.

    weight: turns an array of pieces into their probabilities.
    """
    n = len(ids) - 1
    first = np.ones_like(weight(ids[1][0]))
    values, logs = [first] * (n + 1), [np.zeros_like(first)] * (n + 1)
    for step in range(1, n + 1):
        here = n - step if backward else step
        if backward:
            steps = [(here + size, weight(ids[here + size][size - 1])) for size in range(1, n - here + 1) if size <= len(ids[here + size])]
        else:
            steps = [(here - size, weight(found)) for size, found in enumerate(ids[here], 1)]
        most = np.max([logs[k] for k, _ in steps], axis=0)
        total = sum(values[k] * np.exp(np.maximum(logs[k] - most, -700)) * w for k, w in steps)
        values[here], logs[here] = np.where(total > 0, 1.0, 0.0), np.where(total > 0, most + np.log(np.maximum(total, 1e-300)), -1e300)
    return values, logs


def log_scores(words: list[str], p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log likelihood of each word under each language."""
    out = np.zeros((len(words), p.shape[1]))
    for which, ids in pieces.lattices(words):
        last = np.log(forward(ids, p)[-1]) if len(ids) <= PLAIN + 2 else passed(ids, p.__getitem__)[1][-1]
        out[which] = last - (len(ids) - 1) * np.log(SCALE)
    return out


def expected(words: list[str], language: np.ndarray, counts: np.ndarray, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected piece counts of each language, (pieces, languages)."""
    n, k = p.shape
    flat, out = p.ravel(), np.zeros(n * k)
    for which, ids in pieces.lattices(words):
        lang = language[which]
        at = [[found.astype(np.int64) * k + lang for found in x] for x in ids]
        if len(ids) > PLAIN + 2:
            ahead, behind = passed(at, flat.__getitem__)[1], passed(at, flat.__getitem__, backward=True)[1]
            for end in range(1, len(ids)):
                for s, f in enumerate(at[end], 1):
                    np.add.at(out, f, counts[which] * flat[f] * np.exp(np.minimum(ahead[end - s] + behind[end] - ahead[-1], 700)))
            continue
        alpha = [np.ones(len(which))]
        for end in range(1, len(ids)):
            alpha.append(sum(alpha[end - s] * flat[f] for s, f in enumerate(at[end], 1)))
        beta = [np.zeros(len(which)) for _ in ids]
        beta[-1] = counts[which] / alpha[-1]
        for end in range(len(ids) - 1, 0, -1):
            for s, f in enumerate(at[end], 1):
                through = beta[end] * flat[f]
                beta[end - s] += through
                out += np.bincount(f, alpha[end - s] * through, n * k) if len(f) > 5000 else 0
                if len(f) <= 5000:
                    np.add.at(out, f, alpha[end - s] * through)
    return out.reshape(n, k)[: pieces.n]


def fit(spark: SparkSession, labelled: DataFrame, vocabulary: str, sample_docs: int = 2500, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """labelled (doc_id, text, lang) -> languages in order, piece probabilities (pieces, languages)."""
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    pieces = Pieces(vocabulary)
    p = np.full((pieces.n, len(langs)), 1 / pieces.n)
    if not langs:
        return langs, p
    scratch = Scratch(spark)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    chosen = labelled.where((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.save(counted, "words")
    for _ in range(rounds):
        table = scaled(p, pieces)

        def share_out(batches: Iterator[pa.RecordBatch], table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            own, number, total = Pieces.kept(vocabulary), {x: i for i, x in enumerate(langs)}, 0
            for batch in batches:
                if batch.num_rows:
                    language = np.array([number[x] for x in batch.column(0).to_pylist()])
                    total = total + expected(batch.column(1).to_pylist(), language, batch.column(2).to_numpy().astype(float), table, own)
            if isinstance(total, np.ndarray):
                piece, lang = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(piece * len(langs) + lang), "n": pa.array(total[piece, lang])})

        # At most pieces x languages cells come back.
        got = words.coalesce(16).mapInArrow(share_out, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(p.size)
        counts[got["cell"].to_numpy()] = got["n"].to_numpy()
        counts = counts.reshape(p.shape) + 0.05
        p = counts / counts.sum(axis=0)
    return langs, p


def predict(spark: SparkSession, docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns with lang_pred and score."""
    shared = spark.sparkContext.broadcast(p)  # pieces x languages, whatever the corpus
    docs = keep_apart(docs, ["lang_pred", "score"])
    names, at = docs.columns, docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.kept(vocabulary)
        table = scaled(shared.value, pieces)
        seen: dict[str, int] = {}
        rows = np.zeros((1 << 17, len(langs)))
        for batch in batches:
            best, certain = [], []
            texts = batch.column(at).to_pylist()
            for a in range(0, len(texts), 100):
                docs_words = [words_of(t) if langs else [] for t in texts[a : a + 100]]
                new = {w for words in docs_words for w in words if w not in seen}
                if len(seen) + len(new) > 400_000:
                    seen.clear()
                    new = {w for words in docs_words for w in words}
                if new:
                    new = list(new)
                    while len(seen) + len(new) > len(rows):
                        rows = np.concatenate([rows, np.zeros_like(rows)])
                    rows[len(seen) : len(seen) + len(new)] = log_scores(new, table, pieces)
                    seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
                for words in docs_words:
                    if not words:
                        best.append("und")
                        certain.append(0.0)
                        continue
                    total = rows[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    k = int(total.argmax())
                    best.append(langs[k])
                    certain.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(certain, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id", rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == rest, F.lit(False))
