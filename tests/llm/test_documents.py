"""Operators on documents against brute force on small fixtures."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from sieveline.llm import decontam, langid, line_dedup, minhash_dedup, packing, pitman_yor, suffix_dedup
from sieveline.llm.queries import vocabulary
from sieveline.llm.suffix_array import permuted_common_prefixes, suffix_array


def unique(rows):
    return sorted({r[0]: r for r in rows}.values())


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


class Classes(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("k", [4, 5])
def test_minhash(docs, rows, spark, k):
    sets = {}
    for i, t, *_ in unique(rows):
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    classes = Classes()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                classes.join(a, b)
    found = minhash_dedup.near_duplicates(spark, docs, k=k)
    assert found.count() == len(rows)
    for i, r in by_id(found).items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), classes.root(i), classes.root(i) == i)


def test_minhash_clouds_of_near_copies(spark):
    import random

    r = random.Random(4)
    base = [f"w{r.randint(0, 9999)}" for _ in range(100)]
    texts = []
    for _ in range(150):  # edits of edits: links form a tangle in which no text is near all others
        words = list(r.choice(texts).split() if texts and r.random() < 0.8 else base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(100)] = f"v{r.randint(0, 99999)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(97)} for t in texts]
    classes = Classes()
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                classes.join(a, b)
    found = by_id(minhash_dedup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=4))
    assert [found[i]["component_id"] for i in range(150)] == [classes.root(i) for i in range(150)]


def test_lines(docs, rows, spark):
    seen, kept, gone = [], {}, {}
    for i, t, *_ in unique(rows):
        out, n = [], 0
        for line in (t or "").split("\n"):
            s = set(line.encode().lower().split())
            if s and any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                n += 1
            else:
                out.append(line)
            if s:
                seen.append(s)
        kept[i], gone[i] = ("\n".join(out) if t is not None else None), n
    found = line_dedup.deduplicate(spark, docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"] and found.count() == len(rows)
    assert {i: (r["text"], r["n_removed"]) for i, r in by_id(found).items()} == {i: (kept[i], gone[i]) for i in kept}


def test_suffix_array_is_the_order_of_suffixes():
    import random

    import numpy as np

    r = random.Random(1)
    for _ in range(200):
        t = np.array([r.randint(1, r.choice([1, 2, 4, 9])) for _ in range(r.randint(1, 50))] + [0], np.uint16)
        order = suffix_array(t, int(t.max()) + 1)
        assert order.tolist() == suffix_array(t.astype(np.int32), int(t.max()) + 1, bytewise=False).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        plcp = permuted_common_prefixes(t, order, np.array([0, len(t) // 2]), np.array([len(t) // 2, len(t) - len(t) // 2]), 100)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert plcp[b] == n


def test_suffix_array_of_many_names():
    import random

    import numpy as np

    r = random.Random(2)
    words = [bytes(r.choices(b"abcdefgh", k=r.randint(3, 9))) for _ in range(4000)]
    raw = b" ".join(r.choices(words, k=12_000)) + b" " + b"ab" * 800 + b"z" * 900
    t = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + np.uint16(2), np.uint16(0))
    order = suffix_array(t, 258)
    assert order[0] == len(raw) and order[1:].tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    # The reduced string has far more than 1,024 names.
    names = len({raw[i : i + 6] for i in range(len(raw))})
    assert names > 10_000


def test_repeated_bytes(docs, rows, spark):
    first, want = {}, {}
    for i, t, *_ in unique(rows):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.get(b[k : k + 50], i) < i:
                covered[k : k + 50] = b"\1" * 50
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        want[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(c for c, x in zip(b, covered, strict=True) if not x)).hexdigest())
    found = suffix_dedup.deduplicate(spark, docs)
    assert found.count() == len(rows)
    assert {i: tuple(r)[1:] for i, r in by_id(found).items()} == want


def test_cuts_are_few_and_dealt_in_few_rows(spark, monkeypatch):
    """Strings far shorter than what is looked for cause no cuts, and a task's rows do not grow with its texts times the shards."""
    import random

    r = random.Random(4)
    plain = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    shared = [plain(24) for _ in range(40)]

    def cut(rows):
        texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        found = suffix_dedup.by_document(suffix_dedup.repeated(suffix_dedup.anchors(texts, 50, 16, 8).coalesce(1)), 8)
        joined = texts.join(found, texts["doc_id"] == found["id"]).select("doc_id", "text", "shared").coalesce(1)
        return suffix_dedup.cut_out(joined, 50, 16, 8, 5).collect()

    assert cut([(i, plain(40).join(shared)) for i in range(4)]) == []
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    passages = [plain(120) for _ in range(30)]
    rows = cut([(i, plain(40).join(r.sample(passages, 10))) for i in range(20)])
    assert len({x["shard"] for x in rows}) == len(rows) <= 5 and sum(len(x["bytes"]) for x in rows) > 20 * 10 * 120


def test_packing_round_trip(docs, rows, spark):
    import numpy as np
    from tokenizers import Tokenizer

    name = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(name)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    found = packing.pack(spark, docs, name, capacity=256).collect()
    by_sequence, parts = collections.defaultdict(list), collections.defaultdict(dict)
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 256 * r["piece"]
        parts[r["doc_id"]][r["piece"]] = part
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in parts.items()} == ids
    total = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
        total += at
    assert len(by_sequence) <= 1.05 * total / 256 + 2


def test_chunks_give_the_tokenizers_ids():
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = ["İstanbul ÅNGSTRÖM. ﬁx a.. don't 3.14, <|endoftext|> x y ét́ Å Ȧ., <|STARTOFTEXT|>", "", "  ", "Élan, naïve. ß", "x y z, 漢字かな.", "it's (good) [no]..."]
    for text, ids in zip(texts, packing.ChunkIds(tokenizer)([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_language(docs, rows, spark):
    pieces = vocabulary("piece_bpe_32k.model")
    langs, p = langid.fit(spark, docs.where(~langid.held_out()), pieces)
    found = langid.predict(spark, docs, langs, p, pieces)
    assert langs == ["de", "en"] and found.columns == [*docs.columns, "lang_pred", "score"]
    right = [(r["lang"] == r["lang_pred"]) for r in found.where(langid.held_out()).collect() if r["lang"] and len(r["text"] or "") > 60 and not r["text"].startswith(("x", "é", "a"))]
    assert sum(right) >= 0.9 * len(right) > 0
    for r in found.collect():
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    own = langid.Pieces(pieces)
    number = {x: i for i, x in enumerate(own.pieces)}

    def total(s, k, at=0):
        if at == len(s):
            return 1.0
        ends = range(at + 1, min(len(s), at + own.longest) + 1)
        return sum((p[number[s[at:e]], k] if s[at:e] in number else (langid.UNKNOWN if e == at + 1 else 0)) * total(s, k, e) for e in ends)

    words = ["thing", "über", "漢a"]
    scores = langid.log_scores(words, langid.scaled(p, own), own)
    for i, w in enumerate(words):
        for k in range(2):
            assert math.isclose(math.log(total(langid.MARK + w, k)), scores[i, k], rel_tol=1e-9)


def test_long_runs_of_letters(spark, docs):
    import numpy as np

    name = vocabulary("piece_bpe_32k.model")
    langs, p = langid.fit(spark, docs.where(~langid.held_out()), name)
    own = langid.Pieces(name)
    table = langid.scaled(p, own)
    for word in ("thereingthe" * 3, "verkeitundüber" * 2 + "漢字"):  # plain and rescaled recursions agree, in scores and in expected counts
        plain, counts = langid.log_scores([word], table, own), langid.expected([word], np.array([1]), np.array([2.0]), table, own)
        kept, langid.PLAIN = langid.PLAIN, 3
        try:
            assert np.allclose(plain, langid.log_scores([word], table, own), rtol=1e-9)
            assert np.allclose(counts, langid.expected([word], np.array([1]), np.array([2.0]), table, own), rtol=1e-9)
        finally:
            langid.PLAIN = kept
    texts = ["ꙮ" * 64, "ꙮ" * 5000, "the of er " * 3 + "漢" * 700, "x" * 20000, None, "12 !"]
    asked = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    found = by_id(langid.predict(spark, asked, langs, p, name))
    assert all(0 < found[k]["score"] <= 1 and found[k]["lang_pred"] in langs for k in range(4)) and found[2]["lang_pred"] == "en"
    assert [(found[k]["lang_pred"], found[k]["score"], found[k]["score_input"]) for k in (4, 5)] == [("und", 0.0, "own")] * 2
    # A text that learning meets, too.
    again, q = langid.fit(spark, spark.createDataFrame([(1, "ꙮ" * 3000 + " the", "en"), (2, "über", "de")], "doc_id long, text string, lang string"), name)
    assert again == ["de", "en"] and np.isfinite(q).all() and np.allclose(q.sum(axis=0), 1)


def test_language_model(docs, rows, spark):
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = collections.Counter(w for i, *_ in rows if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    found = pitman_yor.scores(spark, docs, ~pitman_yor.held_out(), heavy=50)  # so that most words take the join
    assert found.count() == len(rows)
    for i, r in by_id(found).items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), rel_tol=1e-9)
    kept = [r for r in found.collect() if not r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)


def bigrams(rows):
    for i, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), b"\n"]
        yield i, list(zip([b"\n", *words], words, strict=False))


def test_language_model_against_its_own_numbers(docs, rows, spark):
    """Every score is the sum of what the model's tables say of each token, and these sum to 1 over the vocabulary."""
    import numpy as np

    model = pitman_yor.fit(spark, docs.where(~pitman_yor.held_out()), heavy=50, often=200)
    hashed = lambda w: pitman_yor.END if w == b"\n" else pitman_yor.hashed_words(w)[0][0]
    get = lambda r, c: np.frombuffer(r[c], pitman_yor.KINDS[c])
    lp0 = dict(zip(model.bins.frequent.tolist(), model.lp0.tolist(), strict=True))
    pairs, left = {}, {}
    for r in model.words.collect():
        lp0.update(zip(get(r, "word").tolist(), get(r, "p0").tolist(), strict=True))
        pairs.update(zip(get(r, "pair").tolist(), get(r, "lp").tolist(), strict=True))
    for r in model.contexts.collect():
        left.update(zip(get(r, "asked").tolist(), get(r, "new").tolist(), strict=True))
    assert abs(sum(10**x for x in lp0.values()) + 10**model.unseen - 1) < 1e-9
    key = lambda w, u: int(pitman_yor.pair_keys(np.array([w]), np.array([u]))[0])

    def lp(w, u):
        return pairs.get(key(w, u), left.get(int(u), 0.0) + lp0.get(int(w), model.unseen))

    for u in [*sorted(left)[:25], int(pitman_yor.END)]:
        u = np.uint64(u)
        assert abs(sum(10 ** lp(np.uint64(w), u) for w in lp0) + 10 ** lp(np.uint64(12345), u) - 1) < 1e-6
    found = {}
    for r in pitman_yor.scores(spark, docs, ~pitman_yor.held_out(), heavy=50, often=200, chunk_tokens=300).collect():
        found.setdefault(r["doc_id"], r)
    for i, some in bigrams(rows):
        want = sum(lp(hashed(w), hashed(u)) for u, w in some)
        assert math.isclose(found[i]["score"], want, rel_tol=1e-5, abs_tol=1e-3), i


def test_language_model_beats_smoothed_bigrams_on_held_out_texts(spark):
    import random

    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    follow = {w: r.choices(words, weights=[1 / (k + 1) for k in range(400)], k=6) for w in words}
    rows = []
    for i in range(700):
        t = [r.choice(words)]
        while len(t) < 40:
            t.append(r.choice(follow[t[-1]]) if r.random() < 0.85 else r.choice(words))
        rows.append((i, " ".join(t)))
    found = pitman_yor.scores(spark, spark.createDataFrame(rows, "doc_id long, text string"), ~pitman_yor.held_out()).collect()
    held = {x["doc_id"]: x for x in found if x["held_out"]}
    one, two, total = collections.Counter(), collections.Counter(), collections.Counter()
    for i, some in bigrams(rows):
        if i not in held:
            one.update(w for _, w in some)
            two.update(some)
            total.update(u for u, _ in some)
    n, v = sum(one.values()), len(one)
    unigram = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    smoothed = sum(math.log10((two[u, w] + 10 * unigram(w)) / (total[u] + 10)) for i, some in bigrams(rows) if i in held for u, w in some)
    score, base = sum(x["score"] for x in held.values()), sum(x["base_score"] for x in held.values())
    assert score > 0.97 * smoothed and score > 0.85 * base  # scores are negative


def test_words_alike_in_40_bits_of_their_hashes(spark):
    """Words whose hashes begin alike are different words: n_known and base_score are exact."""
    one, two = (pitman_yor.hashed_words(w)[0][0] for w in (b"w1726740", b"w2066413"))
    assert int(one) >> 24 == int(two) >> 24 and one != two
    trained = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 != 1)
    asked = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(trained, "w1726740 w1726740 x"), (asked, "w2066413"), (None, None)]
    found = by_id(pitman_yor.scores(spark, spark.createDataFrame(rows, "doc_id long, text string"), ~pitman_yor.held_out()))
    n, v = 5, 3  # the null text is trained on: one end more
    assert (found[asked]["n_known"], found[asked]["n_tokens"], found[trained]["n_known"]) == (1, 2, 4) and found[asked]["train_tokens"] == n
    assert math.isclose(found[asked]["base_score"], sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in (0, 2)), rel_tol=1e-9)


def test_alike_words_among_many_contexts(spark):
    """Words alike in 40 bits of their hashes, both trained on after many words, and long words of one polynomial are told apart."""
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    one, other = morse[:1024], morse[1024:]
    from sieveline.llm.common import segment_words

    assert [len(x) for x in segment_words(b"", {})] == [0, 0, 0]  # a worker's first texts are all empty
    assert one != other and len(set(pitman_yor.hashed_words(f"{one} {other}".encode())[0].tolist())) == 2
    train, held = ([i for i in range(99) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (False, True))
    text = " ".join(f"c{k} w1726740 d{k} w2066413" for k in range(40))
    rows = [(train[0], text), (train[1], f"{one} {one}"), (held[0], f"w1726740 w2066413 {one} unseen"), (held[1], other)]
    tokens = {i: [*t.split(), "\n"] for i, t in rows}
    count = collections.Counter(w for i in train[:2] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, r in by_id(pitman_yor.scores(spark, spark.createDataFrame(rows, "doc_id long, text string"), ~pitman_yor.held_out())).items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), rel_tol=1e-9)


def test_every_sweep_seats_all_customers_anew():
    """One sweep from any seating gives the distribution itself, for small dishes (table) and large ones (integral)."""
    import inspect

    import numpy as np

    assert "seats" not in inspect.signature(pitman_yor.fit).parameters
    random, m = np.random.default_rng(0), 4000
    for c, d, fresh, more in ((2, 0.5, 0.4, 0.1), (200, 0.7, 2.0, 0.1), (1500, 0.85, 0.3, 0.02), (1500, 0.4, 40.0, 0.01)):
        stirling = np.zeros(1)  # logs of the row of c
        for n in range(2, c + 1):
            old = stirling + np.log(n - 1 - d * np.arange(1, n))
            stirling = np.logaddexp(np.append(-np.inf, stirling), np.append(old, -np.inf))
        want = stirling + np.append(0, np.cumsum(np.log(fresh + more * np.arange(1, c))))
        want = np.exp(want - want.max())
        want /= want.sum()
        found = pitman_yor.seated_anew(np.full(m, c), np.full(m, fresh), np.full(m, more), d, random)
        assert found.min() >= 1 and found.max() <= c
        assert np.abs(np.cumsum(np.bincount(found, minlength=c + 1)[1:]) / m - np.cumsum(want)).max() < 0.035
    assert pitman_yor.seated_anew(np.array([1, 0, 1]), np.ones(3), np.ones(3), 0.5, random).tolist() == [1, 1, 1]
    t = np.arange(1.0, 1400.0, 7)
    error = stirling[t.astype(int) - 1] - pitman_yor.log_stirling(np.full(len(t), 1500.0), t, 0.4)
    assert np.ptp(error) < 1e-6


def test_contamination(docs, rows, spark):
    texts = {i: t for i, t, *_ in rows if t and len(t.split()) > 60}
    ids = sorted(texts)
    middle = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(k, middle(texts[i], 5, 45)) for k, i in enumerate(ids[:6])] + [(98, "completely unrelated question about nothing that any document holds. Nobody knows it"), (99, None), (97, "")]
    changed = items[0][1].split()
    changed[7] = "paraphrased"
    extra = [(100_000, "before it " + " ".join(changed) + " after it", "en", "s", 1, 1), (100_001, items[1][1].upper() + ".", "en", "s", 1, 1)]
    found = by_id(decontam.decontaminate(spark, docs.union(spark.createDataFrame(extra, docs.schema)), spark.createDataFrame(items, "item_id long, text string")))
    norm = lambda t: b" " + b" ".join(decontam.words_of(t or "")) + b" "
    for i, t, *_ in rows:
        want = {k for k, x in items if x and norm(x) in norm(t)}
        assert want <= set(found[i]["item_ids"]) and not {97, 98, 99} & set(found[i]["item_ids"]), i
    assert 0 in found[100_000]["item_ids"] and 1 in found[100_001]["item_ids"]


def test_weighted_sums_are_the_products_of_sparse_and_dense_rows():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 40, 2, 16, 17, 1, 3])
    rows, x, dense = rng.integers(0, 9, sizes.sum()), rng.random(sizes.sum()), rng.random((9, 5))
    ends = np.cumsum(sizes)
    for depth in (1, 2, 16, 50):
        found = decontam.weighted_sums(x, rows, dense, sizes, depth)
        for y, a, b in zip(found, ends - sizes, ends, strict=True):
            assert np.allclose(y, x[a:b] @ dense[rows[a:b]])
    assert decontam.weighted_sums(x[:0], rows[:0], dense, sizes[:0]).shape == (0, 5)


def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([(1, "some words to look for")], "item_id long, text string")
    for df in (minhash_dedup.near_duplicates(spark, empty), line_dedup.deduplicate(spark, empty), suffix_dedup.deduplicate(spark, empty), pitman_yor.scores(spark, empty, ~pitman_yor.held_out()),
               packing.pack(spark, empty, vocabulary("word_bpe_49k.json")), decontam.decontaminate(spark, empty, benchmark)):
        assert df.count() == 0
    langs, p = langid.fit(spark, empty, vocabulary("piece_bpe_32k.model"))
    assert langs == [] and langid.predict(spark, empty, langs, p, vocabulary("piece_bpe_32k.model")).count() == 0


def test_items_that_are_leaked_often_or_hold_common_words_only(spark):
    import random

    r = random.Random(5)
    filler = [f"w{k}" for k in range(3000)]
    common = [f"c{k}" for k in range(12)]
    often, plain, short = " ".join(f"leak{k}" for k in range(30)), " ".join(r.choices(common, k=30)), "c1 c1 c1 x"
    texts = []
    for k in range(600):
        parts = [r.choice(common) if r.random() < 0.5 else r.choice(filler) for _ in range(80)]
        for x in [x for x, every in ((often, 2), (plain, 5), (short, 7)) if k % every == 0]:
            at = r.randrange(len(parts))
            parts[at:at] = [x]
        texts.append((k, " ".join(parts)))
    items = spark.createDataFrame([(0, often), (1, plain), (2, short)], "item_id long, text string")
    found = by_id(decontam.decontaminate(spark, spark.createDataFrame(texts, "doc_id long, text string"), items))
    norm = lambda t: b" " + b" ".join(decontam.words_of(t)) + b" "
    want = [[i for i, x in enumerate((often, plain, short)) if norm(x) in norm(t)] for _, t in texts]
    assert sum(map(len, want)) > 400
    assert all(set(w) <= set(found[k]["item_ids"]) for k, w in enumerate(want))
    assert all(found[k]["item_ids"].count(0) == (0 in w) for k, w in enumerate(want))


@pytest.mark.parametrize(("most", "hot"), [(1, 40), (4, 50_000), (2, 300)])
def test_lines_of_few_words_that_many_share(spark, most, hot):
    import random

    r = random.Random(8)
    words = [f"w{k}" for k in range(14)]
    rows = []
    for k in range(150):
        line = lambda: " ".join(r.choices(words, k=r.choice([1, 2, 6, 9, 12])))
        rows.append((k * 2, "\n".join(line() for _ in range(r.randint(0, 6))) + r.choice(["", "\nRead more here", "\n \n"])))
    seen, want = [], set()
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            s = set(x.lower().split())
            if s and any(100 * len(s & y) >= 80 * len(s | y) for y in seen):
                want.add((i, k))
            if s:
                seen.append(s)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = line_dedup.removed_lines(spark, df, most=most, hot=hot).collect()
    assert len(found) == len(want) > 100 and {tuple(x) for x in found} == want


def test_lines_keep_clashing_columns_and_null_ids(spark):
    text = "a line of some words\na line of some words"
    df = spark.createDataFrame([(None, text, 1, 2), (5, text, 1, 2), (5, text, 3, 4), (6, None, 1, 2)], "doc_id long, text string, n_removed int, gone int")
    found = line_dedup.deduplicate(spark, df)
    assert found.columns == ["doc_id", "text", "n_removed_input", "gone", "n_lines", "n_removed"]
    assert sorted((r["doc_id"] or 0, r["text"], r["n_removed"], r["gone"]) for r in found.collect() if r["text"]) == [(0, text, 0, 2), (5, text[:20], 1, 2), (5, text[:20], 1, 4)]
