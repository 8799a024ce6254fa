import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="session")
def rows():
    """Small documents with copies, near copies, shared passages, long, empty and null texts, and a repeated row."""
    r = random.Random(11)
    syllables = {"en": "the of an in er on re th st ing ed tion".split(), "de": "der und ein sch ich ver ung keit über be".split()}
    word = lambda lang: "".join(r.choices(syllables[lang], k=r.choice([1, 1, 2, 3, 4])))

    def text(lang, n):
        lines = [" ".join(word(lang) for _ in range(r.randint(3, 30))) for _ in range(n)]
        return "\n".join(lines)

    texts = []
    passage = " ".join(word("en") for _ in range(40))
    for k in range(60):
        lang = "en" if k % 3 else "de"
        t = text(lang, r.randint(1, 8))
        if k % 7 == 0:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        texts.append((t, lang))
    for k in range(8):
        texts.append(texts[k * 3])
    for k in range(8):
        words = texts[k * 5][0].split(" ")
        words[len(words) // 2] = "changed"
        texts.append((" ".join(words), texts[k * 5][1]))
    texts += [("", "en"), (None, "en"), ("   \n ", None), ("word", None), ("12345 !!", "en"), ("a b c", "en"), ("a b c", "de"), ("x" * 300, "en"), (text("en", 700), "en"), ("é" * 40 + " ß\n" + "é" * 40, "de"), ("aaaa " * 200, "en")]
    out = [(i * 3 + 1, t, lang, f"src{i % 3}", len(t or ""), i) for i, (t, lang) in enumerate(texts)]
    return [*out, out[4]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
