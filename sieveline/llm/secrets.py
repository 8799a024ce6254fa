"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything here is DataFrame expressions and Spark ML (JVM code); no row passes through Python.

1. Candidates: words of a text (runs of non-white-space) whose value - what follows a last quote, equals sign or colon -
   has 12 or more characters of base64 or identifier alphabets with a digit among them, or 20 or more with dots between such
   parts (signed tokens), or at least 8 of any kind right behind a credential's name; and the password, of 6 or more characters, of
   ``scheme://user:password@host``.  A text without any such place is skipped by one pattern over the whole text.
2. Features of a candidate: its length; shares of digits, capitals, small letters and signs; transitions between character
   classes, and from consonant to vowel; distinct characters; whether it is all hexadecimal or all digits; the share of
   characters that words of a dictionary cover, and that placeholders do; its dots, and whether it is an address's password; what kind of
   path it stands in; credential names and words of harmless values among the words beside it.  The dictionary is any list of words
   in lower case; ``dictionary_of`` takes the first ``most`` whole words of a public vocabulary, which is ordered by frequency.
3. The forest is trained on labelled findings: any DataFrame (word, before, after, path, label).  ``labelled_findings`` makes a
   public, fixed set of ``n`` rows by rule, half of them secrets of common kinds, half of them what scanners take for secrets.

Results: one row per finding that the forest takes for a secret, (doc_id, position, value_sha256, score); position counts
words from 0.  Null and empty texts, and empty tables, have no findings; a null path is an empty path; repeated rows give repeated
findings, and a null doc_id stays null.  Texts and values may have any length: a text is cut into words in one row.  Other columns of the
table, whatever their names, are not read.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "pass(word|wd|phrase)?|pwd|secret|token|api_?-?key|access_?-?key|private_?-?key|auth|credential|bearer"
HARMLESS = "commit|sha1|sha256|md5|hash|digest|checksum|uuid|guid|version|build|order|invoice|isbn|doi|card|phone|tel|call|fax|tracking|serial|integrity|example|sample|placeholder|dummy|changeme|ref|id"
PLACEHOLDERS = "password|passw0rd|secret|token|changeme|example|sample|default|insert|your|here|test|user|admin|login|name|value|config|index|image|file|path|page|node|data|list|item|table|column|report|release|version|build|update|script|style|button|header|footer|content|section|module|service|server|client|public|private|system|module|number|string|object|class|function|method|return|import|export"
ANY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+\d)[A-Za-z0-9+/_-]{12,}"
DOTTED = r"^(?=.*\d)(?=.*[A-Za-z0-9+/_-]{12})[A-Za-z0-9+/_-]+(\.[A-Za-z0-9+/_-]+)+=*$"
ADDRESS = r"^(.*?\w://[^\s/:@]*:)([^\s/@]{6,})@"  # up to the password, the password
WORDS = 30_000  # of the dictionary: a bound that documents do not move
NAMED = rf"(?i)({NAMES})\w*[\"']?\s?[=:]\s?[\"']?[^\s\"']{{8,}}"


def parts(word: Column) -> tuple[Column, Column]:
    """The name before the last equals sign, colon or quote, and the value after it; of an address with a password, what stands before that, and it."""
    # A closing quote ends a value, whatever signs are stuck to it.
    bare = F.regexp_replace(word, r"[\"'`][^A-Za-z0-9]*$|[,;.!?)\]}>]+$", "")
    either = lambda k, other: F.when(word.rlike(ADDRESS), F.regexp_extract(word, ADDRESS, k)).otherwise(other)
    return either(1, F.regexp_extract(bare, r"^(.*)[=:\"'`(<]", 1)), either(2, F.regexp_extract(bare, r"([^=:\"'`(<]+=*)$", 1))


def dictionary_of(path: str, most: int = WORDS) -> list[str]:
    """The first words of four letters or more, a to z, of a vocabulary whose whole words end in </w>."""
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    words = (w[:-4] for w in sorted(ids, key=ids.get) if w.endswith("</w>"))
    return [w for w in words if len(w) >= 4 and w.isascii() and w.isalpha() and w.islower()][:most]


def features(df: DataFrame, dictionary: list[str]) -> DataFrame:
    """df (word, before, after, path, ...) with columns name, value and the features f_*."""
    if not all(w.isascii() and w.isalpha() for w in dictionary):
        raise ValueError("words of the dictionary must be letters a to z")
    known = ",".join(f"'{w}'" for w in dictionary) or "''"
    # Runs of letters, cut where a small letter meets a capital; membership is one lookup in a hash set of the plan.
    covered = F.expr(
        "aggregate(regexp_extract_all(regexp_replace(value, '([a-z])([A-Z])', '$1 $2'), '[A-Za-z]{4,}', 0), 0, "
        f"(n, w) -> n + if(lower(w) in ({known}), length(w), 0))")  # fmt: skip
    name, value = parts(F.col("word"))
    df = df.withColumn("name", name).withColumn("value", value)
    v, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(v), F.lit(1))
    beside = F.lower(F.concat_ws(" ", "before", "name", "after"))
    near = F.lower(F.concat_ws(" ", "before", "name"))
    return df.select(
        "*",
        n.cast("double").alias("f_length"),
        *[(F.regexp_count(v, F.lit(c)) / n).alias(f"f_{x}") for x, c in (("digits", "[0-9]"), ("capitals", "[A-Z]"), ("small", "[a-z]"), ("signs", "[^A-Za-z0-9]"))],
        (F.regexp_count(v, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n).alias("f_transitions"),
        (F.regexp_count(low, F.lit("[b-df-hj-np-tv-z][aeiou]")) / n).alias("f_syllables"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("f_distinct"),
        v.rlike("^[0-9a-fA-F]+$").cast("double").alias("f_hexadecimal"),
        v.rlike("^[0-9]+$").cast("double").alias("f_number"),
        (covered / n).alias("f_dictionary"),
        (1 - F.length(F.regexp_replace(low, PLACEHOLDERS, "")) / n).alias("f_placeholder"),
        F.regexp_count(v, F.lit(r"\.")).cast("double").alias("f_dots"),
        F.col("word").rlike(ADDRESS).cast("double").alias("f_address"),
        F.coalesce(F.lower("path").rlike("test|example|sample|fixture|mock|docs?/|readme"), F.lit(False)).cast("double").alias("f_path_example"),
        F.coalesce(F.lower("path").rlike(r"\.lock|vendor|node_modules|package|\.min\.|\.svg"), F.lit(False)).cast("double").alias("f_path_generated"),
        near.rlike(NAMES).cast("double").alias("f_named"),
        beside.rlike(rf"\b({HARMLESS})\b").cast("double").alias("f_harmless"),
        v.rlike("^(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|glpat-|AIza|eyJ)").cast("double").alias("f_prefix"),
    )


def feature_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("f_"))


def drawn(alphabet: str, length: int | Column, seed: int) -> Column:
    """A string of characters drawn by the hash of ``id``."""
    size = F.lit(length) if isinstance(length, int) else length
    places = F.sequence(F.lit(1), size.cast("int"))
    return F.concat_ws("", F.transform(places, lambda i: F.substr(F.lit(alphabet), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))))


def one_of(values: list[str], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(values))).cast("int") + 1)


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``n`` labelled findings, made by rule from row numbers: (word, before, after, path, label)."""
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    base64, capitals = alnum + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    length = lambda low, high: F.pmod(F.xxhash64("id", F.lit(99)), F.lit(high - low + 1)) + low
    text = one_of(["the", "of", "and", "in", "is", "with", "here", "from", "la", "de", "und", "die"], 1)
    name = one_of(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "PASSWORD", "SECRET", "TOKEN"], 2)
    plain = one_of(["build", "commit", "sha1", "hash", "id", "uuid", "order", "version", "checksum", "ref", "invoice", "serial"], 3)
    term = one_of(["user", "config", "image", "release", "table", "section", "report", "module"], 4)
    other = one_of(["index", "value", "path", "name", "content", "script", "client", "update"], 5)
    digits = drawn("0123456789", 4, 6)
    scheme = one_of(["postgres", "mysql", "amqp", "redis", "https", "mongodb"], 8)
    path = one_of(["src/app.py", "config/settings.yml", "src0", "src7", "deploy/run.sh", "web/main.js"], 7)
    rows = [  # (word, before, label)
        (F.concat(name, F.lit("="), drawn(hexa, length(16, 40), 11)), text, 1),
        (F.concat(F.lit('"'), drawn(hexa, length(24, 64), 12), F.lit('"')), F.concat(text, F.lit(" "), name, F.lit(" =")), 1),
        (F.concat(F.lit("AKIA"), drawn(capitals, 16, 13)), text, 1),
        (F.concat(name, F.lit(":"), drawn(base64, length(20, 64), 14)), text, 1),
        (F.concat(F.lit("ghp_"), drawn(alnum, 36, 15)), text, 1),
        (F.concat(name, F.lit("='"), drawn(alnum + "!@#%^&*-_", length(10, 24), 16), F.lit("'")), text, 1),
        (F.concat(F.lit("sk_live_"), drawn(alnum, 24, 17)), text, 1),
        (drawn(base64, 40, 18), F.concat(name, F.lit(" =")), 1),
        (F.concat(name, F.lit("=eyJ"), drawn(alnum, length(100, 900), 31), F.lit("."), drawn(alnum + "-_", 43, 32)), text, 1),
        (F.concat(name, F.lit(":"), drawn(base64, length(201, 1600), 33)), text, 1),
        (drawn("0123456789", length(12, 19), 21), text, 0),
        (drawn(hexa, 40, 22), F.concat(text, F.lit(" "), plain), 0),
        (F.concat(drawn(hexa, 8, 23), F.lit("-"), drawn(hexa, 4, 24), F.lit("-4"), drawn(hexa, 3, 25), F.lit("-"), drawn(hexa, 12, 26)), F.concat(plain, F.lit(" ")), 0),
        (F.concat(term, F.lit("_"), other, F.lit("_"), digits), text, 0),
        (F.concat(name, F.lit("=changeme"), digits), text, 0),
        (F.concat(name, F.lit("=your_"), other, F.lit("_here1")), text, 0),
        (F.concat(F.lit("https://"), term, F.lit(".example/"), other, F.lit("/"), digits, F.lit("/"), term), text, 0),
        (F.concat(F.lit("data:image/png;base64,"), drawn(base64, length(201, 1600), 34)), F.concat(text, F.lit(" src=")), 0),
        (F.concat(plain, F.lit("="), drawn(hexa, length(201, 1600), 35)), text, 0),
        (F.concat(F.lit("eyJ"), drawn(alnum, length(17, 40), 41), F.lit("."), drawn(alnum + "-_", length(60, 500), 42), F.lit("."), drawn(alnum + "-_", 43, 43)), text, 1),
        (F.concat(scheme, F.lit("://"), term, F.lit(":"), drawn(alnum + "!#%^*-_", length(8, 24), 44), F.lit("@"), other, F.lit("."), term, F.lit(":"), digits, F.lit("/"), other), text, 1),
        (F.concat(scheme, F.lit("://"), term, F.lit(":"), one_of(["password", "changeme", "your_password", "${PASSWORD}", "<password>", "example1", "secret"], 45), F.lit("@"), other, F.lit(":"), digits), text, 0),
        (F.concat(F.lit("com."), other, F.lit("."), term, F.lit("Configuration."), F.initcap(other), F.lit("Service"), digits), text, 0),
        (F.concat(other, F.lit("."), term, F.lit("-"), other, F.lit("-"), digits, F.lit("."), one_of(["tar.gz", "parquet", "example.org", "min.js"], 46)), text, 0),
        (F.concat(F.lit("20"), drawn("012", 2, 27), F.lit("-0"), drawn("123456789", 1, 28), F.lit("-1"), drawn("0123456789", 1, 29), F.lit("T12")), text, 0),
    ]
    kind = F.pmod("id", F.lit(len(rows))) + 1
    pick = lambda k: F.element_at(F.array(*[r[k] if isinstance(r[k], Column) else F.lit(r[k]) for r in rows]), kind.cast("int"))
    return spark.range(n).select(pick(0).alias("word"), pick(1).alias("before"), text.alias("after"), path.alias("path"), pick(2).cast("double").alias("label"))


def train(labelled: DataFrame, dictionary: list[str], trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    made = features(labelled, dictionary)
    rows = VectorAssembler(inputCols=feature_columns(made), outputCol="vector").transform(made)
    return RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=17).fit(rows)


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, path) -> doc_id, position, word, before, after, path."""
    some = docs.where(F.col("text").rlike(ANY) | F.col("text").rlike(NAMED) | F.col("text").rlike(r"://[^\s/:@]*:[^\s/@]{6,}@"))
    words = F.split("text", r"\s+")
    blank = lambda k: F.array_repeat(F.lit(""), k)
    beside = F.arrays_zip(
        words.alias("word"), F.concat(blank(1), words).alias("last"), F.concat(blank(2), words).alias("last2"), F.concat(blank(3), words).alias("last3"), F.slice(words, 2, 1 << 30).alias("after"))
    rows = some.select("doc_id", "path", F.posexplode(beside).alias("position", "x")).where(F.length("x.word") >= 8)
    rows = rows.select("doc_id", "path", "position", "x.word", F.concat_ws(" ", "x.last3", "x.last2", "x.last").alias("before"), "x.after")
    name, value = parts(F.col("word"))
    before = F.concat(F.element_at(F.split("before", " "), -1), F.lit(" "), name)
    named = F.concat_ws(" ", "before", name, F.when(F.col("word").rlike("[=:]"), F.lit("="))).rlike(rf"(?i)({NAMES})\w*[\"']?\s*[=:]") & (F.length(value) >= 8) & before.rlike(rf"(?i)({NAMES}|[=:])")
    dotted = (F.length(value) >= 20) & value.rlike(DOTTED)
    return rows.where(value.rlike(r"^(?=.*\d)[A-Za-z0-9+/_-]{12,}=*$") | dotted | named | F.col("word").rlike(ADDRESS))


def findings(docs: DataFrame, model: RandomForestClassificationModel, dictionary: list[str], threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text, path) -> its findings that the forest takes for secrets, with value and score."""
    made = features(candidates(docs), dictionary)
    rows = model.transform(VectorAssembler(inputCols=feature_columns(made), outputCol="vector", handleInvalid="error").transform(made))
    return rows.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= threshold).select("doc_id", F.col("position").cast("long").alias("position"), "value", "score")


def scan(spark: SparkSession, docs: DataFrame, dictionary: list[str]) -> DataFrame:
    found = findings(docs.select("doc_id", "text", F.col("source").alias("path")), train(labelled_findings(spark), dictionary), dictionary)
    return found.select("doc_id", "position", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))
