"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, langid, line_dedup, minhash_dedup, mixing, packing, pitman_yor, runs, secrets, suffix_dedup, vector_dedup, warc
from .common import table

TOKENIZERS = None  # folder of the public vocabularies; None: where the public_tokenizers package keeps them


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = vocabulary("piece_bpe_32k.model")
    langs, p = langid.fit(spark, docs.where(~langid.held_out()), pieces)
    asked = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(spark, asked, langs, p, pieces).select("doc_id", "held_out", "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spark, table(spark, sf_dir, "documents"), secrets.dictionary_of(vocabulary("word_bpe_49k.json")))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"), least=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(spark, docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_ids", "overlap", "contaminated")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(spark, table(spark, sf_dir, "documents"), length=50)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digests(line_dedup.deduplicate(spark, docs, percent=80))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=4, percent=80)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(spark, table(spark, sf_dir, "documents"), ~pitman_yor.held_out())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digests(runs.find_runs(spark, runs.planted(docs)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents").select("text", "lang", "source"), least=30, top=50)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc_archives": op3_warc_archives,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pitman_yor_scores": op10_pitman_yor_scores,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mix": op13_source_mix,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc_archives": """
        SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
          CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)""",
    "op11_periodic_runs": r"""
        WITH ids AS (
          SELECT doc_id, text, row_number() OVER () AS nr,
            flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: [ord(substring(doc_id::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
          FROM documents),
        hashed AS (  -- the CRC-32 of the digits of doc_id: each byte is mixed in, then eight bits are shifted out
          SELECT nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            xor(list_reduce(list_concat([4294967295], steps),
              lambda c, t: CASE WHEN t >= 0 THEN xor(c::BIGINT, t::BIGINT) WHEN c % 2 = 1 THEN xor(c::BIGINT // 2, 3988292384) ELSE c::BIGINT // 2 END), 4294967295) AS h
          FROM ids),
        sized AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM hashed),
        cycled AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
        word AS (
          SELECT nr, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word
          FROM (SELECT nr, w, a, p, unnest(range(n)) AS i FROM cycled)),
        equal AS (  -- places whose word recurs q words on
          SELECT x.nr, x.i, y.i - x.i AS q FROM word AS x JOIN word AS y ON x.nr = y.nr AND x.word = y.word AND y.i > x.i
          JOIN sized ON sized.nr = x.nr AND 4 * (y.i - x.i) <= n),
        stretch AS (
          SELECT nr, q, min(i) AS s, count(*) + q AS l FROM (SELECT nr, q, i, i - row_number() OVER (PARTITION BY nr, q ORDER BY i) AS island FROM equal)
          GROUP BY nr, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        run AS (SELECT nr, s, l, min(q) AS q FROM stretch GROUP BY nr, s, l),
        best AS (
          SELECT a.nr, a.s, a.l, a.q FROM run AS a WHERE NOT EXISTS (
            FROM run AS b WHERE b.nr = a.nr AND (b.l * a.q > a.l * b.q OR (b.l * a.q = a.l * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))),
        listed AS (SELECT nr, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY nr),
        dropped AS (SELECT DISTINCT nr, unnest(range(s + q, s + l)) AS i FROM run),
        left_over AS (SELECT nr, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN dropped USING (nr, i) GROUP BY nr)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
          sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM sized AS d LEFT JOIN listed USING (nr) LEFT JOIN best USING (nr) LEFT JOIN left_over USING (nr)""",
    "op12_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        w AS (SELECT nr, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT nr) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        size AS (
          SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
        vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        whole AS (SELECT lang, sum(n) AS n FROM size GROUP BY lang),
        p AS (
          SELECT size.lang, size.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 5)) // (size.n + 5 * v) AS p
          FROM size JOIN vocabulary USING (lang) JOIN kept AS k USING (lang)
          LEFT JOIN c ON c.lang = size.lang AND c.source = size.source AND c.term = k.term),
        q AS (
          SELECT lang, term, 1 + (1000000000 * (sum(c.n) + 5)) // (any_value(whole.n) + 5 * any_value(v)) AS q
          FROM c JOIN whole USING (lang) JOIN vocabulary USING (lang) GROUP BY lang, term),
        pair AS (
          SELECT a.lang, a.source, b.source AS item, coalesce(any_value(s.value), 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (
            SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
            GROUP BY x.lang, x.source, y.source) AS s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
          GROUP BY a.lang, a.source, b.source),
        term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
        UNION ALL
        SELECT * FROM (
          SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term)
        WHERE rank <= 50""",
    "op13_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            ('0x' || md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, '')))[1:15])::BIGINT AS h
          FROM documents),
        s AS (
          SELECT source, sum(size)::BIGINT AS total, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        filled AS (  -- sources by the share of a unit of weight at which they stop
          SELECT *, coalesce(sum(3 * total) OVER before, 0) AS held, coalesce(sum(w) OVER before, 0) AS stopped, row_number() OVER (ORDER BY 18 * total // w, source NULLS LAST) AS nth
          FROM s WINDOW before AS (ORDER BY 18 * total // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        whole AS (SELECT sum(total) AS words, sum(w) AS weight FROM s),
        share AS (
          SELECT words - held AS num, weight - stopped AS den FROM filled, whole
          WHERE 3 * total * (weight - stopped) >= (words - held) * w ORDER BY nth LIMIT 1),
        t AS (
          SELECT source, total, CASE WHEN 3 * total * den < num * w THEN (3 * total)::DOUBLE ELSE (num * w)::DOUBLE / den::DOUBLE END AS target,
            CASE WHEN 3 * total * den < num * w THEN 3 * total ELSE num * w // den END AS budget FROM s, share),
        r AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE least(3, budget // total) END AS copies FROM t),
        d0 AS (
          SELECT d.*, r.total, r.target, r.copies, r.budget - r.copies * r.total AS room, size > 0 AS ok,
            sum(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY d.source ORDER BY h) AS reach
          FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
        f0 AS (SELECT *, ok AND reach <= room AS taken0 FROM d0),
        g0 AS (SELECT *, room - coalesce(sum(CASE WHEN taken0 THEN size END) OVER (PARTITION BY source), 0) AS left0 FROM f0),
        f1 AS (SELECT *, taken0 OR coalesce(ok AND 4 * size <= left0 AND sum(CASE WHEN ok AND NOT taken0 AND 4 * size <= left0 THEN size END)
            OVER (PARTITION BY source ORDER BY h) <= left0, false) AS taken1 FROM g0),
        g1 AS (SELECT *, room - coalesce(sum(CASE WHEN taken1 THEN size END) OVER (PARTITION BY source), 0) AS left1 FROM f1),
        f2 AS (SELECT *, taken1 OR coalesce(ok AND 4 * size <= left1 AND sum(CASE WHEN ok AND NOT taken1 AND 4 * size <= left1 THEN size END)
            OVER (PARTITION BY source ORDER BY h) <= left1, false) AS taken2 FROM g1),
        g2 AS (SELECT *, room - coalesce(sum(CASE WHEN taken2 THEN size END) OVER (PARTITION BY source), 0) AS left2 FROM f2),
        f3 AS (SELECT *, taken2 OR coalesce(ok AND 4 * size <= left2 AND sum(CASE WHEN ok AND NOT taken2 AND 4 * size <= left2 THEN size END)
            OVER (PARTITION BY source ORDER BY h) <= left2, false) AS taken3 FROM g2)
        SELECT doc_id, size, total AS source_size, target, (size * (copies + CASE WHEN taken3 THEN 1 ELSE 0 END))::BIGINT AS taken FROM f3""",
}
