"""Registered queries of the text operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html_wrapper import extract

    return extract(_read(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_dedup import line_report

    return line_report(_read(spark, sf_dir, "documents"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.kneser_ney import quality

    return quality(_read(spark, sf_dir, "documents")).drop("text_key")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sentence_spans import span_report

    return span_report(_read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.warc import round_trip

    return round_trip(spark, _read(spark, sf_dir, "pages"))


def op8_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffix_radix import substring_report

    return substring_report(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.url_filter import judge

    return judge(_read(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.prefix_trie import trie

    return trie(_read(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html_wrapper": op2_html_wrapper,
    "op3_line_dedup": op3_line_dedup,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_suffix_radix": op8_suffix_radix,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

#: crc32 of a string's bytes, the polynomial of zip files.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))))"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, i, line, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        common AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT l.doc_id, l.i, l.line, c.key IS NOT NULL AND l.doc_id <> c.last AS lost FROM lines l LEFT JOIN common c ON l.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
        w AS (SELECT source, n, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w FROM s),
        r AS (SELECT *, coalesce(sum(2 * n) OVER o, 0)::DOUBLE AS before_n, coalesce(sum(w) OVER o, 0) AS before_w,
                     (sum(n) OVER ())::DOUBLE * 1.5 AS total, sum(w) OVER () AS all_w
              FROM w WINDOW o AS (ORDER BY 2.0 * n / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, (total - before_n) * w / (all_w - before_w) > 2 * n AS capped FROM r),
        q AS (SELECT source, n, w, capped, CASE WHEN capped THEN 2.0::DOUBLE * n
                     ELSE (total - coalesce(sum(CASE WHEN capped THEN 2 * n END) OVER (), 0)::DOUBLE) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM c),
        g AS (SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE least(2 * n, round_even(target, 0)::BIGINT) // n END AS base,
                     CASE WHEN n = 0 THEN 0 ELSE least(2 * n, round_even(target, 0)::BIGINT) % n END AS need FROM q),
        x AS (SELECT d.doc_id, d.size, g.n, g.target, g.base, g.need,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size::BIGINT AS size, n AS source_size, target,
               (size * (base + CASE WHEN need > 0 AND 2 * run - size <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""",
    "op10_decontamination": rf"""
        WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        w AS (SELECT DISTINCT item_id, words[s + 1 : s + 10] AS win FROM (SELECT item_id, words, unnest(generate_series(0, greatest(len(words) - 10, 0))) AS s FROM b WHERE len(words) > 0)),
        d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
        n AS (SELECT DISTINCT len(win) AS n FROM w),
        p AS (SELECT doc_id, s, n, words[s + 1 : s + n] AS win FROM (SELECT doc_id, words, n, unnest(generate_series(0, len(words) - n)) AS s FROM d, n WHERE len(words) >= n)),
        m AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM p JOIN w ON p.win = w.win),
        h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM m) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY encode(item_id)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
               sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i,
                          sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT c, count(*) AS n, c - c % 100 AS base, {_CRC.format("c::VARCHAR")} % 6 AS h FROM t GROUP BY c),
        p AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS kept FROM c LEFT JOIN (SELECT c AS base, n FROM c) b USING (base)),
        r AS (SELECT p.c, kept + i - h AS i, k, t.n FROM t JOIN p ON t.c = p.c AND i >= h
              UNION ALL SELECT p.c, i, k, t.n FROM p JOIN t ON t.c = p.base AND i < kept),
        m AS (SELECT c, kept + greatest(n - h, 0) AS total FROM p),
        x AS (SELECT c, i + 1 AS d, n, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY i)) AS name FROM r
              UNION ALL SELECT c, 0, 0, '' FROM m),
        g AS (SELECT d, name, min(c) AS c, count(*) AS n_convs, max(x.n) AS n, string_agg(CASE WHEN total = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM x JOIN m USING (c) GROUP BY d, name),
        u AS (SELECT g.*, q.c AS parent FROM g LEFT JOIN x ON x.c = g.c AND x.d = g.d - 1 LEFT JOIN g q ON q.d = x.d AND q.name = x.name),
        k AS (SELECT u.d - 1 AS d, x.name, count(*) AS n_children FROM u JOIN x ON x.c = u.c AND x.d = u.d - 1 GROUP BY ALL),
        v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (d, name)),
        s AS (SELECT x.d, x.name, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.n) AS saved FROM v JOIN x ON x.c = v.c AND x.d <= v.d GROUP BY ALL)
        SELECT v.c AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM v JOIN s USING (d, name)""",
}
