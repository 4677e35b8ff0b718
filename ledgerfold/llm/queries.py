"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.llm._common import spread, table

#: The URL rules that op3 applies.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.packing import pack_documents

    return pack_documents(spread(table(spark, sf_dir, "documents")), tokenizer_path("word_bpe_49k.json"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.topk import nearest_codes

    rows = table(spark, sf_dir, "embeddings")
    return nearest_codes(rows, rows.where("vec_id % 100 = 0"), k=10)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.urlfilter import filter_urls, rule_table

    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.html_extract import extract_pages

    return extract_pages(spread(table(spark, sf_dir, "pages")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.lm import score_documents

    return score_documents(spread(table(spark, sf_dir, "documents")), tokenizer_path("piece_bpe_32k.model"), class_column="lang")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerfold.llm.bpe import encode_documents

    return encode_documents(spread(table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.quality_knn import fit_labelled, score_documents

    docs = spread(table(spark, sf_dir, "documents"))
    return score_documents(docs, fit_labelled(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.simhash import near_duplicates

    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.secrets import secret_report

    return secret_report(spread(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.quality_rules import quality_report

    return quality_report(spread(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_topk, op3_url_filters, op4_html_extraction, op5_lm_scoring, op6_byte_bpe,
        op7_quality_classifier, op8_simhash, op9_secrets, op10_quality_rules, pipeline,
    )
}

_TOPK_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (coalesce(q.embedding[i], 0) > 0) <> (coalesce(e.embedding[i], 0) > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings q, embeddings e
  WHERE q.vec_id % 100 = 0 AND q.embedding IS NOT NULL AND e.embedding IS NOT NULL
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

_URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict, url FROM judged
"""



def _quality_sql() -> str:
    """The counts and line rules of quality_rules, with its thresholds and word lists."""
    from ledgerfold.llm.quality_rules import BOILERPLATE, MARKS, NAVIGATION, SYMBOLS, WINDOW, LineRules

    r, quoted = LineRules(), lambda x: "'" + x.replace("'", "''") + "'"
    share = lambda x: f"CAST({x} AS DOUBLE) * n"
    word, symbol, navigation = quoted(r"[^\x20\x09-\x0D]+"), quoted(f"[{SYMBOLS}]"), f"string_split({quoted(NAVIGATION)}, ' ')"
    count = lambda test: f"len(list_filter(ws, lambda w: {test}))"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS doc_row, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_row, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (SELECT doc_row, line, ws, CAST(len(ws) AS BIGINT) AS n FROM (SELECT doc_row, line, regexp_extract_all(line, {word}) AS ws FROM lines) WHERE len(ws) > 0),
judged AS (
  SELECT doc_row, line, n,
    (n >= 3 AND len(regexp_extract_all(line, {quoted(f"[{MARKS}]")})) > {share(r.max_mark_share)})
    OR {count(f"regexp_matches(w, {symbol})")} > {share(r.max_symbol_share)}
    OR (n >= 4 AND {count("regexp_matches(w, '[!?]$')")} > {share(r.max_shout_share)})
    OR (n >= 4 AND len(list_filter(range(1, n), lambda i: ws[i] = ws[i + 1])) > {share(r.max_repeat_share)})
    OR (n >= 8 AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '\p{{Ll}}'))
    OR (n <= {r.short_line} AND {count(f"list_contains({navigation}, trim(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,:;|>'))")} > {share(r.max_navigation_share)})
    OR (regexp_matches(line, {quoted("(?i)(?:" + BOILERPLATE + ")")})
        AND list_sum(list_transform(regexp_extract_all(line, {quoted("(?i)(?:" + BOILERPLATE + ")")}), lambda x: len(regexp_extract_all(x, {word})))) >= {share(r.max_boilerplate_share)}) AS fails
  FROM worded
),
by_line AS (
  SELECT doc_row, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY doc_row
),
words AS (SELECT doc_row, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM (SELECT doc_row, regexp_extract_all(text, {word}) AS ws FROM docs)),
windows AS (
  SELECT doc_row, pos, n, CASE WHEN pos + {WINDOW - 1} <= n THEN string_agg(w, ' ') OVER (PARTITION BY doc_row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) END AS whole FROM words
),
twice AS (SELECT doc_row, pos, whole IS NOT NULL AND count(*) OVER (PARTITION BY doc_row, whole) > 1 AS again FROM windows),
covered AS (SELECT doc_row, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_row ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeats AS (SELECT doc_row, count(*) AS n_words, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM covered GROUP BY doc_row),
counts AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, {symbol})) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM docs LEFT JOIN by_line USING (doc_row) LEFT JOIN repeats USING (doc_row)
)
SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeated_percent} * n_words AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeated_percent} * n_words) AND n_lost_words <= CAST({r.max_lost} AS DOUBLE) * n_words AS kept
FROM counts
"""


#: Only the whole result counts, so queries that SQL can't express in full have none.
ORACLE_SQL = {"op2_topk": _TOPK_SQL, "op3_url_filters": _URL_SQL, "op10_quality_rules": _quality_sql()}
