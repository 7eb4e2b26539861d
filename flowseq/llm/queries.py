"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowseq.llm import decontaminate, packing, pii, quotes, simhash, substring_dedup, token_count, topk_search, toxicity, url_filter
from flowseq.llm.common import table

#: Tokens a training sequence holds.
SEQUENCE = 4096

# The rules of the URL query, as (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=SEQUENCE)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), sequence=SEQUENCE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_quotations": op3_quotations,
    "op4_token_counts": op4_token_counts,
    "op5_url_rules": op5_url_rules,
    "op6_topk": op6_topk,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quotations": """
        WITH RECURSIVE
        m AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
        l AS (
          SELECT conv_id, turn, text, i, string_split(text, chr(10))[i] AS line
          FROM (SELECT DISTINCT conv_id, turn, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM m)),
        q AS (
          SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+', 0), '[^>]', '', 'g')) AS level,
                 substr(line, length(regexp_extract(line, '^[ \t]*(>[ \t]*)+', 0)) + 1) AS body FROM l),
        own AS (
          SELECT conv_id, turn, text, coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '') AS body
          FROM q GROUP BY ALL),
        units AS (
          SELECT conv_id, turn, body AS u FROM own
          UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(body, '\n[ \t\r]*\n')) FROM own
          UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM own),
        f AS (SELECT conv_id, turn, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g'), ' ') AS words FROM units),
        o AS (SELECT conv_id, words, min(turn) AS original FROM f WHERE words <> '' GROUP BY ALL),
        r AS (SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn, text ORDER BY i) AS turned FROM q),
        s AS (SELECT *, sum(CAST(turned AS INT)) OVER (PARTITION BY conv_id, turn, text ORDER BY i) AS run FROM r),
        p AS (SELECT conv_id, turn, text, run, level, string_agg(body, chr(10) ORDER BY i) AS raw FROM s WHERE level > 0 GROUP BY ALL),
        parts AS (
          SELECT conv_id, turn, text, run, level, 0 AS kind, raw AS part FROM p
          UNION ALL SELECT conv_id, turn, text, run, level, 1, unnest(regexp_split_to_array(raw, '\n[ \t\r]*\n')) FROM p
          UNION ALL SELECT conv_id, turn, text, run, level, 2, unnest(string_split(raw, chr(10))) FROM p),
        pn AS (SELECT conv_id, turn, text, run, level, kind, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g'), ' ') AS words FROM parts),
        k AS (
          SELECT pn.conv_id, pn.turn, pn.text, pn.run, pn.level, pn.kind, length(pn.words) AS size, o.original
          FROM pn JOIN o ON pn.conv_id = o.conv_id AND pn.words = o.words AND o.original < pn.turn WHERE pn.words <> ''),
        kp AS (SELECT DISTINCT ON (conv_id, turn, text, run) conv_id, turn, level, kind, size, original FROM k ORDER BY kind, size DESC, original),
        a AS (
          SELECT conv_id, turn, first(original ORDER BY level, kind, size DESC, original) AS parent, count(*) AS n_linked FROM kp GROUP BY conv_id, turn),
        tree AS (
          SELECT conv_id, turn, [turn] AS path FROM (SELECT DISTINCT conv_id, turn FROM m) x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = x.conv_id AND a.turn = x.turn)
          UNION ALL SELECT a.conv_id, a.turn, list_append(tree.path, a.turn) FROM tree JOIN a ON a.conv_id = tree.conv_id AND a.parent = tree.turn),
        d AS (SELECT conv_id, turn, path[1] AS thread, len(path) - 1 AS depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position FROM tree)
        SELECT m.conv_id, d.thread, d.depth, m.turn, d.position, a.parent, m.role, own.body, coalesce(a.n_linked, 0) AS n_linked
        FROM m JOIN own ON m.conv_id = own.conv_id AND m.turn = own.turn AND m.text = own.text
        JOIN d ON m.conv_id = d.conv_id AND m.turn = d.turn
        LEFT JOIN a ON m.conv_id = a.conv_id AND m.turn = a.turn
    """,
    "op6_topk": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.r AS q, c.r AS c, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
    """,
    "op7_substring_dedup": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        i AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
        s AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM i),
        m AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s),
        g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM s JOIN m ON s.s = m.s WHERE coalesce(doc_id > least, least IS NOT NULL)),
        k AS (
          SELECT x.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.p) AS kept
          FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN g ON x.r = g.r AND x.p = g.p GROUP BY x.r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.r = k.r
    """,
    "op5_url_rules": """
        WITH u AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
          FROM pages),
        r(says, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        m AS (
          SELECT page_id, host, path, rh || rp AS rule, says
          FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
        b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k FROM m)
        SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM b WHERE k = 1
    """,
}
