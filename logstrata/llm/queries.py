"""The registered queries of this subpackage, op1 to op10, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import chat_format, decontaminate, exact_dedup, langid, minhash, pieces, secret_scan, suffix_tree_lm, token_counts, warc
from logstrata.llm.common import table


def piece_model() -> str:
    """Where the public vocabulary lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary(piece_model()))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits", "items")


#: Of the rows' folds by crc32 of the id, the one that is held out, for languages and for the language model.
LANG_FOLDS, LM_FOLDS, HELD_OUT = 4, 7, 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = langid.train(docs.filter(langid.fold_of("doc_id", LANG_FOLDS) != HELD_OUT))
    return langid.identify(docs, parser).withColumn("held_out", langid.fold_of("doc_id", LANG_FOLDS) == HELD_OUT)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs)).drop("found")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), langid.fold_of("doc_id", LM_FOLDS) == HELD_OUT)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), piece_model())


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), size=4, percent=80).drop("kept_row")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_secret_scan that SQL can express: the patterns' spans."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_lm_score that SQL can express: counts of words, and the unigram score."""
    return op7_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_lm_score": op7_lm_score,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_minhash": op10_minhash,
    "secret_base": secret_base,
    "lm_base": lm_base,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of a string of ASCII letters, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(0, length({0}) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr({0}, i, 1)) END),
    lambda c, b: list_reduce(list_transform(range(0, 9), lambda i: CASE WHEN i = 0 THEN xor(c, b) ELSE 0 END), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

_CALM = "coalesce(text, '')"


def _span_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of a kind: gaps and matches take turns, and their lengths add up to places."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, e - length(hit) AS s, e FROM (
        SELECT rid, i, hits[i] AS hit, own[i] AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS e
        FROM (SELECT rid, regexp_split_to_array(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS own FROM d) AS x, unnest(range(1, len(hits) + 1)) AS r(i))
        WHERE length(value) >= {least}"""


ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       translate(array_to_string([to_base(('0x' || x[i:i + 9])::BIGINT, 32, 8) FOR i IN [1, 11, 21, 31]], ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN m END AS refers_to
FROM r
""",
    "op4_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN_WORDS.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
        FROM b, unnest(range(1, greatest(len(w) - 13 + 2, 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, pos.n, item_id FROM pos JOIN win USING (n, k)),
marks AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
owners AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN owners USING (rid)
""",
    "op8_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (g ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
""",
    "secret_base": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CALM} AS t FROM documents),
spans AS ({" UNION ALL ".join([_span_sql(0, secret_scan.ASSIGN, 1, secret_scan.ASSIGN_LEAST), _span_sql(1, secret_scan.ACCESS, 0, 0), _span_sql(2, secret_scan.HEX, 0, 0)])}),
said AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
         string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS x FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN said USING (rid)
""",
    "lm_base": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC.format("doc_id::VARCHAR")} % 7 = 2 AS held_out,
           list_append(list_filter(regexp_split_to_array({_LOWER.format("text")}, '[\x20\x09-\x0D]+'), lambda x: x <> ''), chr(10)) AS w FROM documents),
e AS (SELECT rid, held_out, unnest(w) AS k FROM d),
c AS (SELECT k, count(*) AS n FROM e WHERE NOT held_out GROUP BY k),
z AS (SELECT coalesce(sum(n), 0)::BIGINT AS total, count(*) AS v FROM c),
r AS (SELECT rid, count(*) AS n_tokens, count(c.n) AS n_known, sum(log10(coalesce(c.n, 0) + 1)) AS logs FROM e LEFT JOIN c USING (k) GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, round(logs - n_tokens * log10(total + v + 1), 4) AS base_score FROM d JOIN r USING (rid), z
""",
    "op10_minhash": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({_LOWER.format("text")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                       ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM d),
e AS MATERIALIZED (SELECT rid, len(g) AS n, unnest(g) AS k FROM s),
links AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM e AS a JOIN e AS b ON a.k = b.k AND a.rid <> b.rid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
                       GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, r) AS (SELECT rid, rid FROM s UNION SELECT y, r FROM reach JOIN links USING (x)),
least_id AS (SELECT r AS rid, min(s.doc_id) AS component_id FROM reach JOIN s ON s.rid = reach.x GROUP BY r)
SELECT doc_id, len(g)::BIGINT AS n_shingles, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id, component_id, doc_id = component_id AS kept
FROM s JOIN least_id USING (rid)
""",
}
