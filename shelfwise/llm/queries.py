"""Queries of this package's operators over the benchmark tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import alignment, byte_bpe, chat, exact_dedup, fingerprints, language_id, near_dedup, packing, pii, suffix_tree, token_counts, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


@_query
def op4_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"))


SQL["op10_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@_query
def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), width=4)


SQL["op6_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id, r.node = min(reach) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""


@_query
def op7_pii(spark, sf_dir):
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.span_text(F.col("base_spans")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@_query
def op2_language_id(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    host = language_id.host_of(F.col("url"))
    evidence = pages.select("page_id", language_id.text_of(F.col("html")).alias("text"), language_id.declared_in(F.col("html")).alias("declared"), host.alias("host"), language_id.suffix_of(host).alias("suffix"))
    return language_id.identify(evidence, language_id.fit(_table(spark, sf_dir, "documents"), "text", "lang", "doc_id"), "page_id", "text", "declared", "host", "suffix")


@_query
def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(_table(spark, sf_dir, "documents"))


@_query
def op9_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_edited(_table(spark, sf_dir, "documents"))


@_query
def op8_chat_format(spark, sf_dir):
    hard = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.read_back(chat.format_conversations(rows))


# The length of an escaped text: each backslash and each control string adds one character.
_ESCAPED = r"""length(regexp_replace(replace({0}, '\', '\\'), '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '.\0', 'g'))"""
SQL["op8_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum({len(chat.TURN + chat.BODY + chat.END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


@_query
def op5_lm_scoring(spark, sf_dir):
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


@_query
def op11_alignment(spark, sf_dir):
    return alignment.digests(_table(spark, sf_dir, "documents"))


@_query
def op12_warc(spark, sf_dir):
    return warc.records(warc.write(_table(spark, sf_dir, "pages"), warc.archive_folder(spark)))


# Base32 of a SHA-1: each 5 hexadecimal digits make 4 symbols.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {1 + 5 * (i // 4)}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31 AS BIGINT) + 1, 1)" for i in range(32))
SQL["op12_warc"] = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS stays FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stays THEN stays END AS refers_to
FROM p
"""


@_query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
