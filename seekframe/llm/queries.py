"""The registered queries of this folder, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm, ngram_join, quality, secrets, sentencepiece, toxicity, warc
from .blocks import read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece.round_trip(documents)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "\u2581", " ")
    return both.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", same.alias("round_trip"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold the template's own marks, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return chat.read_chats(chat.format_chats(turns))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and inferred secret spans of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find(documents, secrets.fit(documents))


_ESC = r"replace(replace(replace({0}, '\', '\\'), '#', '\#'), '<', '\<')"
OP2_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(replace({_ESC.format("role")}, ':', '\\:')) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC records and read back, with each capture's place in the merged index."""
    folder = warc.write_archives(read(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, folder)
    history = warc.capture_history(records).select(F.col("file").alias("in_file"), F.col("record").alias("in_record"), "url_key", F.col("position").alias("capture_position"))
    brief = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "record")
    return brief.join(history, (brief["file"] == history["in_file"]) & (brief["record"] == history["in_record"])).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_position", "url_key")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fixed rules and the likelihood ratio's verdict for every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(documents, quality.ratios(quality.counts(documents, read(spark, sf_dir, "labels"))))


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url, coalesce(url, '') AS u,
    sha1(coalesce(html, '')) AS hex,
    strftime(make_timestamp((1600000000 + coalesce(page_id % 100000000, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM pages),
r AS (SELECT *, CASE WHEN position('://' IN u) > 0 THEN substr(u, position('://' IN u) + 3) ELSE u END AS rest FROM p),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS whole, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM r),
k AS (SELECT *, lower(split_part(whole, ':', 1)) AS host, CASE WHEN position(':' IN whole) > 0 THEN substr(whole, position(':' IN whole) + 1) ELSE '' END AS port FROM h),
d AS (SELECT *,
    array_to_string(list_reverse(string_split(CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE host END, '.')), ',')
      || CASE WHEN port <> '' THEN ':' || lower(port) ELSE '' END || ')' || split_part(tail, '#', 1) AS url_key,
    array_to_string(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest FROM k),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
    row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS capture_position FROM d)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CAST(capture_position AS BIGINT) AS capture_position, url_key FROM f"""

def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item whose question and answer it holds."""
    found = decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document: five words, four fifths."""
    return ngram_join.join(read(spark, sf_dir, "documents"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END)) AS grams FROM d),
c AS MATERIALIZED (SELECT md5(array_to_string(grams, chr(10))) AS k, len(grams) AS n, min(doc_id) AS least, any_value(grams) AS grams FROM s WHERE len(grams) > 0 AND doc_id IS NOT NULL GROUP BY ALL),
g AS MATERIALIZED (SELECT k, n, unnest(grams) AS gram FROM (SELECT k, n, grams FROM c)),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.k AS a, y.k AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.k <> y.k AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n GROUP BY x.k, y.k)
    WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT k AS node, k AS reached FROM c UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT r.node, min(c.least) AS component_id FROM r JOIN c ON c.k = r.reached GROUP BY r.node)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, CASE WHEN s.doc_id IS NOT NULL THEN coalesce(m.component_id, s.doc_id) END AS component_id
FROM s LEFT JOIN m ON len(s.grams) > 0 AND m.node = md5(array_to_string(s.grams, chr(10)))"""


#: Categories of the classifier chain over the columns of labels, in the order of prediction.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document; toxic from one half."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(documents, read(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.predict(documents, chain)
    return scored.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES), (F.col("p_toxic") >= 0.5).alias("toxic"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree scores of every document, learnt from those outside fold 2 of 7."""
    return lm.score(read(spark, sf_dir, "documents").select("doc_id", "text", (langid.fold("doc_id", 7) == 2).alias("held_out")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those outside fold 2 of 4."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.fold("doc_id", 4) == 2)
    net = langid.fit(documents.where("not held_out"))
    scored = langid.predict(documents.select("doc_id", "text", "held_out"), net)
    return scored.select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op5_warc": OP5_SQL, "op7_ngram_join": OP7_SQL}
