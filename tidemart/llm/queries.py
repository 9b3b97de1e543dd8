"""The operators as registered queries over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidemart.llm import (alignment, chat, decontaminate, html_text, lexical_search, licenses, mixing,
                          quality, quality_rules, secret_scan, simhash, token_files, warc)
from tidemart.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The conversation that holds nothing but control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every whole text: pattern matches and windows of high entropy."""
    return secret_scan.scan(table(spark, sf, "documents"))


def op2_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one of control strings, formatted, masked and read back."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
                                    "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(control), TOKENIZER,
                                                  chat.DIGESTED))


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License notices in every whole text by alignment with templates."""
    found = licenses.scan(table(spark, sf, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op4_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix by source weights takes from each document."""
    return mixing.mix_sizes(table(spark, sf, "documents"))


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as token ids in shard files, read back."""
    return token_files.token_files(table(spark, sf, "documents"), TOKENIZER).drop("shard")


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """A quality score of every document; labels are learnt from rows that aren't held out."""
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule counts of every document, and verdicts of documents and of their hosts."""
    return quality_rules.judged(table(spark, sf, "documents"), "source")


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.archived(table(spark, sf, "pages"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark windows in every whole text."""
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page by tag-path ratios."""
    return html_text.extract(table(spark, sf, "pages")).drop("root")


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of two vocabularies over every whole text, aligned by the bytes they cover."""
    return alignment.aligned(table(spark, sf, "documents"), TOKENIZER, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (
    op1_secret_scan, op2_chat_formatting, op3_license_scan, op4_source_mixing, op5_token_files,
    op6_quality_classifier, op7_simhash_near_dedup, op8_quality_rules, op9_warc,
    op10_decontamination, op11_html_text, op12_lexical_search, op13_token_alignment)} | {"pipeline": corpus_pipeline.run}

ORACLE: dict[str, str] = {
    "op2_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok'
  FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
shown AS (
  SELECT *, '<|im_start|>'
    || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')
    || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS line
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(length(line))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id""",
    "op8_quality_rules": r"""
WITH parts AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c
  FROM places),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM parts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
stats AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
flags AS (
  SELECT *, unnest(['short', 'repeats', 'symbols', 'word_length']) AS rule, unnest([
    n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > word_chars,
    word_chars < 2 * n_words OR word_chars > 20 * n_words]) AS failed FROM stats),
hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM flags GROUP BY ALL),
means AS (
  SELECT rule, sum(k) / sum(n) AS mean, sum(n) AS docs, count(*) AS hosts
  FROM hosts GROUP BY rule),
priors AS (
  SELECT rule, mean, CASE WHEN excess > 0
    THEN least(greatest(mean * (1 - mean) / excess - 1, 1), 1000000) ELSE 1000000 END AS strength
  FROM (SELECT rule, any_value(mean) AS mean,
          (sum(n * (k / n - mean) ** 2) - any_value(mean * (1 - mean) * hosts)) / any_value(docs)
            AS excess
        FROM hosts JOIN means USING (rule) GROUP BY rule)),
verdicts AS (
  SELECT source, max((k + strength * mean) / (n + strength)) > 0.5 AS host_failed
  FROM hosts JOIN priors USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, host_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept
FROM stats JOIN verdicts ON stats.source IS NOT DISTINCT FROM verdicts.source""",
    "op9_warc": r"""
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
groups AS (
  SELECT payload_digest, max(page_id) AS last FROM rows
  WHERE payload_bytes >= 1000 AND page_id IS NOT NULL GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM rows LEFT JOIN groups USING (payload_digest)""",
    "op10_decontamination": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items
        WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs, sizes
  WHERE len(words) >= size),
found AS (
  SELECT doc_id, item_id, i, p.size FROM places p
  JOIN windows v ON p.size = v.size AND array_to_string(words[i:i + p.size - 1], ' ') = v.w),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit,
  coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  hits.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_lexical_search": r"""
WITH docs AS (
  SELECT * FROM (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents)
  WHERE len(words) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs),
held AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM docs) GROUP BY ALL),
counts AS (SELECT term, count(*) AS df FROM held GROUP BY term),
asked AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
weighed AS (
  SELECT q, item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM asked JOIN counts USING (term), corpus),
scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf)
    // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weighed JOIN held USING (term), corpus GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10""",
}
