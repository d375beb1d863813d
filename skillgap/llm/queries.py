"""One query per operator, over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skillgap.llm import align, chat, langid, lexical, licenses, mixing, ordermin, pieces, quality_net, rules, simhash, vectors, warc
from skillgap.sources.scratch import materialize, scratch_path

#: A vocabulary file by name, looked up in the public tokenizers.
MODEL = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), model_path(), keep=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # The archives are gone through once; assembling reads the records several times.
    records = materialize(warc.read_archives(spark, path, blocks=False), "records")
    return warc.page_report(warc.assemble(records))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_report(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.read_chats(chat.format_chats(turns))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.edited_report(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(table(spark, sf_dir, "documents"), model_path(BYTES), model_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_warc, op3_mixing, op4_licenses, op5_simhash, op6_langid, op7_quality_net, op8_quality_rules,
        op9_chat, op10_embeddings, op11_lexical, op12_order_minhash, op13_alignment,
    )
}

_WORD = r"'[^\x20\x09-\x0D]+'"
ORACLES: dict[str, str] = {}

# The digest has to be turned from hex to base32, five hex digits to four.
ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hexed AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS code FROM p),
d AS (
  SELECT page_id, payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(code, 1 + 5 * (i // 4), 5))::INT // [32768, 1024, 32, 1][1 + i % 4]) % 32, 1)
    FOR i IN range(32)], '') AS payload_digest
  FROM hexed),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM m
"""

# Whichever sources are held at their most, the rest's level is no higher than the true one: the largest is it.
ORACLES["op3_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(n) OVER () AS total,
    sum(w) OVER (ORDER BY 3 * n / w DESC, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS open,
    coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w DESC, source NULLS LAST ROWS UNBOUNDED PRECEDING), 0) AS reach
  FROM s),
v AS (
  SELECT *, (total - (3 * total - reach))::DOUBLE / open::DOUBLE AS level FROM o),
l AS (SELECT max(level) AS level FROM v),
t AS (
  SELECT source, n, w, CASE WHEN w * l.level > 3 * n THEN (3 * n)::DOUBLE ELSE w * l.level END AS target FROM s, l),
r AS (
  SELECT d.doc_id, d.source, d.size, t.n AS source_size, t.target,
    CASE WHEN t.n > 0 THEN floor(t.target / t.n * 4294967296 + 0.5)::BIGINT ELSE 0 END AS units,
    ('0x' || substr(md5('mix|' || coalesce('s' || d.source, 'null')), 1, 8))::BIGINT AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, sum(units) OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, size, source_size, target,
  (((upto + u) // 4294967296 - (upto - units + u) // 4294967296) * size)::BIGINT AS taken
FROM k
"""

ORACLES["op8_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(body, {_WORD}) AS words FROM t),
m AS (
  SELECT doc_id, r, body, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines,
    length(regexp_replace(body, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(body, '\P{{Lu}}', '', 'g')) AS uppers
  FROM w),
x AS (
  SELECT r, i, array_to_string(words[i : i + 7], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM m WHERE len(words) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM x) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
f AS (
  SELECT m.*, coalesce(cover.n, 0) AS n_repeat_words,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM m LEFT JOIN cover USING (r)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
j AS (
  SELECT *, 10 * n_symbols > n_words AS symbols, word_chars > 15 * n_words OR word_chars < 2 * n_words AS word_length,
    n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * len(lines) AS repeated_lines, 2 * letters < word_chars AS few_letters,
    2 * uppers > letters AS shouting, length(body)::BIGINT AS chars
  FROM g),
sampled AS (SELECT * FROM j ORDER BY md5(concat(coalesce(doc_id::VARCHAR, ''), '|', body)) LIMIT {rules.SAMPLE_ROWS}),
estimated AS (
  SELECT 'symbols' AS rule, sum(symbols::BIGINT) AS rejected, 2 * count(*) AS read FROM sampled UNION ALL
  SELECT 'word_length', sum(word_length::BIGINT), 2 * count(*) FROM sampled UNION ALL
  SELECT 'repeated_lines', sum(repeated_lines::BIGINT), 2 * count(*) FROM sampled UNION ALL
  SELECT 'few_letters', sum(few_letters::BIGINT), sum(chars + 1) FROM sampled UNION ALL
  SELECT 'shouting', sum(shouting::BIGINT), sum(2 * chars) FROM sampled),
placed AS (SELECT rule, row_number() OVER (ORDER BY rejected::DOUBLE / greatest(1, read)::DOUBLE DESC, rule) AS place FROM estimated),
hits AS (
  SELECT r, 'symbols' AS rule FROM j WHERE symbols UNION ALL SELECT r, 'word_length' FROM j WHERE word_length UNION ALL
  SELECT r, 'repeated_lines' FROM j WHERE repeated_lines UNION ALL SELECT r, 'few_letters' FROM j WHERE few_letters UNION ALL
  SELECT r, 'shouting' FROM j WHERE shouting),
stops AS (SELECT r, arg_min(rule, place) AS rule FROM hits JOIN placed USING (rule) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rule IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE rule END AS stopped_by
FROM j LEFT JOIN stops USING (r)
"""

ORACLES["op11_lexical"] = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
d AS (SELECT doc_id, r, words, len(words)::BIGINT AS n FROM w WHERE len(words) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
i AS (
  SELECT item_id, row_number() OVER () AS q,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
iq AS (SELECT item_id, q, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
tf AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
v AS (
  SELECT r, doc_id, term,
    floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total)))) AS part
  FROM tf JOIN df USING (term), s),
scored AS (SELECT item_id, q, r, doc_id, sum(times * part)::BIGINT AS score FROM iq JOIN v USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
