"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm import (
    byte_bpe, chat_format, fill_middle, license_scan, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, toxicity, vector_codes, vector_trie,
)
from tabulens.llm.common import Query, table

_WORD = r"[^\x20\x09-\x0D]+"


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf, "documents"))


def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return mixing.mixed(rows).select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_codec.codec_report(table(spark, sf, "documents"))


def op6_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    said = r"</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")),
    )).alias("x")).select("x.*")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_records(chat_format.conversation_records(turns)))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf, "documents"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_report(table(spark, sf, "documents"), width=2)


def op10_nearest_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.nearest_vectors(table(spark, sf, "embeddings"))


def op11_vector_trie(spark: SparkSession, sf: str) -> DataFrame:
    return vector_trie.code_report(table(spark, sf, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.bpe_report(table(spark, sf, "documents"), path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.fill_in_middle_report(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_toxicity, op2_license_scan, op3_source_mixing, op4_quality_classifier, op5_sentencepiece, op6_chat_formatting, op7_quality_rules, op8_line_dedup, op9_minhash_near_dedup, op10_nearest_codes,
    op11_vector_trie, op12_byte_bpe, op13_fill_in_middle,
)}

def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assigning distinct parts to entries and moving these; a distance and an entry's number are one whole number."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT p, c.x, c.n, min(list_sum(list_transform(list_zip(c.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {entries} + e.e) AS best
  FROM counted c JOIN book{k} e USING (p) GROUP BY p, c.x, c.n
)""")
        if k < rounds:
            steps.append(f"""means{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS x FROM (
    SELECT p, (best % {entries})::BIGINT AS e, j, sum(v * n) AS s, sum(n) AS n
    FROM (SELECT p, best, n, unnest(x) AS v, unnest(range(len(x))) AS j FROM near{k}) GROUP BY ALL
  ) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m USING (p, e)
)""")
    chain = ", ".join(steps)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(p)
), counted AS MATERIALIZED (
  SELECT p, x, count(*) AS n FROM cut GROUP BY p, x
), book0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, x FROM cut WHERE r <= {entries}
), {chain}, coded AS (
  SELECT r, string_agg(format('{{:02x}}', (best % {entries})::BIGINT), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
  FROM cut JOIN near{rounds} USING (p, x) GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"""


ORACLES: dict[str, str] = {
    "op2_license_scan": license_scan.SQL,
    "op3_source_mixing": r"""
WITH RECURSIVE counts AS (
  SELECT coalesce('=' || source, 'null') AS src, count(*) AS n, pow(count(*), 0.7) AS w FROM documents GROUP BY 1
), top AS (
  SELECT sum(w) AS w, ceil(max(ceil(n / 16) / w) * sum(w))::BIGINT + count(*) + 2 AS slots, greatest(256, count(*)) AS period FROM counts
), weighed AS (
  SELECT src, n, greatest(1, round(c.w / top.w * pow(2, 61 - ceil(log2(slots + period)))))::HUGEINT AS a, slots FROM counts c, top
), line AS (
  SELECT list(a ORDER BY src) AS a, sum(a)::HUGEINT AS m, max(slots) AS slots FROM weighed
), edf AS (
  SELECT -1::BIGINT AS t, 0::HUGEINT AS pick, list_transform(a, lambda x: 0::HUGEINT) AS done FROM line WHERE m > 0
  UNION ALL
  SELECT t + 1, best, list_transform(done, lambda d, i: d + (i = best)::HUGEINT) FROM (
    SELECT t, done, list_min(list_transform(a, lambda x, i: CASE WHEN done[i] * m // x <= t + 1
      THEN ((done[i] + 1) * m + x - 1) // x * 100000 + i END)) % 100000 AS best
    FROM edf, line WHERE t + 1 < slots
  )
), places AS (
  SELECT pick, list(t ORDER BY t) AS slots FROM edf WHERE t >= 0 GROUP BY pick
), plan AS (
  SELECT src, n, slots FROM (SELECT src, n, row_number() OVER (ORDER BY src) AS i FROM weighed) w JOIN places ON i = pick
), ends AS (
  SELECT max(slots[(n - 1) // 16 + 1]) + 1 AS e FROM plan
), budget AS (
  SELECT *, len(list_filter(slots, lambda s: s < e)) * 16 AS items FROM plan, ends
), ranked AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS src,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id) - 1 AS k FROM documents
), turns AS (
  SELECT doc_id, source, k, n, slots, unnest(range((items - 1 - k) // n + 1)) AS epoch FROM ranked JOIN budget USING (src)
), placed AS (
  SELECT doc_id, source, epoch, k + epoch * n AS item, slots[(k + epoch * n) // 16 + 1] AS slot FROM turns
)
SELECT doc_id, source, epoch, slot, slot * 16 + item % 16 AS position FROM placed""",
    "op6_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, regexp_replace(replace(t, '\', '\\'), '([<\[])((\|(im_start|im_end|endoftext|startoftext|begin_of_text|end_of_text|start_header_id|end_header_id|eot_id|system|user|assistant|end)\|>)|/?s>|/?INST\]|</?SYS>>|(unk|pad|bos|eos|start_of_turn|end_of_turn)>)', '\1\\\2', 'g') AS e FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(e) + 24)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id""",
    "op7_quality_rules": rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM base
), sequence AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words
), windows AS (
  SELECT doc_id, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS g, lead(word, 4) OVER o AS fifth
  FROM sequence WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), named AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE fifth IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM named WHERE n > 1) GROUP BY doc_id
), facts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM words LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS repeated, 10 * n_symbols > n_words AS symbols,
    100 * n_dup_lines > 30 * n_lines AS lines, word_chars < 3 * n_words OR word_chars > 12 * n_words AS lengths FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeated AS base_failed,
  NOT (few OR repeated OR symbols OR lines OR lengths) AS kept,
  CASE WHEN few THEN 'few_words' WHEN repeated THEN 'repeated_words' WHEN symbols THEN 'symbols'
    WHEN lines THEN 'repeated_lines' WHEN lengths THEN 'word_length' END AS rejected_by
FROM judged""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT doc_id, i, line, owner IS NOT NULL AND owner < doc_id AS gone FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op11_vector_trie": _vector_codes_sql(),
    "op13_fill_in_middle": r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), drawn AS (
  SELECT *, len(w) AS n, list_transform(range(4), lambda k: ('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT) AS d FROM split
), cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 : n], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""",
}
