"""The op queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import audit, chat, decontam, langid, licenses, linededup, minhash, mixing, resample, simhash, suffix, tokenbin, urlrules
from proofmill.llm.common import documents

CONFLICT = r"\### Assistant: </turn> ok"
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), digest=True)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(documents(spark, sf_dir))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_output(documents(spark, sf_dir))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urlrules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(documents(spark, sf_dir))


QUERIES = {"op1_chat": op1_chat, "op2_suffix": op2_suffix, "op3_language": op3_language, "op4_simhash": op4_simhash, "op5_decontam": op5_decontam, "op6_mix": op6_mix, "op7_minhash": op7_minhash, "op8_licenses": op8_licenses, "op9_tokens": op9_tokens, "op10_urls": op10_urls, "op11_resample": op11_resample, "op12_audit": op12_audit, "op13_lines": op13_lines}

_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), parts AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) ELSE 5 + 2 * octet_length(encode(role)) END AS label,
    regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '##(\\*)# ', '##\\\1# ', 'g') AS safe,
    regexp_matches(text, '<\\*/turn>|##\\*# ') AS clash
  FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    bool_or(clash) AS escaped,
    sum(4 + label + 2 + length(text) + 8) AS plain_chars, sum(4 + label + 2 + length(safe) + 8) AS safe_chars
  FROM parts GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (CASE WHEN escaped THEN safe_chars ELSE plain_chars END)::BIGINT AS formatted_chars, escaped
FROM whole
"""

_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::BIGINT AS w FROM totals
), seen AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS pool, sum(w) OVER () AS all_w,
    coalesce(sum(2 * source_size) OVER f, 0) AS before, coalesce(sum(w) OVER f, 0) AS before_w
  FROM weighed
  WINDOW f AS (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, 2 * source_size <= w * (pool - before) / (all_w - before_w) AS is_full FROM seen
), leveled AS (
  SELECT *, sum(CASE WHEN is_full THEN 2 * source_size ELSE 0 END) OVER () AS full_cap,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS open_w FROM flagged
), plan AS (
  SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE w * ((pool - full_cap) / nullif(open_w, 0)) END AS target FROM leveled
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS rate FROM plan
), joined AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, floor(r.rate)::BIGINT AS times, r.rate - floor(r.rate) AS fraction
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT source, doc_id, any_value(fraction) AS fraction,
    row_number() OVER (PARTITION BY source ORDER BY max(size) DESC, doc_id ASC NULLS FIRST) AS r,
    ('0x' || substr(md5('11/' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM joined WHERE size * 50 > source_size GROUP BY source, doc_id
), long AS (
  SELECT source, doc_id, (floor(r * fraction + u) - floor((r - 1) * fraction + u))::BIGINT AS together FROM ranked
), copies AS (
  SELECT j.*, times + coalesce(l.together, CASE WHEN ('0x' || substr(md5('11/' || coalesce(j.source, '') || '/' || coalesce(j.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < j.fraction THEN 1 ELSE 0 END) AS copies
  FROM joined j LEFT JOIN long l ON j.source IS NOT DISTINCT FROM l.source AND j.doc_id IS NOT DISTINCT FROM l.doc_id
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copies
"""

_OP10 = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict AS v,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS rk
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE rk = 1
"""

_OP12 = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS capitals,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), masks AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * capitals > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM worded
), flags AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE bad) AS n_bad
  FROM masks LEFT JOIN flags USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), done AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n_bad) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM done
"""

_OP13 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLE = {"op1_chat": _OP1, "op6_mix": _OP6, "op10_urls": _OP10, "op12_audit": _OP12, "op13_lines": _OP13}
