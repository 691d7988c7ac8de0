"""Queries of the operators that stay in the JVM: line dedup, PII surrogates and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm import line_dedup, pii, quality
from veridex.sources.tables import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("text")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(table(spark, sf_dir, "documents"), key="veridex")
    return replaced.withColumn("kinds", F.array_join("kinds", ","))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op9_quality_rules": op9_quality_rules,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, h.keeper IS NOT NULL AND k.doc_id <> h.keeper AS lost FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op9_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
t3 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM t3),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, ls
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
x AS (SELECT doc_id, unnest(ls) AS line FROM b),
y AS (SELECT doc_id, trim(line, {_BLANKS}) AS s FROM x),
z AS (SELECT doc_id, s, len(regexp_split_to_array(s, '[\\x20\\x09-\\x0D]+')) AS n, len(regexp_extract_all(s, '[|»›>•]')) AS marks,
             len(regexp_extract_all(s, '[#*$%&|<>]')) AS signs FROM y),
f AS (SELECT doc_id, sum(length(regexp_replace(s, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS lost FROM z
      WHERE (marks >= 2 AND marks * 4 >= n) OR signs * 10 > length(s)
         OR (n <= 15 AND regexp_matches(s, '{quality.STOCK}'))
         OR (n < 4 AND NOT regexp_matches(s, '{quality.ENDS.replace("'", "''")}'))
      GROUP BY doc_id),
e AS (SELECT b.*, coalesce(lost, 0) AS lost_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM b LEFT JOIN f ON b.doc_id = f.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       CAST(lost_chars AS BIGINT) AS lost_chars, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept
FROM e""",
}
