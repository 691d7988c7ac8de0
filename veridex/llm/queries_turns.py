"""Queries of the operators on vectors, on conversations and on byte-level vocabularies."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridex.llm import byte_bpe, conversations, whitening
from veridex.llm.queries_scans import digests
from veridex.sources.tables import table


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


def op13_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


QUERIES = {
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_byte_bpe_round_trip": op13_byte_bpe_round_trip,
}


def _more(state: str, price: str, letter: str) -> str:
    """A way (six digits of cost, then its letters) with one more edit."""
    return f"lpad(CAST(CAST(left({state}, 6) AS BIGINT) + {price} AS VARCHAR), 6, '0') || substr({state}, 7) || '{letter}'"


def _to_user(price: str, letter: str) -> str:
    return f"least({', '.join(_more(s, price, letter) for s in ('i0', 'i1', 'i3'))})"


_BLANK = "\\x20\\x09-\\x0D"
_INSERTED = f"""SELECT *, s0 AS i0, s1 AS i1, least(s2, {_more('s0', '3', 'I')}, {_more('s1', '3', 'I')}, {_more('s3', '3', 'I')}) AS i2,
                       least(s3, {_more(f"least(s2, {_more('s0', '3', 'I')}, {_more('s1', '3', 'I')})", '3', 'I')}) AS i3"""

ORACLES = {
    "op12_conversation_repair": f"""
WITH RECURSIVE
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, len(name) + 1),
                     lambda i: list_prepend(CAST(ascii(name[i]) AS BIGINT), list_transform(range(8), lambda j: CAST(-1 AS BIGINT)))))),
                lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM n),
f AS (SELECT conv_id, turn, xor(crc, CAST(4294967295 AS BIGINT)) % 20 AS d, role, text FROM k),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE d <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM g),
h AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_BLANK}]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][{_BLANK}]*\\z') THEN 'truncated' ELSE '' END AS fault,
             left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM p),
a AS (SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated,
             count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM h GROUP BY conv_id),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS step, n_rows, '000000' AS s0, '900000' AS s1, '900000' AS s2, '900000' AS s3 FROM a
  UNION ALL
  SELECT i.conv_id, i.step + 1, i.n_rows, {_more('i0', '4', 'D')},
         least({_more('i1', '4', 'D')}, CASE WHEN whole AND initial = 's' THEN {_more('i0', 'more', 'K')} ELSE '999999' END),
         least({_more('i2', '4', 'D')}, CASE WHEN whole THEN {_to_user('3 + more', 'R')} ELSE '999999' END,
               CASE WHEN whole AND initial = 'u' THEN {_to_user('more', 'K')} ELSE '999999' END),
         least({_more('i3', '4', 'D')}, CASE WHEN whole THEN {_more('i2', '3 + more', 'R')} ELSE '999999' END,
               CASE WHEN whole AND initial = 'a' THEN {_more('i2', 'more', 'K')} ELSE '999999' END)
  FROM ({_INSERTED} FROM w WHERE step < n_rows) i
  JOIN (SELECT conv_id, pos, initial, fault IN ('', 'truncated') AS whole, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM h) x
    ON x.conv_id IS NOT DISTINCT FROM i.conv_id AND x.pos = i.step + 1),
z AS (SELECT conv_id, least(i0, i3) AS way FROM ({_INSERTED} FROM w WHERE step = n_rows)),
e AS (SELECT conv_id, substr(way, 7) AS audit, unnest(range(1, len(way) - 5)) AS j FROM z),
l AS (SELECT conv_id, j, audit[j] AS edit, len(replace(left(audit, j), 'I', '')) AS pos, len(replace(left(audit, j), 'D', '')) AS nth,
             len(replace(audit, 'D', '')) % 2 AS odd FROM e),
t AS (SELECT l.conv_id, j, CASE WHEN edit = 'K' THEN h.role WHEN (nth - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
                           || ':' || CASE WHEN edit = 'I' THEN '' ELSE h.text END AS line
      FROM l LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM l.conv_id AND h.pos = l.pos AND edit <> 'I' WHERE edit <> 'D'),
s AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS whole FROM t GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(way, 6) AS BIGINT), 0) AS cost,
       coalesce(substr(way, 7), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM o LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
