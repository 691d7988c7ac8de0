"""Nearest vectors with all rows as queries, through the inverted file; tests hold them against the exact answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridex.functions import text as tx
from veridex.operators import resolve, vector_index, vectors
from veridex.plans.register import registrar
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()


@query("j16_all_rows_top_k")
def all_nearest(spark, d):
    """The 5 most similar rows of every row, of lists that hold 95 in 100 of a sample's true neighbours."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector_index.fit(rows, "vec_id", "embedding", 5)
    return vector_index.top_k(index, rows, rows, "vec_id", "embedding", 5)


@query("a33_recall_of_the_index")
def index_recall(spark, d):
    """The share of the true 5 nearest of ids divisible by 50 that the index finds, and whether it is 0.9 at least."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector_index.fit(rows, "vec_id", "embedding", 5)
    asked = rows.filter("vec_id % 50 = 0")
    found = vector_index.top_k(index, asked, rows, "vec_id", "embedding", 5).select("query", "match", F.lit(1).alias("hit"))
    true = vectors.top_k(asked, rows, "vec_id", "embedding", 5).select("query", "match")
    held = true.join(found, ["query", "match"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return held.withColumn("reached", F.col("recall") >= 0.9)


@query("a31_nil_rejection_of_all_rows")
def all_nil_rejection(spark, d):
    """For each threshold the rows whose most similar row of another label reaches it, all rows as queries."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    index = vector_index.fit(rows, "vec_id", "embedding", 1, concept="label")
    best = vector_index.top_k(index, rows, rows, "vec_id", "embedding", 1, concept="label")
    swept = best.select("similarity", F.explode(F.array(*map(F.lit, [0.2, 0.3, 0.4, 0.5]))).alias("threshold"))
    return swept.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("similarity") >= F.col("threshold"), 1)).alias("false_ground"))


_NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_ACUTE = "(regexp_matches({0}, '\\bacute\\b') AND regexp_matches({1}, '\\bchronic\\b'))"
HIGH, MEDIUM = 0.42, 0.34


def named_vectors(spark, d):
    """Vectors with names and brands of parts: id, name, concept, obsolete, vector, size."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")).join(part, "id")
    name = F.concat("p_name", F.when(F.col("label") % 3 == 0, " chronic").otherwise(""))
    return rows.select("id", name.alias("name"), F.col("p_brand").alias("concept"), (F.col("label") % 5 == 0).alias("obsolete"), "vector", F.col("p_size").alias("size"), "p_name")


@query(
    "g7_g9_resolution_by_tiers",
    f"""WITH v AS (SELECT vec_id AS id, p_name || CASE WHEN label % 3 = 0 THEN ' chronic' ELSE '' END AS name, p_brand AS concept, label % 5 = 0 AS obsolete, embedding, p_size AS size, p_name FROM embeddings JOIN part ON vec_id = p_partkey),
q AS (SELECT id, embedding, CASE size % 6 WHEN 0 THEN p_name || ' placebo' WHEN 1 THEN '(' || p_name || ') ?' WHEN 2 THEN upper(p_name) || '!' WHEN 3 THEN p_name || ' brand' ELSE p_name || ' of acute kind' END AS name FROM v WHERE id % 10 = 0),
n AS (SELECT *, {_NORMAL.format("name")} AS normal FROM q), dict AS (SELECT lower(p_name) AS normal, min(p_brand) AS concept FROM part GROUP BY 1), ali AS (SELECT lower(p_name) || ' brand' AS normal, max(p_brand) AS concept FROM part WHERE length(p_name) % 2 = 0 GROUP BY 1),
l AS (SELECT n.*, CASE WHEN regexp_matches(name, '{tx.VAGUE}') THEN 'vague_or_combined' WHEN n.normal = '' THEN 'empty_after_normalising' END AS abstain, dict.concept AS exact, ali.concept AS alias FROM n LEFT JOIN dict ON n.normal = dict.normal LEFT JOIN ali ON n.normal = ali.normal),
t AS (SELECT l.id AS query, v.name, v.concept, v.obsolete, l.normal, round(list_dot_product(l.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS s, v.id AS match, row_number() OVER (PARTITION BY l.id ORDER BY round(list_dot_product(l.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.id) AS rn
FROM l JOIN v ON l.id <> v.id WHERE abstain IS NULL AND exact IS NULL AND alias IS NULL),
u AS (SELECT *, NOT obsolete AND NOT ({_ACUTE.format("normal", _NORMAL.format("name"))} OR {_ACUTE.format(_NORMAL.format("name"), "normal")}) AS usable FROM t WHERE rn <= 10),
b AS (SELECT query, round(max(s), 6) AS best, arg_min(name, rn) FILTER (WHERE usable) AS name, arg_min(concept, rn) FILTER (WHERE usable) AS concept, round(arg_min(s, rn) FILTER (WHERE usable), 6) AS s FROM u GROUP BY 1)
SELECT id, CASE WHEN l.abstain IS NULL THEN coalesce(exact, alias, CASE WHEN s >= {MEDIUM} THEN b.concept END) END AS concept, CASE WHEN l.abstain IS NULL THEN CASE WHEN coalesce(exact, alias) IS NOT NULL THEN normal WHEN s >= {MEDIUM} THEN b.name END END AS matched,
CASE WHEN l.abstain IS NULL THEN CASE WHEN coalesce(exact, alias) IS NOT NULL THEN 1.0 WHEN s >= {MEDIUM} THEN s ELSE best END END::DOUBLE AS confidence,
CASE WHEN l.abstain IS NULL THEN CASE WHEN exact IS NOT NULL THEN 'exact' WHEN alias IS NOT NULL THEN 'alias' WHEN s >= {HIGH} THEN 'vector_confident' WHEN s >= {MEDIUM} THEN 'vector_advisory' END END AS source,
coalesce(l.abstain, CASE WHEN coalesce(exact, alias) IS NULL AND NOT coalesce(s >= {MEDIUM}, false) THEN 'below_threshold' END) AS abstain FROM l LEFT JOIN b ON l.id = b.query""",
)
def resolution(spark, d):
    """Names as people write them, of ids divisible by 10, resolved to brands through all tiers."""
    entries = named_vectors(spark, d)
    m = F.col("size") % 6
    said = F.when(m == 0, F.concat("p_name", F.lit(" placebo"))).when(m == 1, F.concat(F.lit("("), "p_name", F.lit(") ?"))).when(m == 2, F.concat(F.upper("p_name"), F.lit("!")))
    said = said.when(m == 3, F.concat("p_name", F.lit(" brand"))).otherwise(F.concat("p_name", F.lit(" of acute kind")))
    asked = entries.filter("id % 10 = 0").select("id", said.alias("name"), "vector")
    part = table(spark, d, "part")
    dictionary = part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_brand").alias("concept"))
    aliases = part.filter(F.length("p_name") % 2 == 0).groupBy(F.concat(F.lower("p_name"), F.lit(" brand")).alias("name")).agg(F.max("p_brand").alias("concept"))
    return resolve.resolve(asked, dictionary, aliases, entries, HIGH, MEDIUM)
