"""Evidence routing over a fact table: flags per key, then an ordered decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.functions import decide
from veridex.sources.tables import table


def evidence_flags(lineitem: DataFrame) -> DataFrame:
    """Per (part, supplier): distinct endpoints, an out-of-range value, any evidence at all."""
    return lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.countDistinct("l_linestatus").alias("n_endpoints"),
        F.max(F.when(F.col("l_discount") > 0.09, 1).otherwise(0)).alias("has_invalid"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def evidence_routing_policy_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each decision of policy A (flag, then reject, then ground)."""
    flags = evidence_flags(table(spark, sf_dir, "lineitem"))
    action = decide.policy_a(F.col("n_endpoints") > 1, F.col("has_invalid") == 1, F.col("n_rows") > 0)
    return flags.select(action.alias("action"), "n_rows").groupBy("action").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows")
    )


QUERIES = {"evidence_routing_policy_a": evidence_routing_policy_a}

ORACLES = {
    "evidence_routing_policy_a": """
WITH f AS (
  SELECT l_partkey, l_suppkey, count(DISTINCT l_linestatus) AS n_endpoints,
         max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS has_invalid, count(*) AS n_rows
  FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN n_endpoints > 1 THEN 'flag' WHEN has_invalid = 1 THEN 'reject' WHEN n_rows > 0 THEN 'ground' ELSE 'defer' END AS action,
       CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(n_rows) AS BIGINT) AS n_rows
FROM f GROUP BY 1"""
}
