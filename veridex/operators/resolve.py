"""Resolution of names to concepts by tiers, the last of them by vectors, with a reason for each abstention.

A name that is vague, or of which nothing is left, isn't looked up.  The others go through the dictionary, then the aliases,
each name once; what is left looks at the most similar entries in order, passes over obsolete ones and opposites, and takes
the first that remains if it is similar enough: confident, or advisory below a higher threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import text as tx
from veridex.operators import vectors

VAGUE, EMPTY, UNKNOWN = "vague_or_combined", "empty_after_normalising", "below_threshold"


def resolve(
    queries: DataFrame, dictionary: DataFrame, aliases: DataFrame, entries: DataFrame, high: float, medium: float, k: int = 10
) -> DataFrame:
    """(id, concept, matched, confidence, source, abstain) for each query.

    queries: id, name, vector.  dictionary and aliases: name (normal, distinct), concept.  entries: id, name, concept, obsolete,
    vector; a query isn't compared with the entry of its own id.  source is exact, alias, vector_confident or
    vector_advisory; where nothing is found, abstain has the reason, and confidence the best similarity if there is one.
    """
    normal = tx.normal_condition(F.col("name"))
    named = queries.withColumn("normal", normal).withColumn("abstain", F.when(tx.vague(F.col("name")), VAGUE).when(F.coalesce("normal", F.lit("")) == "", EMPTY))
    one = dictionary.select(F.col("name").alias("normal"), F.col("concept").alias("_exact"))
    two = aliases.select(F.col("name").alias("normal"), F.col("concept").alias("_alias"))
    looked = named.join(one, "normal", "left").join(two, "normal", "left")
    found = F.when(F.col("abstain").isNull(), F.coalesce("_exact", "_alias"))
    source = F.when(found.isNotNull(), F.when(F.col("_exact").isNotNull(), "exact").otherwise("alias"))
    looked = looked.select("id", "name", "normal", "vector", "abstain", found.alias("concept"), source.alias("source"))

    settled = looked.filter("concept IS NOT NULL OR abstain IS NOT NULL")
    rest = looked.filter("concept IS NULL AND abstain IS NULL AND vector IS NOT NULL")
    near = vectors.top_k(rest.select("id", "vector"), entries.filter("vector IS NOT NULL").select("id", "vector"), "id", "vector", k)
    shown = entries.select(F.col("id").alias("match"), F.col("name").alias("entry"), F.col("concept").alias("_concept"), "obsolete")
    near = near.join(shown, "match").join(rest.select(F.col("id").alias("query"), F.col("normal").alias("asked")), "query")
    usable = ~F.col("obsolete") & ~F.coalesce(tx.opposed(F.col("asked"), tx.normal_condition(F.col("entry"))), F.lit(False))
    choice = F.struct("entry", "_concept", F.round("similarity", 6).alias("similarity"))
    best = near.groupBy("query").agg(F.min_by(F.when(usable, choice), F.when(usable, F.col("rn"))).alias("taken"), F.round(F.max("similarity"), 6).alias("_best"))
    enough = F.col("taken.similarity") >= medium
    judged = rest.join(best, rest["id"] == best["query"], "left").select(
        "id",
        F.when(enough, F.col("taken._concept")).alias("concept"),
        F.when(enough, F.col("taken.entry")).alias("matched"),
        F.when(enough, F.col("taken.similarity")).otherwise(F.col("_best")).alias("confidence"),
        F.when(F.col("taken.similarity") >= high, "vector_confident").when(enough, "vector_advisory").alias("source"),
        F.when(~F.coalesce(enough, F.lit(False)), UNKNOWN).alias("abstain"),
    )
    blank = looked.filter("concept IS NULL AND abstain IS NULL AND vector IS NULL").withColumn("abstain", F.lit(UNKNOWN))
    plain = settled.union(blank).select(
        "id", "concept", F.when(F.col("concept").isNotNull(), F.col("normal")).alias("matched"), F.when(F.col("concept").isNotNull(), 1.0).alias("confidence"), "source", "abstain"
    )
    return plain.unionByName(judged)
