"""Risk certificates, gates, decisions, nested records, vectors and validation over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veridex.functions import decide
from veridex.functions import text as tx
from veridex.operators import rank, risk, validate, vectors
from veridex.plans.register import registrar
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()
GRID = [i / 50 for i in range(50)]
_OBS = "SELECT least(n_chars / 4000.0, 1.0)::DOUBLE AS score, 1 - quality AS failed FROM labels JOIN documents USING (doc_id)"
_SWEPT = f"""o AS ({_OBS}), t AS (SELECT i / 50.0::DOUBLE AS threshold FROM range(50) r(i)), s AS (SELECT threshold, (SELECT count(*) FROM o) AS targets, count(*) FILTER (WHERE score >= threshold) AS trusted,
coalesce(sum(failed) FILTER (WHERE score >= threshold), 0)::BIGINT AS failures FROM t, o GROUP BY threshold)"""


def observations(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).cast("double").alias("score"), (1 - F.col("quality")).alias("failed"))


@query("j15_a22_threshold_sweep", f"WITH {_SWEPT} SELECT threshold, targets, trusted, failures FROM s")
def sweep(spark, d):
    return risk.sweep(observations(spark, d), "score", "failed", GRID)


@query(
    "a23_hoeffding_certificate",
    f"WITH {_SWEPT}, b AS (SELECT *, least(1.0, failures / trusted + sqrt({math.log(50 / 0.1)!r} / (2 * trusted))) AS bound FROM s WHERE trusted > 0) SELECT threshold, trusted, failures, round(bound, 6) AS bound FROM b WHERE bound <= 0.6 ORDER BY trusted DESC, threshold LIMIT 1",
)
def certificate(spark, d):
    found = risk.certified(risk.hoeffding(risk.sweep(observations(spark, d), "score", "failed", GRID), 0.1, 50), 0.6)
    return found.select("threshold", "trusted", "failures", F.round("bound", 6).alias("bound"))


@query(
    "a24_a25_fixed_threshold",
    f"WITH {_SWEPT} SELECT threshold, trusted, CASE WHEN trusted > 0 THEN round(least(1.0, failures / trusted + sqrt({math.log(1 / 0.1)!r} / (2 * trusted))), 6) END AS bound, {risk.least_zero_failure_n(0.3, 0.1, 50)}::BIGINT AS least_n FROM s WHERE abs(threshold - 0.8) < 1e-9",
)
def fixed(spark, d):
    swept = risk.hoeffding(risk.sweep(observations(spark, d), "score", "failed", [0.8]), 0.1, 1)
    return swept.select("threshold", "trusted", F.round("bound", 6).alias("bound"), F.lit(risk.least_zero_failure_n(0.3, 0.1, 50)).cast("bigint").alias("least_n"))


_GAP = """c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, lead(n) OVER w AS nx, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type)),
g AS (SELECT user_id, (n - nx)::DOUBLE AS gap, event_type IN ('click', 'view') AS correct FROM r WHERE rn = 1)"""


def gated(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return rank.gaps(counted, ["user_id"], "n", "event_type").select("user_id", "gap", F.col("event_type").isin("click", "view").alias("correct"))


@query(
    "e7_gate_sweep",
    f"""WITH {_GAP} SELECT t AS threshold, count(*) FILTER (WHERE gap >= t) AS trusted, count(*) FILTER (WHERE gap >= t AND correct) AS correct_trusted, count(*) FILTER (WHERE gap >= t AND NOT correct) AS unsafe,
count(*) FILTER (WHERE NOT coalesce(gap >= t, false)) AS fail_closed FROM g, (VALUES (0.0::DOUBLE), (1), (2), (4), (8)) AS v(t) GROUP BY t""",
)
def gate_sweep(spark, d):
    rows = gated(spark, d).withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in (0.0, 1.0, 2.0, 4.0, 8.0)))))
    return rows.groupBy("threshold").agg(*risk.gate_counts(rows, "gap", "correct", F.col("threshold")))


@query("e7_zero_unsafe_threshold", f"WITH {_GAP} SELECT coalesce(max(gap) FILTER (WHERE NOT correct), 0) + 1e-6 AS threshold FROM g")
def zero_unsafe(spark, d):
    rows = gated(spark, d)
    return risk.zero_unsafe_threshold(rows, "gap", "correct")


@query(
    "e8_a26_centred_calibration",
    """WITH c AS (SELECT user_id, event_type, avg(value) AS s FROM events GROUP BY 1, 2), m AS (SELECT event_type, avg(s) AS mean FROM c WHERE user_id % 4 <> 0 GROUP BY 1),
x AS (SELECT user_id, event_type, s - mean AS centred FROM c JOIN m USING (event_type) WHERE user_id % 4 = 0)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(centred, 9) DESC, event_type) AS rn FROM x) WHERE rn = 1""",
)
def centred(spark, d):
    scores = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("s"))
    means = scores.filter("user_id % 4 <> 0").groupBy("event_type").agg(F.avg("s").alias("mean"))
    held = scores.filter("user_id % 4 = 0").join(means, "event_type").withColumn("centred", F.round(F.col("s") - F.col("mean"), 9))
    return rank.top_per_group(held, ["user_id"], [F.col("centred").desc(), F.col("event_type")]).select("user_id", "event_type")


_FLAGS = """f AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_linestatus) > 1 AS mixed, max(l_discount) > 0.09 AS invalid, true AS present FROM lineitem GROUP BY 1, 2)"""


def flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg((F.min("l_linestatus") < F.max("l_linestatus")).alias("mixed"), (F.max("l_discount") > 0.09).alias("invalid"), F.lit(True).alias("present"))


@query(
    "g1_g2_policies_a_and_b",
    f"""WITH {_FLAGS}, p AS (SELECT CASE WHEN mixed THEN 'flag' WHEN invalid THEN 'reject' ELSE 'ground' END AS policy_a, CASE WHEN invalid THEN 'reject' WHEN mixed THEN 'flag' ELSE 'ground' END AS policy_b FROM f)
SELECT policy_a, policy_b, count(*) AS n FROM p GROUP BY 1, 2""",
)
def policies(spark, d):
    args = (F.col("mixed"), F.col("invalid"), F.col("present"))
    return flags(spark, d).groupBy(decide.policy_a(*args).alias("policy_a"), decide.policy_b(*args).alias("policy_b")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g3_g6_gate_with_reason_and_score",
    f"""WITH {_FLAGS}, p AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'defer' WHEN mixed THEN 'flag' WHEN invalid THEN 'reject' ELSE 'ground' END AS action, CASE WHEN l_suppkey % 10 = 0 THEN 'stale' WHEN mixed THEN 'mixed_endpoint' WHEN invalid THEN 'invalid_value' ELSE 'clean' END AS reason, mixed FROM f)
SELECT action, reason, count(*) AS n, sum(CASE WHEN action = 'defer' THEN 0.0 WHEN (action = 'flag') = mixed THEN 1.0 ELSE -0.5 END)::DOUBLE AS score FROM p GROUP BY 1, 2""",
)
def gate(spark, d):
    cases = [(F.col("l_suppkey") % 10 == 0, "defer", "stale"), (F.col("mixed"), "flag", "mixed_endpoint"), (F.col("invalid"), "reject", "invalid_value")]
    rows = flags(spark, d).select(decide.first_match([(c, a) for c, a, _ in cases], "ground").alias("action"), decide.first_match([(c, r) for c, _, r in cases], "clean").alias("reason"), "mixed")
    points = F.when(F.col("action") == "defer", 0.0).when((F.col("action") == "flag") == F.col("mixed"), 1.0).otherwise(-0.5)
    return rows.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(points).alias("score"))


@query(
    "g7_g8_tiers_and_verdicts",
    """SELECT l_suppkey, CASE WHEN n = 0 THEN 'no_recorded_failure' WHEN share >= 0.4 THEN 'grounded' ELSE 'grounded_advisory' END AS verdict, CASE WHEN share >= 0.4 THEN 'confident' WHEN share >= 0.3 THEN 'advisory' ELSE 'low' END AS tier
FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS share FROM lineitem GROUP BY 1)""",
)
def verdicts(spark, d):
    counted = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n"), F.count(F.lit(1)).alias("t"))
    share = F.col("n") / F.col("t")
    verdict = decide.first_match([(F.col("n") == 0, "no_recorded_failure"), (share >= 0.4, "grounded")], "grounded_advisory")
    return counted.select("l_suppkey", verdict.alias("verdict"), decide.first_match([(share >= 0.4, "confident"), (share >= 0.3, "advisory")], "low").alias("tier"))


@query("g10_invalid_values", "SELECT event_id, TRY_CAST(x AS DOUBLE) IS NULL OR TRY_CAST(x AS DOUBLE) NOT BETWEEN 0 AND 1 AS invalid FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '14.73' WHEN 2 THEN '-0.1' ELSE '0.5' END AS x FROM events)")
def invalid(spark, d):
    m = F.col("event_id") % 5
    return table(spark, d, "events").select("event_id", tx.invalid_probability(F.when(m == 0, "abc").when(m == 1, "14.73").when(m == 2, "-0.1").otherwise("0.5")).alias("invalid"))


@query(
    "h1_ordered_subsequence",
    """WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_type) AS tools FROM events GROUP BY 1), a AS (SELECT user_id, list_position(tools, 'view') AS v, tools FROM s)
SELECT user_id, coalesce(v > 0 AND list_contains(tools[v + 1 :], 'purchase'), false) AS reached, len(tools)::BIGINT AS steps FROM a""",
)
def subsequence(spark, d):
    steps = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("s"))
    reached = tx.ordered_subsequence(F.transform("s", lambda x: x["event_type"]), F.array(F.lit("view"), F.lit("purchase")))
    return steps.select("user_id", reached.alias("reached"), F.size("s").cast("bigint").alias("steps"))


@query("h9_h14_candidate_enumeration", "SELECT n_nationkey, unnest(list_concat(['defer', 'verify'], ['ground:' || n_nationkey, 'flag:' || n_nationkey])) AS candidate FROM nation")
def candidates(spark, d):
    ids = F.array(F.col("n_nationkey").cast("string"))
    made = F.flatten(F.transform(F.array(F.lit("ground"), F.lit("flag")), lambda a: F.transform(ids, lambda i: F.concat_ws(":", a, i))))
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.concat(F.array(F.lit("defer"), F.lit("verify")), made)).alias("candidate"))


@query("h7_first_matching_message", "SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(length(text), turn) AS size FROM conversations WHERE role = 'assistant' GROUP BY 1")
def first_message(spark, d):
    said = table(spark, d, "conversations").filter("role = 'assistant'")
    return said.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by(F.length("text"), "turn").cast("bigint").alias("size"))


@query(
    "j16_m1_vector_top_k",
    """SELECT q.vec_id AS query, v.vec_id AS match FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) <= 5""",
)
def nearest(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(rows, rows, "vec_id", "embedding", 5).select("query", "match")


@query(
    "a33_recall_at_k",
    """WITH t AS (SELECT q.label AS ql, v.label AS vl, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rn, q.vec_id
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id), g AS (SELECT vec_id, max((rn = 1 AND ql = vl)::INT) AS top1, max((rn <= 8 AND ql = vl)::INT) AS top8 FROM t GROUP BY 1)
SELECT avg(top1)::DOUBLE AS recall_at_1, avg(top8)::DOUBLE AS ceiling_at_8 FROM g""",
)
def recall(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    top = vectors.top_k(rows, rows, "vec_id", "embedding", 9, label="label")  # a ninth, which is no hit, where labels are missing
    hit = (F.col("query_label") == F.col("match_label")).cast("int")
    per = top.groupBy("query").agg(*(F.max(F.when(F.col("rn") <= n, hit).otherwise(0)).alias(f"top{n}") for n in (1, 8)))
    return per.agg(F.avg("top1").alias("recall_at_1"), F.avg("top8").alias("ceiling_at_8"))


@query("a30_band_precision", "SELECT floor(l_discount * 50) / 50 AS low, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1")
def bands(spark, d):
    low = F.floor(F.col("l_discount") * 50) / 50
    return table(spark, d, "lineitem").groupBy(low.cast("double").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("hits"))


@query(
    "v1_row_issues",
    "SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT (o_totalprice BETWEEN 1000 AND 400000) THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL)) AS issue FROM orders",
)
def row_issues(spark, d):
    return validate.issues(table(spark, d, "orders"), "o_orderkey", [("price", F.col("o_totalprice").between(1000, 400000)), ("status", F.col("o_orderstatus").isin("F", "O"))])


@query("v2_duplicate_keys", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return validate.duplicates(table(spark, d, "part"), "p_name")


@query("v3_hidden_value_leak", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || c_mktsegment), lower(right(c_custkey::VARCHAR, 2)))")
def leak(spark, d):
    visible = F.struct("c_name", "c_mktsegment")
    return validate.leaks(table(spark, d, "customer"), visible, F.right(F.col("c_custkey").cast("string"), F.lit(2))).select("c_custkey")


@query("v4_least_class_counts", "SELECT w.lang, least, coalesce(n, 0) AS n FROM (VALUES ('en', 10), ('it', 1), ('de', 1000000)) AS w(lang, least) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) c ON w.lang = c.lang WHERE coalesce(n, 0) < least")
def class_counts(spark, d):
    return validate.least_counts(table(spark, d, "documents"), "lang", {"en": 10, "it": 1, "de": 1_000_000})


@query("v5_split_overlap", "SELECT count(*) AS overlap FROM (SELECT p_name FROM part WHERE p_partkey % 10 = 0 INTERSECT SELECT p_name FROM part WHERE p_partkey % 10 <> 0)")
def overlap(spark, d):
    part = table(spark, d, "part")
    return part.filter("p_partkey % 10 = 0").select("p_name").intersect(part.filter("p_partkey % 10 <> 0").select("p_name")).agg(F.count(F.lit(1)).alias("overlap"))


@query("v10_sensitive_patterns", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}') AND NOT regexp_matches(text, 'AKIAEXAMPLE')")
def sensitive(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike("AKIA[0-9A-Z]{16}") & ~F.col("text").rlike("AKIAEXAMPLE")).select("doc_id")


@query("v13_manifest_reconciliation", "SELECT c.lang, c.n AS computed, CASE WHEN c.lang = 'fr' THEN c.n + 1 ELSE c.n END AS declared FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) c WHERE c.lang = 'fr'")
def manifest(spark, d):
    counted = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    declared = counted.select("lang", (F.col("n") + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("n"))
    return validate.reconciled(counted, declared, "lang", "n")


@query(
    "e9_e10_preference_pairs",
    """SELECT doc_id, gold AS chosen, unnest(list_filter(['ground', 'flag', 'reject', 'defer'], lambda a: a <> gold)) AS rejected FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'ground' ELSE 'flag' END AS gold FROM labels)""",
)
def preference_pairs(spark, d):
    gold = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "ground").otherwise("flag")
    actions = F.array(*map(F.lit, ["ground", "flag", "reject", "defer"]))
    return table(spark, d, "labels").select("doc_id", gold.alias("chosen")).select("doc_id", "chosen", F.explode(F.filter(actions, lambda a: a != F.col("chosen"))).alias("rejected"))
