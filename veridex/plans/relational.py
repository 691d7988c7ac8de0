"""Projections, filters, joins, aggregates and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridex.functions import nested
from veridex.functions import text as tx
from veridex.operators import joins, metrics
from veridex.plans.register import registrar
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()


@query("p1_p3_scan_in_list", "SELECT p_partkey, p_name, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_name IS NOT NULL")
def p1_p3(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & F.col("p_name").isNotNull()).select("p_partkey", "p_name", "p_type")


@query("p2_coalesce_label", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END, ''), nullif(c_mktsegment, ''), 'customer:' || c_custkey) AS label FROM customer")
def p2(spark, d):
    name = F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("")
    return table(spark, d, "customer").select("c_custkey", tx.label_of(name, F.col("c_mktsegment"), F.concat(F.lit("customer:"), "c_custkey")).alias("label"))


@query("p4_ilike", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%licen%'")
def p4(spark, d):
    return table(spark, d, "documents").filter(F.col("text").ilike("%licen%")).select("doc_id", "lang")


@query("p5_equal_and_unequal", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def p5(spark, d):
    return table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")


@query("p6_in_list_by_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def p6(spark, d):
    ids = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(ids, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("p9_injected_value", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey = 7 THEN 14.73 ELSE l_discount END AS p_value FROM lineitem")
def p9(spark, d):
    value = F.when(F.col("l_partkey") == 7, 14.73).otherwise(F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("p_value"))


@query(
    "p12_first_failing_reason",
    """SELECT coalesce(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' WHEN o_totalprice < 50000 THEN 'small'
WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'old' WHEN o_orderpriority LIKE '5%' THEN 'priority' END, 'eligible') AS reason, count(*) AS n FROM orders GROUP BY 1""",
)
def p12(spark, d):
    reason = (
        F.when(~F.col("o_orderstatus").isin("F", "O"), "status").when(F.col("o_totalprice") < 50000, "small")
        .when(F.col("o_orderdate") < F.lit("1994-01-01").cast("timestamp"), "old").when(F.col("o_orderpriority").like("5%"), "priority")
    )
    return table(spark, d, "orders").groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_parse_checks",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 10 AND 90, false) AS in_range,
regexp_matches(event_type, '^[a-z_]+$') AS well_formed FROM events""",
)
def p13(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(k.between(10, 90), F.lit(False)).alias("in_range"), F.col("event_type").rlike("^[a-z_]+$").alias("well_formed"))


@query("p14_enum_mapping", "SELECT lang, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' ELSE error('unknown language') END AS family, count(*) AS n FROM documents GROUP BY lang")
def p14(spark, d):
    """An unknown language stops the query."""
    names = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
    counted = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("lang", nested.required_name(F.col("lang"), names, "language").alias("family"), "n")


@query(
    "j1_three_way_join",
    """SELECT p_brand, n_name, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2""",
)
def j1(spark, d):
    facts = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_quantity")
    joined = facts.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("j3_distinct_values_per_key", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def j3(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query(
    "j4_j5_aligned_outer_join",
    """SELECT CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unexpected' ELSE 'matched' END AS join_status, count(*) AS n
FROM labels l FULL JOIN (SELECT doc_id, n_chars FROM documents WHERE n_chars > 800) p ON l.doc_id = p.doc_id GROUP BY 1""",
)
def j4(spark, d):
    predictions = table(spark, d, "documents").filter("n_chars > 800").select("doc_id", "n_chars")
    return joins.aligned(table(spark, d, "labels"), predictions, "doc_id").groupBy("join_status").agg(F.count(F.lit(1)).alias("n"))


@query("j6_j7_left_join_with_status", "SELECT d.doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 'no_match' ELSE 'joined' END AS join_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j7(spark, d):
    return joins.with_status(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("j8_semi_join", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def j8(spark, d):
    hot = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(hot, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("j9_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j9(spark, d):
    used = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(used, "c_custkey", "left_anti").select("c_custkey")


@query(
    "j10_exclude_on_any_key",
    """SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey > 100 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey <= 20)
AND p_type || p_brand NOT IN (SELECT p_type || p_brand FROM part WHERE p_partkey <= 20)""",
)
def j10(spark, d):
    part = table(spark, d, "part").withColumn("group", F.concat("p_type", "p_brand"))
    used = part.filter("p_partkey <= 20")
    return joins.exclude_used(part.filter("p_partkey > 100"), [(used, "p_name"), (used, "group")]).select("p_partkey", "p_name", "p_brand")


@query(
    "j11_overlap_audit",
    "SELECT count(*) AS before_n, count(*) FILTER (WHERE o_custkey % 7 = 0) AS overlap_n, count(*) FILTER (WHERE o_custkey % 7 <> 0) AS after_n FROM orders",
)
def j11(spark, d):
    orders = table(spark, d, "orders").select("o_custkey")
    blocked = table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"))
    return orders.join(blocked, "o_custkey", "left").agg(F.count(F.lit(1)).alias("before_n"), F.count("hit").alias("overlap_n"), F.sum(F.col("hit").isNull().cast("bigint")).alias("after_n"))


@query("j12_siblings_through_shared_key", "SELECT DISTINCT a.p_partkey AS part, b.p_partkey AS sibling FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey")
def j12(spark, d):
    return joins.siblings(table(spark, d, "part"), ["p_name", "p_brand"], "p_partkey").toDF("part", "sibling")


_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'n' || n_nationkey AS dst, 0 AS pri, 'EXACT' AS relation FROM nation
UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1, 'SUBTYPE' FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, 'ANCESTOR' FROM nation)"""


@query(
    "j13_hierarchy_join",
    f"WITH {_EDGES} SELECT src AS node, arg_min(relation, pri) AS relation, dst AS c_node, count(*) AS customers FROM e JOIN customer ON dst = 'n' || c_nationkey GROUP BY src, dst",
)
def j13(spark, d):
    nation = table(spark, d, "nation")
    n, r = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    edges = nation.select(n.alias("node"), n.alias("c_node"), F.lit(0).alias("pri"), F.lit("EXACT").alias("relation"))
    edges = edges.unionAll(nation.select(r, n, F.lit(1), F.lit("SUBTYPE"))).unionAll(nation.select(n, r, F.lit(2), F.lit("ANCESTOR")))
    people = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("c_node"))
    return edges.join(people, "c_node").groupBy("node", "c_node").agg(F.min_by("relation", "pri").alias("relation"), F.count(F.lit(1)).alias("customers"))


@query("j14_sibling_neighbourhood", "SELECT a.n_nationkey AS node, b.n_nationkey AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def j14(spark, d):
    nation = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("node"))
    return nation.join(nation.withColumnRenamed("node", "neighbour"), "n_regionkey").select("node", "neighbour")


@query(
    "j19_case_by_policy",
    """SELECT policy, action, count(*) AS n FROM (SELECT policy, CASE WHEN policy = 'strict' AND mixed THEN 'flag' WHEN policy = 'lenient' AND discount > 0.095 THEN 'reject' WHEN mixed THEN 'flag' ELSE 'ground' END AS action
FROM (SELECT l_partkey, count(DISTINCT l_linestatus) > 1 AS mixed, max(l_discount) AS discount FROM lineitem GROUP BY 1), (VALUES ('strict'), ('lenient')) AS p(policy)) GROUP BY 1, 2""",
)
def j19(spark, d):
    cases = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.countDistinct("l_linestatus") > 1).alias("mixed"), F.max("l_discount").alias("discount"))
    cases = cases.withColumn("policy", F.explode(F.array(F.lit("strict"), F.lit("lenient"))))
    action = F.when((F.col("policy") == "strict") & F.col("mixed"), "flag").when((F.col("policy") == "lenient") & (F.col("discount") > 0.095), "reject").when(F.col("mixed"), "flag").otherwise("ground")
    return cases.groupBy("policy", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j20_row_by_perturbation",
    "SELECT kind, count(*) AS n FROM (SELECT event_type, unnest(['clean', 'drop', 'stale', 'swap']) AS kind FROM events) WHERE NOT (kind = 'swap' AND event_type = 'login') GROUP BY kind",
)
def j20(spark, d):
    rows = table(spark, d, "events").select("event_type", F.explode(F.array(*map(F.lit, ["clean", "drop", "stale", "swap"]))).alias("kind"))
    return rows.filter("NOT (kind = 'swap' AND event_type = 'login')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j21_a18_paired_runs",
    """SELECT CASE WHEN base AND tuned THEN 'kept' WHEN tuned THEN 'newly_won' WHEN base THEN 'newly_lost' ELSE 'still_lost' END AS outcome, count(*) AS n
FROM (SELECT l.doc_id, (n_chars > 1500) = (quality = 1) AS base, (n_chars > 600) = (quality = 1) AS tuned FROM labels l JOIN documents d ON l.doc_id = d.doc_id) GROUP BY 1""",
)
def j21(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    good = F.col("quality") == 1
    base, tuned = (F.col("n_chars") > 1500) == good, (F.col("n_chars") > 600) == good
    outcome = F.when(base & tuned, "kept").when(tuned, "newly_won").when(base, "newly_lost").otherwise("still_lost")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("a1_a5_counts_and_existence", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS any_returned FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def a1(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), (F.count(F.when(F.col("l_returnflag") == "R", 1)) > 0).alias("any_returned"))


@query("a3_groups_with_conflict", "SELECT l_partkey, l_suppkey, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) > 1")
def a3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_linestatus").alias("n")).filter("n > 1")


@query("a6_count_by_text_key", "SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS n FROM part GROUP BY 1")
def a6(spark, d):
    return table(spark, d, "part").groupBy(F.coalesce(F.col("p_size").cast("string"), F.lit("None")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("a7_a9_groups_of_names", "SELECT p_brand, count(DISTINCT lower(p_name)) AS n_names, string_agg(DISTINCT lower(p_name), '|' ORDER BY lower(p_name)) AS names FROM part GROUP BY 1 HAVING count(DISTINCT lower(p_name)) >= 2")
def a7(spark, d):
    names = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.lower("p_name"))).alias("names"))
    return names.filter(F.size("names") >= 2).select("p_brand", F.size("names").cast("bigint").alias("n_names"), F.array_join("names", "|").alias("names"))


@query("a10_fraction_by_class", "SELECT lang, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT || '/' || count(*) AS fraction FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a10(spark, d):
    return metrics.accuracy_by(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), ["lang"], F.col("quality") == 1)


@query(
    "a11_merged_fractions",
    """WITH f AS (SELECT source, lang, sum(quality)::BIGINT AS c, count(*) AS t FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, sum(c)::BIGINT AS correct, sum(t)::BIGINT AS total, sum(c)::BIGINT || '/' || sum(t)::BIGINT AS fraction FROM f GROUP BY lang""",
)
def a11(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return metrics.merged_fractions(metrics.accuracy_by(both, ["source", "lang"], F.col("quality") == 1).select("lang", "fraction"), ["lang"], "fraction")


_PRED = "SELECT l.doc_id, lang, quality AS gold, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def predictions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("gold"), (F.col("n_chars") > 1000).cast("int").alias("pred"), "n_chars")


@query("a12_confusion", f"SELECT gold, pred, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")
def a12(spark, d):
    return metrics.confusion(predictions(spark, d), "gold", "pred")


@query("a13_failure_pairs", f"SELECT gold || '->' || pred AS pair, count(*) AS n FROM ({_PRED}) WHERE gold <> pred GROUP BY 1")
def a13(spark, d):
    return predictions(spark, d).filter("gold <> pred").groupBy(F.concat_ws("->", "gold", "pred").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a14_explode_violations",
    """SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice < 20000 THEN 'small' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END,
CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS v FROM orders) GROUP BY 1""",
)
def a14(spark, d):
    issues = F.array_compact(F.array(F.when(F.col("o_totalprice") < 20000, "small"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderpriority").like("1%"), "urgent")))
    return table(spark, d, "orders").select(F.explode(issues).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a15_guardrail_outcomes",
    """SELECT CASE WHEN b AND a THEN 'kept' WHEN a THEN 'rescued' WHEN b THEN 'introduced' ELSE 'still_wrong' END AS outcome, count(*) AS n
FROM (SELECT (n_chars > 1000) = (quality = 1) AS b, (n_chars > 400) = (quality = 1) AS a FROM labels JOIN documents USING (doc_id)) GROUP BY 1""",
)
def a15(spark, d):
    rows = predictions(spark, d)
    return metrics.outcomes(rows, F.col("gold") == F.col("pred"), F.col("gold") == (F.col("n_chars") > 400).cast("int"))


@query("a16_margin_summary", "SELECT event_type, count(value) AS n, avg(value) AS mean, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def a16(spark, d):
    return metrics.margins(table(spark, d, "events"), ["event_type"], "value")


@query(
    "a17_win_rate_overall_and_by_pair",
    "SELECT grouping(o_orderpriority) = 1 AS every_pair, o_orderpriority AS pair, count(*) AS n, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS win_rate FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority))",
)
def a17(spark, d):
    sets = table(spark, d, "orders").rollup("o_orderpriority").agg((F.grouping("o_orderpriority") == 1).alias("every_pair"), F.count(F.lit(1)).alias("n"), F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("win_rate"))
    return sets.select("every_pair", F.col("o_orderpriority").alias("pair"), "n", "win_rate")


@query(
    "a21_strategy_summary",
    f"""WITH p AS ({_PRED}), g AS (SELECT lang, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY lang)
SELECT count(*) AS n, sum(CASE WHEN gold = pred THEN 1 ELSE 0 END)::BIGINT AS exact, sum(CASE WHEN gold = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS unsafe,
(SELECT avg(acc) FROM g)::DOUBLE AS macro, (SELECT min(acc) FROM g)::DOUBLE AS worst FROM p""",
)
def a21_a45(spark, d):
    right = (F.col("gold") == F.col("pred")).cast("int")
    groups = predictions(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("exact"), F.sum(((F.col("gold") == 0) & (F.col("pred") == 1)).cast("int")).alias("unsafe"), F.avg(right.cast("double")).alias("acc"))
    return groups.agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), F.sum("unsafe").alias("unsafe"), F.avg("acc").alias("macro"), F.min("acc").alias("worst"))


@query(
    "a27_a28_majority_value",
    """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rn, sum(n) OVER (PARTITION BY lang) AS total FROM c)
SELECT lang, source, n, total::BIGINT AS total, n / total AS share FROM r WHERE rn = 1""",
)
def a27(spark, d):
    return metrics.majority(table(spark, d, "documents"), ["lang"], "source")


@query(
    "a32_mcnemar",
    """WITH x AS (SELECT (n_chars > 1000) = (quality = 1) AS a, (n_chars > 400) = (quality = 1) AS b FROM labels JOIN documents USING (doc_id)),
y AS (SELECT sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END)::BIGINT AS b, sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END)::BIGINT AS c FROM x)
SELECT b, c, CASE WHEN b + c = 0 THEN 0.0 ELSE CAST(greatest(abs(b - c) - 1, 0) AS DOUBLE) ** 2 / (b + c) END AS chi2 FROM y""",
)
def a32(spark, d):
    return metrics.mcnemar(predictions(spark, d), F.col("gold") == F.col("pred"), F.col("gold") == (F.col("n_chars") > 400).cast("int"))


@query("a34_union_ladder", "SELECT avg((n_chars > 2000)::INT)::DOUBLE AS a, avg((n_chars > 2000 OR lang = 'en')::INT)::DOUBLE AS a_b, avg((n_chars > 2000 OR lang = 'en' OR source = 'src0')::INT)::DOUBLE AS a_b_c FROM documents")
def a34(spark, d):
    tests, seen, out = [F.col("n_chars") > 2000, F.col("lang") == "en", F.col("source") == "src0"], F.lit(False), []
    for name, test in zip(("a", "a_b", "a_b_c"), tests, strict=True):
        seen = seen | test
        out.append(F.avg(seen.cast("double")).alias(name))
    return table(spark, d, "documents").agg(*out)


@query("a37_recurrent_failures", "SELECT l_partkey, count(DISTINCT l_suppkey) AS conditions FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def a37(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("conditions")).filter("conditions >= 3")


@query("a39_all_and_any", "SELECT r_regionkey, coalesce(bool_and(n_nationkey > 2), true) AS all_above, coalesce(bool_or(n_nationkey > 23), false) AS any_above FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def a39(spark, d):
    both = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return both.groupBy("r_regionkey").agg(F.coalesce(F.bool_and(F.col("n_nationkey") > 2), F.lit(True)).alias("all_above"), F.coalesce(F.bool_or(F.col("n_nationkey") > 23), F.lit(False)).alias("any_above"))


@query("a40_set_digest", "SELECT n_regionkey, sha256(string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1")
def a40(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws("=", "n_nationkey", "n_name").alias("t"))))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.transform(pairs, lambda p: p["t"]), ","), 256).alias("digest"))


@query("a41_coverage_of_folds", "SELECT source, min(n) AS least, max(n) AS most FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def a41(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@query("a42_constant_columns", "SELECT user_id, count(DISTINCT event_type) = 1 AS constant FROM events GROUP BY 1")
def a42(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg((F.countDistinct("event_type") == 1).alias("constant"))


@query("u1_u4_set_operations", """SELECT 'union_all' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10)""")
def u1(spark, d):
    a, b = table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_nationkey")

    def counted(op, frame):
        return frame.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))

    return counted("union_all", a.unionAll(b)).unionAll(counted("intersect", a.intersect(b))).unionAll(counted("except", a.subtract(b.filter("s_nationkey < 10"))))


@query("u5_subset_of_array", "SELECT user_id, list_has_all(list_distinct(list(event_type)), ['click', 'view']) AS complete FROM events GROUP BY 1")
def u5(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return seen.select("user_id", tx.subset(F.array(F.lit("click"), F.lit("view")), F.col("seen")).alias("complete"))
