"""Windows, splits, samples and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridex.functions import similarity
from veridex.functions import text as tx
from veridex.operators import fuzzy, greedy, phrases, rank, select
from veridex.plans.register import registrar
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()


@query(
    "w1_top_with_ties",
    """SELECT c_nationkey, c_custkey, c_mktsegment, ties AS tie_count FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_mktsegment) DESC, c_custkey) AS rn,
sum(CASE WHEN rk = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey)::BIGINT AS ties FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY length(c_mktsegment) DESC) AS rk FROM customer)) WHERE rn = 1""",
)
def w1(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return rank.top_with_ties(rows, ["c_nationkey"], F.length("c_mktsegment"), [F.col("c_custkey")])


@query("w3_t14_top_k_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def w3(spark, d):
    ranked = rank.numbered(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return ranked.filter("rn <= 3").select("o_custkey", "o_orderkey", F.col("rn").cast("bigint").alias("rn"))


@query(
    "w4_w7_candidate_ranks",
    """SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS position, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS competition
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""",
)
def w4(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = rank.numbered(counted, ["user_id"], [F.col("n").desc(), F.col("event_type")], "position")
    competition = F.rank().over(Window.partitionBy("user_id").orderBy(F.col("n").desc()))
    return ranked.select("user_id", "event_type", "n", F.col("position").cast("bigint").alias("position"), competition.cast("bigint").alias("competition"))


@query(
    "w5_top_second_gap",
    """SELECT l_partkey, l_suppkey, round(q - nx, 6) AS gap FROM (SELECT *, lead(q) OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS nx, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS rn
FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE rn = 1""",
)
def w5(spark, d):
    scores = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return rank.gaps(scores, ["l_partkey"], "q", "l_suppkey").select("l_partkey", "l_suppkey", "gap")


@query(
    "w6_field_value_rank",
    """SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY best DESC, source) AS field_rank FROM (SELECT lang, source, max(n_chars) AS best FROM documents GROUP BY 1, 2)""",
)
def w6(spark, d):
    best = table(spark, d, "documents").groupBy("lang", "source").agg(F.max("n_chars").alias("best"))
    return rank.numbered(best, ["lang"], [F.col("best").desc(), F.col("source")], "field_rank").select("lang", "source", F.col("field_rank").cast("bigint").alias("field_rank"))


@query("w9_t11_quota_per_class", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def w9(spark, d):
    return rank.top_per_group(table(spark, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 5)


@query("w10_distinct_on", "SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1")
def w10(spark, d):
    return rank.distinct_on(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], [F.col("p_partkey")])


@query("w11_case_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS case_index FROM conversations")
def w11(spark, d):
    numbered = rank.numbered(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")])
    return numbered.select("conv_id", "turn", (F.col("rn") - 1).cast("bigint").alias("case_index"))


@query(
    "w12_middle_of_group",
    """SELECT p_brand, p_name, n AS n_values FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS rn, count(*) OVER (PARTITION BY p_brand) AS n
FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE n >= 3 AND rn = n // 2 + 1""",
)
def w12(spark, d):
    return rank.middle_of_group(table(spark, d, "part"), "p_brand", "p_name").select("p_brand", "p_name", "n_values")


@query(
    "w13_distinct_concept_top_k",
    """SELECT o_orderpriority, o_custkey, best, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY best DESC, o_custkey) AS rn
FROM (SELECT o_orderpriority, o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1, 2)) WHERE rn <= 8""",
)
def w13(spark, d):
    best = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.max("o_totalprice").alias("best"))
    return rank.numbered(best, ["o_orderpriority"], [F.col("best").desc(), F.col("o_custkey")]).filter("rn <= 8").select("o_orderpriority", "o_custkey", "best", F.col("rn").cast("bigint").alias("rn"))


@query(
    "w14_reserve_promotion",
    """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, c_custkey) AS rn FROM customer WHERE c_acctbal > 0) WHERE rn <= 4""",
)
def w14(spark, d):
    passed = table(spark, d, "customer").filter("c_acctbal > 0").select("c_nationkey", "c_custkey")
    return rank.top_per_group(passed, ["c_nationkey"], [(F.col("c_custkey") % 3 == 0).cast("int"), F.col("c_custkey")], 4)


@query(
    "w15_round_robin",
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS slot FROM documents)
SELECT i * 4 + slot AS position, doc_id, lang FROM r WHERE i < (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""",
)
def w15(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return rank.interleaved(docs, "lang", "doc_id", ["de", "en", "es", "fr"]).select(F.col("position").cast("bigint").alias("position"), "doc_id", "lang")


@query("t2_custom_order", "SELECT role, min(turn) AS first_turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS role_order FROM conversations GROUP BY role")
def t2(spark, d):
    order = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return table(spark, d, "conversations").groupBy("role", order.alias("role_order")).agg(F.min("turn").alias("first_turn")).orderBy("role_order")


@query("t6_hash_ordered_selection", "SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('pilot::' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 10")
def t6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return rank.numbered(docs, ["lang"], [select.hash_key("pilot", F.col("doc_id")), F.col("doc_id")]).filter("rn <= 10").select("doc_id", F.col("rn").cast("bigint").alias("rn"))


@query(
    "t7_md5_modulo_split",
    """SELECT c_custkey, list_reduce(list_concat([0], list_transform(string_split(md5(c_custkey::VARCHAR), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda r, x: (r * 16 + x) % 100) < 12 AS evaluation FROM customer""",
)
def t7(spark, d):
    return table(spark, d, "customer").select("c_custkey", (select.modulo_of_md5(F.col("c_custkey"), 100) < 12).alias("evaluation"))


@query(
    "t8_stratified_held_out",
    """SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256('split::' || doc_id), doc_id) <= 12 THEN 'heldout' ELSE 'train' END AS split FROM documents""",
)
def t8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return select.held_out(docs, "lang", "split", "doc_id", 12).select("doc_id", "split")


@query("t9_stratified_folds", "SELECT doc_id, floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) * 5 / count(*) OVER (PARTITION BY lang))::INT AS fold FROM documents")
def t9(spark, d):
    return select.folds(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5).select("doc_id", "fold")


@query(
    "t10_group_split_to_children",
    """WITH s AS (SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY sha256('g::' || conv_id), conv_id) <= 10 THEN 'heldout' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT c.conv_id, turn, split FROM conversations c JOIN s ON c.conv_id = s.conv_id""",
)
def t10(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    groups = turns.select("conv_id").distinct().select("conv_id", select.hash_key("g", F.col("conv_id")).alias("h"))
    chosen = groups.orderBy("h", "conv_id").limit(10).select("conv_id", F.lit("heldout").alias("split"))
    return turns.join(chosen, "conv_id", "left").select("conv_id", "turn", F.coalesce("split", F.lit("train")).alias("split"))


@query("t15_oversample", "SELECT event_type, count(*) AS n FROM (SELECT event_type, unnest(range(CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END)) AS copy FROM events) GROUP BY 1")
def t15(spark, d):
    copies = select.repeated(table(spark, d, "events").select("event_type"), F.when(F.col("event_type") == "purchase", 3).otherwise(1))
    return copies.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t16_balance_to_largest",
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id, unnest(range(rn, (SELECT max(n) FROM r), n)) AS slot FROM r""",
)
def t16(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return select.balanced(docs, "lang", "doc_id").select("lang", "doc_id", F.col("slot").cast("bigint").alias("slot"))


@query(
    "t13_greedy_unique",
    """WITH RECURSIVE o AS (SELECT p_partkey, p_name, p_brand, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS brands, CAST(NULL AS BIGINT) AS kept
UNION ALL SELECT next, CASE WHEN free THEN list_append(names, p_name) ELSE names END, CASE WHEN free THEN list_append(brands, p_brand) ELSE brands END, CASE WHEN free THEN p_partkey END
FROM (SELECT names, brands, o.i AS next, p_partkey, p_name, p_brand, NOT list_contains(names, p_name) AND NOT list_contains(brands, p_brand) AS free FROM w JOIN o ON o.i = w.i + 1))
SELECT p_partkey, p_name, p_brand FROM o WHERE p_partkey IN (SELECT kept FROM w)""",
)
def t13(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return greedy.greedy_unique(part, ["p_name", "p_brand"], ["p_partkey"])


@query("t21_best_record", "SELECT l_suppkey, arg_max(l_partkey, [q, -l_partkey]) AS best_part FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def t21(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return q.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("q", (-F.col("l_partkey")).alias("k"))).alias("best_part"))


@query("t22_sentinel_rows", "SELECT o_orderstatus, o_orderkey FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE rn IN (1, n // 2 + 1, n)")
def t22(spark, d):
    return select.sentinels(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey")


@query("f1_f20_matches", r"SELECT page_id, nullif(regexp_extract(html, '[0-9]+', 0), '') AS first_number, len(list_distinct(regexp_extract_all(html, '[0-9]+')))::BIGINT AS distinct_numbers FROM pages")
def f1(spark, d):
    return table(spark, d, "pages").select("page_id", tx.first_match(F.col("html"), "[0-9]+").alias("first_number"), F.size(tx.distinct_matches(F.col("html"), "[0-9]+")).cast("bigint").alias("distinct_numbers"))


@query("f2_normal_condition", r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS normal FROM pages")
def f2(spark, d):
    return table(spark, d, "pages").select("page_id", tx.normal_condition(F.col("url")).alias("normal"))


@query(
    "f3_normal_substance",
    rf"""WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '\(.*?\)', ' ', 'g'), '{tx.DOSE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS base
FROM (SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN ' sodium 5 mg' WHEN 1 THEN ' (oral) sulfate' ELSE ' 10%' END AS x FROM part UNION ALL SELECT -1, 'magnesium sulfate' UNION ALL SELECT -2, 'sodium'))
SELECT p_partkey, CASE WHEN b = '' OR b IN ({", ".join(f"'{c}'" for c in tx.CATIONS)}) THEN base ELSE b END AS normal
FROM (SELECT *, trim(regexp_replace(regexp_replace(base, '\b({"|".join(tx.SALTS)})\b', ' ', 'g'), ' +', ' ', 'g')) AS b FROM n)""",
)
def f3(spark, d):
    tail = F.when(F.col("p_size") % 3 == 0, " sodium 5 mg").when(F.col("p_size") % 3 == 1, " (oral) sulfate").otherwise(" 10%")
    named = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.concat("p_name", tail).alias("x"))
    extra = spark.createDataFrame([(-1, "magnesium sulfate"), (-2, "sodium")], "p_partkey bigint, x string")
    return named.unionByName(extra).select("p_partkey", tx.normal_substance(F.col("x")).alias("normal"))


@query(
    "f6_longest_dictionary_phrase",
    """WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM conversations),
g AS (SELECT conv_id, turn, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase FROM (SELECT conv_id, turn, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5), (6)) AS t(n) WHERE len(ws) >= n)),
k AS (SELECT phrase FROM g GROUP BY phrase HAVING count(DISTINCT conv_id) >= 3)
SELECT conv_id, turn, phrase FROM (SELECT g.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, length(phrase) DESC, i) AS rn FROM g JOIN k USING (phrase)) WHERE rn = 1""",
)
def f6(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.filter(F.split(tx.normal_condition(F.regexp_replace("text", r"[()]", " ")), " "), lambda x: x != "").alias("ws"))

    return phrases.longest_shared(words, ["conv_id", "turn"], "ws", "conv_id", 3, 6).select("conv_id", "turn", "phrase")


@query("f7_f8_f9_claims", "SELECT o_orderkey, lower(trim('  Order ' || o_orderstatus || ' for customer ' || o_custkey || ' ')) AS claim, contains(lower(o_orderpriority), lower('URG')) AS leaks FROM orders")
def f7(spark, d):
    claim = F.lower(F.trim(F.format_string("  Order %s for customer %d ", "o_orderstatus", "o_custkey")))
    return table(spark, d, "orders").select("o_orderkey", claim.alias("claim"), F.lower("o_orderpriority").contains("urg").alias("leaks"))


@query("f10_surface_features", "SELECT doc_id, length(text) AS n_characters, len(string_split(text, ' '))::BIGINT AS n_spaced, string_split(text, ' ')[1] AS head FROM documents")
def f10(spark, d):
    parts = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_characters"), F.size(parts).cast("bigint").alias("n_spaced"), F.get(parts, F.lit(0)).alias("head"))


@query("f12_token_order_groups", "SELECT names, count(*) AS n FROM (SELECT array_to_string(list_sort(string_split(trim(lower(p_name)), ' ')), ' ') AS names FROM part) GROUP BY 1")
def f12(spark, d):
    return table(spark, d, "part").groupBy(tx.sorted_tokens(F.lower("p_name")).alias("names")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_list_parse", "SELECT s_suppkey, list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c NOT IN ('', 'NA')) AS chains FROM (SELECT s_suppkey, 'A | ' || CASE WHEN s_suppkey % 2 = 0 THEN 'NA' ELSE s_name END AS x FROM supplier)")
def f15(spark, d):
    text = F.concat(F.lit("A | "), F.when(F.col("s_suppkey") % 2 == 0, "NA").otherwise(F.col("s_name")))
    parts = F.filter(F.transform(F.split(text, r"\|"), lambda c: F.trim(c)), lambda c: ~c.isin("", "NA"))
    return table(spark, d, "supplier").select("s_suppkey", parts.alias("chains"))


@query("f18_prefix_digest", "SELECT c_custkey, left(sha256(c_name || '|' || c_mktsegment), 16) AS digest FROM customer")
def f18(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.left(F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256), F.lit(16)).alias("digest"))


@query("f11_j17_fuzzy_names")
def fuzzy_names(spark, d):
    names = table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    queries = table(spark, d, "part").filter("p_partkey % 50 = 0")
    typed = queries.select(F.concat(F.lower("p_name"), F.lit("s")).alias("query")).distinct()
    return fuzzy.ratio_join(typed, names, "query", "name", 85.0).withColumn("ratio", F.round("ratio", 3))


@query("f13_token_set_ratio")
def token_sets(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("b"))
    return names.select("p_partkey", F.round(similarity.token_set_ratio("a", "b"), 3).alias("ratio"))


@query("f12_token_sort_ratio")
def token_sort(spark, d):
    """Names whose sorted tokens have a ratio of 90 or more with another's; of equal token sets one stands for all."""
    forms = table(spark, d, "part").select(tx.sorted_tokens(F.lower("p_name")).alias("name")).distinct()
    typed = table(spark, d, "part").filter("p_partkey % 50 = 0").select(tx.sorted_tokens(F.lower("p_name")).alias("query")).distinct()
    return fuzzy.ratio_join(typed, forms, "query", "name", 90.0).withColumn("ratio", F.round("ratio", 3))


@query("f13_best_token_set_match")
def best_token_set(spark, d):
    """For each name with its type before it and a letter lost, of ids divisible by 50, the best name by token sets."""
    part = table(spark, d, "part")
    typed = F.lower(F.concat_ws(" ", F.split_part("p_type", F.lit(" "), F.lit(1)), F.substring("p_name", 2, 1 << 30)))
    asked = part.filter("p_partkey % 50 = 0").select(typed.alias("query"))
    found = fuzzy.best_by_tokens(asked, part.select(F.lower("p_name").alias("name")), "query", "name", 70.0)
    return found.withColumn("ratio", F.round("ratio", 3))
