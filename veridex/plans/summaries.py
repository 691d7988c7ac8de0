"""Run summaries, candidate ranks, sweeps, further selections, text rules and validators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from veridex.functions import similarity
from veridex.functions import text as tx
from veridex.operators import joins, ranges, rank, select, trajectory, vectors
from veridex.plans.register import registrar
from veridex.plans.spans import first, last, span_sql, spans
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()


def count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def histogram(keys: str) -> Column:
    """'key:n' of the counts of a group's values, already counted by (key, n) rows, in the order of the keys."""
    pairs = F.array_sort(F.collect_list(F.struct(keys, "n")))
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p[keys].cast("string"), p["n"].cast("string"))), ",")


_TYPES = "['click', 'view', 'purchase', 'signup', 'logout']"


def losses(spark, d):
    """Each user's candidates with their mean loss, and the candidate that was expected."""
    expected = F.get(F.array(*map(F.lit, ["click", "view", "purchase", "signup", "logout"])), (F.col("user_id") % 5).cast("int"))
    scored = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("nll"))
    return scored.withColumn("expected", expected)


_LOSSES = f"""c AS (SELECT user_id, event_type, round(avg(value), 6) AS nll, {_TYPES}[user_id % 5 + 1] AS expected FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nll, event_type) AS rk, nll - min(nll) OVER (PARTITION BY user_id) AS margin FROM c),
e AS (SELECT user_id, expected, max(rk) FILTER (WHERE event_type = expected) AS rk, round(max(margin) FILTER (WHERE event_type = expected), 6) AS margin, max(event_type) FILTER (WHERE rk = 1) AS pred FROM r GROUP BY 1, 2)"""


def expected_ranks(spark, d):
    """user_id, expected, rk and margin of the expected candidate (null where it wasn't scored), pred."""
    own = Window.partitionBy("user_id")
    ranked = losses(spark, d).withColumn("rk", F.row_number().over(own.orderBy("nll", "event_type"))).withColumn("margin", F.col("nll") - F.min("nll").over(own))
    hit = F.col("event_type") == F.col("expected")
    return ranked.groupBy("user_id", "expected").agg(
        F.max(F.when(hit, F.col("rk"))).cast("bigint").alias("rk"), F.round(F.max(F.when(hit, F.col("margin"))), 6).alias("margin"), F.max(F.when(F.col("rk") == 1, F.col("event_type"))).alias("pred")
    )


@query("w8_loss_rank_and_margin", f"WITH {_LOSSES} SELECT user_id, expected, rk, margin, pred FROM e")
def loss_ranks(spark, d):
    return expected_ranks(spark, d)


@query(
    "a19_a38_rank_summary_by_class",
    f"""WITH {_LOSSES}, h AS (SELECT expected, coalesce(rk::VARCHAR, 'missing') AS key, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT expected, pred AS key, count(*) AS n FROM e GROUP BY 1, 2)
SELECT expected, count(*) AS n, round(avg((pred = expected)::INT), 3)::DOUBLE AS accuracy, (SELECT string_agg(key || ':' || n, ',' ORDER BY key) FROM h WHERE h.expected = e.expected) AS ranks,
(SELECT string_agg(key || ':' || n, ',' ORDER BY key) FROM p WHERE p.expected = e.expected) AS predicted, round(avg(margin), 6) AS mean_margin, round(median(margin), 6) AS median_margin FROM e GROUP BY expected""",
)
def rank_summary(spark, d):
    rows = expected_ranks(spark, d)

    def counted(key: Column, name: str):
        return rows.groupBy("expected", key.alias(name)).agg(F.count(F.lit(1)).alias("n")).groupBy("expected").agg(histogram(name).alias(f"{name}s"))

    stats = rows.groupBy("expected").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == F.col("expected")).cast("int")), 3).alias("accuracy"),
        F.round(F.avg("margin"), 6).alias("mean_margin"),
    )
    middle = ranges.medians(rows, ["expected"], "margin", "median_margin").withColumn("median_margin", F.round("median_margin", 6))
    ranks = counted(F.coalesce(F.col("rk").cast("string"), F.lit("missing")), "rank")
    predicted = counted(F.col("pred"), "predicted").withColumnRenamed("predicteds", "predicted")
    return stats.join(middle, "expected").join(ranks, "expected").join(predicted, "expected")


@query(
    "a20_gate_accuracy_by_reward",
    """WITH m AS (SELECT doc_id, 'quality' AS key, quality::DOUBLE AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels WHERE doc_id % 3 <> 0) SELECT key, round(sum(v) / (SELECT count(*) FROM labels), 3)::DOUBLE AS accuracy FROM m GROUP BY 1""",
)
def gate_accuracy(spark, d):
    """Mean of each reward over all rows; a row without it counts as 0."""
    rows = table(spark, d, "labels")
    rewards = F.when(F.col("doc_id") % 3 != 0, F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).otherwise(F.create_map(F.lit("quality"), "quality"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    by_key = rows.select(F.explode(rewards).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("s"))
    return by_key.crossJoin(total).select("key", F.round(F.col("s") / F.col("total"), 3).alias("accuracy"))


@query(
    "a35_a36_run_summary",
    """SELECT o_orderpriority AS class, count(*) FILTER (WHERE o_orderstatus = 'F') || '/' || count(*) AS correct, round(avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE -0.5 END), 6)::DOUBLE AS mean_reward,
round(avg((o_totalprice > 100000)::INT), 6)::DOUBLE AS tool_call_rate, round(avg((o_orderstatus = 'P')::INT) FILTER (WHERE o_totalprice > 200000), 6)::DOUBLE AS false_deprioritised FROM orders GROUP BY 1""",
)
def run_summary(spark, d):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    reward = F.when(status == "F", 1.0).when(status == "O", 0.0).otherwise(-0.5)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("class")).agg(
        F.concat_ws("/", count(status == "F").cast("string"), F.count(F.lit(1)).cast("string")).alias("correct"), F.round(F.avg(reward), 6).alias("mean_reward"),
        F.round(F.avg((price > 100000).cast("int")), 6).alias("tool_call_rate"), F.round(F.avg(F.when(price > 200000, (status == "P").cast("int"))), 6).alias("false_deprioritised"),
    )


@query(
    "a29_best_threshold_of_a_feature",
    """WITH x AS (SELECT length(c_mktsegment) + c_nationkey AS v, c_acctbal > 4000 AS gold FROM customer), g AS (SELECT v, count(*) FILTER (WHERE gold) AS p, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT v, sum(p) OVER (ORDER BY v) AS lp, sum(n) OVER (ORDER BY v) AS ln, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM g)
SELECT v::BIGINT AS threshold, round((greatest(lp, ln - lp) + greatest(tp - lp, tn - ln - tp + lp)) / tn, 6)::DOUBLE AS accuracy FROM c WHERE ln < tn ORDER BY accuracy DESC, threshold LIMIT 1""",
)
def stump(spark, d):
    """Each side of a threshold predicts its own majority; the rows are counted once, then only counts by value are summed."""
    rows = table(spark, d, "customer").select((F.length("c_mktsegment") + F.col("c_nationkey")).cast("bigint").alias("v"), (F.col("c_acctbal") > 4000).alias("gold"))
    by_value = rows.groupBy("v").agg(count(F.col("gold")).alias("p"), F.count(F.lit(1)).alias("n"))
    cut = ranges.running(by_value, [], [F.col("v")], ["p", "n"]).toDF("v", "p", "n", "lp", "ln", "tp", "tn")
    left, right = F.greatest("lp", F.expr("ln - lp")), F.greatest(F.expr("tp - lp"), F.expr("tn - ln - tp + lp"))
    scored = cut.filter("ln < tn").select(F.col("v").alias("threshold"), F.round((left + right) / F.col("tn"), 6).alias("accuracy"))
    return scored.orderBy(F.col("accuracy").desc(), "threshold").limit(1)


@query(
    "a31_nil_rejection_sweep",
    """WITH s AS (SELECT q.vec_id, max(round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12)) AS best FROM embeddings q JOIN embeddings v ON q.label <> v.label GROUP BY 1)
SELECT t AS threshold, count(*) AS n, count(*) FILTER (WHERE best >= t) AS false_ground FROM s, (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5)) v(t) GROUP BY 1""",
)
def nil_rejection(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    best = vectors.top_k(rows, rows, "vec_id", "embedding", 1, concept="label").select(F.col("similarity").alias("best"))
    swept = best.select("best", F.explode(F.array(*map(F.lit, [0.2, 0.3, 0.4, 0.5]))).alias("threshold"))
    return swept.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), count(F.col("best") >= F.col("threshold")).alias("false_ground"))


@query("a43_distinct_value_sets", "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n FROM documents GROUP BY 1")
def value_sets(spark, d):
    pairs = table(spark, d, "documents").select("lang", "source").distinct()
    return pairs.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"), F.count("source").alias("n"))


@query(
    "a45_floor_deficits",
    """WITH g AS (SELECT o_orderpriority AS class, avg((o_orderstatus = 'F')::INT) AS acc FROM orders GROUP BY 1), f AS (SELECT * FROM (VALUES ('1-URGENT', 0.6::DOUBLE), ('2-HIGH', 0.3), ('5-LOW', 0.49)) AS f(class, floor))
SELECT round(min(acc), 6) AS worst, round(sum(greatest(0, floor - acc)), 6)::DOUBLE AS deficit FROM g LEFT JOIN f USING (class)""",
)
def deficits(spark, d):
    acc = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("class")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("acc"))
    floors = spark.createDataFrame([("1-URGENT", 0.6), ("2-HIGH", 0.3), ("5-LOW", 0.49)], "class string, floor double")
    short = F.greatest(F.lit(0.0), F.col("floor") - F.col("acc"))
    return acc.join(floors, "class", "left").agg(F.round(F.min("acc"), 6).alias("worst"), F.round(F.sum(short), 6).alias("deficit"))


@query(
    "a46_candidate_retention",
    f"""WITH {_LOSSES}, k AS (SELECT user_id, expected, count(*) FILTER (WHERE rk <= 3) AS kept, bool_or(event_type = expected AND rk <= 3) AS gold_kept, max(rk) FILTER (WHERE event_type = expected AND rk <= 3) AS rk FROM r GROUP BY 1, 2)
SELECT expected, count(*) AS n, count(*) FILTER (WHERE gold_kept) AS gold_retained, bool_and(gold_kept) AS all_retained, round(avg(rk), 6) AS mean_rank_of_observed, round(avg(kept), 6) AS mean_kept FROM k GROUP BY 1""",
)
def retention(spark, d):
    ranked = rank.numbered(losses(spark, d), ["user_id"], [F.col("nll"), F.col("event_type")], "rk").filter("rk <= 3")
    gold = F.col("event_type") == F.col("expected")
    per = ranked.groupBy("user_id", "expected").agg(F.count(F.lit(1)).alias("kept"), F.bool_or(gold).alias("gold_kept"), F.max(F.when(gold, F.col("rk"))).alias("rk"))
    return per.groupBy("expected").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("gold_kept")).alias("gold_retained"), F.bool_and("gold_kept").alias("all_retained"), F.round(F.avg("rk"), 6).alias("mean_rank_of_observed"), F.round(F.avg("kept"), 6).alias("mean_kept")
    )


@query(
    "a17_margin_summary_with_total",
    """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'total' ELSE 'pair' END AS level, o_orderpriority AS pair, count(*) AS n, round(avg((m > 0)::INT), 6)::DOUBLE AS win_rate, round(avg(m), 4) AS mean_margin, round(median(m), 4) AS median_margin, min(m) AS least, max(m) AS most
FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_totalprice - 150000 AS m FROM orders) GROUP BY ROLLUP (o_orderpriority)""",
)
def margins(spark, d):
    m = F.col("m")
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("pair"), (F.col("o_totalprice") - 150000).alias("m"))
    levels = rows.withColumn("level", F.explode(F.array(F.lit("pair"), F.lit("total"))))  # each row counts in its pair and in all
    levels = levels.withColumn("pair", F.when(F.col("level") == "pair", F.col("pair")))
    stats = levels.groupBy("level", "pair").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((m > 0).cast("int")), 6).alias("win_rate"), F.round(F.avg(m), 4).alias("mean_margin"), F.min(m).alias("least"), F.max(m).alias("most"),
    )
    middle = ranges.medians(levels, ["level", "pair"], "m").select(F.col("level").alias("l"), F.col("pair").alias("p"), F.round("median", 4).alias("median_margin"))
    return stats.join(middle, (F.col("level") == F.col("l")) & F.col("pair").eqNullSafe(F.col("p"))).drop("l", "p")


@query(
    "w2_two_level_tie_break",
    """WITH a AS (SELECT l_suppkey, l_quantity, l_discount, l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r1, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_discount DESC) AS r2 FROM lineitem)
SELECT l_suppkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) FILTER (WHERE r2 = 1) AS winner, count(*) FILTER (WHERE r1 = 1) AS rank_ties, count(*) FILTER (WHERE r2 = 1) AS score_ties FROM a GROUP BY 1""",
)
def two_level(spark, d):
    """Only aggregates: counts by (group, score, second score), then the best of them; no sort of a group's rows."""
    first = F.min(F.struct("l_orderkey", "l_linenumber"))
    counted = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    by_score = counted.groupBy("l_suppkey", "l_quantity").agg(F.sum("n").alias("ties"), F.max(F.struct("l_discount", "n", "first")).alias("best"))
    top = by_score.groupBy("l_suppkey").agg(F.max_by(F.struct("ties", "best"), "l_quantity").alias("t"))
    return top.select("l_suppkey", F.col("t.best.first.l_orderkey").alias("winner"), F.col("t.ties").alias("rank_ties"), F.col("t.best.n").alias("score_ties"))


@query(
    "w17_rank_on_projected_key",
    f"""WITH e AS ({span_sql("week")}), c AS (SELECT k, types, vals, ks, unnest(range(1, len(types) + 1)) AS pos FROM e)
SELECT k, min(pos) FILTER (WHERE types[pos] = types[-1] AND (ks[pos] >= 50) = (vals[1] > 20)) AS first_match FROM c GROUP BY 1""",
)
def projected_rank(spark, d):
    """The place of the first event of a user's week whose type is the last one's and whose status is the first one's,
    whatever else it holds; null if none is."""
    rows = spans(spark, d, "week").withColumn("wanted", F.struct(last()["event_type"].alias("action"), (first()["value"] > 20).alias("status")))
    candidates = F.transform("e", lambda x: F.struct(x["event_type"].alias("action"), (x["k"] >= 50).alias("status"), F.array(x["event_id"]).alias("cited")))
    matches = F.transform(candidates, lambda c: F.struct(c["action"].alias("action"), c["status"].alias("status")) == F.col("wanted"))
    return rows.select("k", F.nullif(F.array_position(matches, True), F.lit(0)).cast("bigint").alias("first_match"))


@query("t1_mixed_direction_sort", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def mixed_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", F.col("c_acctbal").desc(), "c_custkey")


@query("t3_source_order_after_split", "SELECT event_id AS pos, user_id, CASE WHEN user_id % 5 = 0 THEN 'heldout' ELSE 'train' END AS split FROM events ORDER BY split, pos")
def source_order(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), "user_id", F.when(F.col("user_id") % 5 == 0, "heldout").otherwise("train").alias("split")).orderBy("split", "pos")


@query("t4_descending_tuples", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, o_orderpriority DESC, o_orderstatus DESC")
def descending(spark, d):
    counted = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), F.col("o_orderpriority").desc(), F.col("o_orderstatus").desc())


_QUOTAS = {"1-URGENT": 0.35, "2-HIGH": 0.30, "3-MEDIUM": 0.15, "4-NOT SPECIFIED": 0.10, "5-LOW": 0.10}


@query(
    "t12_quota_fill_by_proportion",
    f"""WITH q(class, quota) AS (VALUES {", ".join(f"('{c}', {round(200 * s)})" for c, s in _QUOTAS.items())}) SELECT o_orderpriority AS class, o_orderkey FROM orders JOIN q ON o_orderpriority = class
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('tasks::' || o_orderkey), o_orderkey) <= any_value(quota) OVER (PARTITION BY o_orderpriority)""",
)
def quotas(spark, d):
    quota = F.create_map(*(F.lit(x) for c, s in _QUOTAS.items() for x in (c, round(200 * s))))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), "o_orderkey")
    # the group limit keeps each task's first 70 of a class before the shuffle
    best = rank.top_per_group(rows, ["class"], [select.hash_key("tasks", F.col("o_orderkey")), F.col("o_orderkey")], round(200 * max(_QUOTAS.values())))
    ranked = rank.numbered(best, ["class"], [select.hash_key("tasks", F.col("o_orderkey")), F.col("o_orderkey")])
    return ranked.filter(F.col("rn") <= F.try_element_at(quota, F.col("class"))).select("class", "o_orderkey")


@query(
    "t17_t18_repeats_by_focus_and_failures",
    """WITH f AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS failures FROM lineitem GROUP BY 1)
SELECT o_orderkey, unnest(range(1 + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END + coalesce(failures, 0)))::INT AS copy FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""",
)
def weighted_repeats(spark, d):
    failures = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("failures"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(failures, "o_orderkey", "left")
    times = 1 + F.when(F.col("o_orderstatus") == "P", 2).otherwise(0) + F.coalesce("failures", F.lit(0))
    return select.repeated(rows, times.cast("int")).select("o_orderkey", "copy")


@query(
    "t19_disjoint_draw",
    """WITH own AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS seen FROM orders GROUP BY 1), a AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS every FROM orders),
n AS (SELECT o_custkey, list_filter(every, lambda p: NOT list_contains(seen, p)) AS novel FROM own, a)
SELECT o_custkey, novel[o_custkey % len(novel) + 1] AS drawn FROM n WHERE len(novel) > 0""",
)
def disjoint_draw(spark, d):
    """For each customer one of the values that it doesn't have, chosen by its key; none where it has all."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    every = orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("every"))  # one row of a column's few values
    own = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("seen"))
    novel = own.crossJoin(every).select("o_custkey", F.array_except("every", "seen").alias("novel")).filter(F.size("novel") > 0)
    return novel.select("o_custkey", F.get("novel", (F.col("o_custkey") % F.size("novel")).cast("int")).alias("drawn"))


@query("t20_slice_head", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:8], ',') AS head FROM orders GROUP BY 1")
def heads(spark, d):
    rows = rank.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 8)
    return rows.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("head"))


@query("t23_stored_split_applied", "SELECT l.doc_id, CASE WHEN l.doc_id % 7 = 0 THEN 'heldout' ELSE 'train' END AS split FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def stored_split(spark, d):
    manifest = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "heldout").otherwise("train").alias("split"))
    return select.with_stored_split(table(spark, d, "labels").select("doc_id"), manifest, "doc_id")


@query("p7_p8_projection_and_overwrite", "SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority, o_totalprice > 100000 AS large FROM orders")
def projection(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.withColumn("o_orderpriority", F.upper("o_orderpriority")).withColumn("large", F.col("o_totalprice") > 100000).select("o_orderkey", "o_orderpriority", "large")


@query("p10_visible_projection", "SELECT conv_id, turn, role, length(text) AS size FROM conversations")
def visible(spark, d):
    packed = table(spark, d, "conversations").select(F.struct("conv_id", "turn", "role", F.length("text").cast("bigint").alias("size")).alias("visible"), F.struct("text").alias("hidden"))
    return packed.select("visible.*")


@query("p11_keys_removed_at_any_depth", "SELECT s_suppkey, '{\"name\":\"' || s_name || '\",\"nested\":{\"nation\":' || s_nationkey || '}}' AS record FROM supplier")
def removed_keys(spark, d):
    packed = F.struct(F.col("s_name").alias("name"), F.lit("x").alias("host"), F.struct(F.col("s_nationkey").alias("nation"), F.lit("y").alias("host")).alias("nested"))
    rows = table(spark, d, "supplier").select("s_suppkey", packed.alias("record"))
    return rows.select("s_suppkey", F.to_json(select.without_keys(rows.schema["record"].dataType, F.col("record"), {"host"})).alias("record"))


@query("p15_strict_types", "SELECT event_id, CASE event_type WHEN 'click' THEN 'boolean' WHEN 'view' THEN 'integer' WHEN 'purchase' THEN 'float' ELSE 'other' END AS kind FROM events")
def strict_types(spark, d):
    """Whether a value read from JSON is a boolean or an integer; 1 isn't true, and true isn't 1.  The JSON holds a test of
    the event's k, the k, its value with two places, the k as a text, or the whole of its own JSON."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    raw = F.when(kind == "click", (k.cast("int") > 50).cast("string")).when(kind == "view", k).when(kind == "purchase", F.format_string("%.2f", F.col("value") + 0.001))
    raw = raw.when(kind == "signup", F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.col("props"))
    found = F.schema_of_variant(F.parse_json(raw))
    named = F.when(found == "BOOLEAN", "boolean").when(found == "BIGINT", "integer").when(found.startswith("DECIMAL") | (found == "DOUBLE"), "float").otherwise("other")
    return table(spark, d, "events").select("event_id", named.alias("kind"))


@query("j2_two_way_join", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def two_way(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query(
    "j18_v14_four_way_binding",
    """SELECT l.doc_id, array_to_string(list_filter([CASE WHEN l.quality NOT IN (0, 1) THEN 'quality' END, CASE WHEN d.n_chars <> length(d.text) THEN 'n_chars' END, CASE WHEN d.lang <> e.lang THEN 'lang' END, CASE WHEN l.toxic <> (l.doc_id % 2) THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS mismatches
FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS lang FROM documents) e ON l.doc_id = e.doc_id""",
)
def binding(spark, d):
    docs = table(spark, d, "documents")
    stated = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang")).alias("stated_lang"))
    other = docs.select("doc_id", "lang", "n_chars", F.length("text").alias("found_chars"))
    bound = table(spark, d, "labels").join(other, "doc_id").join(stated, "doc_id")
    checks = [("quality", ~F.col("quality").isin(0, 1)), ("n_chars", F.col("n_chars") != F.col("found_chars")), ("lang", F.col("lang") != F.col("stated_lang")), ("toxic", F.col("toxic") != F.col("doc_id") % 2)]
    return bound.select("doc_id", F.array_join(trajectory.names_of(checks), ",").alias("mismatches"))


@query(
    "j24_zip_by_id_with_checks",
    """SELECT count(*) AS n, count(*) FILTER (WHERE a.doc_id IS NULL OR b.doc_id IS NULL) AS unmatched, count(*) FILTER (WHERE a.lang <> b.lang) AS disagreeing FROM (SELECT doc_id, lang FROM documents) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 'xx' ELSE lang END AS lang FROM documents) b ON a.doc_id = b.doc_id""",
)
def zipped(spark, d):
    a = table(spark, d, "documents").select("doc_id", "lang")
    b = a.select(F.col("doc_id").alias("other"), F.when(F.col("doc_id") % 100 == 0, "xx").otherwise(F.col("lang")).alias("other_lang"))
    both = a.join(b, F.col("doc_id") == F.col("other"), "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n"), count(F.col("doc_id").isNull() | F.col("other").isNull()).alias("unmatched"), count(F.col("lang") != F.col("other_lang")).alias("disagreeing"))


@query("u4_set_equality", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) + (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) = 0 AS equal_sets")
def equal_sets(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    missing = a.subtract(b).union(b.subtract(a))
    return missing.agg((F.count(F.lit(1)) == 0).alias("equal_sets"))


@query(
    "u6_map_keys",
    f"""WITH e AS ({span_sql("day")}), m AS (SELECT k, list_distinct(types) AS held FROM e)
SELECT k, list_contains(held, 'view') AND list_contains(held, 'click') AS has_all, list_contains(held, 'view') AND list_contains(held, 'click') AND len(held) = 2 AS exact FROM m""",
)
def map_keys(spark, d):
    """Whether the map of a day's counts by type has the two wanted keys, and no other."""
    rows = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("held"))
    wanted, keys = F.array(F.lit("view"), F.lit("click")), F.map_keys("held")
    has_all = F.size(F.array_except(wanted, keys)) == 0
    name = F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string"))
    return counts.select(name.alias("k"), has_all.alias("has_all"), (has_all & (F.size(F.array_except(keys, wanted)) == 0)).alias("exact"))


@query("f4_vague_names", f"SELECT p_partkey, regexp_matches(x, '{tx.VAGUE}') AS vague FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' and vehicle' WHEN 1 THEN ' Placebo' WHEN 2 THEN ' 5mg' ELSE '+x' END AS x FROM part)")
def vague_names(spark, d):
    m = F.col("p_partkey") % 4
    tail = F.when(m == 0, " and vehicle").when(m == 1, " Placebo").when(m == 2, " 5mg").otherwise("+x")
    return table(spark, d, "part").select("p_partkey", tx.vague(F.concat("p_name", tail)).alias("vague"))


_CONDITIONS = ["hypertension", "hypotension", "type 1 diabetes", "type 2 diabetes", "acute pain", "chronic pain", "hodgkin lymphoma", "non hodgkin lymphoma", "benign tumour", "malignant tumour", "primary failure", "secondary failure"]
_OPPOSED = " OR ".join(f"(regexp_matches(a, '{x}') AND regexp_matches(b, '{y}')) OR (regexp_matches(a, '{y}') AND regexp_matches(b, '{x}'))" for x, y in tx.OPPOSITES)


@query(
    "f5_opposite_conditions",
    f"""SELECT k, {_OPPOSED} OR (contains(a, 'non hodgkin') AND contains(b, 'hodgkin') AND NOT contains(b, 'non hodgkin')) OR (contains(b, 'non hodgkin') AND contains(a, 'hodgkin') AND NOT contains(a, 'non hodgkin')) AS opposed
FROM (SELECT c_custkey AS k, {_CONDITIONS}[c_custkey % 12 + 1] AS a, {_CONDITIONS}[(c_custkey // 12) % 12 + 1] AS b FROM customer)""",
)
def opposites(spark, d):
    names, k = F.array(*map(F.lit, _CONDITIONS)), F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("k"), F.get(names, (k % 12).cast("int")).alias("a"), F.get(names, (F.floor(k / 12) % 12).cast("int")).alias("b"))
    return rows.select("k", tx.opposed(F.col("a"), F.col("b")).alias("opposed"))


@query("f14_most_dissimilar_form")
def dissimilar(spark, d):
    """Of each brand's names the one least like its shortest; ties by name."""
    names = table(spark, d, "part").select("p_brand", F.lower("p_name").alias("form")).distinct()
    shortest = names.groupBy("p_brand").agg(F.min_by("form", F.struct(F.length("form"), "form")).alias("short"))
    scored = names.join(shortest, "p_brand").filter("form <> short").withColumn("ratio", F.round(similarity.indel_ratio("form", "short"), 6))
    return scored.groupBy("p_brand").agg(F.min(F.struct("ratio", "form")).alias("m")).select("p_brand", F.col("m.form").alias("form"), F.col("m.ratio").alias("ratio"))


@query(
    "f16_f17_prefixes_and_paths",
    """WITH x AS (SELECT page_id, url, 'PDB_0000' || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END || right(md5(url), 4) AS name, regexp_extract(url, '^[a-z]+://[^/]+(/[^?]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN right(md5(url), 4) END AS short_id, path LIKE '/%' AS absolute, false AS url_absolute FROM x""",
)
def prefixes(spark, d):
    """Short ids from names made of digests of pages' addresses, some with a letter too many; paths of the addresses, and
    the addresses themselves, which are no paths."""
    more = F.when(F.col("page_id") % 3 == 0, "x").otherwise("")
    name = F.concat(F.lit("PDB_0000"), more, F.right(F.md5("url"), F.lit(4)))
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?]*)", 1)
    return table(spark, d, "pages").select("page_id", tx.short_id(name).alias("short_id"), tx.absolute_path(path).alias("absolute"), tx.absolute_path(F.col("url")).alias("url_absolute"))


@query("m2_m6_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, true AS finite, 1.0::DOUBLE AS unit_norm FROM embeddings")
def unit_vectors(spark, d):
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("n", F.sqrt(square(F.col("v"))))
    rows = rows.withColumn("u", F.transform("v", lambda x: x / F.col("n")))
    finite = F.forall("u", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", F.round("n", 5).alias("norm"), finite.alias("finite"), F.round(F.sqrt(square(F.col("u"))), 6).alias("unit_norm"))


@query("m7_date_cutoff", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1995-06-01' AS recent FROM orders")
def cutoff(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.to_date("o_orderdate") >= F.lit("1995-06-01").cast("date")).alias("recent"))


@query(
    "v6_panel_validator",
    """WITH r AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'reserve' ELSE 'primary' END AS role, o_orderpriority FROM orders), b AS (SELECT o_custkey FROM r GROUP BY 1 HAVING count(DISTINCT role) > 1)
SELECT 'forbidden_text' AS issue, count(*) AS n FROM r WHERE contains(o_orderpriority, 'NOT') UNION ALL SELECT 'cluster_overlap', count(*) FROM b UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT k FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'too_few_' || w.role, CASE WHEN coalesce(c.n, 0) < w.least THEN 1 ELSE 0 END FROM (VALUES ('primary', 100), ('reserve', 100), ('spare', 1)) w(role, least) LEFT JOIN (SELECT role, count(*) AS n FROM r GROUP BY 1) c ON w.role = c.role""",
)
def panel(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.when(F.col("o_orderkey") % 5 == 0, "reserve").otherwise("primary").alias("role"), "o_orderpriority")
    one = F.count(F.lit(1)).alias("n")
    forbidden = rows.filter(F.col("o_orderpriority").contains("NOT")).agg(one).select(F.lit("forbidden_text").alias("issue"), "n")
    overlap = rows.groupBy("o_custkey").agg((F.min("role") < F.max("role")).alias("both")).filter("both").agg(one).select(F.lit("cluster_overlap").alias("issue"), "n")
    repeated = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(one).select(F.lit("duplicate_key").alias("issue"), "n")
    least = spark.createDataFrame([("primary", 100), ("reserve", 100), ("spare", 1)], "role string, least bigint")
    roles = least.join(rows.groupBy("role").agg(F.count(F.lit(1)).alias("c")), "role", "left")
    short = roles.select(F.concat(F.lit("too_few_"), "role").alias("issue"), (F.coalesce("c", F.lit(0)) < F.col("least")).cast("bigint").alias("n"))
    return forbidden.union(overlap).union(repeated).union(short)


@query(
    "v8_commitments_recomputed",
    "SELECT s_suppkey, s_suppkey % 10 <> 0 AS agrees FROM supplier",
)
def commitments(spark, d):
    """Stored digests of rows against digests computed anew; a missing one doesn't agree."""
    digest = F.sha2(F.to_json(F.struct("s_name", "s_nationkey", "s_suppkey")), 256)
    stored = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 20 == 0, F.lit(None).cast("string")).when(F.col("s_suppkey") % 10 == 0, "0").otherwise(digest).alias("stored"))
    now = table(spark, d, "supplier").select("s_suppkey", digest.alias("now"))
    return now.join(stored, F.col("s_suppkey") == F.col("key"), "left").select("s_suppkey", F.col("now").eqNullSafe(F.col("stored")).alias("agrees"))


@query(
    "v9_visibility_audit",
    """WITH g AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT c_acctbal > 0) > 1 AS open, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_mktsegment, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (WHERE open), 0)::BIGINT AS underdetermined FROM g GROUP BY 1""",
)
def visibility(spark, d):
    """Rows whose visible fields fit more than one hidden label."""
    label = F.col("c_acctbal") > 0
    groups = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.min(label) < F.max(label)).alias("open"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("underdetermined"))


@query(
    "v12_dataset_rules",
    """SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN turn % 2 = 0 AND role <> 'user' THEN 'alternation' END, CASE WHEN text IS NULL THEN 'missing' END], lambda x: x IS NOT NULL)) AS issue FROM conversations) GROUP BY 1""",
)
def dataset_rules(spark, d):
    rules = [("role", ~F.col("role").isin("user", "assistant")), ("short", F.length("text") < 40), ("alternation", (F.col("turn") % 2 == 0) & (F.col("role") != "user")), ("missing", F.col("text").isNull())]
    return table(spark, d, "conversations").select(F.explode(trajectory.names_of(rules)).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v15_rows_by_perturbation",
    """WITH c AS (SELECT ['clean', 'stale', 'missing'][p + 1] AS perturbation, count(*) AS n FROM (SELECT o_orderkey, unnest(range(3)) AS p FROM orders) WHERE NOT (p = 1 AND o_orderkey % 2 = 0) GROUP BY 1), t AS (SELECT count(*) AS total FROM orders)
SELECT perturbation, n, n = CASE WHEN perturbation = 'stale' THEN total // 2 ELSE total END AS as_expected FROM c, t""",
)
def perturbed(spark, d):
    k = F.col("o_orderkey")
    made = table(spark, d, "orders").select(F.explode(F.array_compact(F.array(F.lit("clean"), F.when(k % 2 != 0, "stale"), F.lit("missing")))).alias("perturbation"))
    total = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"))
    counted = made.groupBy("perturbation").agg(F.count(F.lit(1)).alias("n")).crossJoin(total)
    wanted = F.when(F.col("perturbation") == "stale", F.floor(F.col("total") / 2)).otherwise(F.col("total"))
    return counted.select("perturbation", "n", (F.col("n") == wanted).alias("as_expected"))


_TREE = "t AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query(
    "j13_hierarchy_of_depth_two",
    f"""WITH {_TREE}, q AS (SELECT DISTINCT parent AS node FROM t), a AS (SELECT node, node AS other, 0 AS pri FROM q UNION ALL SELECT parent, child, 1 FROM t UNION ALL SELECT x.parent, y.child, 2 FROM t x JOIN t y ON x.child = y.parent UNION ALL SELECT child, parent, 3 FROM t WHERE child IN (SELECT node FROM q)),
b AS (SELECT node, other, min(pri) AS pri FROM a GROUP BY 1, 2) SELECT node, ['EXACT', 'SUBTYPE', 'SUBTYPE', 'ANCESTOR'][pri + 1] AS relation, count(*) AS n FROM b GROUP BY 1, 2""",
)
def depth_two(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    edges = edges.union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    nodes = edges.select(F.col("parent").alias("node")).distinct()
    return joins.ground_set(nodes, edges).groupBy("node", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j14_whole_neighbourhood",
    """WITH t AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation) SELECT child AS node, parent AS neighbour FROM t UNION SELECT parent, child FROM t UNION SELECT a.child, b.child FROM t a JOIN t b ON a.parent = b.parent UNION SELECT parent, parent FROM t""",
)
def whole_neighbourhood(spark, d):
    edges = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return joins.neighbourhood(edges)


@query(
    "w14_promoted_reserves",
    """WITH r AS (SELECT c_nationkey, c_custkey, c_custkey % 3 = 0 AS reserve, c_acctbal > 0 AS passed, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 = 0 ORDER BY c_custkey) AS selection_rank FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY reserve, selection_rank) AS place FROM r WHERE passed AND selection_rank <= CASE WHEN reserve THEN 3 ELSE 4 END)
SELECT c_nationkey, c_custkey, CASE WHEN reserve THEN 'reserve' ELSE 'primary' END AS role, selection_rank, reserve AS promoted FROM p WHERE place <= 4""",
)
def promoted(spark, d):
    """Four primaries and three reserves a nation; primaries that fail are replaced by reserves that pass, in their order."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 3 == 0).alias("reserve"), (F.col("c_acctbal") > 0).alias("passed"))
    picked = rank.top_per_group(rows, ["c_nationkey", "reserve"], [F.col("c_custkey")], 4)
    picked = rank.numbered(picked, ["c_nationkey", "reserve"], [F.col("c_custkey")], "selection_rank").filter("passed AND (NOT reserve OR selection_rank <= 3)")
    final = rank.top_per_group(picked, ["c_nationkey"], [F.col("reserve"), F.col("selection_rank")], 4)
    return final.select("c_nationkey", "c_custkey", F.when(F.col("reserve"), "reserve").otherwise("primary").alias("role"), F.col("selection_rank").cast("bigint").alias("selection_rank"), F.col("reserve").alias("promoted"))
