"""Runtime gates, arbitration, classifiers and contract compilers as ordered decisions over nested tool results.

The states are made from orders: each stands for the tool results of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions import decide
from veridex.operators import trajectory
from veridex.plans.register import registrar
from veridex.plans.spans import number_of, span_sql, spans
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()
#: Signals of complete evidence, with the pair and the reason that each leads to.
SIGNALS = {
    "mixed_endpoint_records_for_same_claim": ("reject/contradicted", "mixed_endpoint_contradiction"),
    "same_indication_failure_record_found": ("ground/supported", "same_indication_failure_supported"),
    "related_evidence_exists_but_same_indication_record_absent": ("verify/insufficient", "related_evidence_requires_verification"),
    "no_same_indication_or_related_failure_record": ("defer/insufficient", "no_relevant_evidence"),
}
FAIL_CLOSED = ["defer/insufficient", "verify/insufficient"]
PAIRS = ["ground/supported", "reject/contradicted", "flag/invalid_value", "verify/insufficient", "defer/insufficient"]
TOOLS = ["survey", "verify", "validity", "completeness"]


#: The tool that a type of event stands for; a signup is a call of another tool if its k is high, else none.
TOOL_OF = {"view": "survey", "click": "verify", "purchase": "validity", "error": "completeness"}


def states(spark, d) -> DataFrame:
    """Weeks of users: k, user_id, loop (array of tool calls with a query and an error), records, findings, signal, counts.

    Calls are the week's events; records are its purchases, and findings its errors of a high k.
    """
    def tool(x: Column) -> Column:
        out = F.when((x["event_type"] == "signup") & (x["k"] >= 97), "other")
        for kind, own in TOOL_OF.items():
            out = out.when(x["event_type"] == kind, own)
        return out

    def call(x: Column) -> Column:
        query = F.col("user_id") + F.when(x["k"] >= 99, 1).otherwise(0)
        return F.struct(tool(x).alias("name"), query.alias("query"), F.when(x["value"] > 300, "down").alias("error"))

    def record(x: Column) -> Column:
        source = F.when(x["k"] >= 3, F.concat(F.lit("p"), x["event_id"].cast("string")))
        return F.struct(source.alias("source_id"), F.when(x["value"] < 1, "stale").when(x["value"] > 50, "current").alias("freshness"))

    finding = lambda x: F.when(x["value"] >= 10, F.concat(F.lit("f"), x["event_id"].cast("string")))
    of = lambda kind: number_of(lambda x: x["event_type"] == kind)
    frame = spans(spark, d, "week").withColumns({"n": F.size("e"), "views": of("view"), "clicks": of("click"), "purchases": of("purchase"), "errors": of("error")})
    purchases = F.filter("e", lambda x: x["event_type"] == "purchase")
    return frame.withColumns(
        {
            "present": F.col("n") >= 3,
            "loop": F.transform(F.filter("e", lambda x: tool(x).isNotNull()), call),
            "records": F.transform(F.filter(purchases, lambda x: x["value"] < 90), record),
            "findings": F.transform(F.filter("e", lambda x: (x["event_type"] == "error") & (x["k"] >= 96)), finding),
            "signal": F.get(F.array(*map(F.lit, [*SIGNALS, "other"]), F.lit(None).cast("string")), F.col("views") % 6),
            "considered": number_of(lambda x: (x["event_type"] == "purchase") & (x["value"] > 150)),
            "related": F.when(F.col("errors") > 0, F.col("errors") - 1),
        }
    )


def with_features(frame: DataFrame) -> DataFrame:
    """Missing, wrong, mismatched and failed tools, records without a source, stale records, and the first finding's id."""
    names = F.transform("loop", lambda x: x["name"])
    tools = F.array(*map(F.lit, TOOLS))
    numbered = F.transform("records", lambda r, i: F.struct(r["source_id"].alias("source_id"), i.alias("i"), r["freshness"].alias("freshness")))
    return frame.withColumns(
        {
            "missing_tools": F.array_sort(F.array_except(tools, names)),
            "wrong_tools": F.array_sort(F.array_except(names, tools)),
            "mismatched": F.transform(F.filter("loop", lambda x: x["query"] != F.col("user_id")), lambda x: x["name"]),
            "failed": F.transform(F.filter("loop", lambda x: F.coalesce(x["error"], F.lit("")) != ""), lambda x: x["name"]),
            "unattributed": F.transform(F.filter(numbered, lambda r: F.coalesce(r["source_id"], F.lit("")) == ""), lambda r: r["i"]),
            "stale": F.transform(F.filter(numbered, lambda r: F.coalesce(r["freshness"], F.lit("current")) != "current"), lambda r: F.coalesce(r["source_id"], F.concat(F.lit("record::"), r["i"].cast("string")))),
            "finding": F.get(F.filter("findings", lambda x: x.isNotNull()), F.lit(0)),
        }
    )


def gate_exits() -> list[tuple[Column, str, str]]:
    """The exits in order: condition, pair, reason; the fourteenth, without a condition, fails closed."""
    defer, verify = "defer/insufficient", "verify/insufficient"

    def some(name: str) -> Column:
        return F.size(name) > 0

    return [
        (~F.col("present"), defer, "missing_model_visible_task"),
        (F.size("loop") == 0, defer, "missing_tool_loop"),
        (some("failed"), defer, "tool_unavailable"),
        (some("missing_tools") | some("wrong_tools"), defer, "tool_contract_failure"),
        (some("mismatched"), defer, "query_contract_failure"),
        (some("unattributed"), verify, "missing_source_attribution"),
        (some("stale"), verify, "stale_source_requires_verification"),
        (some("findings"), "flag/invalid_value", "invalid_numeric_value"),
        *((F.col("signal") == signal, pair, reason) for signal, (pair, reason) in SIGNALS.items()),
    ]


def gated(frame: DataFrame) -> DataFrame:
    """Adds pair, reason and the cited id of a finding."""
    exits = gate_exits()
    pair = decide.first_match([(c, p) for c, p, _ in exits], "defer/insufficient")
    reason = decide.first_match([(c, r) for c, _, r in exits], "unknown_evidence_state_fail_closed")
    return with_features(frame).withColumns({"pair": pair, "reason": reason}).withColumn("cited", F.when(F.col("pair") == "flag/invalid_value", F.col("finding")))


_CALLED = f"CASE WHEN t = 'signup' AND ks[i] >= 97 THEN 'other' ELSE MAP {TOOL_OF}[t] END"
_STATES = f"""e AS ({span_sql("week")}), f AS (SELECT *, len(types) AS n, len(list_filter(types, lambda t: t = 'view')) AS views, len(list_filter(types, lambda t: t = 'click')) AS clicks,
len(list_filter(types, lambda t: t = 'purchase')) AS purchases, len(list_filter(types, lambda t: t = 'error')) AS errors, list_transform(types, lambda t, i: {_CALLED}) AS called FROM e),
r AS (SELECT *, list_filter(range(1, n + 1), lambda i: called[i] IS NOT NULL) AS c, list_filter(range(1, n + 1), lambda i: types[i] = 'purchase' AND vals[i] < 90) AS p, list_filter(range(1, n + 1), lambda i: types[i] = 'error' AND ks[i] >= 96) AS o FROM f),
s AS (SELECT *, list_sort(list_filter({TOOLS}, lambda t: NOT list_contains(called, t))) AS missing_tools, CASE WHEN list_contains(called, 'other') THEN ['other'] ELSE [] END AS wrong_tools,
list_transform(list_filter(c, lambda i: ks[i] >= 99), lambda i: called[i]) AS mismatched, list_filter(c, lambda i: vals[i] > 300) AS failed, list_transform(list_filter(p, lambda i: ks[i] < 3), lambda i: list_position(p, i) - 1) AS unattributed,
list_transform(list_filter(p, lambda i: vals[i] < 1), lambda i: CASE WHEN ks[i] < 3 THEN 'record::' || (list_position(p, i) - 1) ELSE 'p' || ids[i] END) AS stale, 'f' || ids[list_filter(o, lambda i: vals[i] >= 10)[1]] AS finding,
{[*SIGNALS, "other"]}[views % 6 + 1] AS signal, len(p) > 0 AS has_records, len(list_filter(range(1, n + 1), lambda i: types[i] = 'purchase' AND vals[i] > 150)) AS considered, CASE WHEN errors > 0 THEN errors - 1 END AS related FROM r),
x AS (SELECT *, CASE WHEN n < 3 THEN 1 WHEN len(c) = 0 THEN 2 WHEN len(failed) > 0 THEN 3 WHEN len(missing_tools) + len(wrong_tools) > 0 THEN 4 WHEN len(mismatched) > 0 THEN 5 WHEN len(unattributed) > 0 THEN 6 WHEN len(stale) > 0 THEN 7
WHEN len(o) > 0 THEN 8 ELSE 8 + coalesce(nullif(list_position({list(SIGNALS)}, coalesce(signal, '')), 0), 5) END AS exit FROM s),
g AS (SELECT *, (['defer/insufficient', 'defer/insufficient', 'defer/insufficient', 'defer/insufficient', 'defer/insufficient', 'verify/insufficient', 'verify/insufficient', 'flag/invalid_value', {", ".join(f"'{p}'" for p, _ in SIGNALS.values())}, 'defer/insufficient'])[exit] AS pair,
(['missing_model_visible_task', 'missing_tool_loop', 'tool_unavailable', 'tool_contract_failure', 'query_contract_failure', 'missing_source_attribution', 'stale_source_requires_verification', 'invalid_numeric_value', {", ".join(f"'{r}'" for _, r in SIGNALS.values())}, 'unknown_evidence_state_fail_closed'])[exit] AS reason FROM x)"""


@query("g3_h8_runtime_gate", f"WITH {_STATES} SELECT k, pair, reason, CASE WHEN exit = 8 THEN finding END AS cited FROM g")
def runtime_gate(spark, d):
    return gated(states(spark, d)).select("k", "pair", "reason", "cited")


@query(
    "h8_tool_features",
    f"""WITH {_STATES} SELECT k, array_to_string(missing_tools, ',') AS missing_tools, array_to_string(wrong_tools, ',') AS wrong_tools, array_to_string(mismatched, ',') AS mismatched,
array_to_string(unattributed, ',') AS unattributed, array_to_string(stale, ',') AS stale FROM g""",
)
def features(spark, d):
    found = with_features(states(spark, d))
    return found.select("k", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing_tools", "wrong_tools", "mismatched", "unattributed", "stale")))


@query(
    "g4_gate_with_count_fallback",
    f"""WITH {_STATES} SELECT k, CASE WHEN len(o) > 0 THEN 'flag' WHEN signal = '{list(SIGNALS)[0]}' THEN 'reject' WHEN signal = '{list(SIGNALS)[1]}' THEN 'ground' WHEN signal = '{list(SIGNALS)[2]}' THEN 'verify' WHEN signal = '{list(SIGNALS)[3]}' THEN 'defer'
WHEN NOT has_records AND considered = 0 AND related > 0 THEN 'verify' ELSE 'defer' END AS action, CASE WHEN len(o) > 0 OR (signal IS NOT NULL AND signal <> 'other') THEN 'signal' WHEN NOT has_records AND considered = 0 AND related = 0 THEN 'count_fallback_no_evidence'
WHEN NOT has_records AND considered = 0 AND related > 0 THEN 'count_fallback_related_evidence' ELSE 'unknown_evidence_state_fail_closed' END AS reason FROM g""",
)
def count_fallback(spark, d):
    nothing = (F.size("records") == 0) & (F.col("considered") == 0)
    exits = [(F.size("findings") > 0, "flag", "signal"), *((F.col("signal") == s, p.split("/")[0], "signal") for s, (p, _) in SIGNALS.items())]
    exits += [(nothing & (F.col("related") == 0), "defer", "count_fallback_no_evidence"), (nothing & (F.col("related") > 0), "verify", "count_fallback_related_evidence")]
    action = decide.first_match([(c, a) for c, a, _ in exits], "defer")
    return states(spark, d).select("k", action.alias("action"), decide.first_match([(c, r) for c, _, r in exits], "unknown_evidence_state_fail_closed").alias("reason"))


def hybrid(model: Column, gate: Column) -> Column:
    """(pair, reason): agreement, the gate where it fails closed, else verification."""
    pair = F.when((model == gate) | gate.isin(FAIL_CLOSED), gate).otherwise("verify/insufficient")
    reason = F.when(model == gate, "model_gate_agreement").when(gate.isin(FAIL_CLOSED), "runtime_fail_closed_override").otherwise("decisive_disagreement_requires_verification")
    return F.struct(pair.alias("pair"), reason.alias("reason"))


@query(
    "g5_hybrid_arbitration",
    f"""WITH {_STATES}, h AS (SELECT *, {PAIRS}[n % 5 + 1] AS model FROM g) SELECT CASE WHEN model = pair OR pair IN ('defer/insufficient', 'verify/insufficient') THEN pair ELSE 'verify/insufficient' END AS final,
CASE WHEN model = pair THEN 'model_gate_agreement' WHEN pair IN ('defer/insufficient', 'verify/insufficient') THEN 'runtime_fail_closed_override' ELSE 'decisive_disagreement_requires_verification' END AS reason, count(*) AS n FROM h GROUP BY 1, 2""",
)
def arbitration(spark, d):
    model = F.get(F.array(*map(F.lit, PAIRS)), F.col("n") % 5)
    made = gated(states(spark, d)).select(hybrid(model, F.col("pair")).alias("h"))
    return made.groupBy(F.col("h.pair").alias("final"), F.col("h.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g5_a21_four_policies",
    f"""WITH {_STATES}, c AS (SELECT k, pair AS gate, n % 2 = 0 AS has_gate, {PAIRS}[n % 5 + 1] AS top, CASE WHEN views > 0 THEN 1.0::DOUBLE * clicks / views END AS gap, {PAIRS}[purchases % 4 + 1] AS target FROM g),
p AS (SELECT *, 'raw_candidate_top1' AS policy, top AS final, true AS trusted FROM c UNION ALL SELECT *, 'score_gap_fail_closed', CASE WHEN gap >= 0.5 THEN top ELSE 'defer/insufficient' END, coalesce(gap >= 0.5, false) FROM c
UNION ALL SELECT *, 'evidence_boundary_override', CASE WHEN has_gate THEN gate ELSE 'defer/insufficient' END, false FROM c UNION ALL SELECT *, 'hybrid_evidence_then_score_gap', CASE WHEN has_gate THEN gate WHEN gap >= 0.5 THEN top ELSE 'defer/insufficient' END, NOT has_gate AND coalesce(gap >= 0.5, false) FROM c),
m AS (SELECT policy, target, avg((final = target)::INT) AS acc FROM p GROUP BY 1, 2)
SELECT p.policy, count(*) AS n, count(*) FILTER (WHERE final = target) AS exact, count(*) FILTER (WHERE trusted AND final <> target) AS trusted_incorrect, count(*) FILTER (WHERE final IN ('ground/supported', 'reject/contradicted', 'flag/invalid_value')) AS decisive,
round(count(*) FILTER (WHERE final NOT IN ('defer/insufficient', 'verify/insufficient') AND final <> target) / nullif(count(*) FILTER (WHERE final NOT IN ('defer/insufficient', 'verify/insufficient')), 0), 6)::DOUBLE AS selective_risk,
round(count(*) FILTER (WHERE final IN ('defer/insufficient', 'verify/insufficient')) / count(*), 6)::DOUBLE AS fail_closed_rate, (SELECT round(avg(acc), 6) FROM m WHERE m.policy = p.policy)::DOUBLE AS macro_accuracy FROM p GROUP BY p.policy""",
)
def four_policies(spark, d):
    pairs, n = F.array(*map(F.lit, PAIRS)), F.col("n")
    rows = gated(states(spark, d)).select(
        F.col("pair").alias("gate"), (n % 2 == 0).alias("has_gate"), F.get(pairs, n % 5).alias("top"),
        F.coalesce(F.when(F.col("views") > 0, F.col("clicks") / F.col("views")) >= 0.5, F.lit(False)).alias("sure"), F.get(pairs, F.col("purchases") % 4).alias("target"),
    )
    closed = F.lit("defer/insufficient")
    gap = F.when(F.col("sure"), F.col("top")).otherwise(closed)
    table_ = {
        "raw_candidate_top1": (F.col("top"), F.lit(True)),
        "score_gap_fail_closed": (gap, F.col("sure")),
        "evidence_boundary_override": (F.when(F.col("has_gate"), F.col("gate")).otherwise(closed), F.lit(False)),
        "hybrid_evidence_then_score_gap": (F.when(F.col("has_gate"), F.col("gate")).otherwise(gap), ~F.col("has_gate") & F.col("sure")),
    }
    made = rows.select("target", F.inline(F.array(*(F.struct(F.lit(n).alias("policy"), f.alias("final"), t.alias("trusted")) for n, (f, t) in table_.items()))))
    right, open_ = F.col("final") == F.col("target"), ~F.col("final").isin(FAIL_CLOSED)

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    # counts by target first, so that the macro average needs no second pass
    by_target = made.groupBy("policy", "target").agg(
        F.count(F.lit(1)).alias("n"), count(right).alias("exact"), count(F.col("trusted") & ~right).alias("trusted_incorrect"), count(open_).alias("decisive"), count(open_ & ~right).alias("wrong")
    )
    total = {c: F.sum(c) for c in ("n", "exact", "trusted_incorrect", "decisive", "wrong")}
    return by_target.groupBy("policy").agg(
        *(total[c].alias(c) for c in ("n", "exact", "trusted_incorrect", "decisive")),
        F.round(total["wrong"] / F.nullif(total["decisive"], F.lit(0)), 6).alias("selective_risk"),
        F.round((total["n"] - total["decisive"]) / total["n"], 6).alias("fail_closed_rate"),
        F.round(F.avg(F.col("exact") / F.col("n")), 6).alias("macro_accuracy"),
    )


@query(
    "g12_field_rank_patterns",
    f"""WITH e AS ({span_sql("week")}), t AS (SELECT k, unnest(types) AS type, unnest(vals) AS value FROM e), c AS (SELECT k, type, count(*) AS n, round(sum(value), 6) AS total FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, type) AS a, row_number() OVER (PARTITION BY k ORDER BY total DESC, type) AS s, row_number() OVER (PARTITION BY k ORDER BY round(total * n, 4) DESC, type) AS pair FROM c),
x AS (SELECT k, max(a) FILTER (WHERE type = 'click' AND a <= 3) AS a, max(s) FILTER (WHERE type = 'click' AND s <= 3) AS s, max(pair) FILTER (WHERE type = 'click') AS pair FROM r GROUP BY 1)
SELECT CASE WHEN pair = 1 THEN 'pair_top1' WHEN a IS NULL OR s IS NULL THEN 'field_not_retained' WHEN a = 1 AND s = 1 THEN 'joint_pair_representation_failure' WHEN a = 1 THEN 'evidence_status_field_failure' WHEN s = 1 THEN 'action_field_failure' ELSE 'both_field_failure' END AS pattern, count(*) AS n FROM x GROUP BY 1""",
)
def patterns(spark, d):
    """Where the wanted type stands by number, by total value and by both in each user's week; three of each are retained."""
    counted = spans(spark, d, "week").select(F.col("k").alias("span"), F.explode("e").alias("x"))
    totals = counted.groupBy("span", F.col("x.event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.value"), 6).alias("total"))
    place = lambda value: F.row_number().over(Window.partitionBy("span").orderBy(value.desc(), "type"))
    ranked = totals.select("span", "type", place(F.col("n")).alias("a"), place(F.col("total")).alias("s"), place(F.round(F.col("total") * F.col("n"), 4)).alias("pair"))
    mine = F.col("type") == "click"
    rows = ranked.groupBy("span").agg(F.max(F.when(mine & (F.col("a") <= 3), F.col("a"))).alias("a"), F.max(F.when(mine & (F.col("s") <= 3), F.col("s"))).alias("s"), F.max(F.when(mine, F.col("pair"))).alias("pair"))
    cases = [
        (F.col("pair") == 1, "pair_top1"), (F.col("a").isNull() | F.col("s").isNull(), "field_not_retained"), ((F.col("a") == 1) & (F.col("s") == 1), "joint_pair_representation_failure"),
        (F.col("a") == 1, "evidence_status_field_failure"), (F.col("s") == 1, "action_field_failure"),
    ]
    return rows.groupBy(decide.first_match(cases, "both_field_failure").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g14_g15_meet_or_beat_gate",
    """WITH c AS (SELECT l_suppkey, count(*) AS rows, count(*) FILTER (WHERE l_returnflag = 'N') AS exact, count(*) FILTER (WHERE l_discount > 0.03) AS trusted, count(*) FILTER (WHERE l_discount > 0.03 AND l_returnflag = 'R') AS wrong FROM lineitem GROUP BY 1), b AS (SELECT max(exact) AS least FROM c WHERE l_suppkey % 10 = 0)
SELECT l_suppkey, array_to_string(list_filter([CASE WHEN exact > rows THEN 'exact_exceeds_rows' END, CASE WHEN trusted > rows THEN 'trusted_exceeds_rows' END, CASE WHEN exact < least THEN 'below_exact_min' END, CASE WHEN wrong > 100 THEN 'unsafe_candidate_trust' END], lambda x: x IS NOT NULL), ',') AS violations,
exact >= least AS meets, exact > least AS beats FROM c, b""",
)
def meet_or_beat(spark, d):
    flag, sure = F.col("l_returnflag"), F.col("l_discount") > 0.03
    counted = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(flag == "N", 1)).alias("exact"), F.count(F.when(sure, 1)).alias("trusted"), F.count(F.when(sure & (flag == "R"), 1)).alias("wrong")
    )
    scorecard = counted.filter("l_suppkey % 10 = 0").agg(F.max("exact").alias("least"))  # one row
    violations = trajectory.names_of(
        [("exact_exceeds_rows", F.col("exact") > F.col("rows")), ("trusted_exceeds_rows", F.col("trusted") > F.col("rows")), ("below_exact_min", F.col("exact") < F.col("least")), ("unsafe_candidate_trust", F.col("wrong") > 100)]
    )
    return counted.crossJoin(scorecard).select("l_suppkey", F.array_join(violations, ",").alias("violations"), (F.col("exact") >= F.col("least")).alias("meets"), (F.col("exact") > F.col("least")).alias("beats"))


@query(
    "v11_contract_compiler",
    """SELECT code, count(*) AS n FROM (SELECT CASE WHEN m = 1 THEN 'wrong_component' WHEN m = 2 THEN 'tool_sequence_contract_mismatch' WHEN m = 3 THEN 'query_missing_or_not_object' WHEN m = 4 THEN 'query_field_set_mismatch' WHEN m = 5 THEN 'condition_namespace_mismatch' WHEN m = 6 THEN 'drug_value_invalid' ELSE 'compiled' END AS code
FROM (SELECT o_orderkey, unnest(range(7)) AS m FROM orders)) GROUP BY 1""",
)
def compiler(spark, d):
    """Each task unchanged and in six mutations, compiled to the code of its first failing rule."""
    part = "struct<namespace:string,value:bigint>"
    field = lambda name, value: F.create_map(F.lit(name), F.struct(F.lit(f"{name}_id").alias("namespace"), value.cast("bigint").alias("value")))
    k, m = F.col("k"), F.col("m")
    whole = F.map_concat(field("drug", k), field("condition", k + 1))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("m")).withColumns(
        {
            "component": F.when(m == 1, "other").otherwise("tool_query"),
            "tools": F.when(m == 2, F.reverse(F.array(*map(F.lit, TOOLS)))).otherwise(F.array(*map(F.lit, TOOLS))),
            "query": F.when(m == 3, F.lit(None).cast(f"map<string,{part}>")).when(m == 4, field("drug", k)).otherwise(whole),
        }
    )
    renamed = F.transform_values("query", lambda name, p: F.when((m == 5) & (name == "condition"), p.withField("namespace", F.lit("other"))).when((m == 6) & (name == "drug"), p.withField("value", F.lit(-1).cast("bigint"))).otherwise(p))
    tasks = tasks.withColumn("query", renamed)
    wanted = F.array(F.lit("drug"), F.lit("condition"))
    keys = F.map_keys("query")
    cases = [
        (F.col("component") != "tool_query", "wrong_component"),
        (F.col("tools") != F.array(*map(F.lit, TOOLS)), "tool_sequence_contract_mismatch"),
        (F.col("query").isNull(), "query_missing_or_not_object"),
        ((F.size(F.array_except(keys, wanted)) > 0) | (F.size(F.array_except(wanted, keys)) > 0), "query_field_set_mismatch"),
    ]
    for name in ("drug", "condition"):
        held = F.try_element_at("query", F.lit(name))
        cases += [(held["namespace"] != f"{name}_id", f"{name}_namespace_mismatch"), (held["value"].isNull() | (held["value"] < 0), f"{name}_value_invalid")]
    return tasks.groupBy(decide.first_match(cases, "compiled").alias("code")).agg(F.count(F.lit(1)).alias("n"))
