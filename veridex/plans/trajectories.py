"""Trajectories: rewards, policy rules, query completeness, failure variants, preference pairs and trust policies.

A case is a user's day: its events are the steps in the order of time, views and signups as searches, clicks and purchases as
checks, with the arguments that their values give; the other fields come from the same events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import decide
from veridex.operators import trajectory
from veridex.plans import gates
from veridex.plans.register import registrar
from veridex.plans.spans import first, last, some, span_sql, spans
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()
GOLD = ["supported", "contradicted", "invalid_value", "insufficient", "unknown"]
ACTIONS = [trajectory.TRUST, trajectory.SELF, trajectory.REJECT, trajectory.BASELINE, trajectory.VERIFY, trajectory.GROUND]


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


#: What a type of event is as a step.
STEP_OF = {"view": "search", "signup": "search", "click": "check", "purchase": "check"}


def _sources(one: Column, two: Column) -> Column:
    return F.array_compact(F.array(F.when(one, "s1"), F.when(two, "s2"))).cast("array<string>")


def _tasks(spark, d) -> DataFrame:
    """Task and packet columns of users' days."""
    frame = spans(spark, d, "day").withColumns({"n": F.size("e"), "high": F.array_max(F.transform("e", lambda x: x["k"])), "most": F.array_max(F.transform("e", lambda x: x["value"]))})
    frame = frame.withColumn("gold_status", _pick(GOLD, first()["k"] % 5))
    wanted = F.when(F.col("gold_status").isin("contradicted", "invalid_value"), trajectory.REJECT).when(F.col("gold_status") == "supported", trajectory.GROUND).otherwise(trajectory.VERIFY)
    begins = first()["event_type"]
    return frame.withColumns(
        {
            "expected_action": F.when(last()["event_type"] != "error", wanted),
            "gold_sources": _sources(some(lambda x: x["value"] > 60), some(lambda x: x["k"] > 85)),
            "required_tools": _texts("search", "check"),
            "required_fields": _texts("drug", "condition"),
            "requires_attribution": F.col("n") >= 3,
            "requires_tool": some(lambda x: x["event_type"] == "purchase"),
            "web_zero": some(lambda x: x["k"] < 8),
            "allowed": F.when(some(lambda x: x["event_type"] == "signup"), _texts(*(a for a in ACTIONS if a != trajectory.SELF))).otherwise(_texts(*ACTIONS)),
            "calibration": F.when(F.col("high") >= 50, "calibrated").when(F.col("high") >= 25, "uncalibrated"),
            "baseline_dominates": F.col("most") > 120,
            "regime": F.when(begins.isin("view", "click"), "Antibody_Antigen").when(begins == "signup", "other"),
            "metric_type": F.when(last()["k"] < 10, "").otherwise("iptm"),
            "metric_scope": F.when(last()["value"] >= 5, "interface"),
            "dataset_id": F.lit("d1"),
            "threshold_id": F.lit("t1"),
            "regime_match": F.when(F.col("n") > 1, F.get("e", F.lit(0))["value"] > F.get("e", F.lit(1))["value"]),
        }
    )


def _step(name: str, *keys: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.map_from_arrays(_texts(*keys), _texts(*("v" for _ in keys))).alias("arguments"))


def _steps() -> Column:
    """The day's events as steps; an event of some value names a drug, one of some k a condition."""

    def one(x: Column) -> Column:
        name = F.lit("look")
        for kind, own in STEP_OF.items():
            name = F.when(x["event_type"] == kind, own).otherwise(name)
        held = F.array_compact(F.array(F.when(x["value"] >= 15, F.struct(F.lit("drug").alias("key"), x["value"].cast("string").alias("v"))), F.when(x["k"] >= 15, F.struct(F.lit("condition").alias("key"), x["k"].cast("string").alias("v")))))
        return F.struct(name.alias("name"), F.map_from_entries(held).alias("arguments"))

    return F.transform("e", one)


def cases(spark, d) -> DataFrame:
    """Tasks with the trajectories of the day."""
    start, end = first(), last()
    return _tasks(spark, d).withColumns(
        {
            "steps": _steps(),
            "action": _pick(ACTIONS, end["k"] % 6),
            "status": F.when(start["value"] > 20, F.col("gold_status")).when(start["value"] > 10, "supported"),
            "packet_status": F.when(end["value"] > 30, F.col("gold_status")).otherwise("unknown"),
            "cited": _sources(some(lambda x: x["value"] > 30), some(lambda x: x["k"] > 70)),
        }
    )


def ideals(spark, d) -> DataFrame:
    """The tasks that name an action, with the trajectory that meets them."""
    frame = _tasks(spark, d).filter("expected_action IS NOT NULL")
    whole = F.array(_step("search", "drug", "condition"), _step("check", "drug", "condition"))
    sources = F.when(F.col("requires_attribution") & (F.size("gold_sources") == 0), _texts("s1")).otherwise(F.col("gold_sources"))
    frame = frame.withColumns({"gold_sources": sources, "steps": whole, "action": F.col("expected_action"), "status": F.col("gold_status"), "packet_status": F.col("gold_status")})
    return frame.withColumns({"cited": F.col("gold_sources"), "allowed": _texts(*ACTIONS)})


def _sql_pick(values: list[str], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{at} + 1]"


def _sql_sources(one: str, two: str) -> str:
    return f"list_filter([CASE WHEN {one} THEN 's1' END, CASE WHEN {two} THEN 's2' END], lambda x: x IS NOT NULL)"


_SQL_TASKS = f"""SELECT *, CASE WHEN types[-1] <> 'error' THEN CASE WHEN gold_status IN ('contradicted', 'invalid_value') THEN '{trajectory.REJECT}' WHEN gold_status = 'supported' THEN '{trajectory.GROUND}' ELSE '{trajectory.VERIFY}' END END AS expected_action,
{_sql_sources("list_max(vals) > 60", "list_max(ks) > 85")} AS gold_sources, len(types) >= 3 AS requires_attribution, list_contains(types, 'purchase') AS requires_tool, list_min(ks) < 8 AS web_zero,
CASE WHEN list_contains(types, 'signup') THEN {[a for a in ACTIONS if a != trajectory.SELF]} ELSE {ACTIONS} END AS allowed, CASE WHEN list_max(ks) >= 50 THEN 'calibrated' WHEN list_max(ks) >= 25 THEN 'uncalibrated' END AS calibration,
list_max(vals) > 120 AS baseline_dominates, CASE WHEN types[1] IN ('view', 'click') THEN 'Antibody_Antigen' WHEN types[1] = 'signup' THEN 'other' END AS regime, ks[-1] < 10 OR NOT vals[-1] >= 5 AS unlabelled, coalesce(vals[1] > vals[2], false) AS regime_match
FROM (SELECT *, {_sql_pick(GOLD, "ks[1] % 5")} AS gold_status FROM ({span_sql("day")}))"""
_SQL_CASES = f"""SELECT *, list_transform(types, lambda t: coalesce(MAP {STEP_OF}[t], 'look')) AS tools, list_transform(types, lambda t, i: (vals[i] >= 15)::INT + (ks[i] >= 15)::INT) AS filled, {_sql_pick(ACTIONS, "ks[-1] % 6")} AS action,
coalesce(CASE WHEN vals[1] > 20 THEN gold_status WHEN vals[1] > 10 THEN 'supported' END, CASE WHEN vals[-1] > 30 THEN gold_status ELSE 'unknown' END) AS said, {_sql_sources("list_max(vals) > 30", "list_max(ks) > 70")} AS cited FROM ({_SQL_TASKS})"""


def _sql_scored(source: str) -> str:
    """violations of rows with tools and filled (how many required fields each step's arguments have)."""
    def last(tool: str) -> str:
        return f"coalesce(filled[len(tools) - list_position(list_reverse(tools), '{tool}') + 1], 0) = 2 AND list_contains(tools, '{tool}')"

    rules = [
        ("action_not_allowed", "NOT list_contains(allowed, action)"),
        ("missing_required_tool_sequence", "NOT (list_contains(tools, 'search') AND list_contains(tools[coalesce(list_position(tools, 'search'), 0) + 1 :], 'check'))"),
        ("evidence_status_mismatch", "said IS DISTINCT FROM gold_status"),
        ("missing_required_attribution", "NOT ((NOT requires_attribution AND len(gold_sources) = 0) OR (len(gold_sources) > 0 AND list_has_all(cited, gold_sources)))"),
        ("terminal_action_mismatch", "expected_action IS NOT NULL AND action <> expected_action"),
        ("web_zero_requires_tool_or_defer", f"web_zero AND action = '{trajectory.SELF}'"),
        ("external_tool_required", f"requires_tool AND action = '{trajectory.SELF}'"),
        ("baseline_dominates_do_not_trust_specialist", f"baseline_dominates AND action = '{trajectory.TRUST}'"),
        ("uncalibrated_specialist_requires_verify_baseline_or_defer", f"action = '{trajectory.TRUST}' AND calibration IS DISTINCT FROM 'calibrated'"),
        ("contradicted_claim_requires_reject_or_flag", f"gold_status = 'contradicted' AND action <> '{trajectory.REJECT}'"),
        ("invalid_value_requires_reject_or_flag", f"gold_status = 'invalid_value' AND action <> '{trajectory.REJECT}'"),
        ("insufficient_evidence_cannot_be_trusted", f"gold_status = 'insufficient' AND action = '{trajectory.TRUST}'"),
        ("c5_trust_missing_metric_or_calibration_schema", f"action = '{trajectory.TRUST}' AND lower(coalesce(regime, '')) = 'antibody_antigen' AND unlabelled"),
        ("c5_trust_requires_regime_matched_calibration", f"action = '{trajectory.TRUST}' AND lower(coalesce(regime, '')) = 'antibody_antigen' AND NOT regime_match"),
        ("query_filter_missing_required_field", f"NOT ({last('search')} AND {last('check')})"),
    ]
    listed = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in rules)
    return f"SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS violations FROM ({source})"


_FIRST = "['action_not_allowed', 'missing_required_tool_sequence', 'evidence_status_mismatch', 'missing_required_attribution', 'terminal_action_mismatch']"
_SEVENTH = "'query_filter_missing_required_field'"
_EARNED = f"5 - len(list_intersect(violations, {_FIRST})) + (len(list_filter(violations, lambda x: NOT list_contains({_FIRST}, x) AND x <> {_SEVENTH})) = 0)::INT"


@query(
    "e1_e2_trajectory_evaluator",
    f"WITH s AS ({_sql_scored(_SQL_CASES)}) SELECT k, ({_EARNED}) / 6.0::DOUBLE AS score, len(list_filter(violations, lambda x: x <> {_SEVENTH})) = 0 AS passed, array_to_string(list_filter(violations, lambda x: x <> {_SEVENTH}), ',') AS violations FROM s",
)
def evaluator(spark, d):
    return trajectory.evaluate(cases(spark, d)).select("k", "score", "passed", F.array_join("violations", ",").alias("violations"))


@query(
    "e3_h11_query_completeness",
    f"WITH s AS ({_sql_scored(_SQL_CASES)}) SELECT k, ({_EARNED} + (NOT list_contains(violations, {_SEVENTH}))::INT) / 7.0::DOUBLE AS score, len(violations) = 0 AS passed, NOT list_contains(violations, {_SEVENTH}) AS complete FROM s",
)
def completeness(spark, d):
    return trajectory.evaluate_with_query(cases(spark, d)).select("k", "score", "passed", (F.col("reward_query_filter_completeness") == 1).alias("complete"))


_SQL_IDEAL = f"""SELECT * REPLACE (CASE WHEN requires_attribution AND len(gold_sources) = 0 THEN ['s1'] ELSE gold_sources END AS gold_sources, {ACTIONS} AS allowed) FROM ({_SQL_TASKS}) WHERE expected_action IS NOT NULL"""
_SQL_IDEALS = f"SELECT *, ['search', 'check'] AS tools, [2, 2] AS filled, expected_action AS action, gold_status AS said, gold_sources AS cited FROM ({_SQL_IDEAL})"
_SQL_VARIANTS = " UNION ALL BY NAME ".join(
    f"SELECT * REPLACE ({changed}), '{name}' AS variant FROM ({_SQL_IDEALS}) WHERE {applies}"
    for name, applies, changed in [
        ("self_answering_without_tools", "true", f"[]::VARCHAR[] AS tools, []::INT[] AS filled, '{trajectory.SELF}' AS action, []::VARCHAR[] AS cited, 'unknown' AS said"),
        ("wrong_tool", "true", "['wrong_tool'] AS tools, [0] AS filled"),
        ("missing_tool", "true", "['search'] AS tools, [2] AS filled"),
        ("partial_query", "true", "[0, 0] AS filled"),
        ("missing_attribution", "len(gold_sources) > 0", "[]::VARCHAR[] AS cited"),
        ("invalid_value_missed", "gold_status = 'invalid_value'", f"'{trajectory.VERIFY}' AS action, 'supported' AS said"),
        ("unsupported_trust", f"expected_action <> '{trajectory.TRUST}'", f"'{trajectory.TRUST}' AS action, gold_status AS said, 'uncalibrated' AS calibration"),
        ("insufficient_as_negative", "gold_status = 'insufficient'", f"'{trajectory.REJECT}' AS action, 'contradicted' AS said, []::VARCHAR[] AS cited"),
    ]
)


@query(
    "e9_h12_failure_variants",
    f"WITH s AS ({_sql_scored(_SQL_VARIANTS)}) SELECT variant, count(*) AS n, count(*) FILTER (WHERE len(violations) = 0) AS passed, sum(len(violations))::BIGINT AS broken FROM s GROUP BY 1",
)
def variants(spark, d):
    scored = trajectory.evaluate_with_query(trajectory.failure_variants(ideals(spark, d)))
    return scored.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.sum(F.size("violations").cast("bigint")).alias("broken"))


@query(
    "e10_scored_preference_pairs",
    f"""WITH c AS ({_sql_scored(_SQL_IDEALS)}), r AS ({_sql_scored(_SQL_VARIANTS)})
SELECT r.k, r.variant, ({_EARNED.replace("violations", "r.violations")} + (NOT list_contains(r.violations, {_SEVENTH}))::INT) / 7.0::DOUBLE AS rejected_score FROM c JOIN r ON c.k = r.k WHERE len(c.violations) = 0 AND len(r.violations) > 0""",
)
def preferences(spark, d):
    """Each ideal that passes with each variant of it that fails: the variant's row holds both, so no join is needed."""
    ideal = trajectory.evaluate_with_query(ideals(spark, d)).filter("passed")
    columns = [c for c in ideal.columns if not c.startswith("reward_") and c not in ("violations", "score", "passed")]
    rejected = trajectory.evaluate_with_query(trajectory.failure_variants(ideal.select(*columns)))
    return rejected.filter("NOT passed").select("k", "variant", F.col("score").alias("rejected_score"))


def packets(spark, d) -> DataFrame:
    """Specialists' outputs with their calibration, made from customers."""
    k = F.col("k")
    frame = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return frame.withColumns(
        {
            "regime": F.when(k % 9 == 0, "other").otherwise(trajectory.REGIME),
            "metric_type": F.when(k % 23 == 0, "").otherwise("iptm"),
            "metric_scope": F.lit("interface"),
            "metric_value": F.when(k % 19 != 0, F.col("x") / 10000),
            "calibration": F.when(k % 7 == 0, "uncalibrated").otherwise("calibrated"),
            "dataset_id": F.when(k % 29 != 0, "d1"),
            "calibration_regime": F.when(k % 11 == 0, "other").otherwise(trajectory.REGIME),
            "threshold_id": F.lit("t1"),
            "threshold_value": F.lit(0.3),
            "general_threshold": F.lit(0.2),
            "regime_match": k % 13 != 0,
            "certified": k % 17 != 0,
            "baseline_dominates": k % 5 == 0,
            "baseline_available": k % 10 < 7,
            "verification_available": k % 4 < 2,
            "hidden_label": F.when(F.col("x") > 5000, "interface_success").otherwise("interface_failure"),
        }
    )


_SQL_PACKETS = """SELECT c_custkey AS k, CASE WHEN k % 19 <> 0 THEN c_acctbal / 10000 END AS m, list_filter([CASE WHEN k % 9 = 0 THEN 'interaction_regime_not_antibody_antigen' END, CASE WHEN k % 23 = 0 THEN 'missing_metric_type' END, CASE WHEN k % 19 = 0 THEN 'missing_metric_value' END,
CASE WHEN k % 7 = 0 THEN 'calibration_status_not_calibrated' END, CASE WHEN k % 29 = 0 THEN 'missing_calibration_dataset_id' END, CASE WHEN k % 11 = 0 THEN 'calibration_regime_not_antibody_antigen' END, CASE WHEN k % 13 = 0 THEN 'calibration_regime_mismatch' END,
CASE WHEN k % 17 = 0 THEN 'rcps_threshold_not_certified' END, CASE WHEN m < 0.3 THEN 'specialist_metric_below_threshold' END, CASE WHEN k % 5 = 0 THEN 'cheap_baseline_dominates' END], lambda x: x IS NOT NULL) AS issues, c_acctbal > 5000 AS success, c_nationkey AS nation, c_mktsegment AS segment FROM customer"""
_SQL_POLICIES = f"""p AS ({_SQL_PACKETS}), q AS (SELECT *, 'trust_all' AS policy, '{trajectory.TRUST}' AS action FROM p UNION ALL SELECT *, 'general_gate', CASE WHEN m >= 0.2 THEN '{trajectory.TRUST}' ELSE '{trajectory.DEFER}' END FROM p
UNION ALL SELECT *, 'regime_specific_gate', CASE WHEN len(issues) = 0 THEN '{trajectory.TRUST}' ELSE '{trajectory.DEFER}' END FROM p
UNION ALL SELECT *, 'fail_closed', CASE WHEN len(issues) = 0 THEN '{trajectory.TRUST}' WHEN k % 10 < 7 AND k % 5 = 0 THEN '{trajectory.BASELINE}' WHEN k % 4 < 2 THEN '{trajectory.VERIFY}' ELSE '{trajectory.DEFER}' END FROM p)"""


@query("g13_trust_issues", f"SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM ({_SQL_PACKETS})) GROUP BY 1")
def issues(spark, d):
    return packets(spark, d).select(F.explode(trajectory.trust_issues()).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("g13_e11_policy_actions", f"WITH {_SQL_POLICIES} SELECT policy, action, count(*) AS n, count(*) FILTER (WHERE action = '{trajectory.TRUST}' AND (NOT success OR len(issues) > 0)) AS unsafe_trust FROM q GROUP BY 1, 2")
def policies(spark, d):
    unsafe = (F.col("action") == trajectory.TRUST) & ((F.col("hidden_label") != "interface_success") | (F.size("issues") > 0))
    return trajectory.by_policy(packets(spark, d)).groupBy("policy", "action").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(unsafe, 1)).alias("unsafe_trust"))


@query(
    "e4_twelve_rewards_by_policy",
    f"""WITH {_SQL_POLICIES}, s AS (SELECT *, action = '{trajectory.TRUST}' AS trusted, len(issues) AS i, k % 7 = 0 AS uncal, k % 5 = 0 AS dom, k % 9 <> 0 AS own, k % 23 = 0 OR k % 29 = 0 AS unlabelled, k % 13 = 0 AS off,
action = CASE WHEN i = 0 AND success THEN '{trajectory.TRUST}' WHEN k % 10 < 7 AND k % 5 = 0 THEN '{trajectory.BASELINE}' WHEN k % 4 < 2 THEN '{trajectory.VERIFY}' ELSE '{trajectory.DEFER}' END AS exact FROM q),
r AS (SELECT policy, [NOT (nation = 3 AND action = '{trajectory.BASELINE}'), nation <> 5, nation <> 7, segment <> 'FURNITURE' OR nation <> 9, exact, NOT (trusted AND (dom OR uncal OR (own AND (unlabelled OR off)))),
nation <> 11 OR m IS NULL, nation <> 13, nation <> 15, NOT trusted OR success, NOT trusted OR i = 0, trusted OR nation <> 17] AS earned FROM s), t AS (SELECT policy, list_transform(earned, lambda x: x::INT) AS e FROM r)
SELECT policy, count(*) AS n, count(*) FILTER (WHERE list_sum(e) = 12) AS exact_pass, round(sum(list_sum(e)) / 12.0 / count(*), 6)::DOUBLE AS mean_score, array_to_string([{", ".join(f"sum(e[{i}])::BIGINT" for i in range(1, 13))}], ',') AS earned FROM t GROUP BY 1""",
)
def twelve(spark, d):
    """Twelve rewards of each policy's trajectories; customers of some nations copy, cite or say something wrong."""
    made, nation = trajectory.by_policy(packets(spark, d)), F.col("nation")
    right = F.when((F.size("issues") == 0) & (F.col("hidden_label") == "interface_success"), trajectory.TRUST).when(F.col("baseline_available") & F.col("baseline_dominates"), trajectory.BASELINE)
    right = right.when(F.col("verification_available"), trajectory.VERIFY).otherwise(trajectory.DEFER)
    made = made.withColumns({f"copied_{c}": F.col(c) for c in ("metric_type", "metric_scope", "calibration", "dataset_id", "regime_match")})
    made = made.withColumn("copied_metric_value", F.col("metric_value") + F.when(nation == 11, 1).otherwise(0)).withColumn("copied_threshold_id", F.when(nation == 13, "t2").otherwise(F.col("threshold_id")))
    none = _texts()
    made = made.withColumns(
        {
            "expected_action": right, "gold_status": F.lit("unknown"), "gold_sources": F.when(F.col("segment") == "FURNITURE", _texts("s1")).otherwise(none), "required_tools": _texts("predict"), "required_fields": none,
            "requires_attribution": F.lit(False), "requires_tool": F.lit(True), "web_zero": F.lit(False),
            "allowed": F.when(nation == 3, _texts(*(a for a in ACTIONS if a != trajectory.BASELINE), trajectory.DEFER)).otherwise(_texts(*ACTIONS, trajectory.DEFER)),
            "steps": F.when(nation == 5, F.array(_step("look"))).otherwise(F.array(_step("predict"))), "status": F.when(nation == 7, "supported").otherwise("unknown"), "packet_status": F.lit("unknown"),
            "cited": F.when(nation == 9, none).otherwise(_texts("s1")), "rationale": F.when(nation == 15, F.concat(F.lit("It is an "), F.upper("hidden_label"))).otherwise(F.col("fail_closed_reason")),
            "fail_closed_reason": F.when(nation == 17, "").otherwise(F.col("fail_closed_reason")),
        }
    )
    scored = trajectory.evaluate(made, trajectory.regime_rewards())
    total = F.sum(F.round(F.col("score") * 12).cast("bigint"))
    earned = F.concat_ws(",", *(F.sum(c).cast("string") for c in scored.columns if c.startswith("reward_")))
    return scored.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passed"), 1)).alias("exact_pass"), F.round(total / 12.0 / F.count(F.lit(1)), 6).alias("mean_score"), earned.alias("earned")
    )


#: The gate's pair of a day's week as a terminal action and a status.
_GATED = {"ground": trajectory.GROUND, "reject": trajectory.REJECT, "flag": trajectory.REJECT, "verify": trajectory.VERIFY, "defer": trajectory.DEFER}
_SQL_GATE = f"MAP {_GATED}[split_part(pair, '/', 1)]", "split_part(pair, '/', 2)"
_SQL_FULL = f"{_SQL_GATE[0]} AS action, {_SQL_GATE[1]} AS said, CASE WHEN split_part(pair, '/', 1) IN ('ground', 'flag') THEN gold_sources ELSE []::VARCHAR[] END AS cited"
_SQL_GATED_IDEALS = f"SELECT i.*, w.pair FROM ({_SQL_IDEALS}) i JOIN (SELECT user_id AS u, start AS s, pair FROM g) w ON i.user_id = w.u AND CAST(date_trunc('week', i.start) AS DATE) = w.s"
_SQL_ARBITRATED = " UNION ALL BY NAME ".join(
    f"SELECT * REPLACE ({changed}), '{name}' AS policy FROM i"
    for name, changed in [
        ("oracle_full", "action AS action"),
        ("self_answer", f"[]::VARCHAR[] AS tools, []::INT[] AS filled, '{trajectory.SELF}' AS action, []::VARCHAR[] AS cited, 'unknown' AS said"),
        ("ground_supported_collapse", f"'{trajectory.GROUND}' AS action, 'supported' AS said, gold_sources AS cited"),
        ("citationless_runtime_action", f"{_SQL_GATE[0]} AS action, {_SQL_GATE[1]} AS said, []::VARCHAR[] AS cited"),
        ("runtime_gate_full", _SQL_FULL),
        ("hybrid_runtime_over_collapse", _SQL_FULL),
    ]
)


@query(
    "e12_full_trajectory_arbitration",
    f"""WITH {gates._STATES}, i AS ({_SQL_GATED_IDEALS}), scored AS ({_sql_scored(_SQL_ARBITRATED)}) SELECT policy, CASE WHEN user_id % 5 = 0 THEN 'heldout' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (WHERE len(violations) = 0) AS passed, count(*) FILTER (WHERE action = '{trajectory.GROUND}' AND expected_action <> '{trajectory.GROUND}') AS unsafe_ground,
round(sum({_EARNED} + (NOT list_contains(violations, {_SEVENTH}))::INT) / 7.0 / count(*), 6)::DOUBLE AS mean_score FROM scored GROUP BY 1, 2""",
)
def arbitration(spark, d):
    """Six policies over each case: the ideal, three shortcuts, the runtime gate of its week, and that gate over a collapsed model."""
    week = gates.gated(gates.states(spark, d)).select("user_id", F.col("start").alias("week"), "pair")
    ideal = ideals(spark, d).withColumn("week", F.date_trunc("week", "start").cast("date")).join(week, ["user_id", "week"])
    none, steps_type = _texts(), ideal.schema["steps"].dataType
    said, table_ = F.split_part("pair", F.lit("/"), F.lit(1)), F.create_map(*(F.lit(x) for pair in _GATED.items() for x in pair))
    gate = {"action": F.try_element_at(table_, said), "status": F.split_part("pair", F.lit("/"), F.lit(2))}
    full = gate | {"cited": F.when(said.isin("ground", "flag"), F.col("gold_sources")).otherwise(none)}
    policies = {
        "oracle_full": {},
        "self_answer": {"steps": F.array().cast(steps_type), "action": F.lit(trajectory.SELF), "status": F.lit("unknown"), "cited": none},
        "ground_supported_collapse": {"action": F.lit(trajectory.GROUND), "status": F.lit("supported")},
        "citationless_runtime_action": gate | {"cited": none},
        "runtime_gate_full": full,
        "hybrid_runtime_over_collapse": full,
    }
    changed = ("steps", "action", "status", "cited")
    made = F.array(*(F.struct(F.lit(name).alias("policy"), *(new.get(c, F.col(c)).alias(c) for c in changed)) for name, new in policies.items()))
    rows = ideal.withColumn("_p", F.explode(made)).select(*(c for c in ideal.columns if c not in changed), "_p.*")
    scored = trajectory.evaluate_with_query(rows)
    unsafe = (F.col("action") == trajectory.GROUND) & (F.col("expected_action") != trajectory.GROUND)
    return scored.groupBy("policy", F.when(F.col("user_id") % 5 == 0, "heldout").otherwise("train").alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(unsafe, 1)).alias("unsafe_ground"),
        F.round(F.sum(F.round(F.col("score") * 7)) / 7.0 / F.count(F.lit(1)), 6).alias("mean_score"),
    )


#: What kind of decision an action is; a rejected claim of an invalid value is a flag.
KINDS = {trajectory.GROUND: "ground", trajectory.VERIFY: "verify", trajectory.BASELINE: "defer", trajectory.SELF: "defer", trajectory.TRUST: "ground"}


@query(
    "g11_failure_buckets",
    f"""WITH s AS ({_sql_scored(_SQL_CASES)}), r AS (SELECT CASE WHEN expected_action = '{trajectory.REJECT}' THEN CASE WHEN gold_status = 'invalid_value' THEN 'flag' ELSE 'reject' END ELSE coalesce(MAP {KINDS}[expected_action], 'defer') END AS class,
CASE WHEN action = '{trajectory.REJECT}' THEN CASE WHEN said = 'invalid_value' THEN 'flag' ELSE 'reject' END ELSE MAP {KINDS}[action] END AS pred, violations AS v FROM s WHERE len(violations) > 0)
SELECT CASE WHEN class = 'flag' AND pred = 'flag' AND v = ['missing_required_attribution'] THEN 'prompt_schema_flag_needs_nct' WHEN class = 'ground' AND pred IN ('defer', 'verify') THEN 'ground_efficacy_record_not_recognized' WHEN class = 'reject' AND pred = 'ground' THEN 'mixed_endpoint_reject_overridden_by_ground'
WHEN list_contains(v, 'missing_required_attribution') THEN 'attribution_error' WHEN list_contains(v, 'evidence_status_mismatch') OR list_contains(v, 'terminal_action_mismatch') THEN 'action_or_evidence_status_error' ELSE 'other_native_failure' END AS bucket, count(*) AS n FROM r GROUP BY 1""",
)
def failure_buckets(spark, d):
    """The first kind of failure that each failed trajectory shows."""
    table_ = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    said = F.coalesce("status", "packet_status")

    def kind(action: Column, status: Column) -> Column:
        rejected = F.when(status == "invalid_value", "flag").otherwise("reject")
        return F.when(action == trajectory.REJECT, rejected).otherwise(F.coalesce(F.try_element_at(table_, action), F.lit("defer")))

    rows = trajectory.evaluate_with_query(cases(spark, d)).filter(F.size("violations") > 0)
    rows = rows.select(kind(F.col("expected_action"), F.col("gold_status")).alias("class"), kind(F.col("action"), said).alias("pred"), F.col("violations").alias("v"))
    has = lambda name: F.array_contains("v", name)
    order = [
        ((F.col("class") == "flag") & (F.col("pred") == "flag") & has("missing_required_attribution") & (F.size(F.array_distinct("v")) == 1), "prompt_schema_flag_needs_nct"),
        ((F.col("class") == "ground") & F.col("pred").isin("defer", "verify"), "ground_efficacy_record_not_recognized"),
        ((F.col("class") == "reject") & (F.col("pred") == "ground"), "mixed_endpoint_reject_overridden_by_ground"),
        (has("missing_required_attribution"), "attribution_error"),
        (has("evidence_status_mismatch") | has("terminal_action_mismatch"), "action_or_evidence_status_error"),
    ]
    return rows.groupBy(decide.first_match(order, "other_native_failure").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
