"""Scores of nested tool-use trajectories as expressions over their arrays.

A row holds the task and the trajectory.  Task: ``expected_action`` (null: any), ``gold_status``, ``gold_sources``,
``required_tools``, ``required_fields``, ``requires_attribution``, ``requires_tool``, ``web_zero``.  Trajectory: ``steps``
(array of struct<name, arguments: map>), ``action``, ``status`` (null: ``packet_status``), ``cited``.  Packet: ``allowed``,
``calibration``, ``baseline_dominates``, ``regime``, ``metric_type``, ``metric_scope``, ``dataset_id``, ``threshold_id``,
``regime_match``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import text as tx

#: Terminal actions and statuses that the rules name.
TRUST, SELF, REJECT = "trust_specialist_output", "answer_self", "reject_or_flag_unsupported_claim"
BASELINE, VERIFY, DEFER = "use_cheap_baseline", "verify_with_assay_or_database", "defer_or_request_more_evidence"
GROUND = "ground_with_attribution"
REGIME = "antibody_antigen"


def held(condition: Column) -> Column:
    """A condition that is false where it is null."""
    return F.coalesce(condition, F.lit(False))


def names_of(cases: list[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(held(condition), F.lit(name)) for name, condition in cases)))


def violations_of(rewards: dict[str, tuple[Column, str]]) -> list[tuple[str, Column]]:
    return [(violation, ~held(passed)) for passed, violation in rewards.values()]


def blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def policy_rules() -> list[tuple[str, Column]]:
    """The nine rules on a terminal action, each true where it is broken."""
    action, gold = F.col("action"), F.col("gold_status")
    trusted = action == TRUST
    in_regime = trusted & (F.lower(F.coalesce("regime", F.lit(""))) == REGIME)
    unlabelled = reduce(lambda a, b: a | b, (blank(F.col(c)) for c in ("metric_type", "metric_scope", "dataset_id", "threshold_id")))
    return [
        ("web_zero_requires_tool_or_defer", F.col("web_zero") & (action == SELF)),
        ("external_tool_required", F.col("requires_tool") & (action == SELF)),
        ("baseline_dominates_do_not_trust_specialist", F.col("baseline_dominates") & trusted),
        ("uncalibrated_specialist_requires_verify_baseline_or_defer", trusted & ~F.col("calibration").eqNullSafe("calibrated")),
        ("contradicted_claim_requires_reject_or_flag", (gold == "contradicted") & (action != REJECT)),
        ("invalid_value_requires_reject_or_flag", (gold == "invalid_value") & (action != REJECT)),
        ("insufficient_evidence_cannot_be_trusted", (gold == "insufficient") & trusted),
        ("c5_trust_missing_metric_or_calibration_schema", in_regime & unlabelled),
        ("c5_trust_requires_regime_matched_calibration", in_regime & ~held(F.col("regime_match"))),
    ]


def attributed() -> Column:
    """Nothing is asked for, or there are gold sources and all are cited."""
    asked = F.col("requires_attribution") | (F.size("gold_sources") > 0)
    return ~asked | ((F.size("gold_sources") > 0) & tx.subset(F.col("gold_sources"), F.col("cited")))


def query_complete() -> Column:
    """The last step of each required tool has all required fields among its arguments; true where nothing is required."""

    def complete(tool: Column) -> Column:
        mine = F.filter("steps", lambda s: s["name"] == tool)
        keys = F.map_keys(F.element_at(mine, -1)["arguments"])
        return (F.size(mine) > 0) & (F.size(F.array_except("required_fields", keys)) == 0)

    nothing = (F.size("required_tools") == 0) | (F.size("required_fields") == 0)
    return nothing | F.forall("required_tools", lambda tool: held(F.when(F.exists("steps", lambda s: s["name"] == tool), complete(tool))))


def evaluate(frame: DataFrame, extra: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Adds reward_<name> (0 or 1), violations (in the order of the rewards, policy rules in their place), score, passed.

    extra: further rewards, name to (condition, violation).  A row passes if it earns all rewards and breaks no rule.
    """
    status = F.coalesce("status", "packet_status")
    tools = F.transform("steps", lambda s: s["name"])
    rewards = {
        "action_allowed": (F.array_contains("allowed", F.col("action")), "action_not_allowed"),
        "required_tool_sequence": (tx.ordered_subsequence(tools, F.col("required_tools")), "missing_required_tool_sequence"),
        "evidence_status": (status == F.col("gold_status"), "evidence_status_mismatch"),
        "attribution": (attributed(), "missing_required_attribution"),
        "terminal_action": (F.col("expected_action").isNull() | (F.col("action") == F.col("expected_action")), "terminal_action_mismatch"),
    }
    frame = frame.withColumn("_broken", names_of(policy_rules()))
    first = names_of(violations_of(rewards))
    every = {**{name: held(passed) for name, (passed, _) in rewards.items()}, "policy_compliance": F.size("_broken") == 0}
    every |= {name: held(passed) for name, (passed, _) in (extra or {}).items()}
    violations = F.concat(first, "_broken", names_of(violations_of(extra or {})))
    frame = frame.withColumns({f"reward_{name}": passed.cast("int") for name, passed in every.items()} | {"violations": violations}).drop("_broken")
    earned = reduce(lambda a, b: a + b, (F.col(f"reward_{name}") for name in every))
    return frame.withColumn("score", earned / F.lit(len(every))).withColumn("passed", (earned == len(every)) & (F.size("violations") == 0))


def evaluate_with_query(frame: DataFrame) -> DataFrame:
    """evaluate with the seventh reward, complete queries."""
    return evaluate(frame, {"query_filter_completeness": (query_complete(), "query_filter_missing_required_field")})


def trust_issues() -> Column:
    """Visible reasons why a specialist's output can't be trusted, over the packet's columns and ``certified``,
    ``calibration_regime``, ``metric_value`` and ``threshold_value``."""
    return names_of(
        [
            ("interaction_regime_not_antibody_antigen", ~F.col("regime").eqNullSafe(REGIME)),
            ("missing_metric_type", blank(F.col("metric_type"))),
            ("missing_metric_scope", blank(F.col("metric_scope"))),
            ("missing_metric_value", F.col("metric_value").isNull()),
            ("calibration_status_not_calibrated", ~F.col("calibration").eqNullSafe("calibrated")),
            ("missing_calibration_dataset_id", blank(F.col("dataset_id"))),
            ("missing_calibration_regime", blank(F.col("calibration_regime"))),
            ("missing_rcps_threshold_id", blank(F.col("threshold_id"))),
            ("missing_rcps_threshold_value", F.col("threshold_value").isNull()),
            ("calibration_regime_not_antibody_antigen", ~F.col("calibration_regime").eqNullSafe(REGIME)),
            ("calibration_regime_mismatch", ~held(F.col("regime_match"))),
            ("rcps_threshold_not_certified", ~held(F.col("certified"))),
            ("specialist_metric_below_threshold", F.col("metric_value") < F.col("threshold_value")),
            ("cheap_baseline_dominates", F.col("baseline_dominates")),
        ]
    )


#: Policies by name: the action over a row's visible columns, ``issues`` among them.
POLICIES = {
    "trust_all": lambda: F.lit(TRUST),
    "general_gate": lambda: F.when(held(F.col("metric_value") >= F.col("general_threshold")), TRUST).otherwise(DEFER),
    "regime_specific_gate": lambda: F.when(F.size("issues") == 0, TRUST).otherwise(DEFER),
    "fail_closed": lambda: F.when(F.size("issues") == 0, TRUST)
    .when(held(F.col("baseline_available") & F.col("baseline_dominates")), BASELINE)
    .when(held(F.col("verification_available")), VERIFY)
    .otherwise(DEFER),
}


def by_policy(frame: DataFrame, policies: dict | None = None) -> DataFrame:
    """Each row once for each policy: policy, action, and fail_closed_reason (null where it trusts)."""
    frame = frame.withColumn("issues", trust_issues())
    table = POLICIES if policies is None else policies
    made = F.array(*(F.struct(F.lit(name).alias("policy"), action().alias("action")) for name, action in table.items()))
    frame = frame.withColumn("_made", F.explode(made)).select("*", "_made.policy", "_made.action").drop("_made")
    reason = F.when(F.size("issues") > 0, F.array_join("issues", ",")).otherwise("general_gate_threshold_not_met")
    return frame.withColumn("fail_closed_reason", F.when(F.col("action") != TRUST, reason))


def regime_rewards() -> dict[str, tuple[Column, str]]:
    """Six further rewards of a specialist's trajectory, over the packet, its ``copied_*`` values and the hidden columns."""
    trusted = F.col("action") == TRUST
    metric = F.col("copied_metric_type").eqNullSafe(F.col("metric_type")) & F.col("copied_metric_value").eqNullSafe(F.col("metric_value"))
    metric &= F.col("copied_metric_scope").eqNullSafe(F.col("metric_scope"))
    calibration = F.col("copied_calibration").eqNullSafe(F.col("calibration")) & F.col("copied_threshold_id").eqNullSafe(F.col("threshold_id"))
    calibration &= F.col("copied_dataset_id").eqNullSafe(F.col("dataset_id")) & F.col("copied_regime_match").eqNullSafe(F.col("regime_match"))
    hidden = blank(F.col("hidden_label")) | ~F.contains(F.lower(F.coalesce("rationale", F.lit(""))), F.lower("hidden_label"))
    conditions = {
        "c5_metric_extraction": metric,
        "c5_calibration_extraction": calibration,
        "c5_hidden_label_isolation": hidden,
        "c5_interface_safety": ~trusted | (F.col("hidden_label") == "interface_success"),
        "c5_trust_gate_completeness": ~trusted | (F.size("issues") == 0),
        "c5_fail_closed_reason": trusted | ~blank(F.col("fail_closed_reason")),
    }
    return {name: (condition, name) for name, condition in conditions.items()}


def failure_variants(frame: DataFrame) -> DataFrame:
    """Each ideal row once for each way to fail that applies to it: variant, with the trajectory changed.

    The columns changed are steps, action, status, packet_status, calibration and cited.
    """
    no_args = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    steps_type = frame.schema["steps"].dataType
    none, uncited = F.array().cast(steps_type), F.array().cast("array<string>")
    wrong = F.array(F.struct(F.lit("wrong_tool").alias("name"), F.create_map(F.lit("query"), F.lit("shortcut")).alias("arguments"))).cast(steps_type)
    emptied = F.transform("steps", lambda s: F.struct(s["name"].alias("name"), no_args.alias("arguments"))).cast(steps_type)
    shorter = F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0)))

    def variant(name: str, applies: Column, **changed: Column) -> Column:
        columns = {c: F.col(c) for c in ("steps", "action", "status", "packet_status", "calibration", "cited")} | changed
        return F.when(held(applies), F.struct(F.lit(name).alias("variant"), *(v.alias(c) for c, v in columns.items())))

    always, gold = F.lit(True), F.col("gold_status")
    variants = [
        variant("self_answering_without_tools", always, steps=none, action=F.lit(SELF), cited=uncited, status=F.lit("unknown"), packet_status=F.lit("unknown")),
        variant("wrong_tool", always, steps=wrong),
        variant("missing_tool", F.size("required_tools") > 0, steps=shorter),
        variant("partial_query", always, steps=emptied),
        variant("missing_attribution", F.size("gold_sources") > 0, cited=uncited),
        variant("invalid_value_missed", gold == "invalid_value", action=F.lit(VERIFY), status=F.lit("supported"), packet_status=F.lit("supported")),
        variant("unsupported_trust", F.col("expected_action") != TRUST, action=F.lit(TRUST), status=gold, packet_status=gold, calibration=F.lit("uncalibrated")),
        variant("insufficient_as_negative", gold == "insufficient", action=F.lit(REJECT), status=F.lit("contradicted"), packet_status=F.lit("contradicted"), cited=uncited),
    ]
    made = frame.withColumn("_v", F.explode(F.array_compact(F.array(*variants))))
    keep = [c for c in frame.columns if c not in ("steps", "action", "status", "packet_status", "calibration", "cited")]
    return made.select(*keep, "_v.*")
