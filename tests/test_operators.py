import math
import time

import pytest
from pyspark.sql import functions as F

from veridex.operators import greedy, joins, metrics, rank, risk, select, trajectory, validate


def test_aligned_join_reports_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, 0.5), (3, 0.7)], "k int, w double")
    got = {r.k: r.join_status for r in joins.aligned(a, b, "k").collect()}
    assert got == {1: "missing", 2: "matched", 3: "unexpected"}


def test_strict_join_stops_on_missing_and_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.strict_one_to_one(a, a, "k").count() == 2
    for other in ([(1,)], [(1,), (2,), (2,)]):
        with pytest.raises(Exception, match="not one row"):
            joins.strict_one_to_one(a, spark.createDataFrame(other, "k int"), "k").collect()


def test_siblings_are_distinct_and_only_rows_are_shuffled(spark):
    rows = [(i % 70, "hot" if i % 3 else f"n{i % 5}", "b" if i % 11 else None) for i in range(200)] + [(None, "hot", "b"), (1, None, "b")]
    want = {(a, b) for a, n, x in rows for b, m, y in rows if None not in (a, b, n, x) and n == m and x == y and a != b}
    frame = spark.createDataFrame(rows, "k bigint, n string, b string")
    for block in (1024, 7):
        got = [tuple(r) for r in joins.siblings(frame, ["n", "b"], "k", block).collect()]
        assert set(got) == want and len(got) == len(want)

    def shuffled(n):
        before = _shuffled(spark)
        assert joins.siblings(spark.range(n).select("id", F.lit("a").alias("n")), ["n"], "id").count() == n * (n - 1)
        return _shuffled(spark) - before

    assert shuffled(2000) < 4000 * 100  # four million pairs of 16 bytes stay where they are made


def _shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    time.sleep(1)  # for the listener
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_ladder_takes_the_first_tier_and_abstains(spark):
    queries = spark.createDataFrame([(1, "asa"), (2, "ASA "), (3, "?")], "id int, name string")
    exact = spark.createDataFrame([("asa", "C1")], "match string, concept string")
    alias = spark.createDataFrame([("asa", "C2")], "match string, concept string")
    tiers = [("exact", exact, F.col("name")), ("alias", alias, F.trim(F.lower("name")))]
    got = {r.id: (r.concept, r.source) for r in joins.ladder(queries, "id", tiers, "concept").collect()}
    assert got == {1: ("C1", "exact"), 2: ("C2", "alias"), 3: (None, "abstain")}


def test_ties_gaps_and_single_rows(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 0.5), ("b", "q", 2.0)], "g string, id string, s double")
    top = {r.g: (r.id, r.tie_count) for r in rank.top_with_ties(rows, ["g"], F.col("s"), [F.col("id")]).collect()}
    assert top == {"a": ("x", 2), "b": ("q", 1)}
    assert {r.g: r.gap for r in rank.gaps(rows, ["g"], "s", "id").collect()} == {"a": 0.0, "b": None}


def test_top_k_prunes_before_the_shuffle(spark):
    plan = rank.top_per_group(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], [F.col("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_splits_are_disjoint_whole_and_of_stated_size(spark):
    rows = spark.range(100).withColumn("c", (F.col("id") % 4).cast("string"))
    got = select.held_out(rows, "c", "s", "id", 5).groupBy("c", "split").count().collect()
    assert {(r.c, r.split): r["count"] for r in got} == {(str(c), s): n for c in range(4) for s, n in (("heldout", 5), ("train", 20))}
    with pytest.raises(Exception, match="class too small"):
        select.held_out(rows, "c", "s", "id", 25).collect()
    folds = select.folds(rows, "c", "id", 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20] * 5


def test_md5_modulo_equals_whole_number(spark):
    import hashlib

    got = spark.range(50).select("id", select.modulo_of_md5(F.col("id"), 100).alias("m")).collect()
    assert all(r.m == int(hashlib.md5(str(r.id).encode()).hexdigest(), 16) % 100 for r in got)


def test_greedy_unique_equals_the_loop(spark):
    rows = [(i, f"a{i * 7 % 11}", f"b{i * 5 % 13}") for i in range(60)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    frame = spark.createDataFrame(rows, "i int, a string, b string")
    assert sorted(r.i for r in greedy.greedy_unique(frame, ["a", "b"], ["i"]).collect()) == want


def test_sweep_counts_ties_and_nothing_trusted(spark):
    rows = spark.createDataFrame([(0.2, 1), (0.5, 0), (0.5, 1), (0.9, 0)], "s double, f int")
    got = {r.threshold: (r.targets, r.trusted, r.failures) for r in risk.sweep(rows, "s", "f", [0.0, 0.5, 0.95]).collect()}
    assert got == {0.0: (4, 4, 2), 0.5: (4, 3, 1), 0.95: (4, 0, 0)}
    bounded = {r.threshold: r.bound for r in risk.hoeffding(risk.sweep(rows, "s", "f", [0.0, 0.95]), 0.1, 2).collect()}
    assert bounded[0.95] is None and bounded[0.0] == pytest.approx(min(1, 0.5 + math.sqrt(math.log(20) / 8)))
    assert [risk.least_zero_failure_n(a, 0.1, 50) for a in (0.3, 0.2, 0.1)] == [35, 78, 311]


def test_mcnemar_and_majority(spark):
    rows = spark.createDataFrame([(True, False)] * 5 + [(False, True)] + [(True, True)], "a boolean, b boolean")
    got = metrics.mcnemar(rows, F.col("a"), F.col("b")).first()
    assert (got.b, got.c, got.chi2) == (5, 1, pytest.approx(1.5))
    values = spark.createDataFrame([("g", "y"), ("g", "x"), ("g", "z"), ("g", "x"), ("g", "y")], "g string, v string")
    assert metrics.majority(values, ["g"], "v").first().v == "x"


CONTROL = {
    "steps": [("search", {"drug": "1"}), ("read", {"drug": "1"})], "required_tools": ["search", "read"], "required_fields": ["drug"], "action": "ground_with_attribution", "expected_action": "ground_with_attribution",
    "status": "supported", "packet_status": None, "gold_status": "supported", "cited": ["s"], "gold_sources": ["s"], "requires_attribution": True, "requires_tool": True, "web_zero": True,
    "allowed": ["ground_with_attribution", "answer_self", "trust_specialist_output"], "calibration": "calibrated", "baseline_dominates": False, "regime": "antibody_antigen", "metric_type": "m", "metric_scope": "s",
    "dataset_id": "d", "threshold_id": "t", "regime_match": True,
}
SCHEMA = """steps array<struct<name:string,arguments:map<string,string>>>, required_tools array<string>, required_fields array<string>, action string, expected_action string, status string, packet_status string, gold_status string,
cited array<string>, gold_sources array<string>, requires_attribution boolean, requires_tool boolean, web_zero boolean, allowed array<string>, calibration string, baseline_dominates boolean, regime string, metric_type string,
metric_scope string, dataset_id string, threshold_id string, regime_match boolean"""
TRUSTED = {"action": "trust_specialist_output", "expected_action": None}


@pytest.mark.parametrize(
    ("changes", "failed", "broken"),
    [
        ({}, [], []),
        ({"expected_action": None}, [], []),
        ({"status": None, "packet_status": "supported"}, [], []),
        ({"steps": [("read", {"drug": "1"}), ("search", {"drug": "1"})]}, ["required_tool_sequence"], ["missing_required_tool_sequence"]),
        ({"steps": [("search", {}), ("read", {"drug": "1"})]}, ["query_filter_completeness"], ["query_filter_missing_required_field"]),
        ({"required_fields": [], "steps": [("search", {}), ("read", {})]}, [], []),
        ({"status": "x"}, ["evidence_status"], ["evidence_status_mismatch"]),
        ({"cited": []}, ["attribution"], ["missing_required_attribution"]),
        ({"gold_sources": []}, ["attribution"], ["missing_required_attribution"]),
        ({"action": "answer_self", "expected_action": None}, ["policy_compliance"], ["web_zero_requires_tool_or_defer", "external_tool_required"]),
        (TRUSTED, [], []),
        (TRUSTED | {"allowed": []}, ["action_allowed"], ["action_not_allowed"]),
        (TRUSTED | {"calibration": None}, ["policy_compliance"], ["uncalibrated_specialist_requires_verify_baseline_or_defer"]),
        (TRUSTED | {"baseline_dominates": True}, ["policy_compliance"], ["baseline_dominates_do_not_trust_specialist"]),
        (TRUSTED | {"regime": "Antibody_Antigen", "metric_type": "", "regime_match": None}, ["policy_compliance"], ["c5_trust_missing_metric_or_calibration_schema", "c5_trust_requires_regime_matched_calibration"]),
    ],
)
def test_trajectory_passes_the_control_and_rejects_shortcuts(spark, changes, failed, broken):
    row = CONTROL | changes
    names = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(", ")]
    got = trajectory.evaluate_with_query(spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA)).first()
    assert [n[7:] for n in got.asDict() if n.startswith("reward_") and not got[n]] == failed
    assert got.violations == broken and got.passed == (not failed) and got.score == pytest.approx(1 - len(failed) / 7)


def test_issues_treat_null_as_broken(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int")
    got = validate.issues(rows, "k", [("range", F.col("v").between(0, 10))]).collect()
    assert sorted(r.k for r in got) == [2, 3]
