"""Component scores, case by case."""

import pytest

from veridex.operators import components
from veridex.plans.reading import COMPONENTS

ENUM = '{"action": "ground", "evidence_status": "supported"}'
CALLS = '{"tool_calls": [{"name": "a", "arguments": {"k": 1, "z": [2]}}]}'
ROUTE = '{"action": "defer", "evidence_status": "insufficient", "cited_source_ids": ["N1"]}'


@pytest.mark.parametrize(
    ("component", "target", "prediction", "broken"),
    [
        ("enum_action", ENUM, ' {"evidence_status":"supported", "action":"ground"}', []), ("enum_action", ENUM, f"```json\n{ENUM}\n```", []), ("enum_action", ENUM, ENUM.replace("ground", "fly"), ["enum_value_invalid", "target_mismatch"]),
        ("enum_action", ENUM, ENUM.replace("}", ', "x": null}'), ["target_key_mismatch", "target_mismatch"]), ("enum_action", ENUM, "[1]", ["prediction_parse_error"]), ("enum_action", ENUM, "so: {}", ["prediction_parse_error"]), ("enum_action", ENUM, None, ["prediction_parse_error"]),
        ("enum_action", ENUM, "{}", ["target_key_mismatch", "enum_value_invalid", "target_mismatch"]), ("tool_query", CALLS, '{"tool_calls": [{"arguments": {"z": [2], "k": 1}, "name": "a"}]}', []), ("tool_query", CALLS, CALLS.replace("1", "2", 1), ["target_mismatch"]),
        ("tool_query", CALLS, '{"tool_calls": []}', ["tool_query_shape_invalid", "target_mismatch"]), ("tool_query", CALLS, '{"tool_calls": [{"name": "a", "arguments": {"z": 1}}]}', ["tool_query_shape_invalid", "target_mismatch"]),
        ("tool_query", CALLS, '{"tool_calls": [{"name": "", "arguments": {"k": 1}}]}', ["tool_query_shape_invalid", "target_mismatch"]), ("tool_query", CALLS, '{"tool_calls": {"name": "a"}}', ["tool_query_shape_invalid", "target_mismatch"]), ("tool_query", CALLS, '{"tool_calls": ["a"]}', ["tool_query_shape_invalid", "target_mismatch"]),
        ("routing_after_loop", ROUTE, ROUTE, []), ("routing_after_loop", ROUTE, ROUTE.replace('"N1"', ""), ["target_mismatch"]), ("other", ROUTE, ROUTE, ["target_key_mismatch", "enum_value_invalid", "tool_query_shape_invalid"]),
    ],
)
def test_each_check(spark, component, target, prediction, broken):
    frame = spark.createDataFrame([(component, target, prediction)], "component string, target string, prediction string")
    got = components.scored(frame, COMPONENTS).first()
    score = 0.0 if broken == ["prediction_parse_error"] else 1 - len(broken) / 4
    assert (got.violations, got.score, got.passed) == (broken, score, not broken)
