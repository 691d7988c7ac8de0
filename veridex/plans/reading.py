"""Model outputs read tolerantly: JSON inside prose, aliases, calls, citations and the shapes of predictions.

The outputs are made from events: each stands for what a model answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import nested
from veridex.operators import components
from veridex.plans.register import registrar
from veridex.plans.spans import first, last, span_sql, spans
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()
#: Names that outputs use for actions, statuses and tools; the status that goes with an action.
ACTIONS = {
    "answer_self": "self_answer", "self_answer": "self_answer", "ground": "ground", "ground_with_attribution": "ground", "reject": "reject", "reject_or_flag_unsupported_claim": "reject",
    "flag": "flag", "defer": "defer", "defer_or_request_more_evidence": "defer", "verify": "verify", "verify_with_assay_or_database": "verify",
}
STATUSES = {
    "supported": "supported", "ground": "supported", "contradicted": "contradicted", "reject": "contradicted", "invalid_value": "invalid_value", "flag": "invalid_value",
    "insufficient": "insufficient", "insufficient_evidence": "insufficient", "defer": "insufficient", "verify": "insufficient", "unknown": "unknown",
}
TOOLS = {"search_failures": ["nullatlas_survey_prior_failures", "nullatlas_verify_trial_claims"], "check_other_indications": ["nullatlas_negative_evidence_completeness"], "check_value_validity": ["nullatlas_check_value_validity"]}
SAID = ["Ground", "ground_with_attribution", " REJECT", "defer ", "verify_with_assay_or_database", "flag"]
#: How a type of event stands as a call: a name, an object with one, or an object with a tool and the event's own JSON.
CALL_OF = {"view": '"search_failures"', "click": '{"name": "check_value_validity"}', "purchase": '{"tool": "check_other_indications", "args": %s}', "signup": '" own_tool "'}


def outputs(spark, d) -> DataFrame:
    """k, user_id, n, raw and body: what a model might say about a user's day, made of its events and of conversations' texts.

    The day's events are the calls and the sources; the text stands alone, fenced, between the user's first turn and a full
    stop, with a brace too many, or is that turn alone.
    """
    said = table(spark, d, "conversations").filter("turn = 0").groupBy(F.col("conv_id").alias("user_id")).agg(F.min("text").alias("said"))
    frame = spans(spark, d, "day").join(said, "user_id", "left").withColumns({"n": F.size("e"), "said": F.coalesce("said", F.lit("no answer"))})
    start, end = first(), last()
    status = F.when(start["value"] > 60, ', "evidence_status": "insufficient_evidence"').when(start["value"] > 30, ', "evidence_status": null').otherwise("")

    def call(x: Column) -> Column:
        props = F.concat(F.lit('{"k": '), x["k"].cast("string"), F.lit("}"))
        out = F.lit(None).cast("string")
        for kind, text in CALL_OF.items():
            before, _, after = text.partition("%s")
            out = F.when(x["event_type"] == kind, F.concat(F.lit(before), props, F.lit(after)) if after else F.lit(text)).otherwise(out)
        return out

    made = F.array_compact(F.transform("e", call))
    listed = F.when(F.size(made) > 0, F.concat(F.lit("["), F.array_join(made, ", "), F.lit("]"))).otherwise("null")
    sources = F.transform(F.filter("e", lambda x: x["value"] > 30), lambda x: F.concat(F.when(x["k"] < 50, '" NCT').otherwise('"NCT'), (x["event_id"] % 7).cast("string"), F.lit('"')))
    cited = F.when(F.size(sources) == 0, "null").when(F.size(sources) == 1, F.get(sources, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(sources, ", "), F.lit(', ""]')))
    words = F.get(F.array(*map(F.lit, SAID)), (end["k"] % 6).cast("int"))
    called, named = F.when(F.col("n") % 2 == 0, '"tool_calls"').otherwise('"called"'), F.when(end["value"] > 25, '"cited_source_ids"').otherwise('"nct"')
    body = F.concat(F.lit('{"action": "'), words, F.lit('"'), status, F.lit(", "), called, F.lit(": "), listed, F.lit(", "), named, F.lit(": "), cited, F.lit("}"))
    form, text = end["k"] % 7, F.col("body")
    raw = F.when(form == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(form == 1, F.concat("said", F.lit(" "), text, F.lit(" ."))).when(form == 2, F.concat(F.lit("{"), text)).when(form == 3, F.col("said")).otherwise(text)
    return frame.withColumn("body", body).select("k", "user_id", "n", raw.alias("raw"), "body")


_CALL_SQL = " ".join(f"WHEN '{kind}' THEN {(chr(39) + text.replace('%s', chr(39) + ' || props[i] || ' + chr(39)) + chr(39))}" for kind, text in CALL_OF.items())
_RAW = f"""e AS (SELECT k, user_id, types, vals, ks, ids, len(types) AS n, list_transform(ks, lambda x: '{{"k": ' || x || '}}') AS props FROM ({span_sql("day")})),
c AS (SELECT conv_id, min(text) AS said FROM conversations WHERE turn = 0 GROUP BY 1),
m AS (SELECT e.*, coalesce(said, 'no answer') AS said, list_filter(list_transform(types, lambda t, i: CASE t {_CALL_SQL} END), lambda x: x IS NOT NULL) AS made,
list_transform(list_filter(range(1, n + 1), lambda i: vals[i] > 30), lambda i: CASE WHEN ks[i] < 50 THEN '" NCT' ELSE '"NCT' END || ids[i] % 7 || '"') AS sources FROM e LEFT JOIN c ON conv_id = user_id),
b AS (SELECT *, '{{"action": "' || {SAID}[ks[-1] % 6 + 1] || '"' || CASE WHEN vals[1] > 60 THEN ', "evidence_status": "insufficient_evidence"' WHEN vals[1] > 30 THEN ', "evidence_status": null' ELSE '' END || ', ' || CASE WHEN n % 2 = 0 THEN '"tool_calls"' ELSE '"called"' END || ': '
|| CASE WHEN len(made) > 0 THEN '[' || array_to_string(made, ', ') || ']' ELSE 'null' END || ', ' || CASE WHEN vals[-1] > 25 THEN '"cited_source_ids"' ELSE '"nct"' END || ': '
|| CASE len(sources) WHEN 0 THEN 'null' WHEN 1 THEN sources[1] ELSE '[' || array_to_string(sources, ', ') || ', ""]' END || '}}' AS body FROM m),
w AS (SELECT *, CASE ks[-1] % 7 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN said || ' ' || body || ' .' WHEN 2 THEN '{{' || body WHEN 3 THEN said ELSE body END AS raw FROM b),
r AS (SELECT k, user_id, n, body, CASE WHEN json_valid(nullif(regexp_extract(raw, '(?s)[{{].*[}}]', 0), '')) THEN regexp_extract(raw, '(?s)[{{].*[}}]', 0) END AS payload FROM w)"""
_ACTION = f"(MAP {{{', '.join(f'{a!r}: {c!r}' for a, c in ACTIONS.items())}}})[lower(trim(json_extract_string(payload, '$.action')))]"


@query("h2_embedded_json", f"WITH {_RAW} SELECT k, payload IS NOT NULL AS parsed, payload FROM r")
def embedded(spark, d):
    found = outputs(spark, d).select("k", nested.embedded_json(F.col("raw")).alias("payload"))
    return found.select("k", F.col("payload").isNotNull().alias("parsed"), "payload")


@query(
    "h6_canonical_decisions",
    f"""WITH {_RAW}, a AS (SELECT k, {_ACTION} AS action, json_extract_string(payload, '$.evidence_status') AS said FROM r WHERE payload IS NOT NULL)
SELECT k, action, coalesce((MAP {{{', '.join(f'{a!r}: {c!r}' for a, c in STATUSES.items())}}})[lower(trim(said))], (MAP {{'self_answer': 'unknown', 'ground': 'supported', 'reject': 'contradicted', 'flag': 'invalid_value', 'defer': 'insufficient', 'verify': 'insufficient'}})[action]) AS status FROM a""",
)
def decisions(spark, d):
    read = nested.with_payload(outputs(spark, d), "raw")
    action = nested.required_name(F.get_json_object("p", "$.action"), ACTIONS, "action")
    read = read.select("k", action.alias("action"), F.get_json_object("p", "$.evidence_status").alias("said"))
    default = nested.required_name(F.col("action"), {"self_answer": "unknown", "ground": "supported", "reject": "contradicted", "flag": "invalid_value", "defer": "insufficient", "verify": "insufficient"}, "action")
    return read.select("k", "action", F.when(F.col("said").isNotNull(), nested.required_name(F.col("said"), STATUSES, "status")).otherwise(default).alias("status"))


_TOOL_MAP = "MAP {" + ", ".join(f"{name!r}: {many!r}" for name, many in TOOLS.items()) + "}"
_NAMES = "list_transform(json_extract(coalesce(json_extract(payload, '$.tool_calls'), json_extract(payload, '$.called')), '$[*]'), lambda x: trim(CASE json_type(x) WHEN 'OBJECT' THEN coalesce(json_extract_string(x, '$.name'), json_extract_string(x, '$.tool')) ELSE json_extract_string(x, '$') END))"
_EXPANDED = f"flatten(list_transform({_NAMES}, lambda n: coalesce(({_TOOL_MAP})[n], [n])))"


@query(
    "h3_h4_tool_calls",
    f"""WITH {_RAW}, x AS (SELECT k, coalesce({_EXPANDED}, []) AS steps FROM r WHERE payload IS NOT NULL) SELECT k, array_to_string(steps, ',') AS steps, array_to_string(list_filter(steps, lambda s, i: list_position(steps, s) = i), ',') AS tools FROM x""",
)
def calls(spark, d):
    read = nested.with_payload(outputs(spark, d), "raw")
    steps = nested.tool_steps(F.col("p"), TOOLS)
    return read.select("k", F.array_join(steps, ",").alias("steps"), F.array_join(F.array_distinct(steps), ",").alias("tools"))


@query(
    "h5_citations",
    f"""WITH {_RAW}, x AS (SELECT k, coalesce(json_extract(payload, '$.cited_source_ids'), json_extract(payload, '$.nct')) AS c FROM r WHERE payload IS NOT NULL),
y AS (SELECT k, list_filter(list_transform(CASE json_type(c) WHEN 'ARRAY' THEN json_extract_string(c, '$[*]') WHEN 'VARCHAR' THEN [json_extract_string(c, '$')] ELSE [] END, lambda s: trim(s)), lambda s: s <> '') AS l FROM x)
SELECT k, array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i), ',') AS cited FROM y""",
)
def cited(spark, d):
    read = nested.with_payload(outputs(spark, d), "raw")
    return read.select("k", F.array_join(nested.citations(F.col("p"), "cited_source_ids", "nct"), ",").alias("cited"))


@query(
    "h13_h15_prediction_shapes",
    f"""WITH {_RAW} SELECT k, ['trajectory', 'target_trajectory', 'model_output', 'raw_output', 'payload'][(n + user_id) % 5 + 1] AS shape, lower(trim(json_extract_string(body, '$.action'))) AS action FROM r""",
)
def shapes(spark, d):
    k = F.col("n") + F.col("user_id")
    names = ["trajectory", "target_trajectory", "model_output", "raw_output"]
    inner = F.concat(*(x for x in (F.lit('{"'), F.get(F.array(*map(F.lit, [*names, "x"])), (k % 5).cast("int")), F.lit('": '), F.col("body"), F.lit("}"))))
    row = F.concat(F.lit('{"prediction": '), F.when(k % 5 < 4, inner).otherwise(F.col("body")), F.lit("}"))
    held = outputs(spark, d).select("k", F.when(k % 2 == 0, row).otherwise(F.get_json_object(row, "$.prediction")).alias("row"))
    payload = F.coalesce(F.get_json_object("row", "$.prediction"), F.col("row"))
    parts = [(name, F.get_json_object(payload, f"$.{name}")) for name in names]
    shape = F.coalesce(*(F.when(part.isNotNull(), F.lit(name)) for name, part in parts), F.lit("payload"))
    found = held.select("k", shape.alias("shape"), F.coalesce(*(part for _, part in parts), payload).alias("p"))
    return found.select("k", "shape", F.lower(F.trim(F.get_json_object("p", "$.action"))).alias("action"))


#: An object around an output, deeper by the key: names and texts with quotes, backslashes, braces and colons.
_DEEP = """'{"id": ' || user_id || ', "said \\\\"x\\\\": {": [' || repeat('[{"level": ', (n % 4)::INTEGER) || body || repeat('}]', (n % 4)::INTEGER) || ', "a\\\\\\\\", "b: \\\\"c\\\\"", null, true]}'"""


@query(
    "h10_keys_and_strings_at_any_depth",
    f"""WITH {_RAW}, x AS (SELECT k, {_DEEP.replace(chr(92) * 2, chr(92))} AS j FROM r), t AS (SELECT x.k, t.key, t.type, t.atom FROM x, json_tree(x.j) t)
SELECT k, array_to_string(list_sort(list_distinct(list(key) FILTER (type IS NOT NULL AND key IS NOT NULL AND NOT regexp_full_match(key, '[0-9]+')))), '|') AS keys,
array_to_string(list_sort(list(json_extract_string(atom, '$')) FILTER (type = 'VARCHAR')), '|') AS strings FROM t GROUP BY k""",
)
def any_depth(spark, d):
    rows = outputs(spark, d).select("k", F.expr(_DEEP.replace("::INTEGER", "::INT")).alias("j"))
    found = rows.select("k", nested.keys_and_strings(F.col("j")).alias("w"))
    return found.select("k", F.array_join(F.array_sort(F.array_distinct("w.keys")), "|").alias("keys"), F.array_join(F.array_sort("w.strings"), "|").alias("strings"))


def same_set(a, b):
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


DECISIONS = {"ground": "supported", "reject": "contradicted", "flag": "invalid_value", "verify": "insufficient", "defer": "insufficient"}
_ENUMS = {"action": tuple(sorted(set(ACTIONS.values()))), "evidence_status": tuple(sorted(set(STATUSES.values())))}
COMPONENTS = {
    "enum_action": components.Component(("action", "evidence_status"), _ENUMS),
    "tool_query": components.Component(("tool_calls",), {}, calls=True, arguments=("k",)),
    "routing_after_loop": components.Component(("action", "evidence_status", "cited_source_ids"), _ENUMS),
}


def component_rows(spark, d) -> DataFrame:
    """k, component, target and prediction of users' days; each kind of slip is some size of a value of the day."""
    start, end = first(), last()
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    table_ = F.create_map(*(F.lit(x) for pair in DECISIONS.items() for x in pair))
    frame = spans(spark, d, "day").withColumn("n", F.size("e")).withColumn("component", F.get(F.array(*map(F.lit, COMPONENTS)), F.col("n") % 3))
    frame = frame.withColumn("action", F.get(F.array(*map(F.lit, DECISIONS)), (start["k"] % 5).cast("int"))).withColumn("status", F.try_element_at(table_, F.col("action")))
    said = F.when(end["value"] > 70, "fly").when(end["value"] > 50, "defer").otherwise(F.col("action"))
    held = F.when(start["value"] < 5, "supported").otherwise(F.col("status"))
    more = F.when(start["value"] > 120, '"x": 1, ').otherwise("")
    source = F.concat(F.lit('"NCT'), start["event_id"].cast("string"), F.lit('"'))
    cited = F.when(start["value"].between(5, 7.99), "").otherwise(source)

    def call(x: Column) -> Column:
        return text('{"arguments": {"k": ', x["k"], '}, "name": ', F.when(x["value"] > 250, "null").otherwise(text('"', x["event_type"], '"')), "}")

    wanted = F.transform("e", lambda x: text('{"name": "', x["event_type"], '", "arguments": {"k": ', x["k"], "}}"))
    calls = F.transform(F.filter("e", lambda x: x["value"] >= 2), call)
    decision, decided = text('"action": "', F.col("action"), '", "evidence_status": "', F.col("status"), '"'), text(more, '"evidence_status": "', held, '", "action": "', said, '"')
    target = F.when(F.col("component") == "enum_action", text("{", decision, "}")).when(F.col("component") == "tool_query", text('{"tool_calls": [', F.array_join(wanted, ", "), "]}")).otherwise(text("{", decision, ', "cited_source_ids": [', source, "]}"))
    made = F.when(F.col("component") == "enum_action", text("{", decided, "}")).when(F.col("component") == "tool_query", text("{", more, '"tool_calls": [', F.array_join(calls, ", "), "]}"))
    made = made.otherwise(text("{", decided, ', "cited_source_ids": [', cited, "]}"))
    return frame.select("k", "component", target.alias("target"), F.when(end["value"] < 3, "oops").when(F.col("n") % 2 == 0, text("```json\n", made, "\n```")).otherwise(made).alias("prediction"))


@query(
    "e5_component_scores",
    f"""WITH e AS ({span_sql("day")}), x AS (SELECT *, {list(COMPONENTS)}[len(types) % 3 + 1] AS component, {list(DECISIONS)}[ks[1] % 5 + 1] AS action FROM e),
c AS (SELECT *, component = 'tool_query' AS tools, NOT vals[-1] < 3 AS parsed, NOT vals[1] > 120 AS keys, tools OR NOT vals[-1] > 70 AS enums, NOT tools OR (list_max(vals) >= 2 AND NOT list_max(vals) > 250) AS shape,
keys AND CASE WHEN tools THEN list_min(vals) >= 2 AND list_max(vals) <= 250 ELSE (vals[-1] <= 50 OR (vals[-1] <= 70 AND action = 'defer')) AND (vals[1] >= 5 OR action = 'ground') AND (component = 'enum_action' OR NOT vals[1] BETWEEN 5 AND 7.99) END AS exact FROM x)
SELECT k, component, CASE WHEN parsed THEN (keys::INT + enums::INT + shape::INT + exact::INT) / 4 ELSE 0.0 END::DOUBLE AS score, parsed AND keys AND enums AND shape AND exact AS passed,
CASE WHEN parsed THEN array_to_string(list_filter([CASE WHEN NOT keys THEN 'target_key_mismatch' END, CASE WHEN NOT enums THEN 'enum_value_invalid' END, CASE WHEN NOT shape THEN 'tool_query_shape_invalid' END, CASE WHEN NOT exact THEN 'target_mismatch' END], lambda v: v IS NOT NULL), ',') ELSE 'prediction_parse_error' END AS violations FROM c""",
)
def component_scores(spark, d):
    found = components.scored(component_rows(spark, d), COMPONENTS)
    return found.select("k", "component", "score", "passed", F.array_join("violations", ",").alias("violations"))


@query(
    "e6_tool_query_transfer",
    f"""WITH e AS ({span_sql("day")}), c AS (SELECT user_id % 3 AS fold, NOT vals[-1] < 3 AS parsed, parsed AND NOT vals[1] > 100 AS keys, parsed AND len(types) > 1 AS shape, shape AND types[1] <> 'error' AS sequence,
shape AND types[-1] <> 'click' AS fields, fields AND types[-1] <> 'signup' AS matched FROM e)
SELECT fold, count(*) AS n, count(*) FILTER (WHERE parsed) AS parseable_json, count(*) FILTER (WHERE keys) AS target_keys, count(*) FILTER (WHERE shape) AS tool_query_shape, count(*) FILTER (WHERE sequence) AS tool_sequence,
count(*) FILTER (WHERE fields) AS query_fields, count(*) FILTER (WHERE matched) AS query_values, count(*) FILTER (WHERE keys AND sequence AND matched) AS exact FROM c GROUP BY 1""",
)
def transfer(spark, d):
    """Seven checks of predicted tool calls against the wanted ones, over users' days: a day asks for two calls about its
    first and its last k, and each kind of slip is some type or value of its events."""
    start, end = first(), last()
    drug, condition = start["k"].cast("string"), end["k"].cast("string")
    kind = end["event_type"]

    def call(name: str, drug: Column, more: Column) -> Column:
        return F.concat(F.lit(f'{{"name": "{name}", "arguments": {{"drug": '), drug, more, F.lit("}}"))

    named = F.concat(F.lit(', "condition": '), condition)
    survey, verify = call("survey", drug, named), call("verify", F.when(kind == "signup", "-1").otherwise(drug), F.when(kind == "click", "").otherwise(named))
    calls = F.when(F.size("e") == 1, survey).when(start["event_type"] == "error", F.concat_ws(", ", verify, survey)).otherwise(F.concat_ws(", ", survey, verify))
    raw = F.when(end["value"] < 3, "none").otherwise(F.concat(F.lit('so {"tool_calls": ['), calls, F.lit("]"), F.when(start["value"] > 100, ', "x": 1').otherwise(""), F.lit("}")))
    rows = spans(spark, d, "day").select((F.col("user_id") % 3).alias("fold"), start["k"].alias("drug"), end["k"].alias("condition"), nested.embedded_json(raw).alias("p"))
    rows = rows.withColumn("calls", F.from_json(F.get_json_object("p", "$.tool_calls"), "array<struct<name:string,arguments:map<string,bigint>>>"))
    wanted = F.create_map(F.lit("drug"), F.col("drug"), F.lit("condition"), F.col("condition"))
    parsed = F.col("p").isNotNull()
    keys = parsed & same_set(F.json_object_keys("p"), F.array(F.lit("tool_calls")))
    shape = (F.size("calls") == 2) & F.forall("calls", lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    sequence = shape & (F.transform("calls", lambda c: c["name"]) == F.array(F.lit("survey"), F.lit("verify")))
    fields = shape & F.forall("calls", lambda c: same_set(F.map_keys(c["arguments"]), F.map_keys(wanted)))
    values = fields & F.forall("calls", lambda c: F.forall(F.map_keys(c["arguments"]), lambda name: F.try_element_at(c["arguments"], name) == F.try_element_at(wanted, name)))
    checks = {"parseable_json": parsed, "target_keys": keys, "tool_query_shape": shape, "tool_sequence": sequence, "query_fields": fields, "query_values": values, "exact": keys & sequence & values}
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.coalesce(check, F.lit(False)), 1)).alias(name) for name, check in checks.items()))
