"""Scores of predicted parts of a decision: its enumerated fields, its tool calls, or its routing after the loop.

A prediction is a text; a target is JSON.  Four checks earn a quarter each: the names of the fields, the enumerated values,
the shape of tool calls, and equality with the target whatever the order of names.  What isn't a JSON object earns nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import json_text


@dataclass(frozen=True)
class Component:
    """The names of a component's fields, which of them are enumerated, with their values, and what arguments calls need."""

    fields: tuple[str, ...]
    enums: dict[str, tuple[str, ...]]
    calls: bool = False
    arguments: tuple[str, ...] = ()


def unfenced(text: Column) -> Column:
    """A text without the lines that open and close a fence, if it begins with one."""
    kept = F.filter(F.split(F.trim(text), "\n"), lambda line: ~F.startswith(F.trim(line), F.lit("```")))
    return F.trim(F.when(F.startswith(F.trim(text), F.lit("```")), F.array_join(kept, "\n")).otherwise(text))


def calls_in_shape(payload: Column, arguments: tuple[str, ...]) -> Column:
    """Whether tool_calls is a list of at least one object with a name and an object of arguments, these among them."""
    needed = F.array(*map(F.lit, arguments)).cast("array<string>")
    listed = F.from_json(payload, "tool_calls array<string>")["tool_calls"]

    def whole(call: Column) -> Column:
        held = F.from_json(call, "name string, arguments string")
        given = F.when(F.startswith(F.ltrim(held["arguments"]), F.lit("{")), F.json_object_keys(held["arguments"]))
        return F.coalesce((held["name"] != "") & (F.size(F.array_except(needed, given)) == 0), F.lit(False))

    return F.coalesce((F.size(listed) > 0) & F.forall(listed, whole), F.lit(False))


def scored(frame: DataFrame, components: dict[str, Component], component: str = "component", target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Adds score, passed and violations (array, in the order of the checks)."""
    frame = frame.withColumn("_p", json_text.canonical_json(unfenced(F.col(prediction)))).withColumn("_t", json_text.canonical_json(F.col(target)))
    parsed = F.coalesce(F.startswith("_p", F.lit("{")), F.lit(False))
    names = F.array_sort(F.json_object_keys("_p"))
    keys, enums, shape = (F.lit(False) for _ in range(3))
    for name, kind in components.items():
        mine = F.col(component) == name
        values = [F.coalesce(F.get_json_object("_p", f"$.{f}").isin(*allowed), F.lit(False)) for f, allowed in kind.enums.items()]
        valid = F.lit(True)
        for value in values:
            valid = valid & value
        keys = F.when(mine, names == F.array(*map(F.lit, sorted(kind.fields)))).otherwise(keys)
        enums = F.when(mine, valid).otherwise(enums)
        shape = F.when(mine, calls_in_shape(F.col("_p"), kind.arguments) if kind.calls else F.lit(True)).otherwise(shape)
    checks = {"target_key_mismatch": keys, "enum_value_invalid": enums, "tool_query_shape_invalid": shape, "target_mismatch": F.col("_p").eqNullSafe(F.col("_t"))}
    frame = frame.withColumn("_parsed", parsed).withColumns({f"_{name}": F.coalesce(check, F.lit(False)) for name, check in checks.items()})
    earned = sum((F.col(f"_{name}").cast("int") for name in checks), F.lit(0)) / F.lit(4)
    broken = F.array_compact(F.array(*(F.when(~F.col(f"_{name}"), F.lit(name)) for name in checks)))
    frame = frame.withColumns(
        {
            "score": F.when(F.col("_parsed"), earned).otherwise(0.0),
            "violations": F.when(F.col("_parsed"), broken).otherwise(F.array(F.lit("prediction_parse_error"))),
        }
    )
    return frame.withColumn("passed", F.size("violations") == 0).drop("_p", "_t", "_parsed", *(f"_{name}" for name in checks))
