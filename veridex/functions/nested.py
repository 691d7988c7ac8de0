"""Tolerant reading of model outputs: JSON inside prose, aliases, calls and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedded_json(text: Column) -> Column:
    """From the first opening to the last closing brace, if that parses as JSON, else null."""
    braced = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(braced).isNotNull(), braced)


def canonical_name(value: Column, aliases: dict[str, str]) -> Column:
    """The name that an alias stands for, whatever its case and blanks; null if unknown."""
    names = F.create_map(*(F.lit(x) for pair in sorted(aliases.items()) for x in pair))
    return F.try_element_at(names, F.lower(F.trim(value)))


def called_tools(payload: Column, aliases: dict[str, list[str]]) -> Column:
    """Tool names of a JSON payload's calls, texts or objects with a name, aliases expanded, first ones kept."""
    calls = F.from_json(F.get_json_object(payload, "$.calls"), "array<string>")
    names = F.transform(calls, lambda c: F.trim(F.coalesce(F.get_json_object(c, "$.name"), c)))
    table = F.create_map(*(x for name, many in sorted(aliases.items()) for x in (F.lit(name), F.array(*map(F.lit, many)))))
    expanded = F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), F.array(n))))
    return F.array_distinct(F.coalesce(expanded, F.array().cast("array<string>")))


def citations(payload: Column, *fields: str) -> Column:
    """Cited ids of the first field that has any: one text or a list, trimmed, distinct, blanks left out."""

    def read(field: str) -> Column:
        raw = F.get_json_object(payload, f"$.{field}")
        listed = F.from_json(F.when(F.startswith(raw, F.lit("[")), raw), "array<string>")
        ids = F.transform(F.coalesce(listed, F.array(raw)), lambda x: F.trim(x))
        ids = F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))
        return F.when(F.size(ids) > 0, ids)

    return F.coalesce(*(read(f) for f in fields), F.array().cast("array<string>"))


def required_name(value: Column, aliases: dict[str, str], what: str) -> Column:
    """The name that an alias stands for, whatever its case and blanks; an unknown or missing one stops the query."""
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("none"))))
    return F.coalesce(canonical_name(value, aliases), unknown.cast("string"))


def with_payload(frame: DataFrame, raw: str, name: str = "p") -> DataFrame:
    """Rows whose text holds JSON, with it; steps apart, and a verdict that stays above them, so that no text is searched twice."""
    found = frame.withColumn("_braced", F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))
    held = F.try_parse_json("_braced").isNotNull() & (F.monotonically_increasing_id() >= 0)
    return found.withColumn("_held", held).filter("_held").withColumnRenamed("_braced", name).drop("_held")


def fields(payload: Column, *names: str) -> Column:
    """A struct of an object's fields as texts, objects and lists as their JSON, in one pass over it."""
    return F.from_json(payload, ", ".join(f"`{name}` string" for name in names))


def tool_steps(payload: Column, aliases: dict[str, list[str]]) -> Column:
    """Names of all calls in order, of tool_calls or else called: texts or objects with a name or tool, aliases expanded."""
    held = fields(payload, "tool_calls", "called")

    def name(call: Column) -> Column:
        own = F.when(F.startswith(call, F.lit("{")), fields(call, "name", "tool"))
        return F.trim(F.coalesce(own["name"], own["tool"], call))

    names = F.transform(F.from_json(F.coalesce(held["tool_calls"], held["called"]), "array<string>"), name)
    table = F.create_map(*(x for name, many in sorted(aliases.items()) for x in (F.lit(name), F.array(*map(F.lit, many)))))
    expanded = F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), F.array(n))))
    return F.coalesce(expanded, F.array().cast("array<string>"))


def keys_and_strings(payload: Column) -> Column:
    """struct(keys, strings): all field names and all text values of JSON of any shape and depth, in order.

    Null if it does not parse, as when one object repeats a name.

    In JSON a quote outside a literal begins one, so literals are found from left to right, and those before a colon are names.
    """
    plain = F.replace(F.replace(payload, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    literals = F.regexp_extract_all(plain, F.lit(r'"[^"]*"\s*:?'), F.lit(0))

    def read(found: Column) -> Column:
        bare = F.array_join(F.transform(found, lambda x: F.regexp_extract(x, '"[^"]*"', 0)), ",")
        return F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")

    names = F.filter(literals, lambda x: F.endswith(x, F.lit(":")))
    texts = F.filter(literals, lambda x: ~F.endswith(x, F.lit(":")))
    return F.when(F.try_parse_json(payload).isNotNull(), F.struct(read(names).alias("keys"), read(texts).alias("strings")))
