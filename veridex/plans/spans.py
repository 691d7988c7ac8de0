"""A user's events of a day or a week as arrays in the order of time: the nested data that other plans read.

Each event is (ts, event_id, event_type, value, k), k from its JSON.  SPAN_SQL gives the same as DuckDB lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.sources.tables import table


def spans(spark, d, unit: str) -> DataFrame:
    """(k, user_id, start, e): a row for each user and day or week; k names it, e has its events."""
    number = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    event = F.struct("ts", "event_id", "event_type", "value", number)
    rows = table(spark, d, "events").select("user_id", F.date_trunc(unit, "ts").cast("date").alias("start"), event.alias("event"))
    found = rows.groupBy("user_id", "start").agg(F.sort_array(F.collect_list("event")).alias("e"))
    return found.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("start").cast("string")).alias("k"), "user_id", "start", "e")


def span_sql(unit: str) -> str:
    return f"""SELECT user_id || '/' || start AS k, user_id, start, list(event_type ORDER BY ts, event_id) AS types, list(value ORDER BY ts, event_id) AS vals,
list(n ORDER BY ts, event_id) AS ks, list(event_id ORDER BY ts, event_id) AS ids FROM (SELECT *, CAST(date_trunc('{unit}', ts) AS DATE) AS start, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events) GROUP BY user_id, start"""


def some(test) -> Column:
    """Whether a test of one event holds for any."""
    return F.exists("e", test)


def number_of(test) -> Column:
    return F.size(F.filter("e", test))


def first() -> Column:
    return F.get("e", F.lit(0))


def last() -> Column:
    return F.element_at("e", -1)
