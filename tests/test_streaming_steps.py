"""Ordered steps in a stream against the batch expression."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veridex.functions import text as tx
from veridex.streaming import steps

REQUIRED = ["view", "click", "purchase"]
SCHEMA = "user_id bigint, ts timestamp, event_type string"


@pytest.fixture
def rocks(spark):
    for name, value in steps.PROVIDER.items():
        spark.conf.set(name, value)
    yield
    for name in steps.PROVIDER:
        spark.conf.unset(name)


def run(spark, tmp_path, batches):
    """Batches as files of a stream, in their order, and at last one event far ahead that lets the watermark pass."""
    end = datetime.datetime(2030, 1, 1)
    for i, rows in enumerate([*batches, [(-1, end, "view")], [(-1, end, "view")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        path = next((tmp_path / "in" / f"{i:03d}").glob("part-*.parquet"))
        (tmp_path / "files").mkdir(exist_ok=True)
        path.rename(tmp_path / "files" / f"{i:03d}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "files"))
    query = steps.ordered_steps(stream, REQUIRED).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return [(r.user_id, r.reached_at) for r in spark.table("steps").collect()]


def test_equals_the_batch_expression(spark, tmp_path, rocks):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(12), start + datetime.timedelta(minutes=i, microseconds=rng.randrange(1000)), rng.choice([*REQUIRED, "error"])) for i in range(150)]
    out_of_order = [row for i in range(0, 150, 5) for row in rng.sample(rows[i : i + 5], 5)]  # within the watermark's ten minutes
    got = run(spark, tmp_path, [out_of_order[i : i + 30] for i in range(0, 150, 30)])
    names = spark.createDataFrame(rows, SCHEMA).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_type"))), lambda x: x["event_type"]).alias("s"))
    want = {r.user_id for r in names.filter(tx.ordered_subsequence(F.col("s"), F.array(*map(F.lit, REQUIRED)))).collect()}
    assert {u for u, _ in got} == want and len(got) == len(want) > 3
    for user, at in got:
        own, position = sorted(r for r in rows if r[0] == user), 0
        for _, ts, kind in own:
            if position < 3 and kind == REQUIRED[position]:
                position += 1
                last = ts
        assert at == last


def test_late_events_are_left_out(spark, tmp_path, rocks):
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    batches = [[(1, at(0), "view"), (1, at(2), "purchase"), (2, at(0), "view")], [(3, at(60), "view")], [(3, at(61), "click")], [(1, at(1), "click"), (2, at(62), "click"), (2, at(63), "purchase")]]
    assert [u for u, _ in run(spark, tmp_path, batches)] == [2]
