"""Canonical JSON against the standard library's, and by depth."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veridex.functions import json_text


def made(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind < 5:
        return rng.choice([None, True, False, 0, -7, 10**30, 1.5, 1e300, -2.5e-9, "", 'q"\\/\n\u0001', "é😀", "host"])
    if kind == 5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "é", "host", '"', ""]) + str(i % 3): made(rng, depth - 1) for i in range(rng.randrange(5))}


def shuffled(rng, value):
    if isinstance(value, dict):
        return {k: shuffled(rng, value[k]) for k in rng.sample(list(value), len(value))}
    return [shuffled(rng, x) for x in value] if isinstance(value, list) else value


def test_equals_the_standard_library():
    rng = random.Random(1)
    for _ in range(2000):
        value = made(rng, 5)
        want = json.dumps(value, sort_keys=True, separators=(",", ":"))
        text = json.dumps(shuffled(rng, value), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert json_text.canonical(f" {text}\n") == want and json_text.canonical(want) == want


def without(value, names):
    if isinstance(value, dict):
        return {k: without(v, names) for k, v in value.items() if k not in names}
    return [without(x, names) for x in value] if isinstance(value, list) else value


def test_names_go_at_any_depth():
    rng = random.Random(2)
    for _ in range(500):
        value = made(rng, 6)
        got = json_text.canonical(json.dumps(value), frozenset({"host0", "a1"}))
        assert got == json.dumps(without(value, {"host0", "a1"}), sort_keys=True, separators=(",", ":"))


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", "{,}", '{"a" 1}', '{"a":1,}', "[1 2]", "nul", "01", "1.", "-", "NaN", "1e999", '"\n"', "[}", "{]", "1 2", "{1:2}", '{"a":}', "[,1]", '"x'])
def test_what_is_not_json_is_null(text):
    assert json_text.canonical(text) is None


def test_repeated_names_and_depth():
    assert json_text.canonical('{"a":1,"b":2,"a":[3]}') == '{"a":[3],"b":2}'
    deep = "[" * 50_000 + "1.0" + "]" * 50_000
    assert json_text.canonical(deep) == deep
    nested = '{"b":0,"a":' * 10 + "1" + "}" * 10
    assert json_text.canonical(nested) == '{"a":' * 10 + "1" + ',"b":0}' * 10


def test_columns_and_digests_in_any_order(spark):
    rows = [(1, '{"b": 1, "a": "é"}'), (2, '{"a":"\\u00e9","b":1}'), (3, None), (4, "no")]
    got = {r.i: (r.c, r.d) for r in spark.createDataFrame(rows, "i int, t string").select("i", json_text.canonical_json(F.col("t")).alias("c"), json_text.digest(F.col("t"), ["b"]).alias("d")).collect()}
    assert got[1] == got[2] == ('{"a":"\\u00e9","b":1}', hashlib.sha256(b'{"a":"\\u00e9"}').hexdigest()) and got[3] == got[4] == (None, None)
    files = [(f"f{i}", hashlib.sha256(bytes([i])).hexdigest()) for i in range(50)]
    for order in (files, files[::-1]):
        frame = spark.createDataFrame(order, "n string, d string").repartition(3)
        want = hashlib.sha256(json.dumps(dict(files), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert frame.agg(json_text.map_digest(F.col("n"), F.col("d")).alias("x")).first().x == want


ODD = ["-0", "-0.0", "[1E5,1e-7,123456789012345678901234567890]", "9" * 3999, "9" * 4000, "-" + "9" * 3999, '"\\ud800"', '"\\ud83d\\ude00"', "\ufeff1", "\u00a01", "1\u00a0", "\u0661", '{"a":1,"a":1e999}', '{"host":1e999}', '{"host":NaN}', '{"host":{"host":1},"a":[{"host":2}]}', "[Infinity]", "-Infinity", "true ", "tru", "[" * 3000 + "]" * 3000, '{"a":' * 3000 + "1" + "}" * 3000, "[" * 3000, '"\x7f\u2028"', '"\t"']


@pytest.mark.parametrize("names", [frozenset(), frozenset({"host"})])
def test_both_ways_agree(names):
    rng = random.Random(3)
    broken = []
    for _ in range(2000):
        text = json.dumps(made(rng, 4))
        at = rng.randrange(len(text))
        broken += [text, text[:at] + rng.choice(['"', "}", "]", ",", ":", " ", "\\", "0", ""]) + text[at + 1 :]]
    for text in ODD + broken:
        assert json_text.canonical(text, names) == json_text.scanned(text, names)


def test_common_texts_take_little_more_than_the_standard_library():
    texts = [json.dumps({"b": [{"k": i}, {"z": 1.5, "host": [], "a": {"k": i}}], "a": "é"}) for i in range(20_000)]

    def seconds(run):
        began = time.process_time()
        for text in texts:
            run(text)
        return time.process_time() - began

    library = seconds(lambda text: json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")))
    assert seconds(lambda text: json_text.canonical(text, frozenset({"host"}))) < 2.5 * library
