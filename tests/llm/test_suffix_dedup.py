import hashlib
import random

import numpy as np
import pytest

from veridex.llm import suffix_dedup


def brute(rows, length):
    seen = {}
    for number, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], []).append((number, i))
    masks = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for number, i in places:
                masks[number][i : i + length] = True
    out = []
    for (i, text), mask in zip(rows, masks):
        data = np.frombuffer((text or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((i, len(data), int(mask.sum()), spans, hashlib.sha256(data[~mask].tobytes()).hexdigest()))
    return out


def corpus(seed, count=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé\0") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = []
    for i in range(count):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(40, 400)], word()]
        rows.append((i, " ".join(parts)))
    rows += [(100, "ab" * 400), (101, "x" * 199), (102, "y" * 200), (103, "z" * 201), (104, None), (105, ""), (106, rows[0][1]), (107, "q" * 150), (108, "q" * 150)]
    return rows


def test_suffix_array_and_prefixes_equal_brute_force():
    rng = np.random.default_rng(1)
    for high, n in ((2, 200), (4, 500), (256, 50), (1, 60)):
        s = rng.integers(0, high, n).astype(np.int16)
        order, rank = suffix_dedup.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        got = suffix_dedup.common_prefixes(s, order, rank, np.array([0]), np.array([n]), 20)
        for i in range(n):
            j = order[rank[i] - 1] if rank[i] else None
            want = 0 if j is None else next((k for k in range(20) if max(i, j) + k >= n or s[i + k] != s[j + k]), 20)
            assert got[i] == want


@pytest.mark.parametrize("block", [8192, 3])
def test_removed_bytes_equal_brute_force(spark, block):
    rows = corpus(7 + block)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kept string").repartition(3)
    got = suffix_dedup.dedup_substrings(frame, block=block, shard_bytes=20_000).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 200))


@pytest.mark.parametrize("length", [64, 300])
def test_other_lengths_equal_brute_force(spark, length):
    rows = corpus(20 + length) + [(300, "lonely " * 60), (301, "".join(random.Random(2).choice("abcdefgh") for _ in range(700)) * 2)]
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), length=length).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, length))
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), length=40_000)


def test_the_registered_query_equals_brute_force(spark, tmp_path):
    from veridex.llm import queries_shared

    rows = corpus(31, 20)
    spark.createDataFrame([(i, t, "n_bytes") for i, t in rows], "doc_id bigint, text string, n_bytes string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_shared.op2_suffix_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 200))


def test_empty_table_and_repeats(spark):
    assert suffix_dedup.dedup_substrings(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    plain = "".join(random.Random(5).choice("abcdefgh") for _ in range(300))
    rows = [(None, "m" * 10), (1, "n1" * 150), (1, "n1" * 150), (2, plain), (2, plain)]
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 300, 300, 300, 300]


def test_heavy_keys_over_many_tasks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOOK", 2)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(320))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(60)]
    rows += [(100 + i, passage * 2) for i in range(40)] + [(200, passage[:199]), (201, passage[60:260])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = suffix_dedup.dedup_substrings(frame).drop("kept").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(brute(rows, 200))


def random_shard(seed, width=12):
    """Surroundings of a few cores, of two letters, cut short at either side."""
    rng = np.random.default_rng(seed)
    count, half = 80, width - 1
    before, after = rng.integers(0, half + 1, count), rng.integers(0, half + 1, count)
    before[::3], after[::3] = half, half
    data = [rng.choice([97, 98], a + b, p=[0.9, 0.1]).astype(np.uint8).tobytes() for a, b in zip(before, after)]
    place = rng.integers(0, 50, count) << 40
    return suffix_dedup.Shard(data, before, rng.integers(0, 5, count).astype(np.int32), place, rng.random(count) < 0.1, width)


def test_classes_equal_those_of_the_whole_array_and_its_prefixes():
    for seed in range(6):
        shard = random_shard(seed)
        order, rank = suffix_dedup.suffix_array(shard.symbols)
        shared = suffix_dedup.common_prefixes(shard.symbols, order, rank, shard.first, shard.size, shard.width)[order]
        left = np.repeat(shard.first + shard.size, shard.size + 1) - np.arange(len(shard.symbols))
        ok = left[order] >= shard.width
        want, number = order[ok], np.cumsum(shared < shard.width)[ok]
        at, group = shard.classes()
        assert sorted(at) == sorted(want)
        # the same classes in the same order
        assert np.diff(group).astype(bool).tolist() == np.diff(number).astype(bool).tolist()
        assert [set(x) for x in np.split(at, np.flatnonzero(np.diff(group)) + 1)] == [set(x) for x in np.split(want, np.flatnonzero(np.diff(number)) + 1)]


def test_suffixes_are_sorted_to_the_wanted_depth_alone(monkeypatch):
    # copies of one surrounding stay tied at any depth: sorting them whole takes more rounds, the more copies there are
    sizes = []
    ordered = suffix_dedup._ordered
    monkeypatch.setattr(suffix_dedup, "_ordered", lambda key, *rest: sizes.append(len(key)) or ordered(key, *rest))
    copies, width = 500, 77
    data = [bytes(range(152))] * copies
    shard = suffix_dedup.Shard(data, np.full(copies, 76), np.zeros(copies, np.int32), np.arange(copies) << 40, np.zeros(copies, bool), width)
    assert shard.repeated().sum() == copies * width
    assert len(sizes) <= 8 and sizes[-1] == copies * width
    assert sizes == sorted(sizes[:-2], reverse=True) + sizes[-2:]


def test_long_keys_are_sorted_beside_their_positions():
    rng = np.random.default_rng(2)
    key, where = rng.integers(0, 1 << 40, 300), rng.permutation(300)
    for wide in (9, 40):
        got, at = suffix_dedup._ordered(key, where, 40, wide)
        assert got.tolist() == sorted(key) and dict(zip(at.tolist(), got.tolist())) == dict(zip(where.tolist(), key.tolist()))


def test_cores_over_many_strings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CACHED", 1000)
    rows = corpus(41)
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_bytes=40_000).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 200))
