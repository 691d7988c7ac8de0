import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veridex.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(rows, most=4):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    out = {}
    for start in sorted(prints):
        if start in out:
            continue
        queue = [start]
        while queue:
            x = queue.pop()
            if x in out:
                continue
            out[x] = start
            queue += [y for y in prints if y not in out and (prints[x] ^ prints[y]).bit_count() <= most]
    return prints, out


def test_keys_of_all_words_within_two_bits_meet():
    table, count = simhash.key_errors()
    assert set(count.tolist()) == {1, 6} and (count == 6).sum() == 1771
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    flips = [0] + [1 << i for i in range(23)] + [(1 << i) | (1 << j) for i in range(23) for j in range(i)]
    one, ok_one = simhash.golay_keys(words)
    for flip in flips:
        two, ok_two = simhash.golay_keys(words ^ flip)
        assert ((one[:, :, None] == two[:, None, :]) & ok_one[:, :, None] & ok_two[:, None, :]).any(axis=(1, 2)).all()


def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "One  two\nthree", "É é x y z w"] + [" ".join(rng.choice("a b c dd Ée".split()) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert simhash.fingerprint_texts(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("block", [16_384, 40])
def test_links_connect_what_is_within_four_bits(spark, block):
    rng = random.Random(3)
    prints = {0}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            value = base
            for _ in range(rng.randint(0, 6)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp bigint").repartition(5)
    edges = simhash.near_links(frame, 4, block).collect()
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for edge in edges:
        a, b = (int(np.int64(x).view(np.uint64)) for x in (edge.u, edge.v))
        label[max(root(a), root(b))] = min(root(a), root(b))
    seen = {}
    for start in prints:
        queue = [start]
        while queue:
            x = queue.pop()
            if x not in seen:
                seen[x] = start
                queue += [y for y in prints if y not in seen and (x ^ y).bit_count() <= 4]
    assert {p: root(p) for p in prints} == seen


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  "), (3, "short one"), (4, "short one")]
    for base in range(8):
        text = [rng.choice(words) for _ in range(200)]
        for copy in range(6):
            changed = list(text)
            for _ in range(copy):
                changed[rng.randrange(200)] = "other"
            rows.append((10 + base * 10 + copy, " ".join(changed)))
    rng.shuffle(rows)
    prints, classes = brute_components(rows)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = simhash.near_duplicates(frame).collect()
    assert {r.doc_id: int(np.int64(r.fp).view(np.uint64)) for r in got} == prints
    assert {r.doc_id: r.component for r in got} == classes
    assert len(set(classes.values())) < len(rows)


def test_empty_table_null_ids_and_repeats(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "q")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.component) for r in got) == [("7", 7), ("7", 7), ("9", 9), ("None", 7)]
