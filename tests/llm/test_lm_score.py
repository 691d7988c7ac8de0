import math
import random
import re
import zlib
from collections import Counter

import pytest

from veridex.llm import lm_score


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def brute(rows, strength=2.0):
    """Score of each row by nested definitions, without an automaton."""
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows}
    train = [split(t) for i, t in rows if not held[i]]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(t, t[1:]))
    three = Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)

    def p1(w):
        return (one[w] + 0.5) / (n + 0.5 * (v + 1))

    def p2(u, w):
        return (two[u, w] + strength * p1(w)) / (one[u] + strength)

    def p3(t, u, w):
        return (three[t, u, w] + strength * p2(u, w)) / (two[t, u] + strength)

    out = {}
    for i, t in rows:
        t = split(t)
        p = [p1(w) if at == 0 else p2(t[0], w) if at == 1 else p3(t[at - 2], t[at - 1], w) for at, w in enumerate(t)]
        out[i] = (held[i], len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("strength", [0.5, 2.0])
def test_scores_equal_brute_force(spark, strength):
    rng = random.Random(5)
    words = ["a", "B", "c", "É", "the", "x1", "of", "Of"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(2, 8)]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (None, "a b"), (7, rows[7][1]), (103, "a B " * 5000)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, score int").repartition(3, "doc_id")
    want = brute(rows, strength)
    got = lm_score.score_texts(frame, strength=strength).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_empty_table(spark):
    assert lm_score.score_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_score_beats_single_words_on_held_out_text(spark):
    rng = random.Random(6)
    phrases = ["the cat sat on the mat", "a dog ran to the house", "we saw it fall down"]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(20))) for i in range(100)]
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_rare_pairs_keep_their_arcs_in_a_larger_corpus(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(1000))) for i in range(400)]  # 1e-5 of the tokens is over 3
    train = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 != 1][:3]
    held = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows += [(i, "seldom seen words") for i in train] + [(held, "seldom seen words")]
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).filter(f"doc_id = {held}").first()
    assert got.held_out and got.score > got.base_score + 8
    assert got.score == pytest.approx(brute(rows)[held][5])


@pytest.mark.parametrize(("block", "bucket", "held"), [(100, 1 << 20, 40), (50, 90, 1 << 20)])
def test_scores_do_not_depend_on_blocks_buckets_or_flushes(spark, monkeypatch, block, bucket, held):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_score, "BUCKET_ENTRIES", bucket)
    monkeypatch.setattr(lm_score, "WORDS_HELD", held)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcd") + rng.choice("efgh") for _ in range(rng.randint(0, 20)))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute(rows)
    got = lm_score.score_texts(frame).collect()
    assert len(got) == 80
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id][5]) and r.base_score == pytest.approx(want[r.doc_id][4])


def test_probabilities_of_all_next_words_sum_to_one():
    """Over the known words and one unknown, for each history of a small corpus."""
    texts = ["a b a c", "b a b", "c a b a"]
    train = [split(t) for t in texts]
    one = Counter(w for t in train for w in t)
    two, three = Counter(p for t in train for p in zip(t, t[1:])), Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)
    for history in [("a", "b"), ("b", "a"), ("c", "b")]:
        total = 0.0
        for w in [*one, "unknown"]:
            p1 = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            p2 = (two[history[1], w] + 2.0 * p1) / (one[history[1]] + 2.0)
            total += (three[(*history, w)] + 2.0 * p2) / (two[history] + 2.0)
        assert total == pytest.approx(1.0)


def test_planes_hold_any_numbers():
    import numpy as np

    values = np.array([0, 1, 255, 256, 2**40 + 3, 2**63 + 7, 2**64 - 1], np.uint64)
    for random_bytes in (0, 4, 5):
        assert (lm_score.from_planes(lm_score.planes(values, random_bytes), len(values), random_bytes) == values).all()


def test_grouped_equals_unique():
    import numpy as np

    rng = np.random.default_rng(9)
    for bits in (64, 56):
        names = rng.integers(0, 2**bits, 300, np.uint64)
        close = np.repeat(names[:40], 3) ^ rng.integers(0, 4, 120).astype(np.uint64)  # differ in the last bits alone
        both = rng.permutation(np.concatenate([names, names[:50], close]))
        for some in (both, both[:1], both[:0]):
            want, inverse = np.unique(some, return_inverse=True)
            got, back = lm_score.grouped(some, bits)
            assert (got == want).all() and (back == inverse).all()
