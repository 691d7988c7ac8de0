"""The registered queries' own columns against brute force, and the shared folder."""

import math
import random
import zlib
from collections import Counter

import pytest
import xxhash

from veridex.llm import queries_scans, queries_shared, shared_store


def table(spark, tmp_path, rows):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "é", "zeta", "eta", "theta", "cc", "by", "all", "rights", "reserved"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(50)]
    return rows + [(60 + i, rows[i][1] + " extra") for i in range(10)] + [(80, None), (81, ""), (82, " \t"), (83, rows[3][1])]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashed = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_op5_equals_brute_force(spark, tmp_path):
    rows = corpus(1)
    prints = {i: fingerprint(t) for i, t in rows}
    component = {i: i for i in prints}
    for _ in rows:
        for i in prints:
            component[i] = min(component[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    got = queries_shared.op5_simhash_near_dedup(spark, table(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted((i, f"{p:016x}", component[i]) for i, p in prints.items())


def test_op3_base_columns_equal_brute_force(spark, tmp_path):
    rows = corpus(2)
    got = queries_scans.op3_license_scan(spark, table(spark, tmp_path, rows))
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for r in got.collect():
        words = (dict(rows)[r.doc_id] or "").lower().split()
        hits = [(i, label) for phrase, label in (("cc by", "cc-by"), ("all rights reserved", "reserved")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1


def test_op10_base_columns_equal_brute_force(spark, tmp_path):
    rows = corpus(3)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: (t or "").lower().split() + [None] for i, t in rows}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    got = queries_scans.op10_lm_score(spark, table(spark, tmp_path, rows))
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for r in got.collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_tables_are_written_where_the_session_says(spark):
    assert shared_store.folder(spark) == spark.conf.get("spark.checkpoint.dir")
    frame = spark.createDataFrame([(1, None), (None, "a")], "a int, b string")
    assert sorted(map(tuple, shared_store.written(frame).collect()), key=str) == sorted([(1, None), (None, "a")], key=str)
