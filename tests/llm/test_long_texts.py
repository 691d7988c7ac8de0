"""Texts of millions of characters through the operators that read whole documents."""

import hashlib
import random

import pytest

from veridex.llm import decontaminate, line_dedup, lm_score, quality, simhash, suffix_dedup

LINES, WORDS = 200_000, 300_000
SHARED = "a line that three of the documents hold as a whole"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    lines = "\n".join(f"line {i} has words of its own" for i in range(LINES)) + f"\n{SHARED}"
    words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(WORDS)) + f"\n{SHARED}"
    return {1: lines, 2: words, 3: "x" * 2_000_000, 4: SHARED, 5: SHARED + "\n", 6: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2)


def test_line_dedup(docs, texts):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (LINES + 1, 1, texts[1].rsplit("\n", 1)[0]) and got[2][:2] == (2, 1) and got[3] == (1, 0, texts[3])
    assert got[4] == (1, 1, "") and got[5] == (2, 0, texts[5])


def test_quality_rules(docs, texts):
    got = {r.doc_id: r for r in quality.clean_lines(docs).collect()}
    assert got[1].n_words == 7 * LINES + 11 and got[1].n_dup_lines == 0 and got[2].n_words == WORDS + 11
    assert got[3].n_words == 1 and got[3].word_chars == 2_000_000 and not got[3].kept


def test_simhash(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[4].fp == got[5].fp and got[4].component == got[5].component == 4 and got[6].fp == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(9, "of its own line 777 has words of its own line 778 has")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got[1] == (7 * LINES + 11, 13) and got[2] == (WORDS + 11, 0) and got[3] == (1, 0)


def test_suffix_dedup(docs, texts):
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert got[3].n_removed == 2_000_000 and got[3].n_spans == 1 and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].n_removed == 0 and got[1].n_bytes == len(texts[1].encode()) and got[2].n_removed == 0


def test_lm_scores(docs):
    got = {r.doc_id: r for r in lm_score.score_texts(docs).collect()}
    assert got[1].n_tokens == 7 * LINES + 12 and got[3].n_tokens == 2 and all(r.score < 0 for r in got.values())
