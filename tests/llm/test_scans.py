import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veridex.llm import bpe, licenses, queries_scans, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "a", "the", "ing", "'s", "'", "!", "<|endoftext|>", "é", "ß", "中", "1", "23", "\t", " ", "\u0085", "\x1c", "tion", "😀", "er", "▁", "<s>"]
ROWS = [(1, None), (2, ""), (3, " "), (4, "plain text, twice"), (4, "plain text, twice"), (None, "x" * 5000), (6, "ab " * 3000), (7, "\n" * 3000 + "é" * 2000)]


def texts(seed, count=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS if i % 3 else PARTS[3:6] + ["er", "tion"]) for _ in range(rng.randint(1, 70))) for i in range(count)]


def test_tree_equals_the_library_at_any_leaf():
    library = Tokenizer.from_file(BPE)
    for leaf, window in ((8, 1), (16, 4)):
        tree = bpe.TreeEncoder(BPE, leaf, window)
        for text in texts(leaf):
            want = library.encode(text, add_special_tokens=False).ids
            assert tree.encode(text).tolist() == want
            assert tree.decode(np.array(want, np.int32)) == library.decode(want, skip_special_tokens=False)


def test_parts_of_long_texts_join_to_the_librarys_ids(monkeypatch):
    library, joined = Tokenizer.from_file(BPE), []
    inner = bpe.TreeEncoder.spliced
    monkeypatch.setattr(bpe.TreeEncoder, "spliced", lambda self, *sides: joined.append(1) or inner(self, *sides))
    rng = random.Random(5)
    units = ["a", "B", "é", " ", "  ", "\n", "\t", " the", "don't", "'s", "中", "文字", "123", "4", "!?", "...", "🙂", "Ġ", "\r\n", "word ", " word"]
    for span, threads in ((12, 1), (12, 3), (40, 2)):
        tree = bpe.TreeEncoder(BPE, leaf=8, window=1, span=span, threads=threads)
        special = next(iter(tree.special), "")
        for _ in range(500):
            text = "".join(rng.choice([*units, special]) for _ in range(rng.randint(0, 80)))
            assert tree.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(joined) > 500
    tree = bpe.TreeEncoder(BPE)
    for text in ("中文" * 50_000, "word " * 40_000, "x" * 70_000, " " * 70_000 + "end", "a b" * 30_000 + "y" * 40_000 + " c" * 30_000):
        assert tree.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark):
    library = Tokenizer.from_file(BPE)
    frame = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id bigint, text string, ids int")
    got = bpe.encode_decode(frame, BPE, leaf=64).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in ROWS]
    assert sorted(map(str, ((r.doc_id, r.ids, r.decoded) for r in got))) == sorted(map(str, want))
    assert bpe.encode_decode(frame.limit(0), BPE).count() == 0


def test_counts_equal_the_library_at_any_overlap():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for chunk, overlap in ((20, 3), (64, 1)):
        counter = token_counts.ResyncCounter(PIECES, chunk, overlap)
        assert counter.provable
        for text in texts(chunk):
            assert counter.count(text) == len(model.encode(text))


def test_count_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    frame = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id bigint, text string, n_tokens int")
    got = token_counts.count_tokens(frame, PIECES, limit=100, chunk=500).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in ROWS]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(frame.limit(0), PIECES).count() == 0


def scanned(spark, rows):
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, labels int")
    return {r.doc_id: r for r in licenses.summarise(licenses.scan_licenses(frame)).collect()}


def test_phrases_and_fuzzy_notices(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. All rights RESERVED, cc by cc by"),
        (2, "this work is lisensed under the apache licence, version 2"),
        (3, "permission is hereby granted, free of charge, to any persom obtaining a copy"),
        (4, "all rights are reserved by law in 2024; general public holidays"),
        (5, None),
        (6, ""),
        (7, "ccby all right reserved"),
    ]
    got = scanned(spark, rows)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (4, 2, 12, "cc-by,reserved")
    assert got[1].score == 1.0 and "apache" in got[2].labels and 0 < got[2].score < 1 and got[2].n_base == 0
    assert "mit" in got[3].labels and got[4].base_labels == "" and got[4].first_word is None
    assert (got[5].n_words, got[5].labels, got[5].score) == (0, "", 0.0) == (got[6].n_words, got[6].labels, got[6].score)
    assert got[7].labels == "reserved" and got[7].n_base == 0


def test_fuzzy_search_misses_nothing_within_its_edits():
    import regex

    scanner = licenses.NoticeScanner(licenses.PHRASES, licenses.NOTICES)
    rng = random.Random(9)
    for _ in range(150):
        notice, (label, edits) = rng.choice(list(licenses.NOTICES.items()))
        text = list(notice)
        for _ in range(rng.randint(0, edits + 2)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["x", "", "q"])
        text = " some words " + "".join(text) + " other words "
        want = bool(regex.search(rf"(?:{notice}){{e<={edits}}}", text))
        assert want == any(found[2] == label and found[4] == len(notice) for found in scanner.fuzzy(text))


@pytest.mark.parametrize("seed", [1, 2])
def test_base_places_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "É", "x9", "CC", "By"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ". ", "é "]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = scanned(spark, rows)
    for i, text in rows:
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        hits = [(at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(own)) if own[at : at + len(phrase.split())] == phrase.split()]
        places = [at for at, _ in hits]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(hits), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))


def test_a_notice_next_to_a_better_one_is_found_too():
    scanner = licenses.NoticeScanner(licenses.PHRASES, licenses.NOTICES)
    for text, places in (("licensed undr cc by licensed under cc by", [0, 4]), ("all rigts reserved all rights reserved", [0, 3]), ("x all rights reserved y all rightz reserved", [1, 5])):
        matches = scanner.scan(text)[1]
        assert sorted(m["first_word"] for m in matches if not m["exact"]) == places


def test_each_notice_is_found_as_it_stands_and_with_one_edit(spark):
    notices = list(licenses.NOTICES)
    rows = [(i, f"some words {n.upper()} more") for i, n in enumerate(notices)] + [(100 + i, f"some words {n[:5]}x{n[6:]} more") for i, n in enumerate(notices)]
    got = scanned(spark, rows)
    for i, notice in enumerate(notices):
        label = licenses.NOTICES[notice][0]
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert label in got[100 + i].labels.split(",")


def test_two_million_characters_of_a_phrase():
    scanner = licenses.NoticeScanner(licenses.PHRASES, licenses.NOTICES)
    began = time.perf_counter()
    n, matches = scanner.scan("cc by " * 333_334)
    assert n == 666_668 and len(matches) == 333_334 and matches[-1]["first_word"] == 666_666
    assert time.perf_counter() - began < 20


def test_two_million_characters_without_a_blank():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(11)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2_000_000))
    began = time.perf_counter()
    want = len(model.encode(text))
    middle = time.perf_counter()
    assert token_counts.ResyncCounter(PIECES).count(text) == want
    assert time.perf_counter() - middle < 4 * (middle - began) + 4


def test_registered_queries_equal_the_libraries(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(77, 60))] + [(100, None), (101, "word " * 5000), (102, "z" * 3000)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    library, model = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = queries_scans.op7_bpe_round_trip(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, got.collect())) == sorted(want)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows]
    got = queries_scans.op8_token_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_scans_of_repeats_null_ids_and_no_rows(spark):
    got = scanned(spark, [(None, "cc by"), (1, "cc by"), (1, "cc by")])
    assert set(got) == {None, 1}
    frame = spark.createDataFrame([(1, "cc by"), (1, "cc by")], "doc_id bigint, text string")
    assert licenses.scan_licenses(frame).count() == 2 and licenses.scan_licenses(frame.limit(0)).count() == 0
