"""Segment-tree encoding against the tiktoken library."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from veridex.llm import byte_bpe, queries_turns

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def odd_texts(n):
    rng = random.Random(9)
    other = [1368, 0x85, 0xA0, 0x2028, 0x1C, 8335, 42958, 43884, 73184, 74863, 97, 32, 10]  # classes that versions differ in, among others
    kinds = [
        lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x32000)])),
        lambda: rng.choice("ab \n\t's"),
        lambda: rng.choice("etaoinshrdlu"),
        lambda: chr(rng.choice(other)),
        lambda: rng.choice(["the", "  ", "\n\n", "é", "ß", "на", "123", "!!", "—", "<|endoftext|>"]),
    ]
    return ["".join(kind() for _ in range(rng.randrange(70))) for kind in kinds for _ in range(n // len(kinds))]


@pytest.mark.parametrize(("wide", "entries"), [(64, 400_000), (4, 400_000), (64, 50)])
def test_ids_equal_the_librarys(library, wide, entries):
    model = byte_bpe.SegmentTreeEncoder(PATH, public_tokenizers.PATTERN, wide, entries)
    texts = odd_texts(2000) + ["", "a" * 5000, "=" * 3001, " " * 777, "\n" * 100 + "x"]
    for at in range(0, len(texts), 300):
        own = texts[at : at + 300]
        ids, counts = model.encode(own)
        data, sizes = model.decode(ids, counts)
        begin = 0
        for text, count in zip(own, counts.tolist(), strict=True):
            assert ids[begin : begin + count].tolist() == library.encode_ordinary(text), text
            begin += count
        assert data.tobytes() == "".join(own).encode() and sizes.tolist() == [len(t.encode()) for t in own]


def test_a_long_unsplit_text_takes_n_log_n(library):
    model = byte_bpe.SegmentTreeEncoder(PATH, public_tokenizers.PATTERN)
    rng, seconds = random.Random(1), []
    for n in (50_000, 400_000):
        text = "".join(rng.choice("etaoin") for _ in range(n))
        began = time.perf_counter()
        ids, _ = model.encode([text])
        seconds.append(time.perf_counter() - began)
        assert ids.tolist() == library.encode_ordinary(text)
    assert seconds[1] < 24 * seconds[0] + 1


def test_op13_equals_the_library(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(100))] + [(500, None), (501, ""), (None, "no id"), (5, "again"), (5, "again"), (502, "word " * 40_000)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest(library.decode_bytes(ids))))
    got = queries_turns.op13_byte_bpe_round_trip(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert byte_bpe.encode_decode(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
