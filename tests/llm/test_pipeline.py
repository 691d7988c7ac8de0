import hashlib
import re
from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from veridex.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_documents_columns_and_the_last_equals_the_library(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now <= before and docs.select("doc_id").distinct().count() == now
        before = now
    left = {r.doc_id: r.text for r in docs.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    want = {}
    for key, text in left.items():
        ids = library.encode(text, add_special_tokens=False).ids
        want[key] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(left)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string")


def test_one_row_of_each_class_of_near_duplicates_stays(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey", "north south east west up down")
    rows = [(1, "x", a), (1, "x", a), (2, "x", a), (1, "y", b), (3, "x", b), (None, "x", c), (None, "x", c), (None, None, c), (4, "x", d), (None, "x", d), (1, "x", b)]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates_once(spark, rows_of(spark, rows), SF).collect()]
    assert sorted(r[2] for r in got) == sorted([a, b, c, d])
    left = {r[2]: r[0] for r in got}
    assert left == {a: 1, b: 1, c: None, d: 4} and set(got) <= set(rows)


def test_each_row_is_decontaminated_by_its_own_text(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("*").collect() if len((r.text or "").split()) >= 10)
    clean = "nothing of a benchmark stands here at all"
    rows = [(1, "x", clean), (1, "x", item), (None, "x", clean), (None, "x", clean), (None, None, clean), (None, "x", item), (2, "x", "")]
    got = [tuple(r) for r in corpus_pipeline.decontaminated(spark, rows_of(spark, rows), SF).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if r[2] != item), key=str)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def good_line(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    size, marks = len(solid(bare)), len(re.findall(quality.MENU_MARKS, bare))
    menu = marks >= 2 and marks * 4 >= size
    stock = size <= 15 and re.search(quality.STOCK.replace("(?i)", ""), bare, re.I | re.A)
    signs = len(re.findall(quality.SYMBOLS, bare)) * 10 > len(bare)
    return not (menu or stock or signs or (size < 4 and not re.search(quality.ENDS, bare)))


def brute_pipeline(rows, benchmark):
    """(doc_id, text) that are left of (doc_id, text), each stage by its definition."""
    left = []
    for i, text in rows:
        text = text or ""
        words, lines = solid(text), [x for x in text.split("\n") if solid(x)]
        triples = Counter(zip(words, words[1:], words[2:]))
        covered = {j + k for j, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
        good = [x for x in lines if good_line(x)]
        total = sum(map(len, words))
        lost = total - sum(len(w) for x in good for w in solid(x))
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and 100 * lost <= 50 * total:
            left.append((i, "\n".join(good)))

    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in left:
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    shared = {k: max(ids) for k, ids in holders.items() if len(k) >= 20 and len(ids) >= 3}
    left = [(i, "\n".join(x for x in text.split("\n") if shared.get(key(x), i) == i)) for i, text in left]
    left = [(i, text) for i, text in left if solid(text)]

    prints = {}
    for i, text in left:
        words = [w.encode() for w in solid(lowered(text))]
        hashed = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 4]), 42) for j in range(max(1, len(words) - 3))]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
    component = {i: i for i in prints}
    near = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4] for i in prints}
    while (after := {i: min(component[j] for j in near[i]) for i in prints}) != component:
        component = after
    left = [(i, text) for i, text in left if component[i] == i]

    plain = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
    windows = {tuple(w[j : j + 10]) for w in map(plain, benchmark) for j in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    return [(i, text) for i, text in left if not any(tuple(plain(text)[j : j + n]) in windows for n in sizes for j in range(len(plain(text)) - n + 1))]


def test_run_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = brute_pipeline(rows, benchmark)
    assert 20 < len(left) < len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in left:
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_take_nulls_repeats_empty_tables_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"word{n} stands here." for n in range(40))
    schema = "doc_id bigint, text string, n_chars bigint, kept boolean, key string, id string, row string, rows bigint, fp bigint"
    rest = (1, None, "k", "i", "r", 2, None)
    rows = [(1, long, *rest), (1, long, *rest), (None, long + " more", *rest), (None, None, *rest), (2, "", *rest), (3, None, *rest), (4, long * 200, *rest)]
    for name, stage in corpus_pipeline.STAGES:
        for some in (rows, []):
            out = stage(spark, spark.createDataFrame(some, schema), SF)
            found = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == [c.split()[0] for c in schema.split(", ")], name
            assert len(found) <= len(some)
            if name == "benchmark decontamination" or name == corpus_pipeline.STAGES[-1][0]:
                assert len(found) == len(some)  # nothing is contaminated; a row each
            if name == "quality rules" and some:
                assert Counter(r.doc_id for r in found) == {1: 2, None: 1}  # 4 repeats itself, the others have no text
            if name == "SimHash near-dedup" and some:
                assert {r.doc_id for r in found} >= {1} and sum(r.doc_id == 1 for r in found) == 1
