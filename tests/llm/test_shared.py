import random
import re

import duckdb
import pytest

from veridex.llm import decontaminate, line_dedup, quality, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    frame = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLES[name])
    order = {c[0]: i for i, c in enumerate(found.description)}
    want = sorted(tuple(row[order[c]] for c in frame.columns) for row in found.fetchall())
    assert sorted(map(tuple, frame.collect())) == want


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, span):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(span, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(item))
    out = {}
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out[key] = (len(own), len(hit), sorted(found), bool(hit))
    return out


@pytest.mark.parametrize(("span", "k"), [(10, 5), (4, 2)])
def test_winnowing_finds_every_window(spark, span, k):
    rng = random.Random(span)
    vocabulary = ["a", "b", "É", "dd", "e1"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for i in range(8)] + [(100, None), (101, "solo"), (101, "Solo word")]
    docs = []
    for i in range(40):
        part = rng.choice(items)[1] or ""
        docs.append((i, f"{make(rng.randint(0, 20))} {part}; {make(rng.randint(0, 9))}"))
    docs += [(200, None), (201, ""), (202, "solo")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(frame, bench, span=span, k=k).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in got} == brute_hits(docs, items, span)


def test_decontaminate_empty_tables_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(None, "a b"), (5, "b")], "item_id bigint, text string")
    assert sorted(r.n_hit for r in decontaminate.decontaminate(docs, none).collect()) == [0, 0, 0]
    assert sorted((str(r.doc_id), r.n_hit) for r in decontaminate.decontaminate(docs, some).collect()) == [("1", 0), ("1", 1), ("None", 1)]
    assert decontaminate.decontaminate(docs.limit(0), some).count() == 0


def test_line_dedup_rules(spark):
    line = "This Line is long enough to count"
    rows = [(1, f"{line}\nown\n {line.upper()}\t"), (2, f"x\n{line}"), (3, f"{line}\nÉ{line}\n\n{line}"), (4, None), (5, ""), (6, "\n\n"), (7, "short line\nshort line"), (8, "short line"), (9, "short line")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_lines int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(frame).collect()}
    assert got[1] == (3, 2, "own") and got[2] == (2, 1, "x") and got[3] == (4, 0, rows[2][1])
    assert got[4] == (1, 0, "") == got[5] and got[6] == (3, 0, "\n\n") and got[7][1] == 0
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_line_dedup_nulls_repeats_and_non_ascii_case(spark):
    line = "É wie Éclair, und noch mehr Text"
    rows = [(None, line), (5, line), (5, line), (6, line.replace("É", "é")), (7, line.lower().replace("é", "É"))]
    got = [(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 1), (5, 1), (5, 1), (6, 0), (7, 0)]))


def test_quality_edge_cases(spark):
    clean = "\n".join(f"Word{i} foxes{i * 3} jump{i} over{i} lazy{i * 7} dogs, while{i} owls watch{i} quietly{i}." for i in range(10))
    menu = "\n".join(["Home | News | Sport | About | Contact | Imprint | Help"] * 12)
    rows = [(1, None), (2, ""), (3, "a b c a b c"), (4, clean), (5, clean + "\n" + menu), (6, "spam eggs ham " * 40), (7, "word " * 49), (None, clean)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, kept int")
    got = {r.doc_id: r for r in quality.clean_lines(frame).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False) == (got[2].n_words, got[2].base_failed, got[2].kept)
    assert got[3].n_repeat_words == 6 and got[3].n_words == 6
    assert got[4].kept and got[4].text == clean and got[None].kept
    assert got[5].text == clean and got[5].n_dup_lines == 11
    assert got[6].base_failed and got[7].base_failed
    assert quality.clean_lines(frame.limit(0)).count() == 0


def test_lines_are_counted_by_distinct_ids(spark):
    line = "This Line is long enough to count"
    rows = [(1, line), (1, f"own\n{line}"), (2, line)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0), (1, 0), (2, 0)]
    got = line_dedup.dedup_lines(spark.createDataFrame([*rows, (3, line), (3, line)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 0), (3, 0)]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_results_are_the_same_without_ansi_mode(spark, tmp_path, name):
    """Whole small tables with nulls, empty texts and repeats give the same rows whether or not errors are raised."""
    line = "A line of words that three documents hold, and more."
    texts = [None, "", line, f"x\n{line}", f"{line}\nMr. Ann Lee wrote to a.b@c.org or +49 30 1234567.", "one two three one two three", "cc by"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, line)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, line), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i), 1.0, float(i * i)]) for i in range(5)] + [(9, None)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(["Hi.", "", None, "Hi."])], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {}
    for mode in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", mode)
        try:
            found[mode] = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
        finally:
            spark.conf.set("spark.sql.ansi.enabled", "true")
    assert found["true"] and str(found["true"]) == str(found["false"])
    assert not any(value == -1 for row in found["false"] for value in row if isinstance(value, int))
