import hashlib

import pytest
from pyspark.sql import functions as F

from veridex.sources import files
from veridex.streaming import sessions


def test_json_lines_skip_blanks_and_stop_on_malformed(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "tags": ["x"]}\n\n{"id": 2}\n')
    assert files.json_lines(spark, str(path), "id int, tags array<string>").count() == 2
    path.write_text('{"id": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(path), "id int").collect()
    loose = files.json_lines(spark, str(path), "id int", strict=False).cache()
    assert [r._corrupt_record for r in loose.filter("_corrupt_record IS NOT NULL").collect()] == ["{broken"]


def test_whole_documents_folds_and_ids(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"rows": [{"id": 1},\n {"id": 2}]}')
    assert files.json_rows(spark, str(tmp_path / "r.json"), "id: int").count() == 2
    for n in (0, 3):
        (tmp_path / f"fold_{n}.jsonl").write_text('{"id": %d}\n' % n)
    got = files.folds(spark, str(tmp_path / "fold_*.jsonl"), "id int").collect()
    assert sorted((r.id, r.fold) for r in got) == [(0, 0), (3, 3)]
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert sorted(r.id for r in files.ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]


def test_stanzas(spark, tmp_path):
    (tmp_path / "o.obo").write_text('format: 1\n\n[Term]\nid: X:1\nname: one\nsynonym: "uno" EXACT []\nsynonym: "big" BROAD []\n\n[Term]\nid: X:2\nname: two\nis_obsolete: true\n\n[Typedef]\nid: p\n')
    got = {r.id: (r.name, r.synonyms, r.obsolete) for r in files.stanzas(spark, str(tmp_path / "o.obo")).collect()}
    assert got == {"X:1": ("one", ["uno"], False), "X:2": ("two", [], True)}


def test_contract_holds_and_each_breach_stops(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id,target,score,secret\n1,a,0.5,x\n2,a,0.25,y\n")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    good = files.Contract({"id": "int", "target": "string", "score": "double"}, "target", 2, 1, digest, ["secret"])
    assert files.contracted_csv(spark, str(path), good).agg(F.sum("score")).first()[0] == 0.75
    columns = good.columns
    for bad in (
        files.Contract(columns, "target", 3, 1, digest, ["secret"]),
        files.Contract(columns, "target", 2, 2, digest, ["secret"]),
        files.Contract(columns, "target", 2, 1, "0" * 64, ["secret"]),
        files.Contract(columns, "target", 2, 1, digest, []),
        files.Contract(columns | {"gone": "int"}, "target", 2, 1, digest, ["secret"]),
    ):
        with pytest.raises(ValueError, match="contract|columns|digest"):
            files.contracted_csv(spark, str(path), bad)


def test_writers_refuse_to_overwrite(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b", "train"), (1, "a", "heldout")], "id int, name string, split string")
    files.write_json_lines(frame, str(tmp_path / "j"), ["id"])
    files.write_splits(frame, str(tmp_path / "s"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    assert text.splitlines() == ['{"id":1,"name":"a","split":"heldout"}', '{"id":2,"name":"b","split":"train"}']
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'train'").count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_splits(frame, str(tmp_path / "s"))


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = sessions.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    want = sessions.windowed_counts(events)
    assert spark.table("windows").select(want.columns).exceptAll(want).count() == 0
    assert sessions.sessions(events).agg(F.sum("n")).first()[0] == events.count()
