"""Sources and sinks with contracts: each breach is named."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from veridex.sources import lines, once, predictions, release

# --- lines by number


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_malformed_line_in_a_later_block_is_named(spark, tmp_path, small_blocks):
    for name, bad in (("a", None), ("b", 71)):
        rows = [json.dumps({"k": i, "v": "x" * (i % 40)}) for i in range(1, 101)]
        rows[4] = "   "
        if bad:
            rows[bad - 1] = '{"k": oops}'
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    numbered = lines.numbered_lines(spark, str(tmp_path)).collect()
    assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 10
    for name in "ab":
        want = list(enumerate((tmp_path / f"{name}.jsonl").read_text().splitlines(), 1))
        assert sorted((r.line, r.value) for r in numbered if r.path.endswith(f"{name}.jsonl")) == want
    with pytest.raises(ValueError, match=r"b\.jsonl:71$"):
        lines.checked_json_lines(spark, str(tmp_path), "k int, v string")
    assert lines.checked_json_lines(spark, str(tmp_path / "a.jsonl"), "k int, v string").count() == 99
    (only,) = lines.malformed_lines(spark, str(tmp_path), "k int, v string").collect()
    assert (only.line, only.value) == (71, '{"k": oops}')


def test_a_wrong_type_is_malformed_and_an_empty_file_is_not(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": "x"}\n')
    (tmp_path / "b.jsonl").write_text("")
    with pytest.raises(ValueError, match=r"a\.jsonl:2$"):
        lines.checked_json_lines(spark, str(tmp_path), "k int")
    assert lines.checked_json_lines(spark, str(tmp_path / "b.jsonl"), "k int").count() == 0


# --- a release and its manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def a_release(spark, tmp_path, **changes):
    root = tmp_path / "release"
    files = {"data/a.jsonl": '{"k":1}\n\n{"k":2}\n', "data/b.jsonl": '{"k":3}', "README.md": "hello"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    rows = {name: {"path": name, "kind": "table", "records": None, "sha256": digest(text), "required": None, "safe_to_publish": True} for name, text in files.items()}
    rows["data/a.jsonl"]["records"] = 2
    rows["data"] = {"path": "data", "kind": "folder", "records": 3, "sha256": digest("x"), "required": True, "safe_to_publish": True}
    for name, change in changes.items():
        rows[name.replace("__", "/").replace("_", ".")] |= change
    return str(root), list(rows.values())


def issues(spark, root, rows, **more):
    manifest = spark.createDataFrame([tuple(r[name] for name in release.FIELDS) for r in rows], ", ".join(f"{n} {k}" for n, k in release.FIELDS.items()))
    return {(r.path, r.issue) for r in release.release_issues(spark, root, manifest, **more).collect()}


def test_a_whole_release_has_no_issues(spark, tmp_path):
    root, rows = a_release(spark, tmp_path)
    assert issues(spark, root, rows) == set()


@pytest.mark.parametrize(
    ("field", "value", "issue"),
    [
        ("sha256", "0" * 64, "digest_differs"), ("sha256", "XYZ", "digest_invalid"), ("sha256", None, "digest_missing"), ("records", 3, "records_differ"), ("kind", " ", "kind_missing"),
        ("kind", None, "kind_missing"), ("safe_to_publish", None, "not_marked_safe"), ("safe_to_publish", False, "not_marked_safe"), ("kind", "raw model output", "prohibited_raw"),
    ],
)
def test_each_field_is_checked(spark, tmp_path, field, value, issue):
    root, rows = a_release(spark, tmp_path)
    rows[0][field] = value
    assert issues(spark, root, rows, prohibited={"raw": "(?i)raw model"}) == {("data/a.jsonl", issue)}


@pytest.mark.parametrize(
    ("path", "issue"),
    [("", "path_empty"), (None, "path_empty"), (" README.md", "path_with_outer_blanks"), ("data\\a", "path_with_backslash"), ("/etc/passwd", "path_absolute"), ("data/../../x", "path_leaves_folder"), ("no/such", "file_missing")],
)
def test_each_path_rule_is_named(spark, tmp_path, path, issue):
    root, rows = a_release(spark, tmp_path)
    rows.append({**rows[2], "path": path})
    assert issues(spark, root, rows) == {(path, issue)}


def test_repeats_surplus_and_optional_files(spark, tmp_path):
    root, rows = a_release(spark, tmp_path)
    assert issues(spark, root, [*rows, rows[2]]) == {("README.md", "path_repeated")}
    assert issues(spark, root, [r for r in rows if r["path"] != "README.md"]) == {("README.md", "file_surplus")}
    assert issues(spark, root, [*rows, {**rows[2], "path": "later.md", "required": False}]) == set()


# --- predictions


def a_folder(tmp_path, jobs=("j1", "j2")):
    root, contract = tmp_path / "out", []
    for job in jobs:
        ranked = []
        for seed, sample in ((1, 0), (1, 1), (2, 0)):
            output, score = f"seed-{seed}_sample-{sample}", 0.5 + 0.1 * sample
            ranked.append((seed, sample, score))
            contract.append((job, seed, sample))
            for name in predictions.SAMPLE_FILES:
                path = root / job / output / f"{job}_{output}{name}"
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(json.dumps({"ranking_score": score, "iptm": 0.1 * seed}, indent=1))
        for name in [*(job + n for n in predictions.JOB_FILES), *predictions.PLAIN_FILES]:
            (root / job / name).write_text(json.dumps({"ranking_score": 0.6}))
        (root / job / f"{job}_ranking_scores.csv").write_text("\n".join([predictions.HEADER, *(f"{s},{n},{x}" for s, n, x in ranked)]) + "\n")
    return root, contract


def frame(spark, contract):
    return spark.createDataFrame(contract, "job string, seed bigint, sample bigint")


def test_whole_predictions_are_selected(spark, tmp_path):
    root, contract = a_folder(tmp_path)
    got = predictions.checked_predictions(spark, str(root), frame(spark, contract)).collect()
    assert sorted((r.job, r.output, r.ranking_score) for r in got) == [("j1", "seed-1_sample-1", 0.6), ("j2", "seed-1_sample-1", 0.6)]


CSV = "j2/j2_ranking_scores.csv"
SUMMARY = "j2/seed-2_sample-0/j2_seed-2_sample-0_summary_confidences.json"


@pytest.mark.parametrize(
    ("file", "change", "issue"),
    [
        ("j2/TERMS_OF_USE.md", None, "file_missing"), ("j2/more.txt", "x", "file_surplus"), ("j2/seed-1_sample-0/more.txt", "x", "file_surplus"), ("j3/a.txt", "x", "file_surplus"),
        (CSV, lambda t: t.replace("seed,sample", "sample,seed"), "header_invalid"), (CSV, lambda t: t.replace("1,0,0.5", "1,0,0.5,9"), "columns_invalid"), (CSV, lambda t: t.replace("1,0,0.5", "1,zero,0.5"), "parse_failed"),
        (CSV, lambda t: t + "1,0,0.5\n", "sample_repeated"), (CSV, lambda t: t.replace("2,0,0.5", "2,0,1.6"), "score_invalid"), (CSV, lambda t: t.replace("2,0,0.5", "2,0,NaN"), "score_invalid"),
        (CSV, lambda t: t.replace("2,0,0.5\n", ""), "sample_missing"), (CSV, lambda t: t + "9,9,0.1\n", "sample_surplus"), (SUMMARY, '{"ranking_score": 0.4, "iptm": 0}', "sample_score_differs"),
        (SUMMARY, "{", "summary_unreadable"), ("j2/j2_summary_confidences.json", '{"ranking_score": 0.7}', "job_score_differs"),
    ],
)
def test_each_breach_stops_with_its_name(spark, tmp_path, file, change, issue):
    root, contract = a_folder(tmp_path)
    path = root / file
    path.parent.mkdir(exist_ok=True)
    path.unlink() if change is None else path.write_text(change(path.read_text()) if callable(change) else change)
    found = {(r.job, r.issue) for r in predictions.prediction_issues(spark, str(root), frame(spark, contract)).collect()}
    assert (file.split("/")[0], issue) in found and {job for job, _ in found} == {file.split("/")[0]}
    with pytest.raises(ValueError, match=file.split("/")[0]):
        predictions.checked_predictions(spark, str(root), frame(spark, contract))


# --- written once


def test_one_of_two_writers_wins(spark, tmp_path):
    path, results = str(tmp_path / "result"), []

    def write(n):
        try:
            once.write_once(spark.range(n), path, freeze="f1")
            results.append(n)
        except once.AlreadyClaimedError:
            results.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    (rows,) = {n for n in results if n}
    assert results.count(None) == 1 and spark.read.parquet(path).count() == rows
    assert once.read_claim(spark, path) == {"status": "complete", "rows": rows, "freeze": "f1"}
    with pytest.raises(once.AlreadyClaimedError):
        once.write_once(spark.range(1), path)
    assert spark.read.parquet(path).count() == rows


def test_a_broken_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "result")
    broken = spark.range(10).select(F.when(F.col("id") > 8, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        once.write_once(broken, path)
    assert list(tmp_path.iterdir()) == []
    once.write_once(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
