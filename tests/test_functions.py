import pytest
from pyspark.sql import functions as F

from veridex.functions import decide, nested
from veridex.functions import text as tx


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Magnesium sulfate", "magnesium sulfate"), ("Warfarin Sodium 5 mg", "warfarin"), ("sodium", "sodium"), ("X (oral) acetate", "x"), ("", ""), (None, None)],
)
def test_normal_substance(spark, text, want):
    assert one(spark, tx.normal_substance(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [(None, False), ("abc", True), ("NaN", True), ("-0.1", True), ("0", False), ("1", False), ("14.73", True)])
def test_invalid_probability(spark, value, want):
    assert one(spark, tx.invalid_probability(F.lit(value).cast("string"))) is want


@pytest.mark.parametrize(
    ("steps", "required", "want"),
    [([], [], True), ([], ["a"], False), (["a", "b"], ["a", "b"], True), (["a", "x", "b"], ["a", "b"], True), (["b", "a"], ["a", "b"], False), (["a"], ["a", "a"], False), (["a", "a"], ["a", "a"], True)],
)
def test_ordered_subsequence(spark, steps, required, want):
    def array(values):
        return F.array(*map(F.lit, values)).cast("array<string>")

    assert one(spark, tx.ordered_subsequence(array(steps), array(required))) is want


def test_policies_disagree_on_mixed_and_invalid(spark):
    yes, no, null = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, decide.policy_a(yes, yes, yes)) == "flag"
    assert one(spark, decide.policy_b(yes, yes, yes)) == "reject"
    assert one(spark, decide.policy_a(null, no, no)) == "defer"


def test_labels_skip_empty_texts(spark):
    assert one(spark, tx.label_of(F.lit(""), F.lit(None).cast("string"), F.lit("c"))) == "c"
    assert one(spark, tx.first_match(F.lit("no digits"), "[0-9]+")) is None


def test_an_unknown_alias_stops_the_query(spark):
    frame = spark.createDataFrame([(1, " Ground "), (2, "who knows")], "k int, a string")
    named = nested.required_name(F.col("a"), {"ground": "ground"}, "action").alias("x")
    assert frame.filter("k = 1").select(named).first().x == "ground"
    with pytest.raises(Exception, match="unknown action: who knows"):
        frame.select(named).collect()


def test_keys_and_strings_at_any_depth(spark):
    rows = [('{"a": {"b": ["x", {"c d" : "\\"y: \\\\"}]}, "é": 1, "": ""}',), ('oops {"a"',), (None,), ("[]",), ('"only"',), ('{"a": 1, "a": 2}',)]
    frame = spark.createDataFrame(rows, "j string")
    got = [r.w and (list(r.w["keys"]), list(r.w["strings"])) for r in frame.select(nested.keys_and_strings(F.col("j")).alias("w")).collect()]
    assert got == [(["a", "b", "c d", "é", ""], ["x", '"y: \\', ""]), None, None, ([], []), ([], ["only"]), None]


def test_lists_in_texts(spark):
    rows = [("a | b||c ",), (" NaN",), (None,), ("",), ("x",)]
    got = [r.l for r in spark.createDataFrame(rows, "t string").select(tx.listed(F.col("t")).alias("l")).collect()]
    assert got == [["a", "b", "c"], [], [], [], ["x"]]
    twice = spark.createDataFrame([("a|b| a",)], "t string")
    assert twice.select(tx.listed(F.col("t"), unique=False).alias("l")).first().l == ["a", "b", "a"]
    with pytest.raises(Exception, match="repeated part"):
        twice.select(tx.listed(F.col("t"))).collect()


def test_an_unknown_name_stops_the_query(spark):
    frame = spark.createDataFrame([("en",), ("xx",)], "lang string")
    with pytest.raises(Exception, match="unknown language: xx"):
        frame.select(nested.required_name(F.col("lang"), {"en": "english"}, "language")).collect()


@pytest.mark.parametrize(("a", "b", "want"), [("non hodgkin lymphoma", "hodgkin lymphoma", True), ("hodgkin", "hodgkin", False), ("non hodgkin", "non hodgkin", False), ("acute pain", "chronic pain", True), ("type 2 x", "type 1 x", True), ("hyper", "hyper", False)])
def test_opposites_in_both_directions(spark, a, b, want):
    row = spark.range(1).select(tx.opposed(F.lit(a), F.lit(b)).alias("one"), tx.opposed(F.lit(b), F.lit(a)).alias("two")).first()
    assert (row.one, row.two) == (want, want)
