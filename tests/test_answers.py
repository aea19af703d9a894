import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopscore.functions.answers import accuracy, answers_from_json, exact_match, normalize_answers, precision_recall_f1, string_match
from hopscore.functions.text import float_text
from hopscore.model import KEY
from hopscore.operators.scoring import add_scores, score_answer_rows, score_results, text_accuracy


@pytest.mark.parametrize(
    "given_answers, expected",
    [
        (["Paris", "London"], ["london", "paris"]),
        (["  Paris  ", "London\t"], ["london", "paris"]),
        ([None, "Paris", None], ["paris"]),
        (["PARIS", "paris", "Paris"], ["paris"]),
        (["a\x1c", "　a ", "\x85a\xa0"], ["a"]),
        (["", "  "], [""]),
        ([], []),
        (None, []),
    ],
)
def test_normalize(value, given_answers, expected):
    assert value(normalize_answers, "array<string>", given_answers) == expected


def test_answers_of_any_type(value):
    assert value(answers_from_json, "string", '[42, 3.14, "100", null, true, ["a", 1]]') == ["42", "3.14", "100", None, "true", '["a",1]']
    assert value(lambda c: normalize_answers(answers_from_json(c)), "string", '[42, 3.14, "100"]') == ["100", "3.14", "42"]


SETS = [
    (["paris", "london"], ["london", "paris"], 1, 1, 1, 1),
    (["paris", "london", "berlin"], ["paris", "london"], 0, 1, 2 / 3, 0.8),
    (["paris"], ["paris", "london"], 0, 0.5, 1, 2 / 3),
    (["paris"], ["london"], 0, 0, 0, 0),
    (["paris"], [], 0, 0, 0, 0),
    ([], ["paris"], 0, 0, 0, 0),
    ([], [], 1, 0, 0, 0),
]


@pytest.mark.parametrize("gold, predicted, em, p, r, f1", SETS)
def test_set_scores(spark, gold, predicted, em, p, r, f1):
    sets = spark.createDataFrame([(gold, predicted)], "g array<string>, p array<string>").select(
        normalize_answers(F.col("g")).alias("g"), normalize_answers(F.col("p")).alias("p")
    )
    scores = {"exact_match": exact_match(F.col("g"), F.col("p")), **precision_recall_f1(F.col("g"), F.col("p"))}
    row = sets.select(*[c.alias(n) for n, c in scores.items()]).first()
    assert row.asDict() == pytest.approx({"exact_match": em, "precision": p, "recall": r, "f1": f1})


def test_accuracy_and_string_match(spark):
    row = spark.range(1).select(
        accuracy(F.lit(3), F.lit(4)).alias("a"),
        accuracy(F.lit(0), F.lit(0)).alias("b"),
        string_match(F.lit(" Paris\n"), F.lit("PARIS")).alias("c"),
        string_match(F.lit("Paris"), F.lit("Lyon")).alias("d"),
    ).first()
    assert tuple(row) == (0.75, 0.0, True, False)


def test_text_accuracy_of_nothing(spark):
    nothing = spark.createDataFrame([], "p string, t string")
    assert text_accuracy(nothing, "p", "t").first().accuracy == 0.0


def test_results_without_success_have_a_struct_without_scores(make_results, make_questions):
    results = make_results(
        ("q1", None, (["A"], True, None), None),
        ("q2", None, (None, False, "boom"), None),
        ("q3", None, None, None),
        ("q4", None, (None, True, None), None),
        ("orphan", None, (["A"], True, None), None),
    )
    questions = make_questions(*[(f"q{i}", ["a"], None) for i in range(1, 5)])
    scores = {r.question_id: tuple(r.eval) for r in score_results(results, questions).collect()}
    none = (None,) * 4
    assert scores == {"q1": (1, 1, 1, 1), "q2": none, "q3": none, "q4": (0, 0, 0, 0)}


ANSWERS = st.lists(st.sampled_from(["a", "A", " b", "c", "d\t", None, ""]), max_size=6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(ANSWERS, ANSWERS, st.sampled_from([True, False, None])), min_size=1, max_size=12))
def test_row_form_scores_like_arrays_and_like_sets(spark, rows):
    config = ("llm", "cypher", "m")
    data = [(f"q{i}", *config, gold, (pred, ok, None)) for i, (gold, pred, ok) in enumerate(rows)]
    pairs = spark.createDataFrame(
        data, "question_id string, method string, lang string, model string, answer array<string>, "
        "exec struct<result: array<string>, success: boolean, error: string>"
    )
    arrays = {r.question_id: tuple(r.scores) for r in add_scores(pairs).collect()}
    executions = pairs.select(*KEY, F.col("exec.success").alias("success"))
    predicted = pairs.select(*KEY, F.explode("exec.result").alias("answer"))
    gold = pairs.select("question_id", F.explode("answer").alias("answer"))
    long = {r.question_id: tuple(r.eval) for r in score_answer_rows(executions, predicted, gold).collect()}
    for i, (gold_list, pred_list, ok) in enumerate(rows):
        g, p = ({a.strip().lower() for a in x if a is not None} for x in (gold_list, pred_list))
        hits = len(g & p)
        precision, recall = hits / len(p) if p else 0.0, hits / len(g) if g else 0.0
        f1 = 2 * precision * recall / (precision + recall) if hits else 0.0
        expected = (float(g == p), f1, precision, recall) if ok else (None,) * 4
        assert arrays[f"q{i}"] == long[f"q{i}"] == pytest.approx(expected)


def test_float_text(spark):
    numbers = [0.0, -0.0, 1.0, 0.5, 123456789.0, 1e7, 1.5e10, 12345678.125, 1e15, 1e16, 1.5e16, -2.25e20, 1e-4, 1.5e-4, 1e-5, -1.25e-7, 3e100, 2.5e-300, 1e22, 0.001, 9007199254740993.0]
    frame = spark.createDataFrame([(n,) for n in numbers], "x double")
    assert [r[0] for r in frame.select(float_text(F.col("x"))).collect()] == [repr(n) for n in numbers]
    special = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,)], "x double")
    assert [r[0] for r in special.select(float_text(F.col("x"))).collect()] == ["inf", "-inf", "nan"]
