"""Patterns of many questions against a brute-force matcher, one question at a time."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hopscore.operators import pattern_sets
from hopscore.operators.pattern_sets import APART, NO_PATTERN, UNBOUND, shape_of, triple_answers
from hopscore.operators.patterns import triple_ask

QUERY = "question_id string, patterns array<struct<s string, p string, o string>>, select array<string>, distinct boolean"


def match(graph, patterns, select, distinct):
    found = [{}]
    for pattern in patterns:
        found = [
            grown
            for binding in found
            for triple in graph
            if (grown := _grow(binding, pattern, triple)) is not None
        ]
    if not select:
        return [["true" if found else "false"]]
    rows = [[b[v] for v in select] for b in found]
    return [list(r) for r in {tuple(r) for r in rows}] if distinct else rows


def _grow(binding, pattern, triple):
    out = dict(binding)
    for term, value in zip(pattern, triple):
        if not term.startswith("?"):
            if term != value:
                return None
        elif out.setdefault(term, value) != value:
            return None
    return out


@pytest.fixture(scope="module")
def graph():
    draw = random.Random(5)
    nodes, relations = [f"<n{i}>" for i in range(8)], ["<r>", "<s>", "<t>"]
    triples = {(draw.choice(nodes), draw.choice(relations), draw.choice(nodes)) for _ in range(60)}
    return sorted(triples | {("<n1>", "<r>", "<n1>"), ("<r>", "<s>", "<n2>")})


def _queries(count):
    draw = random.Random(11)
    names, nodes = ["?a", "?b", "?c"], [f"<n{i}>" for i in range(9)]
    out = []
    for i in range(count):
        patterns = [
            (draw.choice(names + nodes), draw.choice(["<r>", "<s>", "<t>", "?a", "?q"]), draw.choice(names + nodes))
            for _ in range(draw.randint(1, 3))
        ]
        known = sorted({t for p in patterns for t in p if t.startswith("?")})
        select = draw.sample(known, draw.randint(0, len(known)))
        out.append((f"q{i}", patterns, select, draw.random() < 0.5))
    return out


def test_random_questions_equal_brute_force(spark, graph):
    queries = _queries(70)
    triples = spark.createDataFrame(graph, "s string, p string, o string")
    answers = triple_answers(spark.createDataFrame(queries, QUERY), triples)
    got = sorted((r.question_id, list(r.cells)) for r in answers.rows.collect())
    refused = {r.question_id for r in answers.errors.collect()}
    want = sorted((q, cells) for q, *rest in queries if q not in refused for cells in match(graph, *rest))
    assert got == want
    assert 0 < len(refused) < 40
    for q, patterns, select, distinct in queries:
        if q in refused:
            with pytest.raises(ValueError, match=APART):
                shape_of(patterns, select, distinct)


def test_shapes_do_not_grow_with_questions(spark, graph):
    patterns = [("?x", "<r>", "?y"), ("<n1>", "<s>", "?x")]
    same = {shape_of([(f"?{a}", f"<{r}>", "?w"), (f"<{n}>", "<k>", f"?{a}")], ["?w"], True)[0] for a in "bcd" for r in "xyz" for n in "uv"}
    assert len(same) == 1
    assert shape_of(patterns, ["?y"], True)[0] == shape_of(patterns[::-1], ["?y"], True)[0] == same.pop()
    asked = [(f"q{i}", [(f"<n{i % 8}>", "<r>", "?y")], ["?y"], True) for i in range(200)]
    tracker, triples = spark.sparkContext.statusTracker(), spark.createDataFrame(graph, "s string, p string, o string")

    def jobs(rows):
        group = f"patterns-{len(rows)}"
        spark.sparkContext.setJobGroup(group, group)
        frame = triple_answers(spark.createDataFrame(rows, QUERY), triples).rows
        n = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return n, frame

    few, _ = jobs(asked[:5])
    many, frame = jobs(asked)
    assert few == many
    assert "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString()


def test_refused_questions_leave_the_others(spark, graph):
    rows = [
        ("apart", [("?a", "<r>", "?b"), ("?c", "<r>", "?d")], ["?a"], False),
        ("unbound", [("?a", "<r>", "?b")], ["?z"], False),
        ("none", [], [], False),
        ("null", None, None, None),
        ("part", [("?a", None, "?b")], ["?a"], False),
        ("good", [("<n1>", "<r>", "?b")], ["?b"], None),
        ("good", [("<n1>", "<r>", "?b")], ["?b"], None),
    ]
    answers = triple_answers(spark.createDataFrame(rows, QUERY), spark.createDataFrame(graph, "s string, p string, o string"))
    errors = {r.question_id: r.engine_error for r in answers.errors.collect()}
    assert (errors["apart"], errors["unbound"], errors["none"], errors["null"]) == (APART, UNBOUND, NO_PATTERN, NO_PATTERN)
    assert "part" in errors
    want = [t[2] for t in graph if t[:2] == ("<n1>", "<r>")]
    assert sorted(r.cells[0] for r in answers.rows.collect()) == sorted(want * 2)


def test_no_questions(spark, graph):
    answers = triple_answers(spark.createDataFrame([], QUERY), spark.createDataFrame(graph, "s string, p string, o string"))
    assert answers.rows.collect() == [] and answers.errors.collect() == []


def test_more_shapes_than_one_plan_holds(spark, graph, monkeypatch):
    monkeypatch.setattr(pattern_sets, "AT_ONCE", 2)
    queries = [q for q in _queries(25) if len(q[1]) < 3]
    triples = spark.createDataFrame(graph, "s string, p string, o string")
    answers = triple_answers(spark.createDataFrame(queries, QUERY), triples)
    refused = {r.question_id for r in answers.errors.collect()}
    want = sorted((q, cells) for q, *rest in queries if q not in refused for cells in match(graph, *rest))
    assert sorted((r.question_id, list(r.cells)) for r in answers.rows.collect()) == want


def test_terms_become_answer_texts(spark):
    rows = spark.createDataFrame(
        [("a", ["<http://x/y>"]), ("b", ['"7"^^<http://www.w3.org/2001/XMLSchema#integer>', '"t\\"x"@en']), ("c", ["true"]), ("d", ["_:z"])],
        "question_id string, cells array<string>",
    )
    got = {r.question_id: r.answer for r in pattern_sets.answers_of_terms(rows).collect()}
    assert got == {"a": "http://x/y", "b": '["7","t\\"x"]', "c": "true", "d": "_:z"}


def test_ask_equals_brute_force(spark, graph):
    triples = spark.createDataFrame(graph, "s string, p string, o string")
    checked = 0
    for _, patterns, _, _ in itertools.islice(_queries(60), 40):
        try:
            got = triple_ask(triples, patterns).first().result
        except ValueError:
            continue
        assert got == (match(graph, patterns, [], False) == [["true"]]), patterns
        checked += 1
    assert checked > 15


def test_ask_joins_the_last_pattern_by_existence(spark, graph):
    triples = spark.createDataFrame(graph, "s string, p string, o string")
    plan = triple_ask(triples, [("?a", "<r>", "?b"), ("?b", "<s>", "?c")])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Distinct" not in plan
    assert F is not None


def test_questions_that_share_many_answers_are_dealt(spark, monkeypatch):
    """60 questions share the 60 answers of one tuple: no task makes more than a part of the 3,600 rows, and texts are made once per answer."""
    monkeypatch.setattr(pattern_sets, "DEAL", 5)
    triples = spark.createDataFrame([(f"<n{i}>", "<r>", "<x>") for i in range(60)] + [("<n1>", "<s>", "<y>")], "s string, p string, o string")
    rows = [(f"q{i}", [("?a", "<r>", "<x>")], ["?a"], False) for i in range(60)] + [("one", [("?a", "<s>", "<y>")], ["?a"], False)]
    kept = []
    stored = pattern_sets.stored
    monkeypatch.setattr(pattern_sets, "stored", lambda df, name: kept.append((name, df.columns, df.count())) or stored(df, name))
    found = triple_answers(spark.createDataFrame(rows, QUERY), triples, {"answer": pattern_sets.text_of_terms(F.col("cells"))}).rows
    want = [(f"q{i}", f"n{j}") for i in range(60) for j in range(60)] + [("one", "n1")]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 400
    assert ("pattern-texts", ["id", "answer"], 61) in kept
