import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopscore.model import KEY, RESULTS, STAGES
from hopscore.operators import selection, staging
from hopscore.plans.stages import evaluate_stage, execute_stage, generate_stage
from hopscore.sources import questions as questions_
from hopscore.sources import results as results_

RECORDS = [
    {"id": "lake-7", "question": "How deep is the Brienzersee in metres?", "answer": [260], "hop": 1},
    {"id": "pass-2", "question": "Which valley lies north of the Susten?", "answer": ["Gadmertal"], "hop": 1, "split": "test"},
    {"id": "peak-4", "question": "Which canton does the Titlis border on?", "answer": ["Obwalden", None], "hop": 2},
    {"id": "hut-9", "question": "bare", "answer": []},
    {"id": "lake-7", "question": "How long is the Brienzersee in kilometres?", "answer": [14], "hop": 3},
]
CONFIG = ("llm", "cypher", "m1")


@pytest.fixture(params=["array", "lines"])
def loaded(request, spark, tmp_path):
    path = tmp_path / "data.json"
    if request.param == "array":
        path.write_text(json.dumps(RECORDS, indent=1))
        return questions_.read_question_arrays(spark, str(path))
    path.write_text("\n".join(map(json.dumps, RECORDS)) + "\n\n")
    return questions_.read_question_lines(spark, str(path))


def test_load_questions(loaded):
    assert loaded.count() == 5
    rows = {r.id: r for r in questions_.latest_questions(loaded, "_order").collect()}
    assert sorted(rows) == ["hut-9", "lake-7", "pass-2", "peak-4"]
    assert (rows["lake-7"].question, rows["lake-7"].answer, rows["lake-7"].extra) == ("How long is the Brienzersee in kilometres?", ["14"], {"hop": "3"})
    assert rows["peak-4"].answer == ["Obwalden", None] and rows["peak-4"].answer_json == '["Obwalden",null]'
    assert rows["hut-9"].extra is None and rows["hut-9"].answer == []


def test_truncated_array_is_an_error(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps(RECORDS)[:-20])
    with pytest.raises(PySparkException):
        questions_.read_question_arrays(spark, str(tmp_path / "cut.json")).collect()


def test_filter_and_fields(loaded):
    latest = questions_.latest_questions(loaded, "_order")

    def ids(**filters):
        return sorted(r.id for r in questions_.filter_questions(latest, **filters).collect())

    assert ids(hop=1) == ["pass-2"]
    assert ids(hop=2) == ["peak-4"]
    assert ids(hop=1, split="test") == ["pass-2"]
    assert ids(hop=1, split="train") == []
    assert ids(absent="x") == []
    assert ids(hop=None, split=None) == ["hut-9", "lake-7", "pass-2", "peak-4"]
    assert ids(id="hut-9") == ["hut-9"]
    field = questions_.field_value
    rows = latest.select("id", field(latest, "hop", 0).alias("hop"), field(latest, "question").alias("q"), field(latest, "no").alias("no"))
    assert {r.id: (r.hop, r.no) for r in rows.collect()}["hut-9"] == ("0", None)
    promoted = questions_.promote_fields(latest, "hop")
    assert promoted.filter("hop = '2'").first().id == "peak-4"


def test_lookup(loaded, spark):
    latest = questions_.latest_questions(loaded, "_order")
    asked = spark.createDataFrame([("lake-7",), ("nope",)], "id string")
    assert [r.id for r in questions_.find_questions(latest, asked).collect()] == ["lake-7"]
    assert {r.id: r.found for r in questions_.questions_exist(latest, asked).collect()} == {"lake-7": True, "nope": False}


def test_record_without_id_is_an_error(spark):
    with pytest.raises(PySparkException):
        questions_.parse_questions(spark.createDataFrame([('{"question": "x"}',)], "value string")).collect()


def test_hot_id_is_reduced_before_the_shuffle(spark):
    repeated = spark.range(1000).select(F.lit("same").alias("id"), F.col("id").cast("string").alias("question"), F.col("id").alias("n"))
    latest = questions_.latest_questions(repeated, "n")
    assert [tuple(r) for r in latest.collect()] == [("same", "999")]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


GEN = ("MATCH (n) RETURN n", (0.5, 10, 5, 0))
EXEC = (["A"], True, None)
EVAL = (1.0, 1.0, 1.0, 1.0)


def stages(table):
    return {tuple(r[k] for k in KEY): tuple(r[s] is not None for s in STAGES) for r in table.collect()}


def test_json_round_trip(make_results):
    table = make_results(("q1", GEN, EXEC, EVAL), ("q2", (None, None), (None, False, "e"), (None,) * 4), ("q3", None, None, None))
    texts = table.withColumns({s: F.to_json(F.col(s), {"ignoreNullFields": "false"}) for s in STAGES})
    assert sorted(results_.decode_results(texts).collect()) == sorted(table.collect())
    sparse = texts.withColumn("exec", F.lit('{"error": "x"}')).withColumn("gen", F.lit(""))
    row = results_.decode_results(sparse).first()
    assert row.exec.success is False and row.exec.error == "x" and row.gen is None


def test_export_writes_nulls(make_results, tmp_path, spark):
    table = make_results(("q1", GEN, None, None))
    results_.export_results(table, str(tmp_path / "out"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    exported = json.loads(line)
    assert exported == json.loads(results_.result_json(table).first().json)
    assert exported["exec"] is None and exported["gen"]["stats"]["input_tokens"] == 10


def test_lookup_results(make_results, spark):
    table = make_results(("q1", GEN, None, None)).union(make_results(("q1", GEN, None, None), config=("llm", "sparql", "m1")))
    assert results_.results_of_config(table, "llm", "sparql", "m1").count() == 1
    assert results_.results_of_questions(table, spark.createDataFrame([("q1",)], "id string")).count() == 2
    keys = spark.createDataFrame([("q1", *CONFIG), ("q1", "llm", "gremlin", "m1")], ", ".join(f"{k} string" for k in KEY))
    assert sorted(r.found for r in results_.results_exist(table, keys).collect()) == [False, True]


def update(spark, stage, *rows, extra=""):
    fields = ", ".join(f"{k} string" for k in KEY) + f", {stage} {RESULTS[stage].dataType.simpleString()}{extra}"
    return spark.createDataFrame(rows, fields)


def test_save_and_invalidate(make_results, spark):
    table = make_results(("q1", GEN, EXEC, EVAL), ("q2", GEN, EXEC, EVAL))
    key = ("q1", *CONFIG)
    again = staging.save_generation(table, update(spark, "gen", (*key, GEN), ("q9", *CONFIG, GEN)))
    assert stages(again) == {key: (True, False, False), ("q2", *CONFIG): (True, True, True), ("q9", *CONFIG): (True, False, False)}
    run = staging.save_execution(table, update(spark, "exec", (*key, EXEC), ("q9", *CONFIG, EXEC)))
    assert stages(run) == {key: (True, True, False), ("q2", *CONFIG): (True, True, True)}
    scored = staging.save_evaluation(again, update(spark, "eval", (*key, (None,) * 4), ("q7", *CONFIG, EVAL)))
    assert stages(scored)[key] == (True, False, True) and len(stages(scored)) == 3


def test_last_update_wins(make_results, spark):
    rows = [("q1", *CONFIG, (f"v{i}", None), i) for i in (2, 3, 1)]
    saved = staging.save_generation(make_results(("q1", None, EXEC, EVAL)), update(spark, "gen", *rows, extra=", n int"), order="n")
    assert saved.first().gen.query == "v3" and saved.count() == 1


def test_configurations_stay_apart(make_results, spark):
    empty = results_.empty_results(spark)
    rows = [("q1", "llm", "cypher", "a", GEN), ("q1", "llm", "sparql", "a", GEN), ("q1", "seq2seq", "cypher", "b", GEN)]
    assert staging.save_generation(empty, update(spark, "gen", *rows)).count() == 3


@pytest.mark.parametrize("stage, left", [("gen", (False, False, False)), ("exec", (True, False, False)), ("eval", (True, True, False))])
def test_clear(make_results, stage, left):
    table = make_results(("q1", GEN, EXEC, EVAL)).union(make_results(("q1", GEN, EXEC, EVAL), config=("llm", "cypher", "m2")))
    cleared = staging.clear_stage(table, *CONFIG, stage)
    assert stages(cleared) == {("q1", *CONFIG): left, ("q1", "llm", "cypher", "m2"): (True, True, True)}
    assert staging.cleared_rows(table, *CONFIG).first().cleared == 1


def test_clear_unknown_stage(make_results):
    with pytest.raises(ValueError):
        staging.clear_stage(make_results(), *CONFIG, "other")


@pytest.fixture
def state(make_questions, make_results):
    """Five questions: no row, cleared row, generated, executed, evaluated."""
    questions = make_questions(*[(f"q{i}", ["a"], None) for i in range(5)])
    results = make_results(("q1", None, None, None), ("q2", GEN, None, None), ("q3", GEN, EXEC, None), ("q4", GEN, EXEC, (None,) * 4))
    other = make_results(("q0", GEN, EXEC, EVAL), config=("llm", "sparql", "m1"))
    return questions, results.union(other)


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_pending(state):
    assert ids(selection.pending_generate(*state, *CONFIG)) == ["q0"]
    assert ids(selection.pending_generate(*state, *CONFIG, regenerate_cleared=True)) == ["q0", "q1"]
    assert ids(selection.pending_generate(*state, *CONFIG, if_exists="override")) == ["q0", "q1", "q2", "q3", "q4"]
    assert ids(selection.pending_execute(*state, *CONFIG)) == ["q1", "q2"]
    assert ids(selection.pending_execute(*state, *CONFIG, if_exists="override")) == ["q1", "q2", "q3", "q4"]
    assert ids(selection.pending_evaluate(*state, *CONFIG)) == ["q3"]
    assert ids(selection.pending_evaluate(*state, *CONFIG, if_exists="override")) == ["q3", "q4"]
    with pytest.raises(ValueError):
        selection.pending_execute(*state, *CONFIG, if_exists="maybe")


def test_skip_counts(state):
    rows = {r.stage: tuple(r)[1:] for r in selection.skip_counts(*state, *CONFIG).collect()}
    assert rows == {"generate": (0, 4, 1), "execute": (1, 2, 2), "evaluate": (3, 1, 1)}


def test_check_rows(spark):
    rows = spark.createDataFrame([("q1", "llm"), (None, "llm"), ("q2", "other"), ("q3", None)], "question_id string, method string")
    problems = [r.problem for r in selection.check_rows(rows).collect()]
    assert problems == [None, "question_id is missing", "method is not allowed", "method is not allowed"]
    valid, rejected = selection.split_valid(rows)
    assert valid.count() == 1 and rejected.count() == 3
    with pytest.raises(PySparkException):
        selection.check_rows(rows, strict=True).collect()
    assert selection.check_rows(rows.limit(1), strict=True).count() == 1


def test_seq2seq_output_is_kept_as_written(make_questions, make_results):
    def tick():
        import pandas as pd

        return lambda batch: pd.DataFrame({"content": "MATCH (n:`Two Words`) RETURN n" + batch["prompt"].str[:0]})

    asked, none = make_questions(("q1", ["A"], None)), make_results(("q9", None, None, None))
    for method, extract, query in (("seq2seq", None, "MATCH (n:`Two Words`) RETURN n"), ("seq2seq", True, "Two Words")):
        table = generate_stage(asked, none, tick, method, *CONFIG[1:], extract=extract)
        assert [r.gen.query for r in table.collect() if r.question_id == "q1"] == [query]


def test_stages_end_to_end(spark, make_questions, make_results):
    def echo():
        import pandas as pd

        return lambda batch: pd.DataFrame({"content": "```\nRETURN '" + batch["prompt"] + "'\n```", "duration": 0.5})

    questions = make_questions(("q1", ["A", "B"], {"hop": "1"}), ("q2", ["C"], None), ("q3", [], None))
    existing = make_results(("q2", ("EXISTING", None), None, None))
    table = generate_stage(questions, existing, echo, *CONFIG)
    generated = {r.question_id: r.gen for r in table.collect()}
    assert generated["q1"].query == "RETURN 'question q1'" and generated["q1"].stats.duration == 0.5
    assert generated["q2"].query == "EXISTING" and len(generated) == 3
    answers = spark.createDataFrame([("q1", ["b ", "a"])], "question_id string, result array<string>")
    errors = spark.createDataFrame([("q2", "Connection failed")], "question_id string, engine_error string")
    table = execute_stage(questions, table, answers, errors, *CONFIG)
    run = {r.question_id: tuple(r.exec) for r in table.collect()}
    assert run == {"q1": (["b ", "a"], True, None), "q2": (None, False, "Connection failed"), "q3": ([], True, None)}
    table = evaluate_stage(questions, table, CONFIG)
    scores = {r.question_id: tuple(r.eval) for r in table.collect()}
    assert scores == {"q1": (1, 1, 1, 1), "q2": (None,) * 4, "q3": (1, 0, 0, 0)}
    assert sorted(evaluate_stage(questions, table, CONFIG).collect()) == sorted(table.collect())


def test_stored_tables(spark, make_questions, make_results, tmp_path):
    paths = str(tmp_path / "questions"), str(tmp_path / "results")
    questions = make_questions(("q1", ["A"], None))
    for _ in range(2):
        results_.init_tables(spark, questions, *paths)
    assert spark.read.parquet(paths[0]).count() == 1 and results_.read_results(spark, paths[1]).count() == 0
    both = make_results(("q1", GEN, EXEC, None)).union(make_results(("q1", GEN, EXEC, EVAL), config=("llm", "cypher", "m2")))
    results_.write_results(both, paths[1])
    stored = results_.read_results(spark, paths[1])
    one = results_.results_of_config(stored, *CONFIG)
    assert "PartitionFilters: [isnotnull(method" in one._jdf.queryExecution().executedPlan().toString()
    results_.write_results(evaluate_stage(questions, one, CONFIG), paths[1])
    assert stages(results_.read_results(spark, paths[1])) == {("q1", *CONFIG): (True, True, True), ("q1", "llm", "cypher", "m2"): (True, True, True)}
