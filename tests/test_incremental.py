"""Incremental reports against full ones; numbering without a group in one task; rejected rows; stage arguments."""

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopscore.model import EVAL_TYPE, EXEC_TYPE, KEY, RESULTS
from hopscore.operators.execution import split_traversal, wrap_scalars
from hopscore.operators.generation import response_columns, split_responses
from hopscore.operators.numbering import number_within
from hopscore.plans.incremental import IncrementalReport
from hopscore.plans.report_text import Report
from hopscore.plans.stages import generate_stage
from hopscore.sources.result_store import ResultStore
from hopscore.sources.results import decode_results, split_stored

CONFIGS = [("llm", "cypher", "m1"), ("seq2seq", "sparql", "m2")]
ERRORS = ["a timeout of 9 s", "Unknown relationship type 'CURES' here", "relationship type HEALS does not exist", "no label Drug"]


def _save(spark, stage, rows):
    fields = ", ".join(f"{k} string" for k in KEY) + f", {stage} {(EXEC_TYPE if stage == 'exec' else EVAL_TYPE).simpleString()}"
    return spark.createDataFrame([(*key, value) for key, value in rows], fields)


def _rows(table):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in table.collect())


def test_updates_equal_a_full_report(spark, make_questions, tmp_path):
    keys = [(f"q{i}", *CONFIGS[i % 2]) for i in range(60)]
    rows = []
    for i, key in enumerate(keys):
        outcome = ([f"a{i}"], True, None) if i % 3 else (None, False, ERRORS[i // 3 % 4])
        rows.append((*key, ("Q", (1.5, i, 2, None)), outcome if i % 7 else None, (float(i % 2), 0.25, 0.5, 1.0) if i % 3 and i % 5 else None))
    questions = make_questions(*[(f"q{i}", [], {"hop": str(i % 3), "tier": "x"} if i % 4 else {"hop": "1"}) for i in range(55)])
    store = ResultStore.create(spark.createDataFrame(rows, RESULTS), str(tmp_path / "store"), buckets=2)
    kept = IncrementalReport(store, questions, str(tmp_path / "report"), "d", ["hop", "tier"])

    def same():
        full, own = Report(store.merged(), questions, "d", ["hop", "tier"]), kept.report()
        for name in ("summary", "by_field", "total_errors", "error_types", "missing_relations"):
            assert _rows(getattr(own, name)) == _rows(getattr(full, name)), name

    kept.update()
    same()
    store.save_execution(_save(spark, "exec", [(keys[i], (["z"], True, None) if i % 2 else (None, False, ERRORS[i % 4])) for i in range(0, 30)]))
    kept.update()
    same()
    store.save_evaluation(_save(spark, "eval", [(keys[i], (1.0, 1.0, 1.0, 0.5)) for i in range(1, 30, 2)]))
    store.clear_stage(*CONFIGS[1], "exec")
    kept.update()
    same()
    before = kept.cells().inputFiles()
    kept.update()  # nothing has changed: nothing is written
    assert kept.cells().inputFiles() == before
    store.compact()
    store.clear_stage(*CONFIGS[0], "gen")
    kept.update()
    same()


def test_an_update_scores_only_what_has_changed(spark, make_questions, tmp_path):
    rows = [(f"q{i}", *CONFIGS[0], None, (["a"], True, None), None) for i in range(40)]
    store = ResultStore.create(spark.createDataFrame(rows, RESULTS), str(tmp_path / "store"), buckets=2)
    state = store.state()
    store.save_execution(_save(spark, "exec", [((f"q{i}", *CONFIGS[0]), (None, False, "x")) for i in (3, 4)]))
    assert sorted(r.question_id for r in store.changed_since(state).collect()) == ["q3", "q4"]
    assert {r.exec.success for r in store.merged(state).collect()} == {True}
    store.compact()
    assert store.changed_since(state) is None
    with pytest.raises(ValueError):
        store.merged(state)


def test_places_in_one_large_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").alias("g"), (-F.col("id")).alias("o"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = number_within(rows, "g", ["o"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {(r.g, r.o): r.place for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "row_number" not in plan
    want = {}
    for group in ("big", "small", None):
        own = sorted(-i for i in range(5000) if ("big" if i % 10 < 8 else "small" if i % 10 == 8 else None) == group)
        want |= {(group, o): n for n, o in enumerate(own, 1)}
    assert found == want


def test_stored_stages_that_are_no_objects(spark):
    good = ("q1", *CONFIGS[0], '{"query": "Q"}', '{"success": true}', None)
    bad = [("q2", *CONFIGS[0], '{"query": "Q', None, None), ("q3", *CONFIGS[0], "{}", "[1]", "x"), ("q4", *CONFIGS[0], "", "null", None)]
    rows = spark.createDataFrame([good, *bad], ", ".join(f"{c} string" for c in (*KEY, "gen", "exec", "eval")))
    valid, rejected = split_stored(rows)
    assert [r.question_id for r in decode_results(valid).collect()] == ["q1"]
    assert {r.question_id: r.problem for r in rejected.collect()} == {
        "q2": "gen is not a JSON object", "q3": "exec is not a JSON object", "q4": "exec is not a JSON object"
    }
    with pytest.raises(PySparkException, match="gen is not a JSON object"):
        decode_results(rows.filter("question_id = 'q2'")).collect()


def test_broken_traversal_rows_and_responses(spark):
    rows = spark.createDataFrame([(0, '{"a": 1}'), (1, "[1, 2]"), (2, '{"a": '), (3, "x"), (4, None), (5, "3")], "row_idx int, value string")
    valid, rejected = split_traversal(rows)
    assert sorted(r.row_idx for r in rejected.collect()) == [2, 3]
    assert wrap_scalars(valid).count() == 4
    with pytest.raises(PySparkException, match="value is not JSON"):
        wrap_scalars(rows).collect()
    log = spark.createDataFrame([("openai", '{"output_text": "a"}'), ("openai", "{"), ("deepseek", "[]"), ("other", "{"), (None, "{"), ("openai", None)], "provider string, payload string")
    valid, rejected = split_responses(log)
    assert sorted(r.provider for r in rejected.collect()) == ["deepseek", "openai"] and valid.count() == 4
    with pytest.raises(PySparkException, match="payload is not a JSON object"):
        response_columns(log, ["provider"]).collect()
    assert response_columns(valid, ["provider"]).count() == 4


def test_own_templates_translator_and_clean_up(spark, make_questions, make_results):
    def load():
        return lambda batch: pd.DataFrame({"content": "out of " + batch["prompt"]})

    def translator(text):
        if "two" in text:
            raise RuntimeError("cannot")
        return f"({text})-[:KNOWS_OF]->(x)"

    asked = make_questions(("one", [], None), ("two", [], None)).withColumn("dataset", F.lit("d")).withColumn("question", F.col("id"))
    schemas = spark.createDataFrame([("d", "cypher", "S")], "dataset string, lang string, schema_text string")
    table = generate_stage(
        asked, make_results(("old", None, None, None)), load, "seq2seq", "cypher", "m", schemas,
        templates={"cypher": "{{ schema }}: {{ question }}"}, translator=translator, clean=["lowercase_relationships", "unknown"],
    )
    queries = {r.question_id: r.gen.query for r in table.filter("model = 'm'").collect()}
    assert queries == {"one": "(out of S: one)-[:knows_of]->(x)", "two": "out of S: two"}
