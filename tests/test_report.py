import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopscore.model import STATS_TYPE
from hopscore.operators import report as report_
from hopscore.operators.scoring import pair_results
from hopscore.plans import report_text

CONFIG = ("llm", "cypher", "gpt-4o")


@pytest.fixture
def golden(make_results, make_questions):
    """Four pairs: two right, one wrong, one failed on a relation that does not exist."""
    stats = (2.0, 100, 50, 10)
    right, wrong = (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)
    done = (["x"], True, None)
    results = make_results(
        ("q001", ("Q", stats), done, right),
        ("q002", ("Q", stats), done, wrong),
        ("q003", ("Q", stats), (None, False, "Unknown relationship type 'MELTS_INTO'"), (None,) * 4),
        ("q004", ("Q", None), done, right),
        config=CONFIG,
    )
    questions = make_questions(("q001", [], {"hop": "1"}), ("q002", [], {"hop": "1"}), ("q003", [], {"hop": "2"}), ("q004", [], {"hop": "2"}))
    return results, questions


def cells(golden, fields=("hop",), keys=()):
    return report_.report_cells(pair_results(*golden), list(fields), list(keys))


def test_summary(golden):
    row = report_.summary(cells(golden), []).first()
    assert (row["count"], row.error_count, row.accuracy) == (4, 1, pytest.approx(2 / 3))
    assert row.avg_f1 == row.avg_precision == row.avg_recall == pytest.approx(2 / 3)
    assert (row.total_duration, row.avg_duration) == (6.0, 2.0)
    assert (row.total_input_tokens, row.total_output_tokens, row.total_cached_tokens) == (300, 150, 30)
    assert (row.avg_input_tokens, row.avg_output_tokens, row.avg_cached_tokens) == (100.0, 50.0, 10.0)


def test_by_field(golden):
    rows = {(r.field, r.value): r for r in report_.by_field(cells(golden), ["hop"], []).collect()}
    assert {k: (r["count"], r.error_count, r.accuracy) for k, r in rows.items()} == {("hop", "1"): (2, 0, 0.5), ("hop", "2"): (2, 1, 1.0)}


def test_field_values_that_are_null_are_left_out(golden, make_questions):
    questions = make_questions(("q001", [], {"hop": "1", "tier": "x"}), ("q002", [], None), ("q003", [], {"hop": "2"}))
    pairs = cells((golden[0], questions), ["hop", "tier"])
    assert report_.summary(pairs, []).first()["count"] == 3
    rows = {(r.field, r.value): r["count"] for r in report_.by_field(pairs, ["hop", "tier"], []).collect()}
    assert rows == {("hop", "1"): 1, ("hop", "2"): 1, ("tier", "x"): 1}


def test_two_counts_of_errors(golden, make_results):
    """A missing execution is an error of the summary, but not a failed one."""
    results = golden[0].union(make_results(("q005", None, None, None), config=CONFIG))
    table = report_.report_cells(results, [], [])
    assert report_.summary(table, []).first().error_count == 2
    assert report_.total_errors(table, []).first().total_errors == 1
    assert [tuple(r) for r in report_.error_categories(table, []).collect()] == [("missing_relationship", 1)]
    assert [r.relation for r in report_.unknown_relations(table, []).collect()] == ["MELTS_INTO"]


def test_success_without_evaluation_counts_as_valid(make_results):
    results = make_results(("q1", None, (["x"], True, None), None), ("q2", None, (["x"], True, None), (1.0, 1.0, 1.0, 1.0)))
    row = report_.summary(report_.report_cells(results, [], []), []).first()
    assert (row.error_count, row.accuracy, row.avg_f1) == (0, 0.5, 0.5)


def test_stats_without_any_number_are_no_stats(make_results):
    results = make_results(("q1", ("Q", (None,) * len(STATS_TYPE)), None, None), ("q2", ("Q", (4.0, None, None, None)), None, None))
    row = report_.summary(report_.report_cells(results, [], []), []).first()
    assert (row.total_duration, row.avg_duration, row.total_input_tokens) == (4.0, 4.0, 0)


def test_nothing(make_results):
    row = report_.summary(report_.report_cells(make_results(), [], []), []).first()
    assert set(row.asDict().values()) == {0}


def test_groups_add_up(golden):
    table = cells(golden, ["hop"])
    whole = report_.summary(table, []).first()
    groups = report_.by_field(table, ["hop"], []).agg(F.sum("count"), F.sum("error_count"), F.sum("total_input_tokens")).first()
    assert tuple(groups) == (whole["count"], whole.error_count, whole.total_input_tokens)


MARKDOWN = """# Report: movies-llm-cypher-gpt-4o

**Total:** 4

## Summary

| Metric | Value |
|--------|-------|
| Count | 4 |
| Errors | 1 |
| Accuracy | 0.6667 |
| Avg F1 | 0.6667 |
| Avg Precision | 0.6667 |
| Avg Recall | 0.6667 |

## By Field

### hop

| Value | Count | Errors | Accuracy | F1 |
|-------|-------|--------|----------|-----|
| 1 | 2 | 0 | 0.5000 | 0.5000 |
| 2 | 2 | 1 | 1.0000 | 1.0000 |

## Errors

**Total Errors:** 1

**Missing Relations:**
- MELTS_INTO

**Error Types:**
- missing_relationship: 1
"""


def test_markdown(golden, spark, tmp_path):
    table = report_text.Report(*golden, "movies", ["hop"])
    report_text.write_markdown(table, str(tmp_path / "md"))
    (folder,) = [p for p in (tmp_path / "md").iterdir() if p.is_dir()]
    assert folder.name == "run_id=movies-llm-cypher-gpt-4o"
    assert "".join(p.read_text() for p in sorted(folder.glob("*.txt"))) == MARKDOWN + "\n"


def test_markdown_without_fields_and_errors(golden):
    good = golden[0].filter("exec.success")
    table = report_text.Report(good, golden[1], "movies", [])
    assert json.loads(table.json().first().json)["by_field"] == {}
    lines = table.markdown()
    texts = [r.line for r in lines.orderBy("section", "item", "value", "part").collect()]
    assert texts[-1] == "" and not any(t.startswith(("## By", "## Err")) for t in texts)


def test_json(golden, spark, tmp_path):
    table = report_text.Report(*golden, "movies", ["hop", "absent"])
    report_text.write_json(table, str(tmp_path / "out"))
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("run_id=*/*.txt"))))
    assert document == json.loads(table.json().first().json)
    assert (document["run_id"], document["total"]) == ("movies-llm-cypher-gpt-4o", 4)
    assert document["summary"]["accuracy"] == pytest.approx(2 / 3)
    assert document["by_field"]["hop"]["2"]["error_count"] == 1 and document["by_field"]["absent"] == {}
    assert list(document) == ["run_id", "total", "summary", "by_field", "errors", "metadata"]
    assert document["errors"] == {"total_errors": 1, "missing_relations": ["MELTS_INTO"], "error_types": {"missing_relationship": 1}}


def test_json_has_no_bound(golden, spark, tmp_path):
    """A field with a value of its own for each of 12,000 questions: pieces that join to one document."""
    n = 12_000
    questions = spark.range(n).selectExpr(
        "concat('q', id) AS id", "'?' AS question", "array('a') AS answer", "map('key', concat(char(34), id)) AS extra"
    )
    results = spark.range(n).selectExpr(
        "concat('q', id) AS question_id", "'llm' AS method", "'cypher' AS lang", "'m' AS model",
        "CAST(NULL AS struct<query: string, stats: struct<duration: double, input_tokens: bigint, output_tokens: bigint, cached_tokens: bigint>>) AS gen",
        "CAST(NULL AS struct<result: array<string>, success: boolean, error: string>) AS exec",
        "CAST(NULL AS struct<exact_match: double, f1: double, precision: double, recall: double>) AS eval",
    )
    report_text.write_json(report_text.Report(results, questions, "d", ["key"]), str(tmp_path / "out"))
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("run_id=*/*.txt"))))
    assert document["total"] == n and set(document["by_field"]["key"]) == {f'"{i}' for i in range(n)}


def test_report_on_nothing_is_an_error(make_results, make_questions, tmp_path):
    table = report_text.Report(make_results(), make_questions(("q", [], None)), "d", ["hop"])
    for write in (report_text.write_json, report_text.write_markdown):
        with pytest.raises(ValueError):
            write(table, str(tmp_path / "x"))


def test_fields_are_those_of_the_question(spark):
    from hopscore.operators.report import report_cells

    pairs = spark.sql(
        "SELECT 'q' || id AS question_id, 'llm' AS method, 'cypher' AS lang, 'm' AS model, map('lang', if(id = 0, 'en', 'fr')) AS extra,"
        " CAST(NULL AS struct<query: string, stats: struct<duration: double, input_tokens: bigint, output_tokens: bigint,"
        " cached_tokens: bigint>>) AS gen, CAST(NULL AS struct<result: array<string>, success: boolean, error: string>) AS exec,"
        " CAST(NULL AS struct<exact_match: double, f1: double, precision: double, recall: double>) AS eval FROM range(2)"
    )
    found = report_cells(pairs, ["lang", "id"]).select("`field:lang`", "`field:id`").collect()
    assert sorted(map(tuple, found)) == [("en", "q0"), ("fr", "q1")]
