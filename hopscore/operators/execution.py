"""The execute stage: rows of query answers, the outcome of each query, and the structs stored for them.

An answer row carries ``cells``: one JSON text per column. Answers may stay in rows, as a table beside the results
(``execute_rows_stage``); ``pack_answers`` makes the array for the results table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions.answers import answers_from_json
from hopscore.functions.json_text import is_json, required

NO_QUERY = "no query to execute"  # Fixed value: the error text of a result without a query.


def json_cell(value: Column) -> Column:
    """One value as JSON text: strings quoted, NULL as ``null``."""
    wrapped = F.to_json(F.array(value))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def cell_text(cell: Column) -> Column:
    """A JSON cell as an answer text: strings bare, NULL as NULL, nested values as JSON."""
    return answers_from_json(F.concat(F.lit("["), cell, F.lit("]")))[0]


def wrap_scalars(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows of traversal output (JSON texts, keyed by ``row_idx``) as name-to-cell maps: objects as they are, any
    other value as ``{value: x}``. A text that is no JSON is an error (``split_traversal`` sets such rows apart)."""
    text = required(F.col(value), is_json(F.col(value)), "value is not JSON")
    is_object = F.startswith(F.trim(text), F.lit("{"))
    # Map values read as strings lose their quotes, so each is looked up again in its JSON form.
    members = F.from_json(text, "map<string,variant>")
    cells = F.transform_values(members, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    scalar = F.create_map(F.lit("value"), text)
    return rows.withColumn("row", F.when(is_object, cells).otherwise(scalar)).drop(value)


def split_traversal(rows: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` rows of traversal output; rejected ones have a ``problem``."""
    bad = F.col(value).isNotNull() & ~is_json(F.col(value))
    return rows.filter(~bad), rows.filter(bad).withColumn("problem", F.lit("value is not JSON"))


def first_row_columns(rows: DataFrame, *keys: str) -> DataFrame:
    """Column names per query: those of its first row."""
    first = F.min_by(F.map_keys("row"), F.col("row_idx"))
    return rows.groupBy(*keys).agg(first.alias("columns"))


def row_values(row: Column, columns: Column) -> Column:
    """Cells of a name-to-cell map in column order; a missing name gives NULL."""
    return F.transform(columns, lambda name: F.try_element_at(row, name))


def answer_of_cells(cells: Column) -> Column:
    """The answer a row stands for: the value of its only column, or the JSON list of all of them."""
    whole = F.transform(cells, lambda c: F.coalesce(c, F.lit("null")))
    listed = F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]"))
    return F.when(F.size(cells) == 1, cell_text(cells[0])).otherwise(listed)


def collect_answers(rows: DataFrame, *keys: str) -> DataFrame:
    """Answers in row form: ``keys, row_idx, answer``; order and repeats are kept."""
    return rows.select(*keys, "row_idx", answer_of_cells(F.col("cells")).alias("answer"))


def row_counts(queries: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, row_count, is_empty`` for every query, also for one without rows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    joined = queries.select(*keys).join(counts, list(keys), "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    return joined.withColumn("is_empty", F.col("row_count") == 0)


def pack_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, result ARRAY``, in row order (rows of one place by text), of any length. A list lies in one row here; where a list outgrows a row of the
    cluster, leave the answers in rows: ``execute_rows_stage`` and ``evaluate_rows_stage`` never gather them."""
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "answer")))
    return answers.groupBy(*keys).agg(F.transform(ordered, lambda a: a["answer"]).alias("result"))


def exec_outcome(query: Column, error: Column, result: Column) -> Column:
    """Execution struct: no or empty query, failed query, or success with its list (empty if it gave no rows)."""
    missing = F.coalesce(query, F.lit("")) == ""
    failed = missing | error.isNotNull()
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(~failed, F.coalesce(result, empty)).alias("result"),
        (~failed).alias("success"),
        F.when(missing, NO_QUERY).otherwise(error).alias("error"),
    )


def run_status(results: DataFrame, errors: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Per result: ``success, error, n_answers``. ``errors``: keys and ``engine_error``; ``answers``: answer rows."""
    counts = answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_answers"))
    joined = results.join(errors.select(*keys, "engine_error"), keys, "left").join(counts, keys, "left")
    outcome = exec_outcome(F.col("gen.query"), F.col("engine_error"), F.lit(None).cast("array<string>"))
    return joined.select(
        *keys,
        outcome["success"].alias("success"),
        outcome["error"].alias("error"),
        F.when(outcome["success"], F.coalesce("n_answers", F.lit(0))).alias("n_answers"),
    )
