"""Questions: JSON files to a table of id, question, answer and extra fields."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscore.functions.answers import answers_from_json
from hopscore.sources.json_arrays import read_array_elements

CORE = ("id", "question", "answer")


def parse_questions(records: DataFrame, text: str = "value", order: str | None = None) -> DataFrame:
    """One JSON record per row -> ``id, question, answer, answer_json, extra`` (+ ``order``).

    Fields besides the core ones go to ``extra``, which is NULL if there are none. A record without an id is an error.
    """
    kept = [order] if order else []
    parsed = records.select(F.col(text).alias("_text"), F.from_json(text, "map<string,string>").alias("_fields"), *kept)

    def core(name: str) -> Column:
        return F.try_element_at(F.col("_fields"), F.lit(name))

    no_id = F.raise_error(F.concat(F.lit("record without id: "), F.col("_text")))
    rest = F.map_filter("_fields", lambda name, _: ~name.isin(*CORE))
    split = parsed.select(
        F.coalesce(core("id"), no_id).alias("id"), core("question").alias("question"), core("answer").alias("answer_json"), rest.alias("_rest"), *kept
    )
    return split.select(
        "id",
        "question",
        answers_from_json(F.col("answer_json")).alias("answer"),
        "answer_json",
        F.when(F.size("_rest") > 0, F.col("_rest")).alias("extra"),
        *kept,
    )


def latest_questions(questions: DataFrame, order: str) -> DataFrame:
    """One row per id, the one that came last. ``max_by`` keeps one row per id and task before the shuffle, so an id
    repeated any number of times costs no more than others."""
    payload = [c for c in questions.columns if c not in ("id", order)]
    last = F.max_by(F.struct(*payload), F.col(order)).alias("last")
    return questions.groupBy("id").agg(last).select("id", *[F.col("last")[c].alias(c) for c in payload])


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, splittable: the form for large sets. ``_order`` follows file name, block and line."""
    lines = spark.read.text(path).select(
        "value",
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("_order"),
    )
    return parse_questions(lines.filter(F.trim("value") != ""), order="_order")


def read_question_arrays(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that hold one array of records each, read by blocks; a file that is no such array is an error. ``_order``
    follows file name and place in the file."""
    elements = read_array_elements(spark, path)
    return parse_questions(elements.select("value", F.struct("file", "place").alias("_order")), order="_order")


def field_value(questions: DataFrame, field: str, default: Any = None) -> Column:
    """A field by name: a column of the table if there is one (so that filters reach the files), else an extra."""
    if field in questions.columns:
        return F.col(field)
    value = F.try_element_at(F.col("extra"), F.lit(field))
    return value if default is None else F.coalesce(value, F.lit(_text(default)))


def filter_questions(questions: DataFrame, **filters: Any) -> DataFrame:
    """Rows all of whose named fields have the given value, compared as text. None is no filter."""
    wanted = [field_value(questions, field).cast("string") == _text(v) for field, v in filters.items() if v is not None]
    return questions.filter(reduce(Column.__and__, wanted)) if wanted else questions


def promote_fields(questions: DataFrame, *fields: str) -> DataFrame:
    """Copy extras to columns of their own, which scans can skip by."""
    return questions.select("*", *[field_value(questions, f).alias(f) for f in fields if f not in questions.columns])


def find_questions(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """The questions with the given ids (column ``id``)."""
    return questions.join(ids.select("id"), "id", "left_semi")


def questions_exist(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, found`` for each asked id."""
    known = questions.select("id", F.lit(True).alias("found"))
    return ids.select("id").join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
