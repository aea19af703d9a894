"""Training examples: split files to one table, and the encoded table back to files."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscore.model import SPLITS
from hopscore.sources.json_arrays import read_array_elements

RAW = "map<string,string>"


def read_examples(
    spark: SparkSession,
    path: str,
    columns: dict[str, str],
    shot: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``split, example_id, input, target, choices, answer`` from the files of the three splits.

    ``columns`` maps ``input``, ``target``, ``choices`` and ``answer`` to the dataset's field names; ``prepare`` is the
    dataset's own hook from DataFrame to DataFrame. ``shot`` picks a few-shot sub-folder. A split is ``<split>.json``
    (one array) and/or ``<split>.jsonl`` (one object per line), both read by blocks; a missing one is left out.
    """
    folder = os.path.join(path, shot) if shot else path
    parts = []
    for split in SPLITS:
        for suffix, read in ((".json", read_array_elements), (".jsonl", lambda spark, file: spark.read.text(file))):
            try:
                texts = read(spark, os.path.join(folder, split + suffix))
            except AnalysisException as error:
                if error.getCondition() == "PATH_NOT_FOUND":
                    continue
                raise
            parts.append(texts.select(F.lit(split).alias("split"), "value"))
    if not parts:
        raise FileNotFoundError(folder)
    return examples_from_json(reduce(DataFrame.unionByName, parts), columns, prepare)


def examples_from_json(
    lines: DataFrame, columns: dict[str, str], prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Rows of JSON text (one object, or an array of objects) to examples; a text that is neither is an error."""
    text = F.trim("value")
    broken = F.raise_error(F.concat(F.lit("not a JSON array: "), F.left(text, F.lit(200))))
    no_object = F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("json", F.lit(200))))
    objects = F.when(F.startswith(text, F.lit("[")), F.coalesce(F.from_json(text, "array<string>"), broken)).otherwise(F.array(text))
    records = lines.filter(text != "").select("split", F.explode(objects).alias("json"))
    fields = records.withColumn("fields", F.coalesce(F.from_json("json", RAW), no_object))
    fields = prepare(fields) if prepare else fields

    def field(name: str):
        return F.try_element_at("fields", F.lit(columns[name])) if name in columns else F.lit(None).cast("string")

    return fields.select(
        "split",
        F.monotonically_increasing_id().alias("example_id"),
        F.coalesce(field("input"), F.lit("")).alias("input"),
        F.coalesce(field("target"), F.lit("")).alias("target"),
        F.from_json(field("choices"), "array<string>").alias("choices"),
        field("answer").alias("answer"),
    )


def write_encoded(encoded: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """One directory per split (none for an empty split) and the vocabulary beside them."""
    encoded.write.mode("overwrite").partitionBy("split").parquet(os.path.join(path, "examples"))
    vocabulary.write.mode("overwrite").parquet(os.path.join(path, "vocabulary"))
