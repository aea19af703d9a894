"""Graph schema files: one JSON document per dataset and query language."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscore.functions.graph_schemas import schema_text


def read_schema(spark: SparkSession, path: str, lang: str) -> DataFrame | None:
    """``lang, json, schema_text`` of one schema file (or of a folder of them); None if there is no such path."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return files.select(
        F.lit(lang).alias("lang"), F.col("value").alias("json"), schema_text(F.col("value"), lang).alias("schema_text")
    )


def read_schemas(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """``dataset, lang, json, schema_text`` for files named by dataset and language; missing files are left out."""
    found = [
        schema.select(F.lit(dataset).alias("dataset"), "lang", "json", "schema_text")
        for (dataset, lang), path in paths.items()
        if (schema := read_schema(spark, path, lang)) is not None
    ]
    if not found:
        return spark.createDataFrame([], "dataset string, lang string, json string, schema_text string")
    return reduce(DataFrame.unionByName, found)
