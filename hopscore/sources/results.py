"""Results: the staged table, its JSON form, and its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hopscore.functions.json_text import is_object, required
from hopscore.model import CONFIG, EVAL_TYPE, EXEC_TYPE, GEN_TYPE, KEY, RESULTS, STAGES
from hopscore.session import cut_lineage
from hopscore.sources.questions import latest_questions


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULTS)


def _stage_text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def split_stored(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` of results whose stages are JSON texts; rejected ones have a ``problem``: their first stage that is no object."""
    problem = F.lit(None).cast("string")
    for name in reversed(STAGES):
        bad = _stage_text(name).isNotNull() & ~is_object(_stage_text(name))
        problem = F.when(bad, f"{name} is not a JSON object").otherwise(problem)
    checked = rows.withColumn("problem", problem)
    return checked.filter(F.col("problem").isNull()).drop("problem"), checked.filter(F.col("problem").isNotNull())


def decode_results(rows: DataFrame) -> DataFrame:
    """Stage columns held as JSON texts -> typed structs. A NULL or empty text is a stage not run; one that is no JSON object is an
    error (``split_stored`` sets such rows apart)."""

    def stage(name: str, dtype) -> Column:
        text = _stage_text(name)
        return F.from_json(required(text, is_object(text), f"{name} is not a JSON object"), dtype)

    success = F.coalesce(F.col("exec.success"), F.lit(False))
    return rows.select(
        *KEY, stage("gen", GEN_TYPE).alias("gen"), stage("exec", EXEC_TYPE).alias("exec"), stage("eval", EVAL_TYPE).alias("eval")
    ).withColumn("exec", F.when(F.col("exec").isNotNull(), F.col("exec").withField("success", success)))


def result_json(results: DataFrame) -> DataFrame:
    """One JSON text per result, with every stage and with NULLs written out."""
    whole = F.struct(*KEY, "gen", "exec", "eval")
    return results.select(*KEY, F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def export_results(results: DataFrame, path: str) -> None:
    """Write a directory of JSON Lines, NULLs written out."""
    results.select(*KEY, "gen", "exec", "eval").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def results_of_config(results: DataFrame, method: str, lang: str, model: str) -> DataFrame:
    """Rows of one configuration; on a stored table only its directory is read."""
    return results.filter((F.col("method") == method) & (F.col("lang") == lang) & (F.col("model") == model))


def results_of_questions(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given questions (column ``id``), under every configuration."""
    return results.join(ids.select(F.col("id").alias("question_id")), "question_id", "left_semi").select(*results.columns)


def results_exist(results: DataFrame, keys: DataFrame) -> DataFrame:
    """``found`` for each asked four-part key."""
    known = results.select(*KEY, F.lit(True).alias("found"))
    return keys.select(*KEY).join(known, KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Replace the directories of the configurations that occur in ``results``; others stay as they are.

    The rows are materialised first, so ``results`` may be derived from the same path. Rebalancing gives files of even
    size and splits a configuration that holds most of the rows over many tasks.
    """
    ready = cut_lineage(results.select(*RESULTS.names))
    writer = ready.hint("rebalance", *CONFIG).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*CONFIG).parquet(path)


def init_tables(spark: SparkSession, questions: DataFrame, questions_path: str, results_path: str) -> int:
    """Start over: store the questions and an empty results table, replacing whatever was there. Returns the number of records
    given; with a column ``_order`` (of the readers) the last record of each id is stored."""
    seen = Observation()
    given = questions.observe(seen, F.count(F.lit(1)).alias("records"))
    rows = latest_questions(given, "_order") if "_order" in questions.columns else given
    rows.write.mode("overwrite").parquet(questions_path)
    empty_results(spark).write.mode("overwrite").partitionBy(*CONFIG).parquet(results_path)
    return seen.get["records"]
