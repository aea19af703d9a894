"""The stages of a run on whole tables. Each returns the new results table; ``write_results`` stores it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscore.model import CONFIG, KEY
from hopscore.operators.execution import exec_outcome
from hopscore.operators.generation import Model, generation_of, predict
from hopscore.operators.prompts import prompt, with_schema
from hopscore.operators.scoring import add_scores, score_answer_rows
from hopscore.operators.selection import pending_execute, pending_generate
from hopscore.operators.staging import save_execution, save_generation
from hopscore.session import cut_lineage


def _keyed(questions: DataFrame, method: str, lang: str, model: str) -> DataFrame:
    config = dict(zip(CONFIG, (method, lang, model)))
    return questions.withColumnRenamed("id", "question_id").withColumns({c: F.lit(v) for c, v in config.items()})


def generate_stage(
    questions: DataFrame,
    results: DataFrame,
    load: Callable[[], Model],
    method: str,
    lang: str,
    model: str,
    schemas: DataFrame | None = None,
    if_exists: str = "skip",
    workers: int | None = None,
    extract: bool | None = None,
    templates: dict[str, str] | None = None,
    translator: Callable[[str], str] | None = None,
    clean: Sequence[str] = (),
) -> DataFrame:
    """Prompt the model with every pending question and store what it wrote. ``questions`` may have a ``dataset``
    column and ``schemas`` the schema texts by dataset and language; without them the prompt is the question.

    ``templates`` are prompt texts of your own by language, with the places ``schema`` and ``question``. ``extract`` takes the query out
    of the completion; if it is not given, for ``llm`` only. ``translator`` turns an intermediate representation into the language (what it
    fails on is kept), and ``clean`` names steps that tidy the query up."""
    pending = _keyed(pending_generate(questions, results, method, lang, model, if_exists), method, lang, model)
    pending = with_schema(pending, schemas) if schemas is not None else pending.withColumn("schema_text", F.lit(None).cast("string"))
    text = prompt(F.col("lang"), F.col("question"), F.col("schema_text"), templates)
    prompts = pending.select(*KEY, text.alias("prompt"))
    query = generation_of(F.col("content"), F.col("stats"), method == "llm" if extract is None else extract, lang, translator, clean)
    written = predict(prompts, load, KEY, workers).select(*KEY, query.alias("gen"))
    return save_generation(results, written)


def execute_stage(
    questions: DataFrame,
    results: DataFrame,
    answers: DataFrame,
    errors: DataFrame,
    method: str,
    lang: str,
    model: str,
    if_exists: str = "skip",
) -> DataFrame:
    """Store the outcome of every pending query. ``answers``: ``question_id, result ARRAY``; ``errors``:
    ``question_id, engine_error`` for the queries that failed."""
    pending = _keyed(pending_execute(questions, results, method, lang, model, if_exists).select("id"), method, lang, model)
    rows = pending.join(results.select(*KEY, "gen"), KEY).join(answers, "question_id", "left").join(errors, "question_id", "left")
    outcome = exec_outcome(F.col("gen.query"), F.col("engine_error"), F.col("result"))
    return save_execution(results, rows.select(*KEY, outcome.alias("exec")))


def execute_rows_stage(
    questions: DataFrame,
    results: DataFrame,
    answers: DataFrame,
    errors: DataFrame,
    method: str,
    lang: str,
    model: str,
    if_exists: str = "skip",
) -> tuple[DataFrame, DataFrame]:
    """Like ``execute_stage``, for answers in rows (``question_id, row_idx, answer``): returns the results, whose
    ``exec.result`` is NULL, and the answer table to store beside them, ``KEY, row_idx, answer`` of the queries that succeeded."""
    pending = _keyed(pending_execute(questions, results, method, lang, model, if_exists).select("id"), method, lang, model)
    rows = pending.join(results.select(*KEY, "gen"), KEY).join(errors, "question_id", "left")
    outcome = exec_outcome(F.col("gen.query"), F.col("engine_error"), F.lit(None).cast("array<string>"))
    outcome = outcome.withField("result", F.lit(None).cast("array<string>"))
    done = cut_lineage(rows.select(*KEY, outcome.alias("exec")))
    stored = done.filter("exec.success").select(*KEY).join(answers, "question_id").select(*KEY, "row_idx", "answer")
    return save_execution(results, done), stored


def evaluate_rows_stage(
    questions: DataFrame,
    results: DataFrame,
    answers: DataFrame,
    config: tuple[str, str, str] | None = None,
    if_exists: str = "skip",
) -> DataFrame:
    """Like ``evaluate_stage``, with the answers of ``execute_rows_stage``: lists of any length, none gathered. An execution
    that holds its list is scored by that list."""
    asked = questions.select(F.col("id").alias("question_id"), "answer")
    todo = F.col("exec").isNotNull()
    if if_exists == "skip":
        todo &= F.col("eval").isNull()
    for column, value in zip(CONFIG, config or ()):
        todo &= F.col(column) == value
    executions = results.filter(todo).join(asked.select("question_id"), "question_id", "left_semi")
    gold = asked.select("question_id", F.explode("answer").alias("answer"))
    listed = executions.filter("exec.success").select(*KEY, F.explode("exec.result").alias("answer"))
    in_rows = answers.join(executions.filter("exec.success AND exec.result IS NULL").select(*KEY), KEY, "left_semi")
    found = in_rows.select(*KEY, "answer").unionByName(listed)
    scores = score_answer_rows(executions.select(*KEY, F.col("exec.success").alias("success")), found, gold)
    joined = results.join(scores.select(*KEY, F.col("eval").alias("_scores"), F.lit(True).alias("_hit")), KEY, "left")
    return joined.select(*KEY, "gen", "exec", F.when(F.col("_hit"), F.col("_scores")).otherwise(F.col("eval")).alias("eval"))


def evaluate_stage(
    questions: DataFrame,
    results: DataFrame,
    config: tuple[str, str, str] | None = None,
    if_exists: str = "skip",
) -> DataFrame:
    """Score what has been executed, of one configuration or of all.

    Choosing the pending rows, scoring them and storing the scores is one join here: results keep their rows, and each
    pending one gets its evaluation from the question it meets.
    """
    asked = questions.select(F.col("id").alias("question_id"), "answer", F.lit(True).alias("_asked"))
    todo = F.col("exec").isNotNull() & F.col("_asked").isNotNull()
    if if_exists == "skip":
        todo &= F.col("eval").isNull()
    for column, value in zip(CONFIG, config or ()):
        todo &= F.col(column) == value
    scored = add_scores(results.join(asked, "question_id", "left").withColumn("_todo", todo), F.col("_todo"))
    return scored.select(*KEY, "gen", "exec", F.when(F.col("_todo"), F.col("scores")).otherwise(F.col("eval")).alias("eval"))
