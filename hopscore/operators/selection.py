"""Which rows each stage still has to do, which ones it skips and why, and which rows are valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.model import LANGUAGES, METHODS, ROLES
from hopscore.sources.results import results_of_config


def _ids(results: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = results if condition is None else results.filter(condition)
    return rows.select(F.col("question_id").alias("id"))


def _check(if_exists: str) -> bool:
    if if_exists not in ("skip", "override"):
        raise ValueError(f"if_exists must be skip or override, not {if_exists!r}")
    return if_exists == "skip"


def pending_generate(
    questions: DataFrame,
    results: DataFrame,
    method: str,
    lang: str,
    model: str,
    if_exists: str = "skip",
    regenerate_cleared: bool = False,
) -> DataFrame:
    """Questions without a result row. A row whose generation was cleared still counts as one, unless
    ``regenerate_cleared`` is set."""
    if not _check(if_exists):
        return questions
    done = F.col("gen").isNotNull() if regenerate_cleared else None
    return questions.join(_ids(results_of_config(results, method, lang, model), done), "id", "left_anti")


def pending_execute(
    questions: DataFrame, results: DataFrame, method: str, lang: str, model: str, if_exists: str = "skip"
) -> DataFrame:
    """Questions with a result row (whatever is in it) that have not been executed."""
    todo = F.col("exec").isNull() if _check(if_exists) else None
    return questions.join(_ids(results_of_config(results, method, lang, model), todo), "id", "left_semi")


def pending_evaluate(
    questions: DataFrame, results: DataFrame, method: str, lang: str, model: str, if_exists: str = "skip"
) -> DataFrame:
    """Questions that have been executed but not evaluated. An evaluation without scores counts as one."""
    todo = F.col("exec").isNotNull()
    if _check(if_exists):
        todo &= F.col("eval").isNull()
    return questions.join(_ids(results_of_config(results, method, lang, model), todo), "id", "left_semi")


def skip_counts(questions: DataFrame, results: DataFrame, method: str, lang: str, model: str) -> DataFrame:
    """Per stage: questions skipped for want of the stage before, skipped as done, and still pending."""
    rows = results_of_config(results, method, lang, model).select(
        F.col("question_id").alias("id"),
        F.lit(True).alias("row"),
        F.col("exec").isNotNull().alias("executed"),
        F.col("eval").isNotNull().alias("evaluated"),
    )
    flags = ("row", "executed", "evaluated")
    state = questions.select("id").join(rows, "id", "left").select(
        *[F.coalesce(flag, F.lit(False)).alias(flag) for flag in flags]
    )
    row, executed, evaluated = (F.col(flag) for flag in flags)
    reasons = {
        "generate": (F.lit(False), row),
        "execute": (~row, row & executed),
        "evaluate": (~executed, executed & evaluated),
    }
    counts = [
        F.struct(
            F.lit(stage).alias("stage"),
            F.count_if(early).alias("no_upstream"),
            F.count_if(done).alias("already_done"),
            F.count_if(~early & ~done).alias("pending"),
        )
        for stage, (early, done) in reasons.items()
    ]
    return state.agg(F.array(*counts).alias("stages")).select(F.inline("stages"))


# The rules a column must keep, by column name.
ALLOWED = {"method": METHODS, "lang": LANGUAGES, "role": ROLES}
REQUIRED = ("id", "question_id")


def check_rows(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``problem``: the first broken rule of a row, or NULL. ``strict`` makes a broken rule an error."""
    rules = [(F.col(c).isNull(), f"{c} is missing") for c in REQUIRED if c in rows.columns]
    rules += [
        (~F.coalesce(F.col(c).isin(*names), F.lit(False)), f"{c} is not allowed")
        for c, names in ALLOWED.items()
        if c in rows.columns
    ]
    problem = reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(problem)).cast("string")
    return rows.withColumn("problem", problem)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; rejected rows keep the ``problem`` column."""
    checked = check_rows(rows)
    return checked.filter(F.col("problem").isNull()).drop("problem"), checked.filter(F.col("problem").isNotNull())
