"""Writing a stage: upsert or update by key, with the later stages cleared.

All functions return the new table. Keys are unique on both sides of each join (updates are reduced to one row per key
first), so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.model import EVAL_TYPE, EXEC_TYPE, GEN_TYPE, KEY, STAGES


def one_per_key(updates: DataFrame, value: str, order: str | None) -> DataFrame:
    """``KEY, _new, _hit``: the update with the greatest ``order`` of each key; without ``order`` several are an error."""
    several = F.raise_error(F.lit(f"several updates of {value} to one key; name the column that orders them"))
    last = F.max_by(value, order) if order else F.when(F.count(F.lit(1)) == 1, F.any_value(value)).otherwise(several)
    return updates.groupBy(*KEY).agg(last.alias("_new"), F.lit(True).alias("_hit"))


def _null(dtype) -> Column:
    return F.lit(None).cast(dtype)


def save_generation(results: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Insert or replace ``gen`` for the keys of ``updates``; their ``exec`` and ``eval`` become NULL.

    Of several updates to one key the one with the greatest ``order`` wins; without ``order`` they are an error.
    """
    hit = F.col("_hit").isNotNull()
    joined = results.join(one_per_key(updates, "gen", order), KEY, "full_outer")
    return joined.select(
        *KEY,
        F.when(hit, F.col("_new")).otherwise(F.col("gen")).alias("gen"),
        F.when(hit, _null(EXEC_TYPE)).otherwise(F.col("exec")).alias("exec"),
        F.when(hit, _null(EVAL_TYPE)).otherwise(F.col("eval")).alias("eval"),
    )


def save_execution(results: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Replace ``exec`` for the keys of ``updates`` that have a row; their ``eval`` becomes NULL."""
    hit = F.col("_hit").isNotNull()
    joined = results.join(one_per_key(updates, "exec", order), KEY, "left")
    return joined.select(
        *KEY,
        "gen",
        F.when(hit, F.col("_new")).otherwise(F.col("exec")).alias("exec"),
        F.when(hit, _null(EVAL_TYPE)).otherwise(F.col("eval")).alias("eval"),
    )


def save_evaluation(results: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Replace ``eval`` for the keys of ``updates`` that have a row."""
    joined = results.join(one_per_key(updates, "eval", order), KEY, "left")
    return joined.select(
        *KEY, "gen", "exec", F.when(F.col("_hit").isNotNull(), F.col("_new")).otherwise(F.col("eval")).alias("eval")
    )


def _of_config(method: str, lang: str, model: str) -> Column:
    return (F.col("method") == method) & (F.col("lang") == lang) & (F.col("model") == model)


def clear_stage(results: DataFrame, method: str, lang: str, model: str, stage: str = "gen") -> DataFrame:
    """Set a stage and the ones after it to NULL for one configuration. Rows stay."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {', '.join(STAGES)}")
    cleared = STAGES[STAGES.index(stage) :]
    types = {"gen": GEN_TYPE, "exec": EXEC_TYPE, "eval": EVAL_TYPE}
    hit = _of_config(method, lang, model)
    return results.withColumns({s: F.when(hit, _null(types[s])).otherwise(F.col(s)) for s in cleared})


def cleared_rows(results: DataFrame, method: str, lang: str, model: str) -> DataFrame:
    """How many rows ``clear_stage`` touches: all rows of the configuration."""
    return results.filter(_of_config(method, lang, model)).agg(F.count(F.lit(1)).alias("cleared"))
