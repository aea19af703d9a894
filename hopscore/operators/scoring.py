"""Scoring executed results against the gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions.answers import (
    accuracy,
    exact_match,
    normalize_answers,
    set_scores,
    string_match,
)
from hopscore.functions.text import fold
from hopscore.model import EVAL_TYPE, KEY


def _score_struct(succeeded: Column, scores: dict[str, Column]) -> Column:
    return F.struct(*[F.when(succeeded, scores[name]).alias(name) for name in EVAL_TYPE.names])


def add_scores(pairs: DataFrame, where: Column | None = None) -> DataFrame:
    """Add ``scores`` to rows with ``answer`` and ``exec``, row by row.

    A failed or missing execution has a struct without scores, not a NULL; so has a row outside ``where``. Sets and
    their sizes are columns of their own on the way, so each is worked out once and only where it is needed.
    """
    succeeded = F.coalesce(F.col("exec.success"), F.lit(False))
    counted = succeeded if where is None else succeeded & where
    sets = pairs.withColumns(
        {
            "_gold": F.when(counted, normalize_answers(F.col("answer"))),
            "_predicted": F.when(counted, normalize_answers(F.col("exec.result"))),
        }
    )
    sizes = sets.withColumns(
        {
            "_same": exact_match(F.col("_gold"), F.col("_predicted")),
            "_hits": F.size(F.array_intersect("_gold", "_predicted")),
            "_n_gold": F.size("_gold"),
            "_n_predicted": F.size("_predicted"),
        }
    )
    scores = {"exact_match": F.col("_same"), **set_scores(F.col("_hits"), F.col("_n_gold"), F.col("_n_predicted"))}
    scored = sizes.withColumn("scores", _score_struct(F.col("_gold").isNotNull(), scores))
    return scored.select(*pairs.columns, "scores")


def pair_results(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results with their question's fields. A result without a question is left out."""
    return results.join(questions, results["question_id"] == questions["id"], "inner").drop(questions["id"])


def evaluate_pairs(pairs: DataFrame) -> DataFrame:
    """Results already joined with their questions, with ``eval`` worked out afresh: scores and report in one join."""
    return add_scores(pairs).withColumn("eval", F.col("scores")).drop("scores")


def score_results(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``key, eval`` for every result that has a question."""
    paired = pair_results(results.select(*KEY, "exec"), questions.select("id", "answer"))
    return add_scores(paired).select(*KEY, F.col("scores").alias("eval"))


def score_answer_rows(executions: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """The same scores with one answer per row, for answer lists of any length.

    ``executions``: key and ``success``, one row per result. ``predicted``: key and ``answer``. ``gold``:
    ``question_id, answer``. Repeats go away before the shuffle, and the shuffles are keyed by answer as well, so a
    question that holds most of the rows is spread over all tasks; only counts meet per result.
    """

    def distinct(rows: DataFrame, keys: list[str]) -> DataFrame:
        folded = rows.filter(F.col("answer").isNotNull()).select(*keys, fold(F.col("answer")).alias("answer"))
        return folded.distinct()

    right = distinct(gold, ["question_id"])
    hits = distinct(predicted, KEY).join(right.withColumn("hit", F.lit(1)), ["question_id", "answer"], "left")
    n_predicted = hits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_predicted"), F.count("hit").alias("hits"))
    n_gold = right.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"))
    sizes = executions.join(n_predicted, KEY, "left").join(n_gold, "question_id", "left").fillna(0, ["n_predicted", "hits", "n_gold"])
    hit, found, wanted = F.col("hits"), F.col("n_predicted"), F.col("n_gold")
    scores = {
        "exact_match": F.when((hit == found) & (hit == wanted), 1.0).otherwise(0.0),
        **set_scores(hit, wanted, found),
    }
    return sizes.select(*KEY, _score_struct(F.coalesce("success", F.lit(False)), scores).alias("eval"))


def text_accuracy(decoded: DataFrame, predicted: str, target: str, *by: str) -> DataFrame:
    """Share of decoded texts that equal their target, apart from case and outer white space."""
    correct = F.count_if(string_match(F.col(predicted), F.col(target)))
    total = F.count(F.lit(1))
    return decoded.groupBy(*by).agg(
        total.alias("total"), correct.alias("correct"), accuracy(correct, total).alias("accuracy")
    )
