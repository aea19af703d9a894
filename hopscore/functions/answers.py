"""Answer sets: normalisation and the four scores, on arrays held in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopscore.functions.text import fold

EMPTY = "array<string>"


def answers_from_json(text: Column) -> Column:
    """A JSON list of any values as texts: strings bare, NULL kept, nested values as JSON."""
    return F.from_json(text, "array<string>")


def normalize_answers(answers: Column) -> Column:
    """The answer set, as a sorted array of folded texts without NULLs and repeats. A NULL list is the empty set."""
    given = F.filter(F.coalesce(answers, F.array().cast(EMPTY)), lambda a: a.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(given, fold)))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def exact_match(gold: Column, predicted: Column) -> Column:
    """1.0 for equal sets (two empty sets are equal), else 0.0. Takes normalised sets."""
    return F.when(gold == predicted, 1.0).otherwise(0.0)


def set_scores(hits: Column, n_gold: Column, n_predicted: Column) -> dict[str, Column]:
    """Precision, recall and F1 from the sizes of the common part and of both sets; all 0.0 if a set is empty."""
    precision, recall = ratio(hits, n_predicted), ratio(hits, n_gold)
    return {"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def precision_recall_f1(gold: Column, predicted: Column) -> dict[str, Column]:
    """Set scores of two normalised sets."""
    return set_scores(F.size(F.array_intersect(gold, predicted)), F.size(gold), F.size(predicted))


def string_match(predicted: Column, target: Column) -> Column:
    """Equality of decoded texts, apart from case and outer white space."""
    return fold(predicted) == fold(target)


def accuracy(correct: Column, total: Column) -> Column:
    """Share of correct ones, 0.0 of nothing."""
    return ratio(correct, total)
