"""Vocabularies: building, looking up, inverting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopscore.functions.text import SPACE_CLASS
from hopscore.session import broadcast_if_small, cut_lineage

# The special tokens and their ids.
SPECIALS = {"<PAD>": 0, "<UNK>": 1, "<START>": 2, "<END>": 3}
PAD, UNKNOWN, START, END = SPECIALS.values()

# A token is a word or a single mark.
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^{SPACE_CLASS}\p{{L}}\p{{M}}\p{{N}}_]"

HEAD = 50_000  # vocabulary entries that may be broadcast: the most frequent ones


def tokenize(text: Column, special_tokens: Sequence[str] = ()) -> Column:
    """Lower-case words and marks of the whole text. The special tokens of a dataset stay in one piece."""
    whole = sorted({token.lower() for token in special_tokens}, key=len, reverse=True)
    pattern = "|".join([rf"\Q{token}\E" for token in whole] + [TOKEN])
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def number_rows(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, without sorting everything in one task.

    The rows are range-partitioned and sorted per partition, kept in the checkpoint folder (so partitions cannot
    differ between the two readings), and numbered by partition offset plus place. Offsets are one row per partition.
    """
    bits = 33  # monotonically_increasing_id: partition number above, place within the partition below
    ranged = cut_lineage(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", bits)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << bits) - 1) + start
    return placed.select(*rows.columns, number.alias(name))


def build_vocabulary(tokens: DataFrame, special_tokens: Sequence[str] = ()) -> DataFrame:
    """``token, idx`` from rows of ``tokens ARRAY``: the fixed special tokens and those of the dataset, then all other
    tokens by falling frequency."""
    given = list(dict.fromkeys([*SPECIALS, *[token.lower() for token in special_tokens]]))
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(~F.col("token").isin(given))
    ranked = number_rows(counts, [F.desc("n"), F.asc("token")], "idx", start=len(given))
    first = tokens.sparkSession.createDataFrame([(token, idx) for idx, token in enumerate(given)], "token string, idx long")
    return first.unionByName(ranked.select("token", "idx"))


def build_answer_vocabulary(answers: DataFrame) -> DataFrame:
    """``token, idx`` over the distinct values of ``answer``, in text order from 0."""
    tokens = answers.select(F.col("answer").alias("token")).filter(F.col("token").isNotNull()).distinct()
    return number_rows(tokens, [F.asc("token")], "idx")


def invert(vocabulary: DataFrame, key: str = "token", value: str = "idx", order: str | None = None) -> DataFrame:
    """The inverse table. Of several keys with one value the last one by ``order`` (by default, by key) is kept."""
    return vocabulary.groupBy(value).agg(F.max_by(key, order or key).alias(key))


def look_up(items: DataFrame, vocabulary: DataFrame, default: int) -> DataFrame:
    """Add ``idx`` to rows with ``token``; unknown tokens get ``default``.

    ``vocabulary`` must be numbered by falling frequency, or be small. Its first ``HEAD`` entries are broadcast (their
    number is fixed by the filter on ``idx``, their bytes are measured); they cover the tokens that are frequent enough to be hot. If there are
    more entries, only rows not found so far are shuffled to meet the rest.
    """
    head = vocabulary.filter(F.col("idx") < HEAD)
    met = items.join(broadcast_if_small(head, "token"), "token", "left")
    if vocabulary.filter(F.col("idx") >= HEAD).isEmpty():
        return met.withColumn("idx", F.coalesce("idx", F.lit(default).cast("long")))
    found = met.filter(F.col("idx").isNotNull())
    tail = vocabulary.filter(F.col("idx") >= HEAD)
    others = met.filter(F.col("idx").isNull()).drop("idx").join(tail, "token", "left")
    return found.unionByName(others.withColumn("idx", F.coalesce("idx", F.lit(default).cast("long"))))
