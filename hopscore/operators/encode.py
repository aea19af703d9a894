"""Training examples as padded id arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.model import SPLITS
from hopscore.operators.vocabulary import END, PAD, START, UNKNOWN, look_up, tokenize

IGNORED = -100  # Fixed value: the label a loss function leaves out.
ANSWER_DEFAULT = 0  # Fixed value: the id of an unknown or absent choice or answer.


def split_lengths(examples: DataFrame, special_tokens: Sequence[str] = ()) -> DataFrame:
    """``split, max_length``: the longest input or target of each split, with its start and end marks. The splits are
    the three known ones, so this is at most three rows; any other name is an error."""
    longest = F.greatest(*[F.size(tokenize(F.col(c), special_tokens)) for c in ("input", "target")])
    unknown = F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce("split", F.lit("NULL"))))
    split = F.when(F.col("split").isin(*SPLITS), F.col("split")).otherwise(unknown).alias("split")
    lengths = examples.groupBy(split).agg((F.max(longest) + 2).alias("max_length"))
    return lengths.filter(F.col("split").isin(*SPLITS))


def _gather(rows: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """Rows of ``field, pos, idx`` back to one array of ids per field, in order. A row goes back to the example that
    its text came from, so no array outgrows the row it was cut from."""
    placed = F.struct("pos", F.col("idx").cast("int").alias("idx"))

    def ids(field: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, placed))), lambda p: p["idx"])

    return rows.groupBy(*keys).agg(*[ids(field).alias(field) for field in fields])


def _items(**fields: Column) -> Column:
    """One array of ``struct<field, pos, token>`` over several token arrays."""

    def tagged(field: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), t.alias("token")))

    return F.concat(*[tagged(field, tokens) for field, tokens in fields.items()])


def encode_ids(examples: DataFrame, vocabulary: DataFrame, special_tokens: Sequence[str] = ()) -> DataFrame:
    """``split, example_id, source_ids, target_ids`` without padding, each between start and end marks."""
    keys = ["split", "example_id"]
    source, target = (tokenize(F.col(c), special_tokens) for c in ("input", "target"))
    items = examples.select(*keys, F.inline_outer(_items(source=source, target=target)))
    gathered = _gather(look_up(items, vocabulary, UNKNOWN), keys, "source", "target")
    marks = F.array(F.lit(START)), F.array(F.lit(END))
    return gathered.select(
        *keys,
        F.concat(marks[0], "source", marks[1]).alias("source_ids"),
        F.concat(marks[0], "target", marks[1]).alias("target_ids"),
    )


def pad(ids: Column, length: Column) -> Column:
    """Cut or fill up to ``length``."""
    return F.concat(F.slice(ids, F.lit(1), length), F.array_repeat(F.lit(PAD), F.greatest(length - F.size(ids), F.lit(0))))


def mask(ids: Column, length: Column) -> Column:
    """1 for each id, 0 for each pad."""
    kept = F.least(F.size(ids), length)
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), length - kept))


def encode_examples(examples: DataFrame, vocabulary: DataFrame, special_tokens: Sequence[str] = ()) -> DataFrame:
    """``split, example_id, source_ids, source_mask, target_ids``, padded to the longest sequence of the split."""
    lengths = F.broadcast(split_lengths(examples, special_tokens))
    padded = encode_ids(examples, vocabulary, special_tokens).join(lengths, "split")
    length = F.col("max_length")
    return padded.select(
        "split",
        "example_id",
        pad(F.col("source_ids"), length).alias("source_ids"),
        mask(F.col("source_ids"), length).alias("source_mask"),
        pad(F.col("target_ids"), length).alias("target_ids"),
    )


def encode_choices(examples: DataFrame, answer_vocabulary: DataFrame) -> DataFrame:
    """``split, example_id, choices, answer`` as ids. An example without both has ``[0]`` and 0, so that every example
    has one row and rows stay aligned."""
    keys = ["split", "example_id"]
    both = F.col("choices").isNotNull() & F.col("answer").isNotNull()
    items = examples.select(
        *keys, F.inline_outer(F.when(both, _items(choices=F.col("choices"), answer=F.array("answer"))))
    )
    gathered = _gather(look_up(items, answer_vocabulary, ANSWER_DEFAULT), keys, "choices", "answer")
    default = F.lit(ANSWER_DEFAULT)
    return gathered.select(
        *keys,
        F.when(F.size("answer") > 0, F.col("choices")).otherwise(F.array(default)).alias("choices"),
        F.coalesce(F.get("answer", F.lit(0)), default).alias("answer"),
    )


def decoder_labels(encoded: DataFrame) -> DataFrame:
    """Decoder input (targets without their last id) and labels (without their first; pads ignored by the loss)."""
    target = F.col("target_ids")
    shorter = F.size(target) - 1
    labels = F.transform(F.slice(target, F.lit(2), shorter), lambda t: F.when(t == PAD, IGNORED).otherwise(t))
    return encoded.select(
        "split", "example_id", F.slice(target, F.lit(1), shorter).alias("decoder_input_ids"), labels.alias("labels")
    )
