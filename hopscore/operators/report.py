"""Reports: statistics per configuration and per question field, and error analysis.

The scored pairs are reduced once to cells, one per configuration and combination of field values, that hold additive
measures only. Summaries and breakdowns are sums over cells, so the large table is read and shuffled once, after
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions.answers import ratio
from hopscore.functions.errors import classify_error, missing_relations
from hopscore.model import CONFIG
from hopscore.sources.questions import field_value

TOKENS = ("input_tokens", "output_tokens", "cached_tokens")
SCORES = {"avg_f1": "f1", "avg_precision": "precision", "avg_recall": "recall"}
STATS = (
    "count", "error_count", "accuracy", *SCORES, "total_duration", "avg_duration",
    *[f"total_{t}" for t in TOKENS], *[f"avg_{t}" for t in TOKENS],
)


def _measures() -> dict[str, Column]:
    """Additive measures of a scored pair. A missing execution counts as an error here."""
    succeeded = F.coalesce(F.col("exec.success"), F.lit(False))
    stats = F.col("gen.stats")
    has_stats = F.coalesce(*[stats[name].cast("double") for name in ("duration", *TOKENS)]).isNotNull()

    def total(value: Column, where: Column, zero) -> Column:
        return F.sum(F.when(where, F.coalesce(value, F.lit(zero))).otherwise(F.lit(zero)))

    return {
        "n": F.count(F.lit(1)),
        "errors": F.count_if(~succeeded),
        "correct": F.count_if(succeeded & (F.col("eval.exact_match") == 1.0)),
        **{f"sum_{score}": total(F.col(f"eval.{score}"), succeeded, 0.0) for score in SCORES.values()},
        "with_stats": F.count_if(has_stats),
        "duration": total(stats["duration"], has_stats, 0.0),
        **{token: total(stats[token], has_stats, 0) for token in TOKENS},
    }


def report_cells(pairs: DataFrame, fields: list[str], keys: list[str] = CONFIG) -> DataFrame:
    """Additive measures per configuration, combination of field values, error category and relations named missing.

    Fields are prefixed ``field:``. Category and relations are NULL but for failed executions.
    """
    failed, error = _is_failed(), F.col("exec.error")
    asked = pairs.drop(*CONFIG, "gen", "exec", "eval")  # a field is one of the question, never of the result
    ids = {"id": F.col("question_id")} if "question_id" in pairs.columns else {}
    dimensions = {f"field:{f}": ids.get(f, field_value(asked, f)).cast("string") for f in fields}
    dimensions["category"] = F.when(failed, classify_error(error))
    dimensions["relations"] = F.when(failed, missing_relations(error))
    named = pairs.select(*keys, "gen", "exec", "eval", *[d.alias(n) for n, d in dimensions.items()])
    return named.groupBy(*keys, *[f"`{n}`" for n in dimensions]).agg(*[m.alias(n) for n, m in _measures().items()])


def merge_cells(cells: DataFrame, added: DataFrame, retracted: DataFrame) -> DataFrame:
    """``cells`` with the measures of ``added`` and without those of ``retracted``; a cell without results is left out.

    Sums are decimals here (``exact_cells``), so that what is added and retracted later leaves no rounding errors.
    """
    measures = list(_measures())
    by = [f"`{c}`" for c in cells.columns if c not in measures]
    minus = exact_cells(retracted).withColumns({m: -F.col(m) for m in measures})
    every = exact_cells(cells).unionByName(exact_cells(added)).unionByName(minus)
    return exact_cells(every.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures]).filter(F.col("n") > 0))


def exact_cells(cells: DataFrame) -> DataFrame:
    """Cells whose sums of scores and durations are decimals of nine places."""
    return cells.withColumns({m: F.col(m).cast("decimal(38,9)") for m in (*[f"sum_{s}" for s in SCORES.values()], "duration")})


def _stats(cells: DataFrame, *by: str) -> DataFrame:
    whole = {"n", "errors", "correct", "with_stats", *TOKENS}
    totals = {name: F.sum(name) if name in whole else F.sum(name).cast("double") for name in _measures()}
    sums = cells.groupBy(*by).agg(*[F.coalesce(total, F.lit(0)).alias(name) for name, total in totals.items()])
    n, errors, timed = F.col("n"), F.col("errors"), F.col("with_stats")
    valid = n - errors
    columns = {
        "count": n,
        "error_count": errors,
        "accuracy": ratio(F.col("correct"), valid),
        **{name: ratio(F.col(f"sum_{score}"), valid) for name, score in SCORES.items()},
        "total_duration": F.col("duration").cast("double"),
        "avg_duration": ratio(F.col("duration"), timed),
        **{f"total_{t}": F.col(t) for t in TOKENS},
        **{f"avg_{t}": ratio(F.col(t), timed) for t in TOKENS},
    }
    return sums.select(*by, *[columns[name].alias(name) for name in STATS])


def summary(cells: DataFrame, keys: list[str] = CONFIG) -> DataFrame:
    """All statistics per configuration; without ``keys`` one row, all zeros if there are no pairs."""
    return _stats(cells, *keys)


def by_field(cells: DataFrame, fields: list[str], keys: list[str] = CONFIG) -> DataFrame:
    """All statistics per configuration, field and value (as text). A row without the field is left out of it."""
    values = [F.struct(F.lit(f).alias("field"), F.col(f"field:{f}").alias("value")) for f in fields]
    listed = F.array(*values).cast("array<struct<field string, value string>>")
    long = cells.select("*", F.inline(listed)).filter(F.col("value").isNotNull())
    return _stats(long, *keys, "field", "value")


def _is_failed() -> Column:
    """Executed without success; unlike in ``error_count``, missing executions are not among them."""
    return F.col("exec").isNotNull() & ~F.coalesce(F.col("exec.success"), F.lit(False))


def total_errors(cells: DataFrame, keys: list[str] = CONFIG) -> DataFrame:
    """Failed executions per configuration."""
    failed = F.when(F.col("category").isNotNull(), F.col("n")).otherwise(0)
    return cells.groupBy(*keys).agg(F.sum(failed).alias("total_errors"))


def error_categories(cells: DataFrame, keys: list[str] = CONFIG) -> DataFrame:
    """Failed executions per configuration and category."""
    return cells.filter(F.col("category").isNotNull()).groupBy(*keys, "category").agg(F.sum("n").alias("n"))


def unknown_relations(cells: DataFrame, keys: list[str] = CONFIG) -> DataFrame:
    """The distinct relations that error texts name as missing, per configuration."""
    return cells.select(*keys, F.explode("relations").alias("relation")).distinct()
