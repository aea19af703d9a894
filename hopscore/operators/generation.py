"""The generate stage: user models as batch functions, logged responses, and translation of what they wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopscore.functions.providers import is_response, parse_response
from hopscore.functions.text import clean_query, extract_query
from hopscore.model import STATS_TYPE

RELEASE = 8  # batches after which a worker gives freed memory back

Batch = pd.DataFrame
Model = Callable[[Batch], Batch]


def predict(prompts: DataFrame, load: Callable[[], Model], keep: list[str], workers: int | None = None) -> DataFrame:
    """Run a user model over all rows: ``keep`` columns, ``content`` and ``stats``.

    ``load`` is called once per task and returns a function from a batch (columns ``keep`` and ``prompt``) to a frame
    with ``content`` and, if it has them, ``duration`` and the token counts. ``workers`` deals the rows out evenly to
    that many tasks; without it the tasks are those of the plan, which may be few when rows are few and calls are slow.
    What a worker has freed goes back to the system every few batches, else its memory grows with the rows of a task.
    """
    stats, often = STATS_TYPE.names, RELEASE
    fields = [prompts.schema[c] for c in keep] + [T.StructField("content", T.StringType()), *STATS_TYPE.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ctypes
        import gc

        import pyarrow

        model = load()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        for number, batch in enumerate(batches, 1):
            if number % often == 0:
                gc.collect()
                pyarrow.default_memory_pool().release_unused()
                if trim is not None:
                    trim(0)
            out = model(batch)
            columns = {c: batch[c].to_numpy() for c in keep}
            columns["content"] = out["content"].to_numpy()
            for name in stats:
                columns[name] = out[name].to_numpy() if name in out else [None] * len(batch)
            yield pd.DataFrame(columns)

    asked = prompts.select(*keep, "prompt")
    done = (asked.repartition(workers) if workers else asked).mapInPandas(run, T.StructType(fields))
    measured = F.coalesce(*[F.col(c).cast("double") for c in stats]).isNotNull()
    return done.select(*keep, "content", F.when(measured, F.struct(*stats)).alias("stats"))


def generation_of(
    content: Column,
    stats: Column,
    extract: bool = True,
    lang: str | None = None,
    translator: Callable[[str], str] | None = None,
    clean: Sequence[str] = (),
) -> Column:
    """The stored generation and the model's stats: the query inside the completion (or all of it), translated to ``lang`` from an
    intermediate representation if there is a ``translator``, and cleaned up by the named steps."""
    query = extract_query(content) if extract else content
    query = translate(query, lang, translator) if translator and lang else query
    return F.struct(clean_query(query, list(clean)).alias("query"), stats.alias("stats"))


def response_columns(log: DataFrame, keep: list[str]) -> DataFrame:
    """Logged provider responses (``provider, payload``) to ``content`` and token counts."""
    parsed = log.select(*keep, parse_response(F.col("provider"), F.col("payload")).alias("response"))
    return parsed.select(*keep, "response.*")


def split_responses(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` logged responses; rejected ones have a ``problem``."""
    good = F.coalesce(is_response(F.col("provider"), F.col("payload")), F.lit(True))
    return log.filter(good), log.filter(~good).withColumn("problem", F.lit("payload is not a JSON object"))


# The languages an intermediate representation can be translated to.
TRANSLATABLE = ("cypher", "sparql", "kopl")


def translate(text: Column, lang: str, translator: Callable[[str], str]) -> Column:
    """Translate an intermediate representation. What fails to translate, and any other language, stays as it is."""
    if lang not in TRANSLATABLE:
        return text

    def batch(texts: pd.Series) -> pd.Series:
        def one(source):
            try:
                return translator(source)
            except Exception:
                return source

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(batch, T.StringType())(text)
