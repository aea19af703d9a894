"""The two tables: questions, and staged results keyed by question and configuration."""

from __future__ import annotations

from pyspark.sql import types as T

# The names the data model admits.
METHODS = ("llm", "seq2seq")
LANGUAGES = ("cypher", "sparql", "gremlin")
ROLES = ("system", "user", "assistant", "tool", "developer")
STAGES = ("gen", "exec", "eval")
SPLITS = ("train", "val", "test")

CONFIG = ["method", "lang", "model"]
KEY = ["question_id", *CONFIG]

STATS_TYPE = T.StructType(
    [
        T.StructField("duration", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cached_tokens", T.LongType()),
    ]
)
GEN_TYPE = T.StructType([T.StructField("query", T.StringType()), T.StructField("stats", STATS_TYPE)])
EXEC_TYPE = T.StructType(
    [
        T.StructField("result", T.ArrayType(T.StringType())),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)
EVAL_TYPE = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("exact_match", "f1", "precision", "recall")]
)
QUESTIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.ArrayType(T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
RESULTS = T.StructType(
    [
        *[T.StructField(name, T.StringType()) for name in KEY],
        T.StructField("gen", GEN_TYPE),
        T.StructField("exec", EXEC_TYPE),
        T.StructField("eval", EVAL_TYPE),
    ]
)
EDGES = "src string, rel string, dst string"
TRIPLES = "s string, p string, o string"
