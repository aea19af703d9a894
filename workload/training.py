"""Queries on training examples: reading, vocabulary, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions.text import SPACES
from hopscore.operators import encode, vocabulary
from hopscore.sources.examples import examples_from_json
from workload import views
from workload.registry import Tables, query

# Words and marks, as in SQL regular expressions.
_SPACE = "".join(rf"\x{{{ord(space):x}}}" for space in SPACES)
_TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^{_SPACE}\p{{L}}\p{{M}}\p{{N}}_]"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{_TOKEN}')"


WITH_TOKENS = f"""WITH {views.SQL_EXAMPLES},
tokens AS (SELECT split, example_id, {_words('input')} AS source, {_words('target')} AS target FROM examples)"""
WITH_VOCABULARY = f"""{WITH_TOKENS},
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(source) AS token FROM tokens UNION ALL SELECT unnest(target) FROM tokens) GROUP BY 1),
vocabulary AS (
  SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS BIGINT) AS idx FROM counts
  UNION ALL SELECT unnest(['<PAD>', '<UNK>', '<START>', '<END>']), unnest([0, 1, 2, 3]))"""


def _tokens(t: Tables) -> DataFrame:
    both = views.examples(t).select(F.explode(F.array("input", "target")).alias("text"))
    return both.select(vocabulary.tokenize(F.col("text")).alias("tokens"))


def _text(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


@query(
    """SELECT split, CAST(regexp_extract(input, '^\\d+') AS BIGINT) AS example, input, target, n_choices, answer FROM (
      SELECT list_extract(['train', 'val', 'test'], CAST(doc_id % 3 + 1 AS INTEGER)) AS split, doc_id || ': ' || source AS input, text AS target,
        CASE WHEN doc_id % 2 = 0 THEN 2 END AS n_choices, CASE WHEN doc_id % 2 = 0 THEN lang END AS answer FROM documents)"""
)
def read_examples(t: Tables) -> DataFrame:
    """Records with field names of their own, mapped to examples; some have choices and an answer."""
    record = F.to_json(
        F.struct(
            F.concat(F.col("doc_id").cast("string"), F.lit(": "), "source").alias("question"),
            F.col("text").alias("LF"),
            F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).alias("options"),
            F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("gold"),
        )
    )
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("doc_id") % 3 + 1).cast("int"))
    files = t.documents.select(split.alias("split"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record).alias("value"))
    columns = {"input": "question", "target": "LF", "choices": "options", "answer": "gold"}
    return examples_from_json(files, columns).select(
        "split",
        F.regexp_extract("input", r"^\d+", 0).cast("bigint").alias("example"),
        "input",
        "target",
        F.when(F.col("choices").isNotNull(), F.size("choices")).alias("n_choices"),
        "answer",
    )


@query(f"{WITH_VOCABULARY} SELECT token, idx FROM vocabulary")
def build_vocabulary(t: Tables) -> DataFrame:
    return vocabulary.build_vocabulary(_tokens(t))


@query(f"{WITH_TOKENS}, words AS (SELECT unnest(source) AS token FROM tokens) SELECT CAST(length(token) AS INTEGER) AS n, max(token) AS token FROM words GROUP BY 1")
def invert_vocabulary(t: Tables) -> DataFrame:
    """Words by length: many words per length, of which the last one stays."""
    words = views.examples(t).select(F.explode(vocabulary.tokenize(F.col("input"))).alias("token"))
    return vocabulary.invert(words.withColumn("n", F.length("token")), "token", "n")


@query(f"{WITH_TOKENS} SELECT split, CAST(max(greatest(len(source), len(target))) + 2 AS INTEGER) AS max_length FROM tokens GROUP BY split")
def split_lengths(t: Tables) -> DataFrame:
    return encode.split_lengths(views.examples(t))


_ENCODED = f"""{WITH_VOCABULARY},
lengths AS (SELECT split, max(greatest(len(source), len(target))) + 2 AS n FROM tokens GROUP BY split),
long AS (
  SELECT split, example_id, 'source' AS field, unnest(source) AS token, generate_subscripts(source, 1) AS pos FROM tokens
  UNION ALL SELECT split, example_id, 'target', unnest(target), generate_subscripts(target, 1) FROM tokens),
ids AS (
  SELECT split, example_id, list(idx ORDER BY pos) FILTER (WHERE field = 'source') AS source, list(idx ORDER BY pos) FILTER (WHERE field = 'target') AS target
  FROM long JOIN vocabulary USING (token) GROUP BY split, example_id),
padded AS (
  SELECT split, example_id, list_resize([2] || source || [3], n, 0) AS source_ids, list_resize([2] || target || [3], n, 0) AS target_ids,
    list_resize(list_transform([2] || source || [3], lambda x: 1), n, 0) AS source_mask FROM ids JOIN lengths USING (split))"""


@query(
    f"""{_ENCODED} SELECT split, example_id, array_to_string(source_ids, ' ') AS source_ids, array_to_string(source_mask, ' ') AS source_mask,
      array_to_string(target_ids, ' ') AS target_ids FROM padded"""
)
def encode_examples(t: Tables) -> DataFrame:
    encoded = encode.encode_examples(views.examples(t), vocabulary.build_vocabulary(_tokens(t)))
    return encoded.select("split", "example_id", *[_text(c).alias(c) for c in ("source_ids", "source_mask", "target_ids")])


@query(
    f"""{_ENCODED} SELECT split, example_id, array_to_string(target_ids[:-2], ' ') AS decoder_input_ids,
      array_to_string(list_transform(target_ids[2:], lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS labels FROM padded"""
)
def decoder_labels(t: Tables) -> DataFrame:
    encoded = encode.encode_examples(views.examples(t), vocabulary.build_vocabulary(_tokens(t)))
    labels = encode.decoder_labels(encoded)
    return labels.select("split", "example_id", *[_text(c).alias(c) for c in ("decoder_input_ids", "labels")])


@query(
    """WITH answers AS (SELECT DISTINCT unnest([lang, source]) AS token FROM documents),
    vocabulary AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM answers)
    SELECT doc_id AS example_id, CASE WHEN l.quality IS NULL THEN '0' ELSE a.idx || ' 0 ' || b.idx END AS choices,
      CAST(CASE WHEN l.quality IS NULL THEN 0 ELSE a.idx END AS INTEGER) AS answer
    FROM documents d LEFT JOIN labels l USING (doc_id) JOIN vocabulary a ON a.token = d.lang JOIN vocabulary b ON b.token = d.source"""
)
def encode_choices(t: Tables) -> DataFrame:
    """Labelled documents have choices (one of them unknown) and an answer, the others have neither."""
    names = t.documents.select(F.explode(F.array("lang", "source")).alias("answer"))
    labelled = F.col("quality").isNotNull()
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left").select(
        F.lit("train").alias("split"),
        F.col("doc_id").alias("example_id"),
        F.when(labelled, F.array("lang", F.lit("unknown name"), "source")).alias("choices"),
        F.when(labelled, F.col("lang")).alias("answer"),
    )
    encoded = encode.encode_choices(rows, vocabulary.build_answer_vocabulary(names))
    return encoded.select("example_id", _text("choices").alias("choices"), "answer")
