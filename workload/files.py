"""Queries on files: each writes a form that users bring, derived from the given tables, and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.model import KEY, STAGES
from hopscore.operators import encode, vocabulary
from hopscore.operators.execution import split_traversal
from hopscore.operators.generation import split_responses
from hopscore.session import shared_path
from hopscore.sources import examples as example_source
from hopscore.sources import graph_schemas as schema_source
from hopscore.sources import questions as question_source
from hopscore.sources import results as result_source
from workload import tables, training, views
from workload.registry import Tables, query

PER_FILE = 2_000  # records of an array


def _write_arrays(records: DataFrame, number: Column, name: str) -> str:
    """JSON texts (column ``value``) as files of one array each, of at most PER_FILE records; returns the folder."""
    path = shared_path(records.sparkSession, name)
    part = F.floor(number / PER_FILE).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(number.alias("n"), "value")))
    arrays = records.groupBy(part.alias("part")).agg(
        F.concat(F.lit("[\n  "), F.array_join(F.transform(ordered, lambda r: r["value"]), ",\n  "), F.lit("\n]")).alias("value")
    )
    arrays.write.partitionBy("part").text(path)
    return path


@query(f"SELECT {tables._RECORD_SQL} FROM orders")
def read_question_arrays(t: Tables) -> DataFrame:
    """All records as array files, read back."""
    path = _write_arrays(tables._records(t), F.col("seq"), "question-arrays")
    return tables._question_columns(question_source.read_question_arrays(t.spark, path))


@query("SELECT count(*) AS records, count(DISTINCT o_custkey) AS questions, CAST(0 AS BIGINT) AS results FROM orders")
def init_tables(t: Tables) -> DataFrame:
    """Loading reports the number of records; a repeated id is stored once, and there are no results yet."""
    records = _write_arrays(tables._records(t), F.col("seq"), "init-arrays")
    questions, results = shared_path(t.spark, "init-questions"), shared_path(t.spark, "init-results")
    n = result_source.init_tables(t.spark, question_source.read_question_arrays(t.spark, records), questions, results)
    stored = t.spark.read.parquet(questions).agg(F.count(F.lit(1)).alias("questions"))
    empty = result_source.read_results(t.spark, results).agg(F.count(F.lit(1)).alias("results"))
    return stored.join(F.broadcast(empty)).select(F.lit(n).cast("long").alias("records"), "questions", "results")


@query(
    """SELECT 'nations' AS dataset, unnest(['cypher', 'gremlin']) AS lang, n_name AS name,
      unnest(['Nodes:', 'Vertices:']) AS heading FROM nation"""
)
def read_schemas(t: Tables) -> DataFrame:
    """A schema file per nation, read for two languages; a folder that is missing is left out."""
    path = shared_path(t.spark, "schemas")
    label = F.struct(F.col("n_name").alias("label"))
    document = F.to_json(F.struct(F.col("n_name").alias("name"), F.array(label).alias("nodes")))
    t.nation.select("n_nationkey", document.alias("value")).write.partitionBy("n_nationkey").text(path)
    asked = {("nations", "cypher"): path, ("nations", "gremlin"): path, ("nations", "sparql"): path + "-missing"}
    read = schema_source.read_schemas(t.spark, asked)
    heading = F.regexp_extract("schema_text", r"(?m)^(\w+:)$", 1)
    return read.select("dataset", "lang", F.get_json_object("json", "$.name").alias("name"), heading.alias("heading"))


@query(
    f"""{training._ENCODED} SELECT split, CAST(count(*) AS BIGINT) AS examples, CAST(sum(list_sum(source_mask)) AS BIGINT) AS tokens,
      CAST(any_value(v.n) AS BIGINT) AS vocabulary FROM padded, (SELECT count(*) AS n FROM vocabulary) AS v GROUP BY split"""
)
def encoded_files(t: Tables) -> DataFrame:
    """The encoded splits and their vocabulary as files, read back."""
    path = shared_path(t.spark, "encoded")
    words = vocabulary.build_vocabulary(training._tokens(t))
    example_source.write_encoded(encode.encode_examples(views.examples(t), words), words, path)
    stored = t.spark.read.parquet(path + "/examples")
    size = t.spark.read.parquet(path + "/vocabulary").agg(F.count(F.lit(1)).alias("vocabulary"))
    used = F.aggregate("source_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    counts = stored.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.sum(used).alias("tokens"))
    return counts.join(F.broadcast(size)).select("split", "examples", "tokens", "vocabulary")


@query(
    """SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, source || ' (' || lang || ')' AS input,
      text AS target, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY ALL"""
)
def dataset_hook(t: Tables) -> DataFrame:
    """Split files with a hook of the dataset: it leaves out one language and builds the input from two fields."""
    path = shared_path(t.spark, "hooked")
    record = F.to_json(F.struct("source", "lang", F.col("text").alias("LF")))
    for i, split in enumerate(("train", "val", "test")):
        own = t.documents.filter(F.col("doc_id") % 3 == i).select(record.alias("value"), "doc_id")
        if split == "val":
            own.select("value").write.text(f"{path}/{split}.jsonl")
        else:
            _copy_arrays(own, f"{path}/{split}.json")

    def hook(records: DataFrame) -> DataFrame:
        kept = records.filter(F.col("fields")["lang"] != "de")
        whole = F.concat(F.col("fields")["source"], F.lit(" ("), F.col("fields")["lang"], F.lit(")"))
        return kept.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("question"), whole)))

    read = example_source.read_examples(t.spark, path, {"input": "question", "target": "LF"}, prepare=hook)
    return read.groupBy("split", "input", "target").agg(F.count(F.lit(1)).alias("n"))


def _copy_arrays(records: DataFrame, path: str) -> None:
    part = F.floor(F.col("doc_id") / PER_FILE).cast("int")
    arrays = records.groupBy(part.alias("part")).agg(F.array_join(F.collect_list("value"), ", ").alias("listed"))
    arrays.select("part", F.concat(F.lit("["), "listed", F.lit("]")).alias("value")).write.partitionBy("part").text(path)


@query(
    f"""{tables.WITH_RESULTS}
    SELECT 'result' AS kind, question_id AS id, CASE WHEN CAST(question_id AS BIGINT) % 50 = 0 THEN 'gen' ELSE 'exec' END || ' is not a JSON object' AS problem
      FROM results WHERE CAST(question_id AS BIGINT) % 50 IN (0, 1)
    UNION ALL SELECT 'row', CAST(event_id AS VARCHAR), 'value is not JSON' FROM events WHERE event_id % 20 = 0
    UNION ALL SELECT 'response', CAST(c_custkey AS VARCHAR), 'payload is not a JSON object' FROM customer WHERE c_custkey % 30 = 0"""
)
def rejected_records(t: Tables) -> DataFrame:
    """Stored stages, traversal rows and responses that are cut off or of another kind, set apart with what is wrong."""
    number = F.col("question_id").cast("bigint") % 50
    texts = views.results(t).withColumns({s: F.to_json(F.col(s)) for s in STAGES})
    texts = texts.withColumns({"gen": F.when(number == 0, F.left("gen", F.lit(1))).otherwise(F.col("gen")), "exec": F.when(number == 1, "[1]").otherwise(F.col("exec"))})
    stored = result_source.split_stored(texts.select(*KEY, *STAGES))[1].select(F.lit("result").alias("kind"), F.col("question_id").alias("id"), "problem")
    value = F.when(F.col("event_id") % 20 == 0, '{"a": [1, ').otherwise(F.to_json(F.struct("event_type")))
    rows = split_traversal(t.events.select(F.col("event_id").cast("string").alias("id"), value.alias("value")))[1]
    known = F.when(F.col("c_custkey") % 30 == 1, "other").otherwise("openai")
    payload = F.when(F.col("c_custkey") % 30 < 2, '"output_text"').otherwise(F.to_json(F.struct(F.col("c_name").alias("output_text"))))
    log = t.customer.select(F.col("c_custkey").cast("string").alias("id"), known.alias("provider"), payload.alias("payload"))
    parts = [frame.select(F.lit(kind).alias("kind"), "id", "problem") for kind, frame in (("row", rows), ("response", split_responses(log)[1]))]
    return stored.unionByName(parts[0]).unionByName(parts[1])
