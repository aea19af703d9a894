"""Queries on the two tables: loading, lookups, pending rows, stage updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscore.model import EVAL_TYPE, EXEC_TYPE, GEN_TYPE, KEY, STAGES, STATS_TYPE
from hopscore.operators import selection, staging
from hopscore.sources import questions as question_source
from hopscore.session import shared_path
from hopscore.sources import results as result_source
from hopscore.sources.result_store import ResultStore
from workload import views
from workload.registry import Tables, query

CONFIG = ("llm", "cypher", "gpt-4o")
SQL_CONFIG = "method = 'llm' AND lang = 'cypher' AND model = 'gpt-4o'"
WITH_QUESTIONS = f"WITH {views.SQL_QUESTIONS}"
WITH_RESULTS = f"WITH {views.SQL_RESULTS}"

FLAT = ", ".join(
    [*KEY, "query", "duration", "input_tokens", "output_tokens", "cached_tokens", "success", "error"]
)


def flat(results: DataFrame) -> DataFrame:
    """Results with plain columns, as the SQL side has them."""
    return results.select(
        *KEY,
        "gen.query",
        *[F.col(f"gen.stats.{name}").alias(name) for name in STATS_TYPE.names],
        "exec.success",
        "exec.error",
        F.array_join(F.array_sort("exec.result"), "|").alias("answers"),
        F.col("eval").isNotNull().alias("evaluated"),
        F.col("eval.f1").alias("f1"),
    )


SQL_FLAT = f"""SELECT {FLAT}, array_to_string(list_sort(result), '|') AS answers, evaluated,
  CASE WHEN evaluated THEN CAST(0.5 AS DOUBLE) END AS f1 FROM results"""


def _records(t: Tables) -> DataFrame:
    """Question records as JSON: one per order, with its customer as the id, so most ids come many times."""
    record = F.format_string(
        '{"id": "c%d", "question": "Status of order %d?", "answer": ["%s", %s, null, %s, ["%s", 1]]%s}',
        "o_custkey",
        "o_orderkey",
        "o_orderstatus",
        F.col("o_totalprice").cast("string"),
        F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"),
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", "").otherwise(
            F.concat(F.lit(', "hop": '), F.left("o_orderpriority", F.lit(1)), F.lit(', "split": "'), "o_orderstatus", F.lit('"'))
        ),
    )
    return t.orders.select(record.alias("value"), F.col("o_orderkey").alias("seq"))


_RECORD_SQL = """
  'c' || o_custkey AS id, 'Status of order ' || o_orderkey || '?' AS question,
  o_orderstatus || '|' || o_totalprice || '|NULL|' || (o_orderkey % 2 = 0) || '|["' || o_orderpriority || '",1]' AS answers,
  CASE WHEN o_orderstatus <> 'P' THEN substr(o_orderpriority, 1, 1) END AS hop,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS split, o_orderstatus = 'P' AS bare"""


def _question_columns(questions: DataFrame) -> DataFrame:
    return questions.select(
        "id",
        "question",
        F.array_join("answer", "|", "NULL").alias("answers"),
        question_source.field_value(questions, "hop").alias("hop"),
        question_source.field_value(questions, "split").alias("split"),
        F.col("extra").isNull().alias("bare"),
    )


@query(f"SELECT {_RECORD_SQL} FROM orders")
def scan_questions(t: Tables) -> DataFrame:
    return _question_columns(question_source.parse_questions(_records(t)))


@query(
    f"""SELECT * EXCLUDE (o_orderkey) FROM (
      SELECT {_RECORD_SQL}, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"""
)
def questions_last_wins(t: Tables) -> DataFrame:
    parsed = question_source.parse_questions(_records(t), order="seq")
    return _question_columns(question_source.latest_questions(parsed, "seq"))


@query(f"{WITH_QUESTIONS} SELECT id, question, hop, split FROM questions WHERE hop = '1' AND split = 'F'")
def filter_questions(t: Tables) -> DataFrame:
    found = question_source.filter_questions(views.questions(t), hop=1, split="F", tier=None)
    return question_source.promote_fields(found, "hop", "split").select("id", "question", "hop", "split")


@query(
    f"""{WITH_QUESTIONS} SELECT id, question AS asked, hop, coalesce(tier, 'low') AS tier, CAST(NULL AS VARCHAR) AS missing
    FROM questions"""
)
def field_access(t: Tables) -> DataFrame:
    questions = views.questions(t)
    field = question_source.field_value
    return questions.select(
        "id",
        field(questions, "question").alias("asked"),
        field(questions, "hop").alias("hop"),
        field(questions, "tier", "low").alias("tier"),
        field(questions, "missing").alias("missing"),
    )


def _asked(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") * 11).cast("string").alias("id"))


_ASKED = "SELECT CAST(c_custkey * 11 AS VARCHAR) AS id FROM customer"


@query(f"{WITH_QUESTIONS} SELECT id, question FROM questions WHERE id IN ({_ASKED})")
def find_questions(t: Tables) -> DataFrame:
    return question_source.find_questions(views.questions(t), _asked(t)).select("id", "question")


@query(f"{WITH_QUESTIONS} SELECT a.id, q.id IS NOT NULL AS found FROM ({_ASKED}) a LEFT JOIN questions q ON q.id = a.id")
def questions_exist(t: Tables) -> DataFrame:
    return question_source.questions_exist(views.questions(t), _asked(t))


@query(f"{WITH_RESULTS} SELECT (SELECT count(*) FROM questions) AS questions, (SELECT count(*) FROM results) AS results")
def count_rows(t: Tables) -> DataFrame:
    counts = [
        rows.select(F.lit(name).alias("name")) for name, rows in (("questions", views.questions(t)), ("results", views.results(t)))
    ]
    both = counts[0].unionByName(counts[1])
    return both.agg(*[F.count_if(F.col("name") == name).alias(name) for name in ("questions", "results")])


@query(f"{WITH_RESULTS} {SQL_FLAT}")
def scan_results(t: Tables) -> DataFrame:
    stored = views.results(t).withColumns({s: F.to_json(F.col(s)) for s in STAGES})
    return flat(result_source.decode_results(stored))


@query(f"{WITH_RESULTS} {SQL_FLAT} WHERE {SQL_CONFIG}")
def results_of_config(t: Tables) -> DataFrame:
    return flat(result_source.results_of_config(views.results(t), *CONFIG))


@query(f"{WITH_RESULTS} {SQL_FLAT} WHERE question_id IN ({_ASKED})")
def results_of_questions(t: Tables) -> DataFrame:
    return flat(result_source.results_of_questions(views.results(t), _asked(t)))


@query(
    f"""{WITH_RESULTS} SELECT id AS question_id, 'llm' AS method, 'cypher' AS lang, 'gpt-4o' AS model, r.model IS NOT NULL AS found
    FROM ({_ASKED}) a LEFT JOIN results r ON question_id = id AND {SQL_CONFIG}"""
)
def results_exist(t: Tables) -> DataFrame:
    method, lang, model = map(F.lit, CONFIG)
    keys = _asked(t).select(
        F.col("id").alias("question_id"), method.alias("method"), lang.alias("lang"), model.alias("model")
    )
    return result_source.results_exist(views.results(t), keys)


@query(
    f"""{WITH_RESULTS} SELECT question_id, method, lang, model, query, success, error, CAST(coalesce(len(result), -1) AS INTEGER) AS n_answers,
      CASE WHEN evaluated THEN CAST(0.5 AS DOUBLE) END AS f1, CASE WHEN evaluated THEN 4 ELSE 0 END AS scores_written,
      CASE WHEN executed THEN 0 ELSE 1 END AS null_exec FROM results"""
)
def export_results(t: Tables) -> DataFrame:
    """The exported JSON, read back piece by piece; NULL stages must be written out."""
    exported = result_source.result_json(views.results(t).withColumn("eval", F.col("eval").cast(EVAL_TYPE)))
    text = F.col("json")

    def piece(path: str):
        return F.get_json_object(text, path)

    return exported.select(
        *KEY,
        piece("$.gen.query").alias("query"),
        piece("$.exec.success").cast("boolean").alias("success"),
        piece("$.exec.error").alias("error"),
        F.coalesce(F.json_array_length(piece("$.exec.result")), F.lit(-1)).alias("n_answers"),
        piece("$.eval.f1").cast("double").alias("f1"),
        F.regexp_count(text, F.lit(r'"(exact_match|f1|precision|recall)":')).alias("scores_written"),
        F.regexp_count(text, F.lit('"exec":null')).alias("null_exec"),
    )


# Pending rows


@query(f"{WITH_RESULTS} SELECT id, question FROM questions WHERE id NOT IN (SELECT question_id FROM results WHERE {SQL_CONFIG})")
def pending_generate(t: Tables) -> DataFrame:
    return selection.pending_generate(views.questions(t), views.results(t), *CONFIG).select("id", "question")


@query(
    f"""{WITH_RESULTS} SELECT id, question FROM questions
    WHERE id IN (SELECT question_id FROM results WHERE {SQL_CONFIG} AND NOT executed)"""
)
def pending_execute(t: Tables) -> DataFrame:
    return selection.pending_execute(views.questions(t), views.results(t), *CONFIG).select("id", "question")


@query(f"{WITH_RESULTS} SELECT id, question FROM questions WHERE id IN (SELECT question_id FROM results WHERE {SQL_CONFIG})")
def pending_execute_override(t: Tables) -> DataFrame:
    pending = selection.pending_execute(views.questions(t), views.results(t), *CONFIG, if_exists="override")
    return pending.select("id", "question")


@query(
    f"""{WITH_RESULTS} SELECT id, question FROM questions
    WHERE id IN (SELECT question_id FROM results WHERE {SQL_CONFIG} AND executed AND NOT evaluated)"""
)
def pending_evaluate(t: Tables) -> DataFrame:
    return selection.pending_evaluate(views.questions(t), views.results(t), *CONFIG).select("id", "question")


@query(
    f"""{WITH_RESULTS}, state AS (
      SELECT r.question_id IS NOT NULL AS has_row, coalesce(executed, false) AS executed, coalesce(evaluated, false) AS evaluated
      FROM questions LEFT JOIN (SELECT * FROM results WHERE {SQL_CONFIG}) r ON question_id = id)
    SELECT 'generate' AS stage, 0 AS no_upstream, count(*) FILTER (WHERE has_row) AS already_done, count(*) FILTER (WHERE NOT has_row) AS pending FROM state
    UNION ALL SELECT 'execute', count(*) FILTER (WHERE NOT has_row), count(*) FILTER (WHERE executed), count(*) FILTER (WHERE has_row AND NOT executed) FROM state
    UNION ALL SELECT 'evaluate', count(*) FILTER (WHERE NOT executed), count(*) FILTER (WHERE evaluated), count(*) FILTER (WHERE executed AND NOT evaluated) FROM state"""
)
def skip_counts(t: Tables) -> DataFrame:
    return selection.skip_counts(views.questions(t), views.results(t), *CONFIG)


@query(
    """SELECT conv_id, turn, CASE WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant', 'tool', 'developer')
      THEN 'role is not allowed' END AS problem FROM conversations"""
)
def check_roles(t: Tables) -> DataFrame:
    return selection.check_rows(t.conversations).select("conv_id", "turn", "problem")


@query(
    """SELECT doc_id, CASE WHEN lang NOT IN ('cypher', 'sparql', 'gremlin') THEN 'lang is not allowed' END AS problem
    FROM documents"""
)
def rejected_languages(t: Tables) -> DataFrame:
    return selection.split_valid(t.documents.select("doc_id", "lang"))[1].select("doc_id", "problem")


# Stage updates: each shipped order gets two updates, of which the later one counts.


def _updates(t: Tables, stage: str) -> DataFrame:
    method, lang, model = map(F.lit, CONFIG)
    shipped = t.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").cast("string").alias("question_id"),
        method.alias("method"),
        lang.alias("lang"),
        model.alias("model"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"),
    )
    text = F.concat(F.lit("version "), F.col("seq").cast("string"))
    value = {
        "gen": F.struct(text.alias("query"), F.lit(None).cast(STATS_TYPE).alias("stats")).cast(GEN_TYPE),
        "exec": F.struct(F.array(text).alias("result"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error")).cast(EXEC_TYPE),
        "eval": F.struct(*[F.col("seq").cast("double").alias(n) for n in EVAL_TYPE.names]).cast(EVAL_TYPE),
    }[stage]
    return shipped.withColumn(stage, value)


_UPDATED = f"""updated AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS question_id, 'llm' AS method, 'cypher' AS lang, 'gpt-4o' AS model
  FROM orders WHERE o_orderstatus = 'F'),
state AS (SELECT r.*, array_to_string(list_sort(result), '|') AS answers, CASE WHEN evaluated THEN CAST(0.5 AS DOUBLE) END AS f1,
  {SQL_CONFIG} AND question_id IN (SELECT question_id FROM updated) AS hit FROM results r)"""
_NULLED = {
    "query": "CAST(NULL AS VARCHAR)",
    **dict.fromkeys(("duration", "f1"), "CAST(NULL AS DOUBLE)"),
    **dict.fromkeys(("input_tokens", "output_tokens", "cached_tokens"), "CAST(NULL AS BIGINT)"),
    "success": "CAST(NULL AS BOOLEAN)",
    "error": "CAST(NULL AS VARCHAR)",
    "answers": "CAST(NULL AS VARCHAR)",
    "evaluated": "false",
}


def _changed(**new: str) -> str:
    """The flat columns with a new value where an update hits."""
    columns = [*FLAT.split(", "), "answers", "evaluated", "f1"]
    return ", ".join(f"CASE WHEN hit THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in columns)


_CLEARED = {
    "gen": ("query", "duration", "input_tokens", "output_tokens", "cached_tokens"),
    "exec": ("success", "error", "answers"),
    "eval": ("evaluated", "f1"),
}


def _nulls(*stages: str) -> dict[str, str]:
    return {c: _NULLED[c] for s in stages for c in _CLEARED[s]}


_NEW_GEN = _nulls("gen", "exec", "eval") | {"query": "'version 2'"}


@query(
    f"""{WITH_RESULTS}, {_UPDATED} SELECT {_changed(**_NEW_GEN)} FROM state
    UNION ALL SELECT question_id, method, lang, model, 'version 2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL
    FROM updated WHERE question_id NOT IN (SELECT question_id FROM results WHERE {SQL_CONFIG})"""
)
def save_generation(t: Tables) -> DataFrame:
    return flat(staging.save_generation(views.results(t), _updates(t, "gen"), order="seq"))


@query(
    f"""{WITH_RESULTS}, {_UPDATED} SELECT
    {_changed(**_nulls("eval"), success="true", error="CAST(NULL AS VARCHAR)", answers="'version 2'")} FROM state"""
)
def save_execution(t: Tables) -> DataFrame:
    return flat(staging.save_execution(views.results(t), _updates(t, "exec"), order="seq"))


@query(f"""{WITH_RESULTS}, {_UPDATED} SELECT {_changed(evaluated="true", f1="CAST(2.0 AS DOUBLE)")} FROM state""")
def save_evaluation(t: Tables) -> DataFrame:
    return flat(staging.save_evaluation(views.results(t), _updates(t, "eval"), order="seq"))


_CONFIG_STATE = f"""state AS (SELECT r.*, array_to_string(list_sort(result), '|') AS answers,
  CASE WHEN evaluated THEN CAST(0.5 AS DOUBLE) END AS f1, {SQL_CONFIG} AS hit FROM results r)"""


@query(f"""{WITH_RESULTS}, {_CONFIG_STATE} SELECT {_changed(**_nulls("gen", "exec", "eval"))} FROM state""")
def clear_generation(t: Tables) -> DataFrame:
    return flat(staging.clear_stage(views.results(t), *CONFIG, "gen"))


@query(f"""{WITH_RESULTS}, {_CONFIG_STATE} SELECT {_changed(**_nulls("exec", "eval"))} FROM state""")
def clear_execution(t: Tables) -> DataFrame:
    return flat(staging.clear_stage(views.results(t), *CONFIG, "exec"))


@query(f"""{WITH_RESULTS}, {_CONFIG_STATE} SELECT {_changed(**_nulls("eval"))} FROM state""")
def clear_evaluation(t: Tables) -> DataFrame:
    return flat(staging.clear_stage(views.results(t), *CONFIG, "eval"))


@query(f"{WITH_RESULTS} SELECT count(*) AS cleared FROM results WHERE {SQL_CONFIG}")
def cleared_rows(t: Tables) -> DataFrame:
    return staging.cleared_rows(views.results(t), *CONFIG)


@query(
    f"""{WITH_RESULTS}, numbered AS (
      SELECT *, CAST(question_id AS BIGINT) % 100 AS k, CAST(question_id AS BIGINT) % 200 = 2 AS scored, {SQL_CONFIG} AS cleared FROM results),
    changed AS (
      SELECT question_id, method, lang, model, CASE WHEN k = 1 THEN 'again' ELSE query END AS query,
        CASE WHEN k <> 1 THEN duration END AS duration, CASE WHEN k <> 1 THEN input_tokens END AS input_tokens,
        CASE WHEN k <> 1 THEN output_tokens END AS output_tokens, CASE WHEN k <> 1 THEN cached_tokens END AS cached_tokens,
        CASE WHEN k IN (1, 2) THEN true WHEN NOT cleared THEN success END AS success,
        CASE WHEN k NOT IN (1, 2) AND NOT cleared THEN error END AS error,
        CASE WHEN k IN (1, 2) THEN 'new' WHEN NOT cleared THEN array_to_string(list_sort(result), '|') END AS answers,
        scored OR (k NOT IN (1, 2) AND NOT cleared AND evaluated) AS evaluated,
        CASE WHEN scored THEN 0.25 WHEN k NOT IN (1, 2) AND NOT cleared AND evaluated THEN 0.5 END AS f1
      FROM numbered)
    SELECT * FROM changed
    UNION ALL SELECT 'n' || c_custkey, 'llm', 'cypher', 'gpt-4o', 'first', NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL
      FROM customer WHERE c_custkey % 10 = 0"""
)
def merged_results(t: Tables) -> DataFrame:
    """Generations, a clear, executions and evaluations saved as changes, and read merged with the results they change."""
    results = views.results(t)
    store = ResultStore.create(results, shared_path(t.spark, "result-store"))
    number = F.col("question_id").try_cast("bigint")
    keys = results.select(*KEY)
    nothing = F.lit(None).cast(STATS_TYPE)
    again = keys.filter(number % 100 == 1).select(*KEY, F.struct(F.lit("again").alias("query"), nothing.alias("stats")).alias("gen"))
    config = [F.lit(v).alias(c) for c, v in zip(("method", "lang", "model"), CONFIG)]
    ids = t.customer.filter(F.col("c_custkey") % 10 == 0).select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("question_id"), *config)
    first = ids.select(*KEY, F.struct(F.lit("first").alias("query"), nothing.alias("stats")).alias("gen"))
    store.save_generation(again.unionByName(first))
    store.clear_stage(*CONFIG, "exec")
    done = F.struct(F.array(F.lit("new")).alias("result"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    lost = keys.limit(1).withColumn("question_id", F.lit("not there"))  # no result: an execution alone inserts none
    store.save_execution(keys.filter((number % 100).isin(1, 2)).unionByName(lost).select(*KEY, done.alias("exec")))
    scores = F.struct(*[F.lit(0.25).alias(name) for name in EVAL_TYPE.names])
    store.save_evaluation(keys.filter(number % 200 == 2).select(*KEY, scores.alias("eval")))
    return flat(store.merged())
