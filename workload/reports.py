"""Queries on scoring, execution outcomes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions.answers import normalize_answers
from hopscore.model import CONFIG, EVAL_TYPE, KEY
from hopscore.operators import execution, prompts, report, scoring
from hopscore.operators.numbering import number_within
from hopscore.plans.incremental import IncrementalReport
from hopscore.plans.report_text import Report
from hopscore.plans.stages import evaluate_rows_stage, evaluate_stage, execute_rows_stage, execute_stage
from hopscore.session import shared_path
from hopscore.sources.result_store import ResultStore
from workload import views
from workload.registry import Tables, query
from workload.tables import CONFIG as RUN
from workload.tables import SQL_CONFIG, WITH_QUESTIONS, WITH_RESULTS

FIELDS = ["hop", "split", "tier"]
WITH_SCORED = f"WITH {views.SQL_SCORED}"
SCORES = EVAL_TYPE.names
DOUBLES = ("accuracy", "avg_f1", "avg_precision", "avg_recall", "total_duration", "avg_duration", "avg_input_tokens",
           "avg_output_tokens", "avg_cached_tokens")


def rounded(table: DataFrame, *names: str) -> DataFrame:
    return table.withColumns({n: F.round(n, 6) for n in names if n in table.columns})


def scored(t: Tables) -> DataFrame:
    return evaluate_stage(views.questions(t), views.results(t), if_exists="override")


def _cells(t: Tables, keys: list[str] = CONFIG) -> DataFrame:
    pairs = scoring.evaluate_pairs(scoring.pair_results(views.results(t), views.questions(t)))
    return report.report_cells(pairs, FIELDS, keys)


def _scores(table: DataFrame) -> DataFrame:
    return table.select(*KEY, *[F.round(F.col("eval")[name], 6).alias(name) for name in SCORES])


_SCORE_COLUMNS = ", ".join(f'round("{n}", 6) AS "{n}"' for n in SCORES)


@query(f"{WITH_SCORED} SELECT {', '.join(KEY)}, {_SCORE_COLUMNS} FROM scored")
def score_results(t: Tables) -> DataFrame:
    return _scores(scoring.score_results(views.results(t), views.questions(t)))


@query(f"{WITH_SCORED} SELECT {', '.join(KEY)}, {_SCORE_COLUMNS} FROM scored")
def score_answer_rows(t: Tables) -> DataFrame:
    """The same scores from answers in row form: order lines as they are, without gathering them per order."""
    lines = views.lines(t).withColumn("question_id", F.col("l_orderkey").cast("string"))
    executions = views.results(t).select(*KEY, F.col("exec.success").alias("success"))
    gold = lines.filter(F.col("l_linestatus") == "F").select("question_id", F.col("written").alias("answer"))
    predicted = lines.filter(F.col("l_returnflag") != "R").select("question_id", F.col("written").alias("answer"))
    succeeded = executions.filter("success").select(*KEY)
    return _scores(scoring.score_answer_rows(executions, predicted.join(succeeded, "question_id").select(*KEY, "answer"), gold))


@query(
    f"""{WITH_SCORED} SELECT question_id, method, lang, model, executed AS has_eval,
    CASE WHEN executed AND {SQL_CONFIG} AND NOT evaluated THEN f1 WHEN evaluated THEN 0.5 END AS f1
    FROM (SELECT * REPLACE (round(f1, 6) AS f1, executed AND ({SQL_CONFIG} OR evaluated) AS executed) FROM scored)"""
)
def evaluate_stage_skip(t: Tables) -> DataFrame:
    """One configuration evaluated, earlier evaluations kept."""
    table = evaluate_stage(views.questions(t), views.results(t), RUN)
    return table.select(*KEY, F.col("eval").isNotNull().alias("has_eval"), F.round("eval.f1", 6).alias("f1"))


@query(f"{WITH_QUESTIONS} SELECT id, array_to_string({views.sql_normal('answer')}, '|') AS answers, CAST(len({views.sql_normal('answer')}) AS INTEGER) AS n FROM questions")
def normalize_answer_sets(t: Tables) -> DataFrame:
    normal = normalize_answers(F.col("answer"))
    return views.questions(t).select("id", F.array_join(normal, "|").alias("answers"), F.size(normal).alias("n"))


@query(f"{WITH_SCORED} SELECT question_id, method, lang, model, hop, split, tier, executed FROM scored")
def result_pairs(t: Tables) -> DataFrame:
    pairs = scoring.pair_results(views.results(t), views.questions(t))
    fields = [F.try_element_at("extra", F.lit(f)).alias(f) for f in FIELDS]
    return pairs.select(*KEY, *fields, F.col("exec").isNotNull().alias("executed"))


@query(
    f"""WITH {views.SQL_COMPLETIONS}
    SELECT kind, count(*) AS total, count(*) FILTER (WHERE hit) AS correct, round(count(*) FILTER (WHERE hit) / count(*), 6) AS accuracy
    FROM (SELECT left(id, 1) AS kind, {views.sql_fold("raw")} = {views.sql_fold("lower(text)")} AS hit FROM completions) GROUP BY 1"""
)
def text_accuracy(t: Tables) -> DataFrame:
    decoded = views.completions(t).select(F.left("id", F.lit(1)).alias("kind"), "raw", F.lower("text").alias("target"))
    return rounded(scoring.text_accuracy(decoded, "raw", "target", "kind"), "accuracy")


# Execution outcomes: the lines of an order are the answer rows of its query.


def _answer_rows(t: Tables) -> DataFrame:
    """Rows of one column for even lines and of two columns for odd ones."""
    brand, quantity = execution.json_cell(F.col("p_brand")), execution.json_cell(F.col("l_quantity").cast("int"))
    cells = F.when(F.col("l_linenumber") % 2 == 0, F.array(brand)).otherwise(F.array(brand, quantity))
    return views.lines(t).select(
        F.col("l_orderkey").cast("string").alias("question_id"), F.col("l_linenumber").alias("row_idx"), cells.alias("cells")
    )


_ANSWER = """CASE WHEN l_linenumber % 2 = 0 THEN p_brand
  ELSE '["' || p_brand || '",' || CAST(l_quantity AS INTEGER) || ']' END"""


@query(
    f"""WITH {views.SQL_LINES}
    SELECT CAST(l_orderkey AS VARCHAR) AS question_id, l_linenumber AS row_idx, {_ANSWER} AS answer FROM lines"""
)
def collect_answers(t: Tables) -> DataFrame:
    return execution.collect_answers(_answer_rows(t), "question_id")


@query(
    f"""{WITH_RESULTS} SELECT question_id, coalesce(n_lines, 0) AS row_count, n_lines IS NULL AS is_empty
    FROM results LEFT JOIN found ON CAST(l_orderkey AS VARCHAR) = question_id"""
)
def row_counts(t: Tables) -> DataFrame:
    return execution.row_counts(views.results(t), _answer_rows(t), "question_id")


@query(
    f"""{WITH_RESULTS} SELECT question_id, coalesce(query, '') <> '' AND error IS NULL AS success,
      CASE WHEN coalesce(query, '') = '' THEN 'no query to execute' ELSE error END AS error,
      CASE WHEN coalesce(query, '') <> '' AND error IS NULL THEN coalesce(n_lines, 0) END AS n_answers
    FROM results LEFT JOIN found ON CAST(l_orderkey AS VARCHAR) = question_id"""
)
def run_status(t: Tables) -> DataFrame:
    results = views.results(t)
    errors = results.filter(F.col("exec.error").isNotNull()).select("question_id", F.col("exec.error").alias("engine_error"))
    answers = execution.collect_answers(_answer_rows(t), "question_id")
    return execution.run_status(results.select("question_id", "gen"), errors, answers, ["question_id"])


@query(
    f"""{WITH_RESULTS}, after AS (
      SELECT *, {SQL_CONFIG} AND NOT executed AS run, coalesce(query, '') = '' AS missing FROM results)
    SELECT question_id, method, lang, model, CASE WHEN run THEN NOT missing ELSE success END AS success,
      CASE WHEN run AND missing THEN 'no query to execute' WHEN NOT run THEN error END AS error,
      CAST(CASE WHEN run AND NOT missing THEN coalesce(n, 0) WHEN NOT run THEN len(result) END AS INTEGER) AS n_answers
    FROM after LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS id, count(DISTINCT p_brand) AS n FROM lines GROUP BY 1) ON id = question_id"""
)
def execute_stage_skip(t: Tables) -> DataFrame:
    """One configuration executed: the answers are the brands of an order, a set bounded by the number of brands."""
    key = F.col("l_orderkey").cast("string").alias("question_id")
    answers = views.lines(t).groupBy(key).agg(F.array_sort(F.collect_set("p_brand")).alias("result"))
    errors = views.results(t).filter(F.col("exec.error").isNotNull()).select("question_id", F.col("exec.error").alias("engine_error"))
    table = execute_stage(views.questions(t), views.results(t), answers, errors, *RUN)
    return table.select(*KEY, "exec.success", "exec.error", F.size("exec.result").alias("n_answers")).withColumn(
        "n_answers", F.when(F.col("n_answers") >= 0, F.col("n_answers"))
    )


@query(
    f"""WITH {views.SQL_LINES}
    SELECT CAST(l_orderkey AS VARCHAR) AS question_id, string_agg({_ANSWER}, '|' ORDER BY l_linenumber, {_ANSWER}) AS answers, count(*) AS n_answers
    FROM lines GROUP BY 1"""
)
def answer_lists(t: Tables) -> DataFrame:
    """The answers of each query as a list: in row order (rows of one place by text), repeats kept."""
    packed = execution.pack_answers(execution.collect_answers(_answer_rows(t), "question_id"), ["question_id"])
    return packed.select("question_id", F.array_join("result", "|").alias("answers"), F.size("result").cast("long").alias("n_answers"))


@query(
    f"""{WITH_RESULTS}, after AS (
      SELECT question_id, method, lang, model, CASE WHEN executed THEN success ELSE coalesce(query, '') <> '' END AS success,
        {views.sql_normal("answer")} AS gold, {views.sql_normal("coalesce(f.predicted, [])")} AS pred
      FROM results JOIN questions ON id = question_id LEFT JOIN found f ON CAST(l_orderkey AS VARCHAR) = question_id WHERE {SQL_CONFIG}),
    hits AS (SELECT *, len(list_intersect(gold, pred)) AS tp FROM after)
    SELECT question_id, method, lang, model, success, CASE WHEN success THEN CAST(gold = pred AS DOUBLE) END AS exact_match,
      round(CASE WHEN success THEN CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (len(gold) + len(pred)) END END, 6) AS f1
    FROM hits"""
)
def run_answer_rows(t: Tables) -> DataFrame:
    """One configuration executed and evaluated with answers in rows, beside executions that hold their list."""
    lines = views.lines(t).filter(F.col("l_returnflag") != "R")
    answers = lines.select(
        F.col("l_orderkey").cast("string").alias("question_id"), F.col("l_linenumber").alias("row_idx"), F.col("written").alias("answer")
    )
    errors = views.results(t).filter(F.col("exec.error").isNotNull()).select("question_id", F.col("exec.error").alias("engine_error"))
    table, stored = execute_rows_stage(views.questions(t), views.results(t), answers, errors, *RUN)
    table = evaluate_rows_stage(views.questions(t), table, stored, RUN, if_exists="override")
    done = table.filter(" AND ".join(f"{c} = '{v}'" for c, v in zip(CONFIG, RUN)))
    return done.select(*KEY, "exec.success", F.col("eval.exact_match").alias("exact_match"), F.round("eval.f1", 6).alias("f1"))


_ROWS = """
rows AS (SELECT event_id, CASE WHEN event_type IN ('view', 'error')
    THEN '{"type": "' || event_type || '", "value": ' || value || ', "props": ' || props || ', "none": null}'
    ELSE '"' || event_type || '"' END AS value, event_type, value AS number, props FROM events)"""


def _traversal_rows(t: Tables) -> DataFrame:
    """Traversal output: an object for some events, a bare string for others."""
    record = F.format_string(
        '{"type": "%s", "value": %s, "props": %s, "none": null}', "event_type", F.col("value").cast("string"), "props"
    )
    bare = F.concat(F.lit('"'), "event_type", F.lit('"'))
    return t.events.select(
        "event_id",
        "user_id",
        F.col("event_id").alias("row_idx"),
        F.when(F.col("event_type").isin("view", "error"), record).otherwise(bare).alias("value"),
    )


@query(
    """SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 'none,props,type,value' ELSE 'value' END AS names,
      CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE event_type END AS scalar,
      CASE WHEN event_type IN ('view', 'error')
        THEN '["' || event_type || '",null,' || replace(props, ' ', '') || ',null]'
        ELSE '[null,null,null,null]' END AS answer FROM events"""
)
def wrap_scalars(t: Tables) -> DataFrame:
    """Traversal output as named cells, then projected to four columns, one of them never there."""
    wrapped = execution.wrap_scalars(_traversal_rows(t))
    names = F.array(*map(F.lit, ("type", "absent", "props", "none")))
    scalar = F.when(F.size("row") == 1, execution.cell_text(F.try_element_at("row", F.lit("value"))))
    return wrapped.select(
        "event_id",
        F.array_join(F.array_sort(F.map_keys("row")), ",").alias("names"),
        scalar.alias("scalar"),
        execution.answer_of_cells(execution.row_values(F.col("row"), names)).alias("answer"),
    )


@query(
    """SELECT user_id, CASE WHEN arg_min(event_type, event_id) IN ('view', 'error') THEN 'none,props,type,value' ELSE 'value' END AS names
    FROM events GROUP BY 1"""
)
def first_row_columns(t: Tables) -> DataFrame:
    columns = execution.first_row_columns(execution.wrap_scalars(_traversal_rows(t)), "user_id")
    return columns.select("user_id", F.array_join(F.array_sort("columns"), ",").alias("names"))


# Reports

_TOKENS = ("input_tokens", "output_tokens", "cached_tokens")


def _sql_stats(by: str, source: str = "scored") -> str:
    valid = "count(*) FILTER (WHERE coalesce(success, false))"

    def average(total: str, count: str) -> str:
        return f"CASE WHEN {count} > 0 THEN round({total} / {count}, 6) ELSE 0.0 END"

    timed = "count(*) FILTER (WHERE has_stats)"
    columns = [
        "count(*) AS count",
        "count(*) FILTER (WHERE NOT coalesce(success, false)) AS error_count",
        average("count(*) FILTER (WHERE exact_match = 1.0)", valid) + " AS accuracy",
        *[average(f'sum("{s}")', valid) + f" AS avg_{s}" for s in ("f1", "precision", "recall")],
        "round(coalesce(sum(duration), 0), 6) AS total_duration",
        average("sum(duration)", timed) + " AS avg_duration",
        *[f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS total_{n}" for n in _TOKENS],
        *[average(f"sum({n})", timed) + f" AS avg_{n}" for n in _TOKENS],
    ]
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {by + ', ' if by else ''}{', '.join(columns)} FROM {source}{group}"


_LONG = f"""long AS (
  SELECT *, 'hop' AS field, hop AS value FROM scored UNION ALL SELECT *, 'split', split FROM scored
  UNION ALL SELECT *, 'tier', tier FROM scored WHERE tier IS NOT NULL)"""


@query(f"{WITH_SCORED} {_sql_stats('')}")
def report_summary(t: Tables) -> DataFrame:
    return rounded(report.summary(_cells(t, []), []), *DOUBLES)


@query(f"{WITH_SCORED} {_sql_stats('method, lang, model')}")
def report_all_configs(t: Tables) -> DataFrame:
    return rounded(report.summary(_cells(t)), *DOUBLES)


@query(f"{WITH_SCORED}, {_LONG} {_sql_stats('field, value', 'long')}")
def report_by_field(t: Tables) -> DataFrame:
    return rounded(report.by_field(_cells(t, []), FIELDS, []), *DOUBLES)


@query(f"{WITH_SCORED}, {_LONG} {_sql_stats('method, lang, model, field, value', 'long')}")
def report_by_config_and_field(t: Tables) -> DataFrame:
    return rounded(report.by_field(_cells(t), FIELDS), *DOUBLES)


@query(f"{WITH_RESULTS} SELECT method, lang, model, count(*) FILTER (WHERE executed AND NOT success) AS total_errors FROM results GROUP BY ALL")
def total_errors(t: Tables) -> DataFrame:
    return report.total_errors(report.report_cells(views.results(t), []))


_CATEGORIES = """CASE WHEN error ILIKE '%timeout%' THEN 'timeout' WHEN error ILIKE '%connection%' THEN 'connection'
  WHEN error ILIKE '%syntax%' THEN 'syntax' WHEN error ILIKE '%relationship%' OR error ILIKE '%rel_type%' THEN 'missing_relationship'
  WHEN error ILIKE '%label%' OR error ILIKE '%node%' THEN 'missing_label' WHEN error ILIKE '%property%' THEN 'missing_property'
  WHEN error ILIKE '%no query%' THEN 'no_query' ELSE 'other' END"""
_RELATIONS = """relations AS (
  SELECT DISTINCT method, lang, model, relation FROM (
    SELECT *, unnest([regexp_extract(error, '(?i)Unknown relationship type ''([^'']+)''', 1),
      regexp_extract(error, '(?i)Relationship type `([^`]+)` not found', 1),
      regexp_extract(error, '(?i)relationship type (\\w+) does not exist', 1),
      regexp_extract(error, '(?i)\\[:(\\w+)\\].*not found', 1)]) AS relation
    FROM results WHERE error IS NOT NULL) WHERE relation <> '')"""


@query(f"{WITH_RESULTS} SELECT method, lang, model, {_CATEGORIES} AS category, count(*) AS n FROM results WHERE NOT success GROUP BY ALL")
def error_categories(t: Tables) -> DataFrame:
    return report.error_categories(report.report_cells(views.results(t), []))


@query(f"{WITH_RESULTS}, {_RELATIONS} SELECT * FROM relations")
def missing_relations(t: Tables) -> DataFrame:
    return report.unknown_relations(report.report_cells(views.results(t), []))


@query(
    f"""{WITH_SCORED}, {_RELATIONS} SELECT 'orders-' || method || '-' || lang || '-' || model AS run_id, count(*) AS total,
      round(count(*) FILTER (WHERE exact_match = 1.0) / count(*) FILTER (WHERE success), 6) AS accuracy,
      count(*) FILTER (WHERE hop = '1') AS hop_1, count(*) FILTER (WHERE tier = 'high') AS tier_high, count(*) FILTER (WHERE NOT success) AS total_errors,
      coalesce((SELECT '["' || array_to_string(list_sort(list(relation)), '","') || '"]' FROM relations r
        WHERE r.method = s.method AND r.lang = s.lang AND r.model = s.model), '[]') AS missing,
      count(*) FILTER (WHERE NOT success AND error ILIKE '%timeout%') AS timeouts
    FROM scored s GROUP BY method, lang, model"""
)
def report_json(t: Tables) -> DataFrame:
    """The JSON reports of all configurations, read back from their pieces: no document lies in one row."""
    section, value, line = F.col("section"), F.col("value"), F.col("line")

    def entry(where: Column, path: str, text: Column, dtype: str = "bigint") -> Column:
        return F.max(F.when(where, F.get_json_object(text, path).cast(dtype)))

    opening = F.concat(line, F.lit("}}"))
    member = F.concat(F.lit("{"), F.regexp_replace(line, "^,", ""), F.lit("}"))
    listed = F.array_sort(F.collect_list(F.when(section == 4, F.struct("value", "line"))))
    pieces = Report(scored(t), views.questions(t), views.DATASET, FIELDS).json_pieces()
    counted = F.regexp_extract(line, '"total_errors":([0-9]+)', 1)
    found = pieces.groupBy("run_id").agg(
        entry(section == 1, "$.total", opening).alias("total"),
        F.round(entry(section == 1, "$.summary.accuracy", opening, "double"), 6).alias("accuracy"),
        entry((section == 2) & (F.col("item") == 0) & (value == " 1"), "$.1.count", member).alias("hop_1"),
        entry((section == 2) & (F.col("item") == 2) & (value == " high"), "$.high.count", member).alias("tier_high"),
        F.max(F.when(section == 3, counted.cast("bigint"))).alias("total_errors"),
        F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["line"]), ""), F.lit("]")).alias("missing"),
        entry((section == 6) & (value == " timeout"), "$.timeout", member).alias("timeouts"),
    )
    return found.na.fill(0)


@query(
    f"""{WITH_SCORED} SELECT 'orders-' || method || '-' || lang || '-' || model AS run_id, question_id AS value, count(*) AS total,
      count(*) FILTER (WHERE NOT coalesce(success, FALSE)) AS error_count,
      min(question_id) OVER (PARTITION BY method, lang, model) = question_id AS leads
    FROM scored GROUP BY method, lang, model, question_id"""
)
def report_json_wide(t: Tables) -> DataFrame:
    """Entries of the JSON reports by a field that has a value for each question, read back from their pieces."""
    pieces = Report(scored(t), views.questions(t), views.DATASET, ["id"]).json_pieces()
    entries = pieces.filter("section = 2 AND startswith(value, ' ')")
    leads = ~F.col("line").startswith(",")
    text = F.concat(F.lit("{"), F.regexp_replace("line", "^,", ""), F.lit("}"))
    parsed = F.from_json(text, "map<string, struct<count: bigint, error_count: bigint>>")
    read = entries.select("run_id", leads.alias("leads"), F.explode(parsed).alias("value", "stats"))
    return read.select("run_id", "value", F.col("stats.count").alias("total"), F.col("stats.error_count").alias("error_count"), "leads")


def _sql_markdown() -> str:
    def four(name: str) -> str:
        return f"printf('%.4f', {name})"

    head = [
        "'# Report: ' || run_id", "''", "'**Total:** ' || count", "''", "'## Summary'", "''", "'| Metric | Value |'",
        "'|--------|-------|'", "'| Count | ' || count || ' |'", "'| Errors | ' || error_count || ' |'",
        f"'| Accuracy | ' || {four('accuracy')} || ' |'", f"'| Avg F1 | ' || {four('avg_f1')} || ' |'",
        f"'| Avg Precision | ' || {four('avg_precision')} || ' |'", f"'| Avg Recall | ' || {four('avg_recall')} || ' |'", "''",
        "'## By Field'", "''",
    ]
    row = f"'| ' || value || ' | ' || count || ' | ' || error_count || ' | ' || {four('accuracy')} || ' | ' || {four('avg_f1')} || ' |'"
    exact = _sql_stats("{}").replace("round(", "(").replace(", 6)", ")")
    name = "'orders-' || method || '-' || lang || '-' || model AS run_id"
    return f"""{WITH_SCORED}, {_LONG}, {_RELATIONS},
    total AS (SELECT *, {name} FROM ({exact.replace('{}', 'method, lang, model')})),
    field AS (SELECT *, {name} FROM ({exact.replace('FROM scored', 'FROM long').replace('{}', 'method, lang, model, field, value')})),
    errors AS (SELECT {name}, {_CATEGORIES} AS category, count(*) AS n FROM results WHERE NOT success GROUP BY ALL),
    missing AS (SELECT {name}, relation FROM relations),
    line AS (
      SELECT run_id, 0 AS block, '' AS a, '' AS b, unnest([{', '.join(head)}]) AS line, generate_subscripts([{', '.join(head)}], 1) AS c FROM total
      UNION ALL SELECT run_id, 1, field, '', unnest(['### ' || field, '', '| Value | Count | Errors | Accuracy | F1 |',
        '|-------|-------|--------|----------|-----|']), generate_subscripts([1, 2, 3, 4], 1) FROM (SELECT DISTINCT run_id, field FROM field)
      UNION ALL SELECT run_id, 1, field, ' ' || value, {row}, 1 FROM field
      UNION ALL SELECT DISTINCT run_id, 1, field, '~', '', 1 FROM field
      UNION ALL SELECT run_id, 2, '', '', unnest(['## Errors', '', '**Total Errors:** ' || sum(n), '']), generate_subscripts([1, 2, 3, 4], 1)
        FROM errors GROUP BY run_id
      UNION ALL SELECT DISTINCT run_id, 3, '', '', '**Missing Relations:**', 1 FROM missing
      UNION ALL SELECT run_id, 3, '', ' ' || relation, '- ' || relation, 1 FROM missing
      UNION ALL SELECT DISTINCT run_id, 3, '', '~', '', 1 FROM missing
      UNION ALL SELECT DISTINCT run_id, 4, '', '', '**Error Types:**', 1 FROM errors
      UNION ALL SELECT run_id, 4, '', ' ' || category, '- ' || category || ': ' || n, 1 FROM errors
      UNION ALL SELECT DISTINCT run_id, 4, '', '~', '', 1 FROM errors)
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY block, a, b, c) AS INTEGER) AS place, line FROM line"""


@query(_sql_markdown())
def report_markdown(t: Tables) -> DataFrame:
    """The Markdown reports of all configurations, each line with its place in its report."""
    lines = Report(scored(t), views.questions(t), views.DATASET, FIELDS).markdown()
    return number_within(lines, "run_id", ["section", "item", "value", "part"]).select("run_id", "place", "line")


@query(f"{WITH_RESULTS} SELECT DISTINCT 'orders-' || method || '-' || lang || '-' || model AS run_id FROM results")
def run_ids(t: Tables) -> DataFrame:
    return views.results(t).select(prompts.run_id(F.lit(views.DATASET), *map(F.col, CONFIG)).alias("run_id")).distinct()


def _sql_changed() -> str:
    """The scored results after the saves and the clear of ``report_incremental``."""
    key = "CAST(question_id AS BIGINT)"
    names = [f'"{n}"' for n in SCORES]
    score = f"CASE WHEN {SQL_CONFIG} THEN 0.0 WHEN {key} % 200 = 2 THEN 1.0 WHEN {key} % 100 IN (1, 2) THEN 0.0 ELSE {{}} END AS {{}}"
    new = ", ".join(score.format(n, n) for n in names)
    before = views.SQL_SCORED.replace("scored AS (", "unchanged AS (")
    done = f"{key} % 100 IN (1, 2) OR success AS success, CASE WHEN {key} % 100 NOT IN (1, 2) THEN error END AS error"
    return f"WITH {before}, scored AS (SELECT * REPLACE ({done}, {new}) FROM unchanged)"


@query(f"{_sql_changed()}, {_LONG} SELECT 'orders-' || method || '-' || lang || '-' || model AS run_id, * EXCLUDE (method, lang, model) FROM ({_sql_stats('method, lang, model, field, value', 'long')})")
def report_incremental(t: Tables) -> DataFrame:
    """A report on stored results, brought up to date after executions and evaluations were saved and a stage was cleared."""
    store = ResultStore.create(scored(t), shared_path(t.spark, "reported-results"))
    kept = IncrementalReport(store, views.questions(t), shared_path(t.spark, "report-cells"), views.DATASET, FIELDS)
    kept.rebuild()
    keys, number = views.results(t).select(*KEY), F.col("question_id").cast("bigint")
    done = F.struct(F.array(F.lit("new")).alias("result"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    store.save_execution(keys.filter((number % 100).isin(1, 2)).select(*KEY, done.alias("exec")))
    kept.update()
    scores = F.struct(*[F.lit(1.0).alias(name) for name in EVAL_TYPE.names])
    store.save_evaluation(keys.filter(number % 200 == 2).select(*KEY, scores.alias("eval")))
    store.clear_stage(*RUN, "eval")
    kept.update()
    return rounded(kept.report().by_field, *DOUBLES)
