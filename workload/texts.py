"""Queries on texts: completions, query clean-up, prompts, messages, responses, schemas, values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions import graph_schemas, terms, text, values
from hopscore.functions.providers import provider_of_model
from hopscore.operators import generation, prompts
from hopscore.plans.stages import generate_stage
from hopscore.sources.graph import parse_triples, triple_terms
from workload import views
from workload.registry import Tables, query
from workload.tables import CONFIG, SQL_CONFIG, WITH_RESULTS


@query(
    rf"""WITH {views.SQL_COMPLETIONS},
    fenced AS (SELECT id, raw, regexp_extract(raw, '(?is)```(?:cypher|sparql|gremlin)?\s*\n?(.*?)```', 1) AS block,
      regexp_matches(raw, '(?is)```(?:cypher|sparql|gremlin)?\s*\n?(.*?)```') AS has_block, regexp_extract(raw, '`([^`]+)`', 1) AS code FROM completions)
    SELECT id, {views.sql_strip("CASE WHEN has_block THEN block WHEN code <> '' THEN code ELSE raw END")} AS query FROM fenced"""
)
def extract_query(t: Tables) -> DataFrame:
    return views.completions(t).select("id", text.extract_query(F.col("raw")).alias("query"))


_WORD = "upper(p_type) || '_' || upper(split_part(p_name, ' ', 1))"
_NUMBERED = "replace(p_brand, '#', '')"


@query(
    f"""SELECT p_partkey, 'MATCH (a:Part)-[r:' || lower({_WORD}) || '{{w: 1}}]->(b:' || lower({_WORD}) || ' {{k: 2}})-[:'
      || lower({_WORD}) || ']->(c:' || {_WORD} || ')-[:' || {_WORD} || '*1..2]->(d:' || {_NUMBERED} || ') RETURN b' AS query FROM part"""
)
def lower_relations(t: Tables) -> DataFrame:
    word = F.concat(F.upper("p_type"), F.lit("_"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))
    raw = F.concat(
        F.lit("MATCH (a:Part)-[r:"), word, F.lit("{w: 1}]->(b: "), word, F.lit(" {k: 2})-[:\t"), word, F.lit("]->(c:"), word,
        F.lit(")-[:"), word, F.lit("*1..2]->(d:"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(") RETURN b"),
    )
    return t.part.select("p_partkey", text.clean_query(raw, ["lowercase_relationships", "unknown"]).alias("query"))


# Prompts: the questions of users, which may hold template marks, against the schema of a nation's graph.
_SCHEMA_TEXT = "'Graph: ' || n_name || chr(10) || '{{ question }}'"


@query(
    f"""SELECT conv_id, turn, CASE WHEN n_nationkey IS NULL THEN text ELSE
      'You write Cypher queries over a knowledge graph.' || chr(10) || 'Answer with one query on a single line and nothing else.' || chr(10)
      || 'Match paths in the graph and return the answers.' || chr(10) || chr(10) || 'Graph schema:' || chr(10) || {_SCHEMA_TEXT}
      || chr(10) || chr(10) || 'User question:' || chr(10) || '{{{{ schema }}}} ' || text || chr(10) || chr(10) || 'Cypher query:' END AS prompt
    FROM conversations LEFT JOIN nation ON n_nationkey = conv_id % 30 WHERE role = 'user'"""
)
def render_prompt(t: Tables) -> DataFrame:
    schemas = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("dataset"),
        F.lit("cypher").alias("lang"),
        F.concat(F.lit("Graph: "), "n_name", F.lit("\n{{ question }}")).alias("schema_text"),
    )
    asked = t.conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", "text", (F.col("conv_id") % 30).alias("dataset"), F.lit("cypher").alias("lang")
    )
    joined = prompts.with_schema(asked, schemas)
    marked = F.when(F.col("schema_text").isNull(), F.col("text")).otherwise(F.concat(F.lit("{{ schema }} "), "text"))
    return joined.select("conv_id", "turn", prompts.prompt(F.col("lang"), marked, F.col("schema_text")).alias("prompt"))


@query(
    """SELECT conv_id, turn, json_extract_string(j, '$[0].role') AS role, json_extract_string(j, '$[0].content') AS content,
      CAST(json_array_length(j) AS INTEGER) AS n FROM (SELECT conv_id, turn, to_json([{'role': role, 'content': text}]) AS j FROM conversations)"""
)
def chat_messages(t: Tables) -> DataFrame:
    """Each turn as the message list of a request, read back from its JSON."""
    listed = prompts.messages_json(prompts.message(F.col("role"), F.col("text")))
    parsed = F.from_json("json", "array<struct<role string, content string>>")
    return t.conversations.select("conv_id", "turn", listed.alias("json")).select(
        "conv_id", "turn", parsed[0]["role"].alias("role"), parsed[0]["content"].alias("content"), F.size(parsed).alias("n")
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'openai' WHEN event_type = 'view' THEN 'deepseek' ELSE 'other' END AS provider,
      CASE WHEN event_type IN ('click', 'view') THEN 'answer ' || event_id || chr(10) || '"' || event_type || '"' END AS content,
      CASE WHEN event_type IN ('click', 'view') THEN event_id + 7 END AS input_tokens,
      CASE WHEN event_type IN ('click', 'view') THEN user_id END AS output_tokens,
      CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE 0 END END AS cached_tokens
    FROM events"""
)
def parse_responses(t: Tables) -> DataFrame:
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    content = F.concat(F.lit("answer "), event, F.lit('\\n\\"'), "event_type", F.lit('\\"'))
    sent = (F.col("event_id") + 7).cast("string")
    cached = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 5).cast("string")).otherwise("null")
    openai = F.format_string(
        '{"output_text": "%s", "usage": {"input_tokens": %s, "output_tokens": %s, "input_tokens_details": %s}}',
        content, sent, user, F.when(cached == "null", "null").otherwise(F.concat(F.lit('{"cached_tokens": '), cached, F.lit("}"))),
    )
    deepseek = F.format_string(
        '{"choices": [{"message": {"content": "%s"}}], "usage": {"prompt_tokens": %s, "completion_tokens": %s, "prompt_cache_hit_tokens": %s}}',
        content, sent, user, cached,
    )
    click, view = F.col("event_type") == "click", F.col("event_type") == "view"
    log = t.events.select(
        "event_id",
        F.when(click, "openai").when(view, "deepseek").otherwise("other").alias("provider"),
        F.when(click, openai).otherwise(deepseek).alias("payload"),
    )
    return generation.response_columns(log, ["event_id", "provider"])


@query(
    f"""{WITH_RESULTS} SELECT question_id, model,
      CASE WHEN model LIKE 'gpt%' THEN 'openai' WHEN model LIKE 'deepseek%' THEN 'deepseek' END AS provider FROM results"""
)
def provider_of_models(t: Tables) -> DataFrame:
    return views.results(t).select("question_id", "model", provider_of_model(F.col("model")).alias("provider"))


# Generation with a model function, and translation of intermediate representations.


def _echo_model():
    """A stand-in for a user model: answers every prompt with a fenced query about it. A function made inside another
    travels to the workers whole, so they need not find this module."""

    def load():
        import pandas as pd

        def run(batch):
            return pd.DataFrame(
                {
                    "content": "```cypher\nMATCH (n) WHERE n.text = '" + batch["prompt"] + "' RETURN n\n```",
                    "duration": batch["prompt"].str.len() / 4.0,
                    "input_tokens": batch["prompt"].str.len(),
                }
            )

        return run

    return load


@query(
    """SELECT conv_id, turn, '```cypher' || chr(10) || 'MATCH (n) WHERE n.text = ''' || text || ''' RETURN n' || chr(10) || '```' AS content,
      length(text) / 4.0 AS duration, length(text) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens FROM conversations"""
)
def predict(t: Tables) -> DataFrame:
    asked = t.conversations.select("conv_id", "turn", F.col("text").alias("prompt"))
    return generation.predict(asked, _echo_model(), ["conv_id", "turn"]).select(
        "conv_id", "turn", "content", *[f"stats.{name}" for name in ("duration", "input_tokens", "output_tokens")]
    )


@query(
    f"""{WITH_RESULTS} SELECT question_id, method, lang, model, query FROM results
    UNION ALL SELECT id, 'llm', 'cypher', 'gpt-4o', 'MATCH (n) WHERE n.text = ''' || question || ''' RETURN n' FROM questions
      WHERE id NOT IN (SELECT question_id FROM results WHERE {SQL_CONFIG})"""
)
def generate_stage_skip(t: Tables) -> DataFrame:
    """One configuration generated for the questions that have no row yet."""
    table = generate_stage(views.questions(t), views.results(t), _echo_model(), *CONFIG)
    return table.select("question_id", "method", "lang", "model", "gen.query")


def _terse_model():
    """A stand-in for a sequence model: writes an intermediate representation."""

    def load():
        import pandas as pd

        return lambda batch: pd.DataFrame({"content": batch["prompt"].str.replace("Ask: ", "ir ", regex=False)})

    return load


@query(
    f"""{WITH_RESULTS} SELECT question_id, method, lang, model, query FROM results
    WHERE NOT (method = 'seq2seq' AND lang = 'cypher' AND model = 'terse')
    UNION ALL SELECT id, 'seq2seq', 'cypher', 'terse',
      CASE WHEN hop = '1' THEN '(' || question || ')-[:shipped_in]->()' ELSE 'ir ' || question END FROM questions"""
)
def generate_seq2seq(t: Tables) -> DataFrame:
    """A sequence model with a prompt text of its own, a translator that fails on some questions, and a clean-up step."""

    def translator(source: str) -> str:
        if not source.endswith(" 1"):
            raise ValueError("cannot translate")
        return "(" + source[3:-2] + ")-[:SHIPPED_IN]->()"

    schemas = t.nation.limit(1).select(F.lit("orders").alias("dataset"), F.lit("cypher").alias("lang"), F.lit("none").alias("schema_text"))
    asked = views.questions(t).withColumn("dataset", F.lit("orders"))
    hop = F.try_element_at("extra", F.lit("hop"))
    asked = asked.withColumn("question", F.when(hop == "1", F.concat("question", F.lit(" 1"))).otherwise(F.col("question")))
    table = generate_stage(
        asked, views.results(t), _terse_model(), "seq2seq", "cypher", "terse", schemas,
        templates={"cypher": "Ask: {{ question }}"}, translator=translator, clean=["lowercase_relationships"],
    )
    return table.select("question_id", "method", "lang", "model", "gen.query")


def _translator():
    def upper_or_fail(source: str) -> str:
        if "a" in source.split()[-1]:
            raise ValueError("cannot translate")
        return "MATCH " + source

    return upper_or_fail


@query("SELECT p_partkey, CASE WHEN split_part(p_name, ' ', -1) LIKE '%a%' THEN p_name ELSE 'MATCH ' || p_name END AS query, p_name AS other FROM part")
def translate_fallback(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select(
        "p_partkey",
        generation.translate(name, "cypher", _translator()).alias("query"),
        generation.translate(name, "gremlin", _translator()).alias("other"),
    )


# Graph schemas: one JSON document per part, in four ways of writing it.


def _schema_json() -> Column:
    key = F.col("p_partkey")
    listed = F.format_string('[{"name": "size", "data_type": "int"}, {"name": "price", "data_type": "%s"}]', "p_type")
    mapped = F.format_string('{"size": "int", "price": "%s"}', "p_type")
    properties = F.when(key % 2 == 0, listed).otherwise(mapped)
    nodes = F.format_string('[{"label": "%s", "properties": %s}, {"label": "Maker"}]', "p_brand", properties)
    edges = F.format_string(
        '[{"label": "MADE_BY", "SUBJ": "%s", "OBJ": "Maker"}, {"label": "LIKE", "SUBJ": "%s", "OBJ": "%s", "properties": %s}]',
        "p_brand", "p_brand", "p_name", properties,
    )
    plain = F.replace(F.replace(edges, F.lit("SUBJ"), F.lit("source_label")), F.lit("OBJ"), F.lit("target_label"))
    other = F.replace(F.replace(edges, F.lit("SUBJ"), F.lit("subj_label")), F.lit("OBJ"), F.lit("obj_label"))
    name = F.format_string('{"name": "%s", "extra": {"domain NAME": "%s"}, ', "p_name", "p_type")
    usual = F.concat(name, F.lit('"nodes": '), nodes, F.lit(', "edges": '), plain, F.lit("}"))
    alternative = F.concat(name, F.lit('"nodes": [], "entities": '), nodes, F.lit(', "relations": '), other, F.lit("}"))
    bare = F.format_string('{"name": "%s"}', "p_name")
    return F.when(key % 5 == 0, bare).when(key % 3 == 0, alternative).otherwise(usual)


def _sql_schema(nodes: str, node: str, edge_1: str, edge_2: str, maker: str) -> str:
    """``node``, ``edge_1`` and ``edge_2`` are the lines of the brand node and of both edges."""
    properties = "'[size: int, price: ' || p_type || ']'"
    brand = f"{node} || ' ' || {properties}"
    ordered = f"CASE WHEN p_brand < 'Maker' THEN {brand} || chr(10) || {maker} ELSE {maker} || chr(10) || {brand} END"
    return f"""SELECT p_partkey, 'Graph: ' || p_name || chr(10) || chr(10) || CASE WHEN p_partkey % 5 = 0
      THEN '{nodes}' || chr(10) || chr(10) || 'Edges:'
      ELSE 'Domain name: ' || p_type || chr(10) || chr(10) || '{nodes}' || chr(10) || {ordered} || chr(10) || chr(10) || 'Edges:'
        || chr(10) || {edge_2} || ' ' || {properties} || chr(10) || {edge_1} END AS schema_text FROM part"""


@query(
    _sql_schema(
        "Nodes:",
        "'  (' || p_brand || ')'",
        "'  (:' || p_brand || ')-[:MADE_BY]->(:Maker)'",
        "'  (:' || p_brand || ')-[:LIKE]->(:' || p_name || ')'",
        "'  (Maker)'",
    )
)
def schema_text_cypher(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", graph_schemas.schema_text(_schema_json(), "cypher").alias("schema_text"))


@query(
    _sql_schema(
        "Vertices:",
        "'  ' || p_brand",
        "'  ' || p_brand || ' -[MADE_BY]-> Maker'",
        "'  ' || p_brand || ' -[LIKE]-> ' || p_name",
        "'  Maker'",
    )
)
def schema_text_gremlin(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", graph_schemas.schema_text(_schema_json(), "gremlin").alias("schema_text"))


@query(
    """SELECT p_partkey, 'RDF Graph: ' || p_name || chr(10) || chr(10)
      || CASE WHEN p_size % 2 = 0 THEN 'Prefixes:' || chr(10) || '  : <http://example.org/>' || chr(10) || '  x: <http://x.org/' || p_type || '>'
           || chr(10) || chr(10) ELSE '' END
      || CASE WHEN p_size % 3 = 0 THEN 'Classes:' || chr(10) || '  :Maker rdfs:subClassOf :Agent' || chr(10) || '  :Part (' || p_brand || ')'
           || chr(10) || chr(10) ELSE '' END
      || 'Properties:' || chr(10) || '  :madeBy (made by) domain=['':Part''] range=['':Maker'', "' || p_type || '''s"] [ObjectProperty]' || chr(10)
      || '  :size domain=['':Part''] [DatatypeProperty]' || chr(10) || '  :z' || p_name || ' ['
      || CASE WHEN p_size % 2 = 0 THEN 'Object' ELSE 'Datatype' END || 'Property]' AS schema_text FROM part"""
)
def schema_text_rdf(t: Tables) -> DataFrame:
    even, third = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    prefixes = F.format_string('"prefixes": {"x": "http://x.org/%s", "": "http://example.org/"}, ', "p_type")
    classes = F.format_string('"classes": [{"uri": ":Part", "label": "%s"}, {"uri": ":Maker", "label": "", "parent": ":Agent"}], ', "p_brand")
    document = F.concat(
        F.format_string('{"name": "%s", ', "p_name"),
        F.when(even, prefixes).otherwise(""),
        F.when(third, classes).otherwise(""),
        F.lit('"datatype_properties": [{"uri": ":size", "domain": [":Part"]}], '),
        F.format_string('"properties": [{"uri": ":z%s", "is_object_property": %s}], ', "p_name", F.when(even, "true").otherwise("false")),
        F.format_string(
            '"object_properties": [{"uri": ":madeBy", "label": "made by", "domain": [":Part"], "range": [":Maker", "%s\'s"]}]}', "p_type"
        ),
    )
    return t.part.select("p_partkey", graph_schemas.schema_text(document, "sparql").alias("schema_text"))


# Canonical values

_XSD = "^^<http://www.w3.org/2001/XMLSchema#"


def _triple_lines(t: Tables) -> DataFrame:
    """Statements on order lines with typed literals, and whole texts as literals with escapes."""

    def subject(kind: str, *keys: str) -> Column:
        return F.concat(F.lit(f"<http://x/{kind}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]), F.lit("> "))

    quantity = F.concat(F.lit('"0'), F.col("l_quantity").cast("int").cast("string"), F.lit(f'"{_XSD}integer> .'))
    price = F.concat(F.lit('"+'), F.col("l_extendedprice").cast("string"), F.lit(f'"{_XSD}double> . # price'))
    shipped = F.concat(F.lit('"'), F.when(F.col("l_linestatus") == "F", "1").otherwise("false"), F.lit(f'"{_XSD}boolean>.'))
    line = subject("line", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = [("quantity", quantity), ("price", price), ("shipped", shipped)]
    statements = [F.concat(line, F.lit(f"<{name}> "), value) for name, value in parts]
    blank = F.concat(F.lit("_:b"), F.col("l_suppkey").cast("string"), F.lit(" <supplies> "), F.lit("<p"), F.col("l_partkey").cast("string"), F.lit(">\t."))
    lines = t.lineitem.select(F.explode(F.array(*statements, blank)).alias("value"))
    escaped = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    escaped = F.replace(F.replace(escaped, F.lit("é"), F.lit("\\u00E9")), F.lit("ö"), F.lit("\\U000000F6"))
    texts = t.documents.select(F.concat(subject("doc", "doc_id"), F.lit('<text> "'), escaped, F.lit('"@'), "lang", F.lit(" .")).alias("value"))
    comments = t.nation.select(F.concat(F.lit("# "), "n_name").alias("value"))
    return lines.unionByName(texts).unionByName(comments)


@query(
    """WITH line AS (SELECT 'http://x/line/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS s, * FROM lineitem)
    SELECT s, 'quantity' AS p, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS o, 'literal' AS kind FROM line
    UNION ALL SELECT s, 'price', CAST(l_extendedprice AS VARCHAR), 'literal' FROM line
    UNION ALL SELECT s, 'shipped', CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'false' END, 'literal' FROM line
    UNION ALL SELECT '_:b' || l_suppkey, 'supplies', 'p' || l_partkey, 'uri' FROM line
    UNION ALL SELECT 'http://x/doc/' || doc_id, 'text', text, 'literal' FROM documents"""
)
def rdf_term_text(t: Tables) -> DataFrame:
    parsed = triple_terms(parse_triples(_triple_lines(t)))
    return parsed.select(*[terms.term_text(F.col(c)).alias(c) for c in ("s", "p", "o")], F.col("o.kind").alias("kind"))


def _clock(ts: str, micros: str | None = None) -> list[Column]:
    nanos = (F.date_format(ts, "SSSSSS").cast("int") * 1000 + 999) if micros is None else F.lit(0)
    return [F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"), nanos.alias("nanosecond")]


def _day(ts: str) -> list[Column]:
    return [F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day")]


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:%M:%S.%f') END AS clock,
      '["' || strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') || '",null]' AS moments,
      '{"span":{"months":1,"days":2,"seconds":' || user_id || ',"nanoseconds":5}}' AS spans,
      '{"nodes":[{"id":"' || event_id || '","labels":["Event","' || event_type || '"],"properties":{"user":"' || user_id
        || '","none":null}}],"relationships":[{"id":"r' || event_id || '","type":"BY","start":"' || event_id || '","end":"u' || user_id || '","properties":{}}]}' AS path,
      '{"when":"' || strftime(ts, '%Y-%m-%d') || '","who":{"id":"' || event_id || '","labels":["Event","' || event_type || '"],"properties":{"user":"' || user_id
        || '","none":null}},"inner":{"days":["' || strftime(ts, '%Y-%m-%d') || '"],"n":' || user_id || '}}' AS projected
    FROM events"""
)
def graph_values(t: Tables) -> DataFrame:
    """Temporal values, lists and maps of them, and a path of one node and one relationship, as answer texts."""
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    moment = F.struct(*_day("ts"), *_clock("ts", "none"))
    duration = F.struct(F.lit(1).alias("months"), F.lit(2).alias("days"), F.col("user_id").alias("seconds"), F.lit(5).alias("nanoseconds"))
    node = F.struct(
        event.alias("element_id"),
        F.array(F.lit("Event"), F.col("event_type")).alias("labels"),
        F.create_map(F.lit("user"), user, F.lit("none"), F.lit(None).cast("string")).alias("properties"),
    )
    relationship = F.struct(
        F.concat(F.lit("r"), event).alias("element_id"),
        F.lit("BY").alias("type"),
        event.alias("start_node"),
        F.concat(F.lit("u"), user).alias("end_node"),
        F.create_map().cast("map<string,string>").alias("properties"),
    )
    raw = t.events.select(
        "event_id",
        F.struct(*_day("ts")).alias("day"),
        F.struct(*_clock("ts")).alias("clock"),
        F.array(moment, F.lit(None)).alias("moments"),
        F.create_map(F.lit("span"), duration).alias("spans"),
        F.struct(F.array(node).alias("nodes"), F.array(relationship).alias("relationships")).alias("path"),
        F.struct(
            F.struct(*_day("ts")).alias("when"),
            node.alias("who"),
            F.struct(F.array(F.struct(*_day("ts"))).alias("days"), F.col("user_id").alias("n")).alias("inner"),
        ).alias("projected"),
    )
    return _as_texts(raw, "event_id", values.graph_value)


def _as_texts(raw: DataFrame, key: str, convert) -> DataFrame:
    names = [c for c in raw.columns if c != key]
    converted = raw.select(key, *[convert(F.col(c), raw.schema[c].dataType).alias(c) for c in names])
    return converted.select(key, *[values.value_text(F.col(c), converted.schema[c].dataType).alias(c) for c in names])


@query(
    """SELECT event_id, event_type AS scalar,
      '{"id":' || event_id || ',"label":"Event"}' AS vertex,
      '[{"id":"e' || event_id || '","label":"BY","inV":' || user_id || ',"outV":' || event_id || '}]' AS edges,
      '{"labels":[["a"],["b","' || event_type || '"]],"objects":[{"id":' || event_id || ',"label":"Event"},{"id":' || user_id || ',"label":"User"}]}' AS path,
      '{"from":{"id":' || user_id || ',"label":"User"},"all":{"k":{"by":{"id":"e' || event_id || '","label":"BY","inV":' || user_id || ',"outV":' || event_id
        || '},"kind":"' || event_type || '"}}}' AS projected
    FROM events"""
)
def traversal_values(t: Tables) -> DataFrame:
    def vertex(key: str, label: str) -> Column:
        return F.struct(F.col(key).alias("id"), F.lit(label).alias("label"))

    edge = F.struct(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.lit("BY").alias("label"),
        vertex("user_id", "User").alias("inV"),
        vertex("event_id", "Event").alias("outV"),
    )
    labels = F.array(F.array(F.lit("a")), F.array(F.lit("b"), F.col("event_type")))
    raw = t.events.select(
        "event_id",
        F.col("event_type").alias("scalar"),
        vertex("event_id", "Event").alias("vertex"),
        F.array(edge).alias("edges"),
        F.struct(labels.alias("labels"), F.array(vertex("event_id", "Event"), vertex("user_id", "User")).alias("objects")).alias("path"),
        F.struct(
            vertex("user_id", "User").alias("from"),
            F.create_map(F.lit("k"), F.struct(edge.alias("by"), F.col("event_type").alias("kind"))).alias("all"),
        ).alias("projected"),
    )
    return _as_texts(raw, "event_id", values.traversal_value)
