import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopscore.functions.errors import classify_error, missing_relations
from hopscore.functions.providers import parse_response, provider_of_model
from hopscore.functions.text import capitalize, clean_query, extract_query, lower_relations, python_quoted
from hopscore.operators.prompts import message, messages_json, prompt, render, run_id, with_schema


@pytest.mark.parametrize(
    "raw, query",
    [
        ("Here's the query:\n```cypher\nMATCH (n) RETURN n\n```", "MATCH (n) RETURN n"),
        ("```\nSELECT * FROM t\n```", "SELECT * FROM t"),
        ("```sparql\nSELECT ?x WHERE { ?x a :Person }\n```", "SELECT ?x WHERE { ?x a :Person }"),
        ("```GREMLIN g.V()```", "g.V()"),
        ("Use this query: `MATCH (n) RETURN n`", "MATCH (n) RETURN n"),
        ("  MATCH (n) RETURN n\n", "MATCH (n) RETURN n"),
        ("``````", ""),
        ("```cypher```", ""),
        ("```sql\nSELECT 1\n```", "sql\nSELECT 1"),
        ("```cypher\nMATCH (n)", "```cypher\nMATCH (n)"),
        ("unclosed ```x `y`", "x"),
        ("```a``` and ```b```", "a"),
        ("````x```", "`x"),
        ("`` `a` ``", ""),
        ("two `a` and `b`", "a"),
        ("line `one\ntwo`", "one\ntwo"),
        ("", ""),
    ],
)
def test_extract_query(value, raw, query):
    assert value(extract_query, "string", raw) == query


@pytest.mark.parametrize(
    "query, cleaned",
    [
        ("MATCH (a)-[:ACTED_IN]->(b)", "MATCH (a)-[:acted_in]->(b)"),
        ("MATCH (a)-[r: ACTED_IN {x: 1}]->(b:MOVIE {y: 2})", "MATCH (a)-[r:acted_in {x: 1}]->(b:movie {y: 2})"),
        ("MATCH (a)-[:A*1..2]->(b)", "MATCH (a)-[:A*1..2]->(b)"),
        ("MATCH (a:PERSON)-[:Acted]->(b)", "MATCH (a:PERSON)-[:Acted]->(b)"),
        ("[:A][:B]{x:C}", "[:a][:b]{x:C}"),
        ("", ""),
    ],
)
def test_lower_relations(value, query, cleaned):
    assert value(lower_relations, "string", query) == cleaned
    assert value(lambda c: clean_query(c, ["lowercase_relationships"]), "string", query) == cleaned
    assert value(lambda c: clean_query(c, ["no_such_step"]), "string", query) == query


@pytest.mark.parametrize(
    "error, category",
    [
        ("gave up: timeout of 5 min reached", "timeout"),
        ("no connection to host graph-2", "connection"),
        ("invalid syntax: unexpected token }", "syntax"),
        ("Unknown relationship type 'CURES' near line 4", "missing_relationship"),
        ("rel_type BINDS_TO is not in the schema", "missing_relationship"),
        ("the label Enzyme is unknown here", "missing_label"),
        ("cannot resolve node kind Enzyme", "missing_label"),
        ("reading property dosage of a drug failed", "missing_property"),
        ("there was no query in this row", "no_query"),
        ("segment 12 is gone", "other"),
        ("timeout while opening a connection", "timeout"),
        (None, "other"),
    ],
)
def test_classify_error(value, error, category):
    assert value(classify_error, "string", error) == category


@pytest.mark.parametrize(
    "error, relations",
    [
        ("Unknown relationship type 'TREATS'", ["TREATS"]),
        ("Relationship type `INHIBITS` not found", ["INHIBITS"]),
        ("RELATIONSHIP TYPE été does not exist", ["été"]),
        ("step [:BINDS] was not found", ["BINDS"]),
        ("step [:BINDS] was\nnot found", []),
        ("relationship type A does not exist, [:B] not found", ["A", "B"]),
        ("nothing", []),
        (None, []),
    ],
)
def test_missing_relations(value, error, relations):
    assert value(missing_relations, "string", error) == relations


def test_small_text_functions(value):
    assert value(capitalize, "string", "domain NAME") == "Domain name"
    for text in ("plain", "it's", 'both \' and "', "back\\slash"):
        assert value(python_quoted, "string", text) == repr(text)
    assert [value(provider_of_model, "string", m) for m in ("gpt-4o", "deepseek-chat", "bart")] == ["openai", "deepseek", None]


def test_render_keeps_marks_inside_values(spark):
    frame = spark.createDataFrame([("what is {{ schema }}?", "Graph: G")], "q string, s string")
    text = render("Schema: {{ schema }}\nQuestion: {{question}}\n", {"schema": F.col("s"), "question": F.col("q")})
    assert frame.select(text).first()[0] == "Schema: Graph: G\nQuestion: what is {{ schema }}?"


def test_render_is_strict(spark):
    with pytest.raises(KeyError):
        render("{{ absent }}", {})
    empty = spark.createDataFrame([(None,)], "q string")
    with pytest.raises(PySparkException):
        empty.select(render("{{ q }}", {"q": F.col("q")})).collect()


def test_prompt_without_schema_is_the_question(spark):
    asked = spark.createDataFrame([("d1", "cypher", "q1"), ("d2", "cypher", "q2"), ("d1", "kopl", "q3")], "dataset string, lang string, q string")
    schemas = spark.createDataFrame([("d1", "cypher", "S"), ("d1", "kopl", "S")], "dataset string, lang string, schema_text string")
    joined = with_schema(asked, schemas).select("q", prompt(F.col("lang"), F.col("q"), F.col("schema_text")).alias("p"))
    prompts = dict(tuple(r) for r in joined.collect())
    assert prompts["q2"] == "q2" and prompts["q3"] == "q3"
    assert "Graph schema:\nS\n" in prompts["q1"] and prompts["q1"].endswith("User question:\nq1\n\nCypher query:")


def test_messages_and_run_id(spark):
    row = spark.range(1).select(
        messages_json(message("system", F.lit("be brief")), message(F.lit("user"), F.lit('say "hi"'))).alias("m"),
        run_id(F.lit("d"), F.lit("llm"), F.lit("cypher"), F.lit("gpt")).alias("r"),
    ).first()
    assert row.m == '[{"role":"system","content":"be brief"},{"role":"user","content":"say \\"hi\\""}]'
    assert row.r == "d-llm-cypher-gpt"


@pytest.mark.parametrize(
    "provider, payload, parsed",
    [
        ("openai", '{"output_text": "a", "usage": {"input_tokens": 1, "output_tokens": 2, "input_tokens_details": {"cached_tokens": 3}}}', ("a", 1, 2, 3)),
        ("openai", '{"output_text": "a", "usage": {"input_tokens": 1, "output_tokens": 2, "input_tokens_details": null}}', ("a", 1, 2, 0)),
        ("deepseek", '{"choices": [{"message": {"content": "b"}}], "usage": {"prompt_tokens": 4, "completion_tokens": 5, "prompt_cache_hit_tokens": 6}}', ("b", 4, 5, 6)),
        ("deepseek", '{"choices": [{"message": {"content": "b"}}], "usage": {"prompt_tokens": 4, "completion_tokens": 5}}', ("b", 4, 5, 0)),
        ("other", "{}", None),
    ],
)
def test_parse_response(spark, provider, payload, parsed):
    frame = spark.createDataFrame([(provider, payload)], "provider string, payload string")
    got = frame.select(parse_response(F.col("provider"), F.col("payload"))).first()[0]
    assert (tuple(got) if got else None) == parsed


@pytest.mark.parametrize("template", ["{% if schema %}x{% endif %}", "{{ question|upper }}", "{# note #}"])
def test_other_template_syntax_is_an_error(spark, template):
    with pytest.raises(ValueError):
        render(template, {"question": F.lit("q")})
