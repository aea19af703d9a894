import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopscore.functions.graph_schemas import parse_property_graph, parse_rdf_schema, schema_text
from hopscore.sources.graph_schemas import read_schema, read_schemas

MOVIES = {
    "name": "MovieDB",
    "nodes": [
        {"label": "Person", "properties": {"name": "string", "age": "int"}},
        {"label": "Movie", "properties": [{"name": "title", "data_type": "string"}]},
        {"label": "Award"},
    ],
    "edges": [
        {"label": "DIRECTED", "source_label": "Person", "target_label": "Movie", "properties": {"year": "int"}},
        {"label": "ACTED_IN", "source_label": "Person", "target_label": "Movie"},
        {"label": "ACTED_IN", "source_label": "Animal", "target_label": "Movie"},
    ],
}


def text(value, schema, lang):
    return value(lambda c: schema_text(c, lang), "string", json.dumps(schema))


def test_cypher_text(value):
    assert text(value, MOVIES, "cypher") == (
        "Graph: MovieDB\n\nNodes:\n  (Award)\n  (Movie) [title: string]\n  (Person) [name: string, age: int]\n\nEdges:\n"
        "  (:Person)-[:ACTED_IN]->(:Movie)\n  (:Animal)-[:ACTED_IN]->(:Movie)\n  (:Person)-[:DIRECTED]->(:Movie) [year: int]"
    )


def test_gremlin_text(value):
    assert text(value, {**MOVIES, "extra": {"source URL": "x"}}, "gremlin") == (
        "Graph: MovieDB\n\nSource url: x\n\nVertices:\n  Award\n  Movie [title: string]\n  Person [name: string, age: int]\n\nEdges:\n"
        "  Person -[ACTED_IN]-> Movie\n  Animal -[ACTED_IN]-> Movie\n  Person -[DIRECTED]-> Movie [year: int]"
    )


def test_other_names_for_nodes_and_edges(value):
    other = {
        "name": "Pharmacy",
        "nodes": [],
        "entities": [{"label": "Drug"}, {"label": "Allergy"}],
        "relations": [{"label": "TRIGGERS", "subj_label": "Drug", "obj_label": "Allergy"}],
    }
    schema = value(parse_property_graph, "string", json.dumps(other))
    assert [n.label for n in schema.nodes] == ["Drug", "Allergy"]
    assert [(e.source_label, e.target_label) for e in schema.edges] == [("Drug", "Allergy")]


def test_empty_schema(value):
    assert text(value, {"name": "Empty"}, "cypher") == "Graph: Empty\n\nNodes:\n\nEdges:"
    assert text(value, {"name": "Empty"}, "sparql") == "RDF Graph: Empty\n\nProperties:"


@pytest.mark.parametrize("broken", [{"nodes": []}, {"name": "x", "edges": [{"label": "E", "target_label": "B"}]}, {"name": "x", "nodes": [{}]}, {"name": "x", "nodes": [{"label": "A", "properties": [{"name": "p"}]}]}])
def test_missing_parts_are_errors(value, broken):
    with pytest.raises(PySparkException):
        text(value, broken, "cypher")


RDF = {
    "name": "MovieDB",
    "prefixes": {"rdfs": "http://r#", "": "http://e/"},
    "classes": [{"uri": ":Person", "label": "a person"}, {"uri": ":Movie", "parent": ":Work"}],
    "properties": [{"uri": ":z", "is_object_property": True}, {"uri": ":y", "range": ["xsd:string"]}],
    "object_properties": [{"uri": ":actedIn", "label": "acted in", "domain": [":Person"], "range": [":Movie", "it's"]}],
    "datatype_properties": [{"uri": ":name", "domain": [":Person"]}],
}


def test_rdf_text(value):
    assert text(value, RDF, "sparql") == (
        "RDF Graph: MovieDB\n\nPrefixes:\n  : <http://e/>\n  rdfs: <http://r#>\n\nClasses:\n  :Movie rdfs:subClassOf :Work\n"
        "  :Person (a person)\n\nProperties:\n  :actedIn (acted in) domain=[':Person'] range=[':Movie', \"it's\"] [ObjectProperty]\n"
        "  :name domain=[':Person'] [DatatypeProperty]\n  :y range=['xsd:string'] [DatatypeProperty]\n  :z [ObjectProperty]"
    )


def test_rdf_properties_in_order_of_kind(value):
    schema = value(parse_rdf_schema, "string", json.dumps(RDF))
    assert [(p.uri, p.is_object) for p in schema.properties] == [(":actedIn", True), (":name", False), (":z", True), (":y", False)]


def test_files(spark, tmp_path):
    (tmp_path / "cypher.json").write_text(json.dumps(MOVIES, indent=2))
    (tmp_path / "sparql.json").write_text(json.dumps(RDF, indent=2))
    assert read_schema(spark, str(tmp_path / "absent.json"), "cypher") is None
    paths = {("movies", lang): str(tmp_path / f"{lang}.json") for lang in ("cypher", "sparql", "gremlin")}
    found = {(r.dataset, r.lang): r.schema_text for r in read_schemas(spark, paths).collect()}
    assert set(found) == {("movies", "cypher"), ("movies", "sparql")}
    assert found["movies", "sparql"].startswith("RDF Graph: MovieDB\n")
    assert read_schemas(spark, {("a", "b"): str(tmp_path / "none")}).isEmpty()


def test_unknown_language_reads_as_property_graph(spark):
    frame = spark.createDataFrame([(json.dumps(MOVIES),)], "j string")
    assert frame.select(schema_text(F.col("j"), "kopl")).first()[0].startswith("Graph: MovieDB\n\nNodes:")


def test_class_without_uri_is_an_error(value):
    with pytest.raises(PySparkException):
        text(value, {"name": "x", "classes": [{"label": "a"}]}, "sparql")
