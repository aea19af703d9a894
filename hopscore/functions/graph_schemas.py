"""Graph schemas: from their JSON form to structs, and from the structs to prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopscore.functions.text import capitalize, once, python_quoted

PROPERTIES = "array<struct<name string, data_type string>>"
_NODE = "array<struct<label string, properties string>>"
_EDGE = (
    "array<struct<label string, source_label string, subj_label string, target_label string, obj_label string, "
    "properties string>>"
)
PROPERTY_GRAPH_JSON = (
    f"name string, extra map<string,string>, nodes {_NODE}, entities {_NODE}, edges {_EDGE}, relations {_EDGE}"
)
_RDF_PROPERTY = (
    "array<struct<uri string, label string, domain array<string>, range array<string>, is_object_property boolean>>"
)
RDF_JSON = (
    "name string, extra map<string,string>, prefixes map<string,string>, "
    "classes array<struct<uri string, label string, parent string>>, "
    f"object_properties {_RDF_PROPERTY}, datatype_properties {_RDF_PROPERTY}, properties {_RDF_PROPERTY}"
)
NO_EXTRA = "map<string,string>"


def _filled(items: Column, fallback: Column) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(fallback)


def _required(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"schema without {what}")))


def _whole_property(item: Column) -> Column:
    return F.struct(
        _required(item["name"], "a property name").alias("name"),
        _required(item["data_type"], "a property type").alias("data_type"),
    )


def _properties(raw: Column) -> Column:
    """Properties written as an object of types or as a list of name and type."""
    listed = F.transform(F.from_json(raw, PROPERTIES), _whole_property)
    mapped = F.transform(
        F.map_entries(F.from_json(raw, "map<string,string>")),
        lambda e: _whole_property(F.struct(e["key"].alias("name"), e["value"].alias("data_type"))),
    )
    parsed = F.when(F.startswith(raw, F.lit("{")), mapped).when(F.startswith(raw, F.lit("[")), listed)
    return F.coalesce(parsed, F.array().cast(PROPERTIES))


def parse_property_graph(text: Column) -> Column:
    """``struct<name, extra, nodes, edges>`` of a JSON schema. ``entities`` and ``relations`` stand in for missing or
    empty ``nodes`` and ``edges``, ``subj_label`` and ``obj_label`` for the ends of an edge."""
    return once(F.from_json(text, PROPERTY_GRAPH_JSON), _property_graph)


def _property_graph(raw: Column) -> Column:
    def end(edge: Column, name: str, other: str) -> Column:
        return _required(F.coalesce(F.nullif(edge[name], F.lit("")), edge[other]), f"an edge's {name}")

    nodes = F.transform(
        _filled(raw["nodes"], raw["entities"]),
        lambda n: F.struct(_required(n["label"], "a node label").alias("label"), _properties(n["properties"]).alias("properties")),
    )
    edges = F.transform(
        _filled(raw["edges"], raw["relations"]),
        lambda e: F.struct(
            _required(e["label"], "an edge label").alias("label"),
            end(e, "source_label", "subj_label").alias("source_label"),
            end(e, "target_label", "obj_label").alias("target_label"),
            _properties(e["properties"]).alias("properties"),
        ),
    )
    return F.struct(
        _required(raw["name"], "a name").alias("name"),
        F.coalesce(raw["extra"], F.create_map().cast(NO_EXTRA)).alias("extra"),
        F.coalesce(nodes, F.array().cast(f"array<struct<label string, properties {PROPERTIES}>>")).alias("nodes"),
        F.coalesce(
            edges,
            F.array().cast(
                f"array<struct<label string, source_label string, target_label string, properties {PROPERTIES}>>"
            ),
        ).alias("edges"),
    )


def parse_rdf_schema(text: Column) -> Column:
    """``struct<name, extra, prefixes, classes, properties>`` of a JSON schema; properties are the object properties,
    then the datatype properties, then the ones that say themselves which they are."""
    return once(F.from_json(text, RDF_JSON), _rdf_schema)


def _rdf_schema(raw: Column) -> Column:
    none = F.array().cast("array<string>")
    classes = F.transform(raw["classes"], lambda c: c.withField("uri", _required(c["uri"], "a class uri")))

    def properties(items: Column, kind: bool | None) -> Column:
        built = F.transform(
            items,
            lambda p: F.struct(
                _required(p["uri"], "a property uri").alias("uri"),
                p["label"].alias("label"),
                F.coalesce(p["domain"], none).alias("domain"),
                F.coalesce(p["range"], none).alias("range"),
                (F.coalesce(p["is_object_property"], F.lit(False)) if kind is None else F.lit(kind)).alias("is_object"),
            ),
        )
        empty = "array<struct<uri string, label string, domain array<string>, range array<string>, is_object boolean>>"
        return F.coalesce(built, F.array().cast(empty))

    return F.struct(
        _required(raw["name"], "a name").alias("name"),
        F.coalesce(raw["extra"], F.create_map().cast(NO_EXTRA)).alias("extra"),
        F.coalesce(raw["prefixes"], F.create_map().cast(NO_EXTRA)).alias("prefixes"),
        F.coalesce(classes, F.array().cast("array<struct<uri string, label string, parent string>>")).alias("classes"),
        F.concat(
            properties(raw["object_properties"], True),
            properties(raw["datatype_properties"], False),
            properties(raw["properties"], None),
        ).alias("properties"),
    )


def parse_schema(text: Column, lang: str) -> Column:
    """Schema struct for a query language; every language but SPARQL has property graphs."""
    return parse_rdf_schema(text) if lang == "sparql" else parse_property_graph(text)


def _sorted_by(items: Column, key: str) -> Column:
    """Stable sort: structs compare by key, then by position."""
    placed = F.transform(items, lambda item, pos: F.struct(item[key].alias("key"), pos.alias("pos"), item.alias("item")))
    return F.transform(F.array_sort(placed), lambda p: p["item"])


def _lines(*parts: Column | str) -> Column:
    arrays = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.concat(*arrays), "\n")


def _extra_lines(extra: Column) -> Column:
    pairs = F.transform(
        F.map_entries(extra), lambda e: F.array(F.concat(capitalize(e["key"]), F.lit(": "), e["value"]), F.lit(""))
    )
    return F.flatten(pairs)


def _property_list(properties: Column) -> Column:
    joined = F.array_join(F.transform(properties, lambda p: F.concat(p["name"], F.lit(": "), p["data_type"])), ", ")
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" ["), joined, F.lit("]")))


# The line layouts per query language, as format strings over the labels.
NODE_HEADING = {"cypher": "Nodes:", "gremlin": "Vertices:"}
NODE_LINE = {"cypher": "  (%s)%s", "gremlin": "  %s%s"}
EDGE_LINE = {"cypher": "  (:%s)-[:%s]->(:%s)%s", "gremlin": "  %s -[%s]-> %s%s"}


def property_graph_text(schema: Column, lang: str = "cypher") -> Column:
    """Prompt text of a property graph: name, extras, node lines and edge lines, both sorted by label."""
    nodes = F.transform(
        _sorted_by(schema["nodes"], "label"),
        lambda n: F.format_string(NODE_LINE[lang], n["label"], _property_list(n["properties"])),
    )
    edges = F.transform(
        _sorted_by(schema["edges"], "label"),
        lambda e: F.format_string(
            EDGE_LINE[lang], e["source_label"], e["label"], e["target_label"], _property_list(e["properties"])
        ),
    )
    title = F.array(F.concat(F.lit("Graph: "), schema["name"]))
    return _lines(title, "", _extra_lines(schema["extra"]), NODE_HEADING[lang], nodes, "", "Edges:", edges)


def rdf_schema_text(schema: Column) -> Column:
    """Prompt text of an RDF schema; sections for prefixes and classes appear only when there are any."""

    def section(heading: str, items: Column) -> Column:
        whole = F.concat(F.array(F.lit(heading)), items, F.array(F.lit("")))
        return F.when(F.size(items) > 0, whole).otherwise(F.array().cast("array<string>"))

    def optional(layout: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.format_string(layout, value))

    def listed(layout: str, values: Column) -> Column:
        return optional(layout, F.array_join(F.transform(values, python_quoted), ", "))

    prefixes = F.transform(
        F.array_sort(F.map_entries(schema["prefixes"])), lambda e: F.format_string("  %s: <%s>", e["key"], e["value"])
    )
    classes = F.transform(
        _sorted_by(schema["classes"], "uri"),
        lambda c: F.concat(
            F.lit("  "), c["uri"], optional(" (%s)", c["label"]), optional(" rdfs:subClassOf %s", c["parent"])
        ),
    )
    properties = F.transform(
        _sorted_by(schema["properties"], "uri"),
        lambda p: F.concat(
            F.lit("  "),
            p["uri"],
            optional(" (%s)", p["label"]),
            listed(" domain=[%s]", p["domain"]),
            listed(" range=[%s]", p["range"]),
            F.when(p["is_object"], " [ObjectProperty]").otherwise(" [DatatypeProperty]"),
        ),
    )
    title = F.array(F.concat(F.lit("RDF Graph: "), schema["name"]))
    return _lines(
        title,
        "",
        _extra_lines(schema["extra"]),
        section("Prefixes:", prefixes),
        section("Classes:", classes),
        "Properties:",
        properties,
    )


def schema_text(text: Column, lang: str) -> Column:
    """Prompt text straight from the JSON form."""
    if lang == "sparql":
        return once(parse_schema(text, lang), rdf_schema_text)
    layout = "gremlin" if lang == "gremlin" else "cypher"
    return once(parse_schema(text, lang), lambda schema: property_graph_text(schema, layout))
