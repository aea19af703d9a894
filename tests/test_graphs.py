import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopscore.functions.terms import parse_term, term_text
from hopscore.functions.values import graph_value, traversal_value, value_text
from hopscore.model import EDGES, TRIPLES
from hopscore.operators import hops
from hopscore.operators.execution import (
    answer_of_cells,
    collect_answers,
    exec_outcome,
    first_row_columns,
    json_cell,
    pack_answers,
    row_counts,
    row_values,
    wrap_scalars,
)
from hopscore.operators.hops import hop_answers
from hopscore.operators.patterns import triple_ask, triple_select
from hopscore.sources.graph import edges_from, parse_triples, read_triples, triple_terms

QUERIES = "question_id string, seed string, path array<struct<rel: string, reverse: boolean>>"


def walk(edges, seed, path):
    """Brute force: the nodes at the end of a path."""
    nodes = {seed}
    for rel, reverse in path:
        steps = [(d, s) if reverse else (s, d) for s, r, d in edges if r == rel]
        nodes = {far for near, far in steps if near in nodes}
    return nodes


def answers(spark, edges, queries):
    found = hop_answers(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(edges, EDGES))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def expected(edges, queries):
    return {(q, a) for q, seed, path in queries for a in walk(edges, seed, path or []) if path is not None}


MOVIES = [("a", "ACTED", "m1"), ("a", "ACTED", "m2"), ("b", "ACTED", "m2"), ("d", "DIRECTED", "m2"), ("m1", "NEXT", "m2"), ("m2", "NEXT", "m1")]


def test_hops(spark):
    queries = [
        ("one", "a", [("ACTED", False)]),
        ("two", "a", [("ACTED", False), ("DIRECTED", True)]),
        ("three", "d", [("DIRECTED", False), ("ACTED", True), ("ACTED", False)]),
        ("cycle", "m1", [("NEXT", False), ("NEXT", None), ("NEXT", False), ("NEXT", False)]),
        ("unknown", "zz", [("ACTED", False)]),
        ("no edge", "a", [("NOPE", False), ("ACTED", False)]),
        ("empty", "a", []),
        ("null", "a", None),
        ("same", "a", [("ACTED", False), ("DIRECTED", True)]),
    ]
    assert answers(spark, MOVIES, queries) == expected(MOVIES, queries)


NODES = st.sampled_from("uvwxyz")
PATH = st.lists(st.tuples(st.sampled_from("RS"), st.booleans()), max_size=4)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(NODES, st.sampled_from("RS"), NODES), min_size=1, max_size=25),
    st.lists(st.tuples(NODES, PATH), min_size=1, max_size=20),
    st.sampled_from([1, 4]),
    st.sampled_from([0, 10_000]),
    st.sampled_from([0, 1 << 20]),
)
def test_hops_like_brute_force(spark, edges, asked, crowd, small, few):
    """With and without shared walks, relations pushed into the scans, and broadcast walkers."""
    queries = [(f"q{i}", seed, path) for i, (seed, path) in enumerate(asked)]
    before = hops.CROWD, hops.SMALL, hops.FEW_BYTES
    hops.CROWD, hops.SMALL, hops.FEW_BYTES = crowd, small, few
    try:
        assert answers(spark, edges, queries) == expected(edges, queries)
    finally:
        hops.CROWD, hops.SMALL, hops.FEW_BYTES = before


def test_a_hub_is_walked_on_once(spark, monkeypatch):
    """600 questions meet at one hub with 500 edges; what leaves the hub must not be repeated per question."""
    edges = spark.range(600).select(F.concat(F.lit("c"), "id").alias("src"), F.lit("IN").alias("rel"), F.lit("hub").alias("dst"))
    far = spark.range(500).select(F.lit("hub").alias("src"), F.lit("OUT").alias("rel"), F.concat(F.lit("s"), "id").alias("dst"))
    back = far.select(F.col("dst").alias("src"), F.lit("IN").alias("rel"), F.lit("end").alias("dst"))
    path = F.array(*[F.struct(F.lit(r).alias("rel"), F.lit(False).alias("reverse")) for r in ("IN", "OUT", "IN")])
    queries = spark.range(600).select(F.concat(F.lit("q"), "id").alias("question_id"), F.concat(F.lit("c"), "id").alias("seed"), path.alias("path"))
    sizes = []
    monkeypatch.setattr(hops, "_advance", lambda *args, original=hops._advance: sizes.append(original(*args)) or sizes[-1])
    found = hop_answers(queries, edges.union(far).union(back))
    assert found.count() == 600 and found.select("answer").distinct().first().answer == "end"
    assert [s.count() for s in sizes] == [600, 500, 1]


def test_hot_node_is_split_by_adaptive_execution(spark):
    settings_ = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 60000, 1, 8)
        hot = F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("n"), "id"))
        edges = ids.select(hot.alias("src"), F.lit("R").alias("rel"), F.concat(F.lit("d"), "id").alias("dst"))
        path = F.array(F.struct(F.lit("R").alias("rel"), F.lit(False).alias("reverse")))
        queries = spark.range(12).select(F.concat(F.lit("q"), "id").alias("question_id"), hot.alias("seed"), path.alias("path"))
        found = hop_answers(queries, edges)
        assert len(found.collect()) == 4 * 20000 + 8
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edges_from_prunes_other_relations(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, y int")
    edges = edges_from([("R", a, a["x"], a["y"]), ("S", b, b["x"], b["y"])])
    assert {tuple(r) for r in edges.collect()} == {("1", "R", "2"), ("3", "S", "4")}
    assert "Union" not in edges.filter("rel = 'R'")._jdf.queryExecution().optimizedPlan().toString()


# Triple patterns


def bindings(triples, patterns):
    found = [{}]
    for pattern in patterns:
        step = []
        for binding in found:
            for triple in triples:
                new = dict(binding)
                if all((new.setdefault(t, v) == v) if t.startswith("?") else t == v for t, v in zip(pattern, triple)):
                    step.append(new)
        found = step
    return found


TERMS = st.sampled_from(["<a>", "<b>", "<c>"])
SLOT = st.sampled_from(["?x", "?y", "?z", "<a>", "<b>"])


@settings(max_examples=12, deadline=None)
@given(st.sets(st.tuples(TERMS, TERMS, TERMS), min_size=1, max_size=12), st.lists(st.tuples(SLOT, SLOT, SLOT), min_size=1, max_size=4))
def test_patterns_like_brute_force(spark, triples, patterns):
    frame = spark.createDataFrame(sorted(triples), TRIPLES)
    variables = sorted({t for p in patterns for t in p if t.startswith("?")})
    want = bindings(sorted(triples), patterns)
    try:
        assert triple_ask(frame, patterns).first().result == bool(want)
        if variables:
            for kept in (variables, variables[:1]):
                rows = sorted(tuple(b[v] for v in kept) for b in want)
                assert sorted(map(tuple, triple_select(frame, patterns, kept).collect())) == rows
                assert sorted(map(tuple, triple_select(frame, patterns, kept, distinct=True).collect())) == sorted(set(rows))
    except ValueError as error:
        assert "cross product" in str(error)


def test_select_needs_known_variables(spark):
    with pytest.raises(ValueError):
        triple_select(spark.createDataFrame([], TRIPLES), [("?x", "<p>", "?y")], ["?z"])


# Terms

LINES = [
    '<http://e/s> <http://e/p> "plain" .',
    '_:b1 <p> <o>.',
    '  <s> <p> "say \\"hi\\"\\n\\u00e9\\U0001F600 \\\\n"@en . # note',
    '<s>\t<p>\t"042"^^<http://www.w3.org/2001/XMLSchema#integer> .',
    '<s> <p> "1.5E10"^^<http://www.w3.org/2001/XMLSchema#double> .',
    '<s> <p> "1"^^<http://www.w3.org/2001/XMLSchema#boolean> .',
    '<s> <p> "+1.50"^^<http://www.w3.org/2001/XMLSchema#decimal> .',
    '<s> <p> "seven"^^<http://www.w3.org/2001/XMLSchema#integer> .',
    '<s> <p> "2020-01-01"^^<http://www.w3.org/2001/XMLSchema#date> .',
    '<s><p>_:o.',
    '<s> <p> "" .',
    "# comment",
    "",
]
OBJECTS = ["plain", "o", 'say "hi"\né\U0001F600 \\n', "42", "15000000000.0", "true", "1.50", "seven", "2020-01-01", "_:o", ""]


def test_triples(spark, tmp_path):
    (tmp_path / "g.nt").write_text("\n".join(LINES))
    triples = read_triples(spark, str(tmp_path / "g.nt"))
    terms = triple_terms(triples)
    rows = terms.select(*[term_text(F.col(c)).alias(c) for c in "spo"], "o.kind", "o.datatype", "o.lang").collect()
    assert [r.o for r in rows] == OBJECTS
    assert (rows[0].s, rows[0].p, rows[1].s) == ("http://e/s", "http://e/p", "_:b1")
    assert rows[2].lang == "en" and rows[3].datatype.endswith("#integer") and rows[1].kind == "uri"


@pytest.mark.parametrize("line", ["<s> <p> .", "<s> <p> <o>", '"s" <p> <o> .', "<s> _:p <o> .", '<s> <p> "open .'])
def test_bad_triples_are_errors(spark, line):
    with pytest.raises(PySparkException):
        parse_triples(spark.createDataFrame([(line,)], "value string")).collect()


def test_unknown_term(value):
    assert value(parse_term, "string", "12") is None


# Answer rows


def test_collect_and_pack(spark):
    people = spark.createDataFrame([("q1", 1, "Bob", 25), ("q1", 0, "Alice", 30), ("q2", 0, None, 1)], "question_id string, row_idx int, name string, age int")
    one = people.select("question_id", "row_idx", F.array(json_cell(F.col("name"))).alias("cells"))
    two = people.select("question_id", "row_idx", F.array(json_cell(F.col("name")), json_cell(F.col("age"))).alias("cells"))
    packed = {r.question_id: r.result for r in pack_answers(collect_answers(one, "question_id"), ["question_id"]).collect()}
    assert packed == {"q1": ["Alice", "Bob"], "q2": [None]}
    packed = {r.question_id: r.result for r in pack_answers(collect_answers(two, "question_id"), ["question_id"]).collect()}
    assert packed == {"q1": ['["Alice",30]', '["Bob",25]'], "q2": ["[null,1]"]}
    asked = spark.createDataFrame([("q1",), ("q3",)], "question_id string")
    assert {tuple(r) for r in row_counts(asked, one, "question_id").collect()} == {("q1", 2, False), ("q3", 0, True)}
    many = spark.range(150_000).selectExpr("'q' AS question_id", "id AS row_idx", "CAST(id AS string) AS answer")
    (packed,) = pack_answers(many, ["question_id"]).selectExpr("size(result) AS n", "result[149999] AS last").collect()
    assert tuple(packed) == (150_000, "149999")


def test_outcomes(spark):
    rows = spark.createDataFrame(
        [(None, None, ["x"]), ("", None, None), ("q", "Connection failed", None), ("q", None, ["a", "a"]), ("q", None, None)],
        "query string, error string, result array<string>",
    )
    got = [tuple(r[0]) for r in rows.select(exec_outcome(F.col("query"), F.col("error"), F.col("result"))).collect()]
    missing = (None, False, "no query to execute")
    assert got == [missing, missing, (None, False, "Connection failed"), (["a", "a"], True, None), ([], True, None)]


def test_traversal_rows(spark):
    rows = spark.createDataFrame(
        [("q", 0, '{"name": "x", "n": {"k": [1, null]}, "none": null}'), ("q", 1, "7"), ("q", 2, '"text"'), ("q", 3, "null"), ("q", 4, "[1, 2]"), ("r", 5, "true")],
        "question_id string, row_idx int, value string",
    )
    wrapped = wrap_scalars(rows)
    assert [r["row"] for r in wrapped.collect()] == [
        {"name": '"x"', "n": '{"k":[1,null]}', "none": "null"}, {"value": "7"}, {"value": '"text"'}, {"value": "null"}, {"value": "[1, 2]"}, {"value": "true"},
    ]
    columns = {r.question_id: r.columns for r in first_row_columns(wrapped, "question_id").collect()}
    assert sorted(columns["q"]) == ["n", "name", "none"] and columns["r"] == ["value"]
    cells = row_values(F.col("row"), F.array(F.lit("name"), F.lit("absent")))
    assert wrapped.select(cells).first()[0] == ['"x"', None]
    texts = wrapped.filter("row_idx between 1 and 3").select(answer_of_cells(F.array(F.col("row")["value"])))
    assert [r[0] for r in texts.collect()] == ["7", "text", None]


# Canonical values


def canonical(frame, convert):
    converted = frame.select(convert(F.col("v"), frame.schema["v"].dataType).alias("v"))
    return [r[0] for r in converted.select(value_text(F.col("v"), converted.schema["v"].dataType)).collect()]


DAY, CLOCK = "year: int, month: int, day: int", "hour: int, minute: int, second: int, nanosecond: bigint"


@pytest.mark.parametrize(
    "dtype, item, text",
    [
        (f"struct<{DAY}>", (2024, 1, 31), "2024-01-31"),
        (f"struct<{DAY}, {CLOCK}>", (2024, 1, 31, 3, 4, 5, 6999), "2024-01-31 03:04:05.000006"),
        (f"struct<{CLOCK}>", (3, 4, 5, 999), "03:04:05"),
        (f"array<struct<{DAY}>>", [(2024, 1, 31), None], '["2024-01-31",null]'),
        ("struct<months: int, days: int, seconds: int, nanoseconds: int>", (1, 2, 3, 4), '{"months":1,"days":2,"seconds":3,"nanoseconds":4}'),
        (
            f"struct<element_id: string, labels: array<string>, properties: map<string, struct<{DAY}>>>",
            ("n1", ["A"], {"d": (2024, 1, 1)}),
            '{"id":"n1","labels":["A"],"properties":{"d":{"year":2024,"month":1,"day":1}}}',
        ),
        (
            "map<string, struct<element_id: string, type: string, start_node: string, end_node: string, properties: map<string, int>>>",
            {"r": ("r1", "T", "a", "b", {})},
            '{"r":{"id":"r1","type":"T","start":"a","end":"b","properties":{}}}',
        ),
        ("int", 7, "7"),
        ("string", None, None),
        (f"struct<{DAY}>", None, None),
    ],
)
def test_graph_values(spark, dtype, item, text):
    assert canonical(spark.createDataFrame([(item,)], f"v {dtype}"), graph_value) == [text]


VERTEX = "struct<id: int, label: string>"


@pytest.mark.parametrize(
    "dtype, item, text",
    [
        (VERTEX, (1, "A"), '{"id":1,"label":"A"}'),
        (f"struct<id: string, label: string, inV: {VERTEX}, outV: {VERTEX}>", ("e", "L", (1, "A"), (2, "B")), '{"id":"e","label":"L","inV":1,"outV":2}'),
        (f"struct<labels: array<array<string>>, objects: array<{VERTEX}>>", ([["x"], []], [(1, "A")]), '{"labels":[["x"],[]],"objects":[{"id":1,"label":"A"}]}'),
        (f"array<map<string, {VERTEX}>>", [{"k": (1, "A")}], '[{"k":{"id":1,"label":"A"}}]'),
        ("double", 1.5, "1.5"),
    ],
)
def test_traversal_values(spark, dtype, item, text):
    assert canonical(spark.createDataFrame([(item,)], f"v {dtype}"), traversal_value) == [text]


@pytest.mark.parametrize(
    "written, datatype, text",
    [
        ("1.5", "integer", "1.5"),
        ("1e3", "integer", "1e3"),
        ("007", "integer", "7"),
        ("01.50", "decimal", "1.50"),
        (".5", "decimal", "0.5"),
        ("-.5", "decimal", "-0.5"),
        ("1.0d", "double", "1.0d"),
        ("1e3", "double", "1000.0"),
    ],
)
def test_numbers_by_their_written_form(value, written, datatype, text):
    literal = f'"{written}"^^<http://www.w3.org/2001/XMLSchema#{datatype}>'
    assert value(lambda c: term_text(parse_term(c)), "string", literal) == text


@pytest.mark.parametrize("few_ends, rows", [(1000, 120), (3, 480)])
def test_a_crowd_shuffles_lists_in_its_last_hop(spark, monkeypatch, few_ends, rows):
    """60 questions stand on the same two nodes with four ends each: 120 lists travel, or 480 single ends where a node has too many for a list."""
    from hopscore.operators import hops

    monkeypatch.setattr(hops, "FEW_ENDS", few_ends)
    monkeypatch.setattr(hops, "BUCKETS", 1)
    edges = [(f"s{i}", "A", f"h{j}") for i in range(60) for j in range(2)] + [(f"h{j}", "B", f"x{i + 2 * j}") for i in range(4) for j in range(2)]
    asked = [(f"q{i}", f"s{i}", [("A", False), ("B", False)]) for i in range(60)]
    frame = spark.createDataFrame(asked, "question_id string, seed string, path array<struct<rel: string, reverse: boolean>>")
    found = hop_answers(frame, spark.createDataFrame(edges, "src string, rel string, dst string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"q{i}", f"x{j}") for i in range(60) for j in range(6))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("collect_list" in plan) == (rows == 120)
    assert ("RepartitionByExpression [root" in plan) == (rows == 120)


def test_a_term_text_is_no_method_too_long_to_be_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes of code for good."""
    xsd = "^^<http://www.w3.org/2001/XMLSchema#double>"
    written = ["1", "-1.5", "+2.50E3", "1e16", "-1e16", "1E-5", "0.0001", "-1.25e-3", "1e15", "123456789.125", "INF", "-INF", "NaN", "1e300", "x"]
    lines = spark.createDataFrame([(f'<a> <b> "{x}"{xsd} .',) for x in written], "value string")
    parsed = triple_terms(parse_triples(lines))
    texts = parsed.select(*[term_text(F.col(c)).alias(c) for c in ("s", "p", "o")])
    stages = texts._jdf.queryExecution().debug().codegenToSeq()
    assert all(stages.apply(i)._3().maxMethodCodeSize() <= 8_000 for i in range(stages.size()))
    assert [r.o for r in texts.collect()] == [
        "1.0", "-1.5", "2500.0", "1e+16", "-1e+16", "1e-05", "0.0001", "-0.00125", "1000000000000000.0", "123456789.125", "inf", "-inf", "nan",
        "1e+300", "x",
    ]
