"""Questions, results, graphs and texts derived from the driver's tables, in Spark and in SQL side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions.text import SPACES
from hopscore.model import EVAL_TYPE, EXEC_TYPE, GEN_TYPE, STATS_TYPE
from hopscore.sources.graph import edges_from
from workload.registry import Tables

# One error text per category, in the order of the rows they are given to.
ERRORS = (
    "timeout: 40 s were not enough for this traversal",
    "the connection to graph-7 broke off",
    "bad syntax near RETURNS (line 2)",
    "Unknown relationship type 'SHIPPED_FROM' in part 3 of the query",
    "there is no label Warehouse in this graph",
    "parts have no property weight",
    "relationship type STORED_IN does not exist; [:LISTED_AT] is not found either",
    "the answer could not be read",
)
MODELS = ("gpt-4o", "deepseek-chat", "bart-base")
LANGS = ("cypher", "sparql", "gremlin")
DATASET = "orders"


def _pick(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (index % len(names) + 1).cast("int"))


def _sql_pick(index: str, names: tuple[str, ...]) -> str:
    listed = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"list_extract([{listed}], CAST({index} % {len(names)} + 1 AS INTEGER))"


# The same brand is written in two ways, so that answers have to be normalised before they are compared.
SQL_LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_quantity, p_brand,
         CASE WHEN l_linenumber % 2 = 0 THEN ' ' || upper(p_brand) || chr(9) ELSE p_brand END AS written
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def lines(t: Tables) -> DataFrame:
    """Order lines with their brand, written in one of two ways."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity"
    ).join(parts, "l_partkey")
    upper = F.concat(F.lit(" "), F.upper("p_brand"), F.lit("\t"))
    return joined.withColumn("written", F.when(F.col("l_linenumber") % 2 == 0, upper).otherwise(F.col("p_brand")))


SQL_QUESTIONS = (
    SQL_LINES
    + """,
gold AS (SELECT l_orderkey, list(DISTINCT written) AS answer FROM lines WHERE l_linestatus = 'F' GROUP BY 1),
questions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Which brands were shipped in order ' || o_orderkey || '?' AS question,
         coalesce(answer, []) AS answer, substr(o_orderpriority, 1, 1) AS hop, o_orderstatus AS split,
         CASE WHEN o_totalprice > 250000 THEN 'high' END AS tier
  FROM orders LEFT JOIN gold ON o_orderkey = l_orderkey)"""
)


def questions(t: Tables) -> DataFrame:
    """One question per order; the gold answers are the distinct brands of its shipped lines (a set bounded by the
    number of brands, so it can be gathered however many lines an order has)."""
    gold = lines(t).filter(F.col("l_linestatus") == "F").groupBy("l_orderkey").agg(F.collect_set("written").alias("answer"))
    extra = F.create_map(
        F.lit("hop"), F.left("o_orderpriority", F.lit(1)),
        F.lit("split"), F.col("o_orderstatus"),
        F.lit("tier"), F.when(F.col("o_totalprice") > 250000, "high"),
    )
    return t.orders.join(gold, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Which brands were shipped in order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"),
        F.coalesce("answer", F.array().cast("array<string>")).alias("answer"),
        F.map_filter(extra, lambda _, v: v.isNotNull()).alias("extra"),
    )


_QUERY_TEXT = "MATCH (o:Order)-[:CONTAINS]->(p) WHERE o.id = "
SQL_RESULTS = (
    SQL_QUESTIONS
    + f""",
found AS (
  SELECT l_orderkey, list(DISTINCT written) FILTER (WHERE l_returnflag <> 'R') AS predicted, count(*) AS n_lines
  FROM lines GROUP BY 1),
results AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS question_id,
         CASE WHEN o_orderkey % 3 = 2 THEN 'seq2seq' ELSE 'llm' END AS method,
         {_sql_pick("o_custkey", LANGS)} AS lang, {_sql_pick("o_orderkey", MODELS)} AS model,
         CASE o_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '{_QUERY_TEXT}' || o_orderkey || ' RETURN p' END AS query,
         o_orderkey % 13 <> 0 AS has_stats,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 100 END AS duration,
         CASE WHEN o_orderkey % 13 <> 0 THEN 100 + 10 * coalesce(n_lines, 0) END AS input_tokens,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 500 END AS output_tokens,
         CASE WHEN o_orderkey % 13 <> 0 THEN coalesce(n_lines, 0) END AS cached_tokens,
         o_orderkey % 11 <> 0 AS executed,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 7 <> 0 END AS success,
         CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 THEN {_sql_pick("o_orderkey", ERRORS)} END AS error,
         CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN coalesce(predicted, []) END AS result,
         o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 AS evaluated
  FROM orders LEFT JOIN found ON o_orderkey = l_orderkey)"""
)


def results(t: Tables) -> DataFrame:
    """One result per order under one of nine configurations, in every stage a result can be in."""
    kept = F.when(F.col("l_returnflag") != "R", F.col("written"))
    found = lines(t).groupBy("l_orderkey").agg(F.collect_set(kept).alias("predicted"), F.count(F.lit(1)).alias("n_lines"))
    key = F.col("o_orderkey")
    n_lines = F.coalesce("n_lines", F.lit(0)).cast("bigint")
    query = F.concat(F.lit(_QUERY_TEXT), key.cast("string"), F.lit(" RETURN p"))
    stats = F.struct(
        (F.col("o_totalprice") / 100).alias("duration"),
        (n_lines * 10 + 100).alias("input_tokens"),
        (F.floor("o_totalprice").cast("bigint") % 500).alias("output_tokens"),
        n_lines.alias("cached_tokens"),
    ).cast(STATS_TYPE)
    gen = F.struct(
        F.when(key % 17 == 1, "").when(key % 17 > 1, query).alias("query"), F.when(key % 13 != 0, stats).alias("stats")
    )
    succeeded = key % 7 != 0
    execution = F.struct(
        F.when(succeeded, F.coalesce("predicted", F.array().cast("array<string>"))).alias("result"),
        succeeded.alias("success"),
        F.when(~succeeded, _pick(key, ERRORS)).alias("error"),
    )
    earlier = F.struct(*[F.lit(0.5).alias(name) for name in EVAL_TYPE.names])
    return t.orders.join(found, key == F.col("l_orderkey"), "left").select(
        key.cast("string").alias("question_id"),
        F.when(key % 3 == 2, "seq2seq").otherwise("llm").alias("method"),
        _pick(F.col("o_custkey"), LANGS).alias("lang"),
        _pick(key, MODELS).alias("model"),
        gen.cast(GEN_TYPE).alias("gen"),
        F.when(key % 11 != 0, execution).cast(EXEC_TYPE).alias("exec"),
        F.when((key % 11 != 0) & (key % 5 == 0), earlier).cast(EVAL_TYPE).alias("eval"),
    )


_TRIM = " || ".join(f"chr({ord(space)})" for space in SPACES)


def sql_strip(text: str) -> str:
    return f"trim({text}, {_TRIM})"


def sql_fold(text: str) -> str:
    return f"lower({sql_strip(text)})"


def sql_normal(answers: str) -> str:
    return f"list_sort(list_distinct(list_transform({answers}, lambda a: {sql_fold('a')})))"


# Every result with its question and its scores; scores are NULL unless the execution succeeded.
SQL_SCORED = (
    SQL_RESULTS
    + f""",
sets AS (
  SELECT r.*, q.hop, q.split, q.tier, {sql_normal("q.answer")} AS gold, {sql_normal("coalesce(r.result, [])")} AS pred
  FROM results r JOIN questions q ON q.id = r.question_id),
hits AS (SELECT *, len(list_intersect(gold, pred)) AS tp FROM sets),
scored AS (
  SELECT *, CASE WHEN success THEN CAST(gold = pred AS DOUBLE) END AS exact_match,
         CASE WHEN success THEN CASE WHEN len(pred) = 0 THEN 0.0 ELSE tp / len(pred) END END AS "precision",
         CASE WHEN success THEN CASE WHEN len(gold) = 0 THEN 0.0 ELSE tp / len(gold) END END AS recall,
         CASE WHEN success THEN CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (len(gold) + len(pred)) END END AS f1
  FROM hits)"""
)


SQL_EDGES = """
edges AS (
  SELECT 'c:' || o_custkey AS src, 'PLACED' AS rel, 'o:' || o_orderkey AS dst FROM orders
  UNION SELECT 'o:' || l_orderkey, 'CONTAINS', 'p:' || l_partkey FROM lineitem
  UNION SELECT 's:' || l_suppkey, 'SUPPLIES', 'p:' || l_partkey FROM lineitem
  UNION SELECT 'c:' || c_custkey, 'IN_NATION', 'n:' || c_nationkey FROM customer
  UNION SELECT 's:' || s_suppkey, 'IN_NATION', 'n:' || s_nationkey FROM supplier
  UNION SELECT 'n:' || n_nationkey, 'IN_REGION', 'r:' || n_regionkey FROM nation)"""


def edges(t: Tables) -> DataFrame:
    """The star schema as a graph."""

    def node(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))

    return edges_from(
        [
            ("PLACED", t.orders, node("c", "o_custkey"), node("o", "o_orderkey")),
            ("CONTAINS", t.lineitem, node("o", "l_orderkey"), node("p", "l_partkey")),
            ("SUPPLIES", t.lineitem, node("s", "l_suppkey"), node("p", "l_partkey")),
            ("IN_NATION", t.customer, node("c", "c_custkey"), node("n", "c_nationkey")),
            ("IN_NATION", t.supplier, node("s", "s_suppkey"), node("n", "s_nationkey")),
            ("IN_REGION", t.nation, node("n", "n_nationkey"), node("r", "n_regionkey")),
        ]
    )


SQL_TRIPLES = (
    SQL_EDGES
    + """,
triples AS (
  SELECT '<' || src || '>' AS s, '<' || rel || '>' AS p, '<' || dst || '>' AS o FROM edges
  UNION SELECT '<n:' || n_nationkey || '>', '<NAME>', '"' || n_name || '"' FROM nation
  UNION SELECT '<p:' || p_partkey || '>', '<BRAND>', '"' || p_brand || '"' FROM part)"""
)


def triples(t: Tables) -> DataFrame:
    """The graph as triples in written form, with names and brands as literals."""

    def wrap(value: Column, marks: str) -> Column:
        return F.concat(F.lit(marks[0]), value, F.lit(marks[-1]))

    graph = edges(t).select(*[wrap(F.col(c), "<>").alias(n) for c, n in (("src", "s"), ("rel", "p"), ("dst", "o"))])
    for table, kind, key, predicate, literal in (
        (t.nation, "n", "n_nationkey", "NAME", "n_name"),
        (t.part, "p", "p_partkey", "BRAND", "p_brand"),
    ):
        subject = wrap(F.concat(F.lit(kind + ":"), F.col(key).cast("string")), "<>")
        graph = graph.unionByName(
            table.select(subject.alias("s"), F.lit(f"<{predicate}>").alias("p"), wrap(F.col(literal), '""').alias("o"))
        )
    return graph


# Model completions: assistant turns as fenced code with a tag, inline code, or bare; and whole documents.
SQL_COMPLETIONS = """
completions AS (
  SELECT 'c' || conv_id || '-' || turn AS id,
         CASE turn % 3 WHEN 0 THEN 'Here it is:' || chr(10) || '```Cypher' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
                       WHEN 1 THEN 'Use `' || text || '` please' ELSE '  ' || text || chr(10) END AS raw, text
  FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT 'd' || doc_id, text, text FROM documents)"""


def completions(t: Tables) -> DataFrame:
    text = F.col("text")
    fenced = F.concat(F.lit("Here it is:\n```Cypher\n"), text, F.lit("\n```\nDone."))
    inline = F.concat(F.lit("Use `"), text, F.lit("` please"))
    bare = F.concat(F.lit("  "), text, F.lit("\n"))
    shape = F.col("turn") % 3
    turns = t.conversations.filter(F.col("role") == "assistant").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.when(shape == 0, fenced).when(shape == 1, inline).otherwise(bare).alias("raw"),
        "text",
    )
    documents = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), text.alias("raw"), "text")
    return turns.unionByName(documents)


# Training examples: each user turn with the assistant turn that follows it.
SQL_EXAMPLES = """
examples AS (
  SELECT list_extract(['train', 'train', 'train', 'val', 'test'], CAST(u.conv_id % 5 + 1 AS INTEGER)) AS split,
         u.conv_id * 1000 + u.turn AS example_id, u.text AS input, a.text AS target
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def examples(t: Tables) -> DataFrame:
    turns = t.conversations
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    said = turns.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return asked.join(said, ["conv_id", "turn"]).select(
        _pick(F.col("conv_id"), ("train", "train", "train", "val", "test")).alias("split"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"),
        "input",
        "target",
    )
