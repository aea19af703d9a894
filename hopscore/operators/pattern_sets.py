"""Triple-pattern queries of many questions at once.

Each question brings its own patterns. Questions whose patterns differ only in their constants (subjects, objects and relations alike) and
in the names of their variables have one *shape*: they share one join plan, in which the constants are columns that join with the
triples. Questions with equal constants share the rows, too: each distinct tuple of constants is answered once and joined back to the
questions at the end. So the number of jobs follows the number of shapes, never that of questions.

Patterns that fall apart into groups without a common variable are refused for that question only, like selected variables that stand in
no pattern: it gets a row in ``errors``, all others are answered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.functions.terms import parse_term, term_text
from hopscore.operators.execution import answer_of_cells
from hopscore.session import cut_lineage, stored

POSITIONS = ("s", "p", "o")
AT_ONCE = 16  # shapes in one plan; more are answered one group after another
MOST_TASKS = 1_000  # in which dealt questions meet their answers
DEAL = 500  # questions, and answers, of one tuple of constants that meet in one place
FEW_RELATIONS = 256  # relations of a shape's pattern that are pushed into the scan of the triples

#: Why a question is refused.
APART = "the patterns fall apart into groups without a common variable"
UNBOUND = "a selected variable stands in no pattern"
NO_PATTERN = "no patterns"


class Answers:
    """``rows``: ``question_id, cells`` with one term per selected variable; a question that selects none asks whether its patterns match and
    has one row, ``true`` or ``false``. ``errors``: ``question_id, engine_error``. The jobs of ``rows`` run when it is first asked for."""

    def __init__(self, answer: Callable[[], DataFrame], errors: DataFrame):
        self._answer, self.errors = answer, errors

    @cached_property
    def rows(self) -> DataFrame:
        return self._answer()


def shape_of(patterns: list[tuple[str, str, str]], select: list[str], distinct: bool) -> tuple[str, list[str]]:
    """The shape as JSON and the constants it leaves out, in order. Patterns with more constants and known variables come first."""
    rest, known = [tuple(p) for p in patterns], set()
    names: dict[str, str] = {}
    constants: list[str] = []
    ordered = []

    def form(pattern: tuple[str, str, str]) -> list:
        """How a pattern looks without the names of constants and new variables: the order never depends on those."""
        seen: dict[str, int] = {}
        return ["c" if not t.startswith("?") else names.get(t) or f"n{seen.setdefault(t, len(seen))}" for t in pattern]

    def rank(pattern: tuple[str, str, str]) -> tuple:
        look, held = form(pattern), {t for t in pattern if t.startswith("?")}
        ends = sum(look[i][0] != "n" for i in (0, 2))  # a known subject or object narrows more than a known relation
        return bool(known and held and not held & known), -ends, look[1][0] == "n", look, pattern

    while rest:
        chosen = min(rest, key=rank)
        held = {t for t in chosen if t.startswith("?")}
        if known and held and not held & known:
            raise ValueError(APART)
        rest.remove(chosen)
        known |= held
        row = []
        for term in chosen:
            if term.startswith("?"):
                row.append(names.setdefault(term, f"v{len(names)}"))
            else:
                row.append(f"c{len(constants)}")
                constants.append(term)
        ordered.append(row)
    if not ordered:
        raise ValueError(NO_PATTERN)
    if not set(select) <= known:
        raise ValueError(UNBOUND)
    return json.dumps({"patterns": ordered, "select": [names[v] for v in select], "distinct": distinct}), constants


def with_shapes(queries: DataFrame) -> DataFrame:
    """``question_id, shape, constants, engine_error`` from ``question_id, patterns, select`` and, if there, ``distinct``."""
    kind = queries.schema["question_id"].dataType.simpleString()

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for patterns, select, distinct in zip(frame["patterns"], frame["select"], frame["distinct"], strict=True):
                try:
                    found = [] if patterns is None else [(p["s"], p["p"], p["o"]) for p in patterns]
                    rows.append((*shape_of(found, [] if select is None else list(select), bool(distinct)), None))
                except (ValueError, AttributeError) as error:  # AttributeError: a pattern with a NULL part
                    rows.append((None, None, str(error) if isinstance(error, ValueError) else "a pattern has no subject, relation or object"))
            out = pd.DataFrame(rows, columns=["shape", "constants", "engine_error"])
            out.insert(0, "question_id", frame["question_id"].to_numpy())
            yield out

    distinct = F.coalesce("distinct", F.lit(False)) if "distinct" in queries.columns else F.lit(False)
    asked = queries.select("question_id", "patterns", "select", distinct.alias("distinct"))
    return asked.mapInPandas(name, f"question_id {kind}, shape string, constants array<string>, engine_error string")


def _relations(tuples: DataFrame) -> dict[str, dict[str, list[str]]]:
    """The relations of each shape by constant, where they are few: no more than FEW_RELATIONS + 1 per shape and constant are kept."""
    slots = F.transform(F.from_json("shape", "patterns array<array<string>>")["patterns"], lambda p: p[1])
    each = tuples.select("shape", "constants", F.explode(slots).alias("slot")).filter(F.startswith("slot", F.lit("c")))
    named = each.select("shape", "slot", F.get("constants", F.substr("slot", F.lit(2)).cast("int")).alias("rel")).distinct()
    few = named.groupBy("shape", "slot").agg(F.count(F.lit(1)).alias("n"))
    kept = named.join(few.filter(F.col("n") <= FEW_RELATIONS), ["shape", "slot"], "left_semi")
    lists: dict[str, dict[str, list[str]]] = {}
    for shape, slot, rels in kept.groupBy("shape", "slot").agg(F.array_sort(F.collect_list("rel"))).collect():
        lists.setdefault(shape, {})[slot] = rels
    return lists


def _scan(triples: DataFrame, pattern: list[str], relations: dict[str, list[str]]) -> DataFrame:
    """The triples a pattern may match, with a column per term of the pattern; a term that stands twice must be equal."""
    rows, seen = triples, {}
    if pattern[1] in relations:
        rows = rows.filter(F.col("p").isin(relations[pattern[1]]))
    for position, term in zip(POSITIONS, pattern, strict=True):
        if term in seen:
            rows = rows.filter(F.col(position) == F.col(seen[term]))
        else:
            seen[term] = position
    return rows.select(*[F.col(position).alias(term) for term, position in seen.items()])


def _answer_shape(tuples: DataFrame, triples: DataFrame, shape: str, relations: dict[str, list[str]]) -> DataFrame:
    """``id, cells`` for every tuple of constants of one shape."""
    plan = json.loads(shape)
    patterns, output, distinct = plan["patterns"], plan["select"], plan["distinct"]
    asks = not output
    count = sum(term.startswith("c") for pattern in patterns for term in pattern)
    own = tuples.filter(F.col("shape") == shape).select("id", *[F.get("constants", F.lit(i)).alias(f"c{i}") for i in range(count)])
    bindings = own
    for i, pattern in enumerate(patterns):
        needed = {term for later in patterns[i + 1 :] for term in later} | set(output)
        matches = _scan(triples, pattern, relations)
        shared = [term for term in matches.columns if term in bindings.columns]
        new = [term for term in matches.columns if term not in bindings.columns and term in needed]
        if not shared:  # only a shape without any constant begins so, and all its questions are one tuple
            bindings = own.join(matches.select(*new).distinct() if asks or distinct else matches.select(*new))
        elif (asks or distinct) and not new or all(term.startswith("c") for term in pattern):
            bindings = bindings.join(matches.select(*shared), shared, "left_semi")
        else:
            matches = matches.select(*shared, *new)
            bindings = bindings.join(matches.distinct() if (asks or distinct) and len(matches.columns) < len(set(pattern)) else matches, shared)
        kept = [c for c in bindings.columns if c == "id" or c in needed]
        bindings = bindings.select(*kept)
        if (asks or distinct) and len(kept) < len(set(shared + new)) + 1:
            bindings = bindings.distinct()
    if asks:
        found = bindings.select("id").distinct().withColumn("found", F.lit(True))
        truth = F.coalesce("found", F.lit(False)).cast("string")
        return own.select("id").join(found, "id", "left").select("id", F.array(truth).alias("cells"))
    rows = bindings.select("id", F.array(*map(F.col, output)).alias("cells"))
    return rows.distinct() if distinct else rows


def _deal(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """``asked`` and ``answered`` joined by ``id``. Where many questions share a tuple with many answers, both are dealt to a grid of places of at
    most about DEAL by DEAL rows: each question stands in one row of its grid and each answer in one column, so that no task makes all rows of a tuple."""
    sides = [(asked, "down", "across"), (answered, "across", "down")]
    grid = None
    for rows, name, _ in sides:
        count = rows.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias(name))
        grid = grid.join(count, "id") if grid is not None else count
    grid = stored(grid.filter("down > 1 OR across > 1"), "grids")  # broadcast: a row stands for more than DEAL others
    dealt = []
    for rows, name, other in sides:
        own = F.floor(F.rand(7) * F.coalesce(name, F.lit(1))).cast("int")  # the rows are stored, so a task that is repeated deals them alike
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        dealt.append(rows.join(F.broadcast(grid), "id", "left").withColumn(f"{name}_at", own).withColumn(f"{other}_at", every).drop("down", "across"))
    places = grid.agg(F.coalesce(F.sum(F.col("down").cast("bigint") * F.col("across")), F.lit(0))).first()[0]
    if places:
        tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(places, MOST_TASKS))
        dealt = [rows.repartition(tasks, "id", "down_at", "across_at") for rows in dealt]  # by number: such tasks are not merged for their few bytes
    return dealt[0].join(dealt[1], ["id", "down_at", "across_at"]).drop("id", "down_at", "across_at")


def triple_answers(queries: DataFrame, triples: DataFrame, shown: dict[str, Column] | None = None) -> Answers:
    """Answers of all questions: ``queries(question_id, patterns ARRAY<STRUCT<s, p, o>>, select ARRAY<STRING>[, distinct])`` over
    ``triples(s, p, o)``, in which a triple stands once. Terms that begin with ``?`` are variables, all others constants in written form.

    Rows keep their number (``distinct`` questions have each row once). Constants meet the triples by equi joins whose shared side is the
    small one, so a hot node is split by adaptive execution; relations that are few are pushed into the scans. ``shown`` names columns over
    ``cells`` that stand in ``rows`` in their place: they are computed once per answer of a tuple, not for each question that shares it.
    Runs one job that writes the distinct tuples of constants, one that reads their shapes, one that writes the answers of the tuples, and one that
    counts them.
    """
    shaped = cut_lineage(with_shapes(queries))
    errors = shaped.filter(F.col("shape").isNull()).select("question_id", "engine_error")
    return Answers(lambda: _answer(shaped.filter(F.col("shape").isNotNull()), triples, shown), errors)


def _answer(named: DataFrame, triples: DataFrame, shown: dict[str, Column] | None) -> DataFrame:
    tuples = cut_lineage(named.select("shape", "constants").distinct().withColumn("id", F.monotonically_increasing_id()))
    shapes = [row[0] for row in tuples.select("shape").distinct().orderBy("shape").toLocalIterator()]
    relations = _relations(tuples)
    parts = []
    for first in range(0, len(shapes), AT_ONCE):
        group = [_answer_shape(tuples, triples, shape, relations.get(shape, {})) for shape in shapes[first : first + AT_ONCE]]
        part = reduce(DataFrame.unionByName, group)
        parts.append(stored(part, "pattern-answers") if len(shapes) > AT_ONCE else part)
    empty = tuples.select("id", F.lit(None).cast("array<string>").alias("cells")).limit(0)
    answered = reduce(DataFrame.unionByName, parts) if parts else empty
    asked = named.join(tuples, ["shape", "constants"]).select("question_id", "id")
    if shown:
        answered = stored(answered, "pattern-answers").select("id", *[column.alias(name) for name, column in shown.items()])
    return _deal(stored(asked, "pattern-questions"), stored(answered, "pattern-texts"))


def term_cell(term: Column) -> Column:
    """A term as the JSON cell of an answer row."""
    text = F.to_json(F.array(term_text(parse_term(term))))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def text_of_terms(cells: Column) -> Column:
    """The answer text of a row of terms, or of ``true`` or ``false``."""
    truth = cells[0].isin("true", "false") & (F.size(cells) == 1)  # written terms begin with <, _: or a quote
    return answer_of_cells(F.when(truth, cells).otherwise(F.transform(cells, term_cell)))


def answers_of_terms(rows: DataFrame) -> DataFrame:
    """``question_id, row_idx, answer`` as the execute stage takes them. Patterns give no order, so all rows have place 0."""
    return rows.select("question_id", F.lit(0).alias("row_idx"), text_of_terms(F.col("cells")).alias("answer"))
