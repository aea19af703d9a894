"""Triple patterns: conjunctive queries over a triple table, as equi joins on shared variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]
POSITIONS = ("s", "p", "o")


def _variables(pattern: Pattern) -> set[str]:
    return {term[1:] for term in pattern if term.startswith("?")}


def _matches(triples: DataFrame, pattern: Pattern, wanted: set[str]) -> DataFrame:
    """Bindings of one pattern: a filtered scan of the columns it needs."""
    rows, seen = triples, {}
    for position, term in zip(POSITIONS, pattern):
        if not term.startswith("?"):
            rows = rows.filter(F.col(position) == term)
        elif term[1:] in seen:
            rows = rows.filter(F.col(position) == F.col(seen[term[1:]]))
        else:
            seen[term[1:]] = position
    return rows.select(*[F.col(position).alias(name) for name, position in seen.items() if name in wanted])


def _join_order(patterns: list[Pattern]) -> list[Pattern]:
    """Most constants first, then always a pattern that shares a variable with those before it."""
    rest = sorted(patterns, key=lambda p: len(_variables(p)))
    ordered, bound = [], set()
    while rest:
        connected = [p for p in rest if not ordered or _variables(p) & bound]
        if not connected:
            raise ValueError("the patterns fall apart into groups without a common variable, a cross product")
        rest.remove(connected[0])
        ordered.append(connected[0])
        bound |= _variables(connected[0])
    return ordered


def triple_select(triples: DataFrame, patterns: list[Pattern], select: list[str], distinct: bool = False) -> DataFrame:
    """Bindings of the selected variables (``?x``); any other term is a constant in the table's written form.

    Each variable is dropped after the last pattern that needs it; with ``distinct``, equal bindings merge at once, so
    intermediate results hold no more than what is still asked for.
    """
    output = {variable[1:] for variable in select}
    open_patterns = _join_order([p for p in patterns if _variables(p)])
    if not output or not output <= set().union(*map(_variables, open_patterns)):
        raise ValueError("every selected variable must occur in a pattern")
    bindings, bound = None, set()
    for i, pattern in enumerate(open_patterns):
        later = output.union(*map(_variables, open_patterns[i + 1 :]))
        matches = _matches(triples, pattern, later | bound)
        if distinct and len(matches.columns) < len(_variables(pattern)):
            matches = matches.distinct()
        shared = sorted(_variables(pattern) & bound)
        bindings = bindings.join(matches, shared) if bindings is not None else matches
        bound = (bound | _variables(pattern)) & later
        if bound != set(bindings.columns):
            bindings = bindings.select(*sorted(bound))
            bindings = bindings.distinct() if distinct else bindings
    for pattern in patterns:
        if not _variables(pattern):
            bindings = bindings.join(_any(triples, pattern), how="left_semi")
    named = bindings.select(*[variable[1:] for variable in select])
    return named.distinct() if distinct else named


def triple_ask(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """One row, ``result``: whether the patterns match at all.

    A pattern that brings no variable a later one needs is a semi join, and nothing is made distinct but the needed columns of one
    pattern, so the first row of the last join ends its task.
    """
    open_patterns = _join_order([p for p in patterns if _variables(p)])
    found, bound = None, set()
    for i, pattern in enumerate(open_patterns):
        later = set().union(*map(_variables, open_patterns[i + 1 :]))
        own = _variables(pattern)
        matches = _matches(triples, pattern, later | bound)
        if found is None:
            found = matches if matches.columns else matches.select(F.lit(True).alias("known"))
        elif own & later <= bound:
            found = found.join(matches, sorted(own & bound), "left_semi")
        else:
            found = found.join(matches.distinct() if len(matches.columns) < len(own) else matches, sorted(own & bound))
        bound = (bound | own) & later
        found = found.select(*sorted(bound)) if bound else found
    for pattern in patterns:
        if not _variables(pattern):
            known = _any(triples, pattern)
            found = known if found is None else found.join(known, how="left_semi")
    return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))


def _any(triples: DataFrame, constant: Pattern) -> DataFrame:
    """At most one row: whether one given triple is there."""
    return _matches(triples, constant, set()).select(F.lit(True).alias("known")).limit(1)
