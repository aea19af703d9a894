"""Prompts and chat messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.session import broadcast_if_small

# Our own prompt texts, one per query language.
_TASK = (
    "You write {name} queries over a knowledge graph.\n"
    "Answer with one query on a single line and nothing else.\n"
    "{hint}\n\n"
    "Graph schema:\n{{{{ schema }}}}\n\n"
    "User question:\n{{{{ question }}}}\n\n"
    "{name} query:"
)
PROMPTS = {
    "cypher": _TASK.format(name="Cypher", hint="Match paths in the graph and return the answers."),
    "gremlin": _TASK.format(name="Gremlin", hint="Begin at the vertices or edges of `g` and return the answers."),
    "sparql": _TASK.format(name="SPARQL", hint="Use triple patterns and select the answers."),
}
# The marks of template syntax. Only plain variables are filled in here.
_SYNTAX = re.compile(r"\{\{|\{%|\{#")
_VARIABLE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{{ name }}`` places with columns. A name without a column is an error, and so are a NULL value and
    any other template syntax.

    The template is cut up once, so braces inside a value are never taken for a place to fill.
    """
    template = template.removesuffix("\n")
    if unknown := _SYNTAX.search(_VARIABLE.sub("", template)):
        raise ValueError(f"template syntax other than plain variables: {unknown.group()!r}")
    pieces, end = [], 0
    for place in _VARIABLE.finditer(template):
        name = place.group(1)
        if name not in values:
            raise KeyError(f"template variable {name!r} has no value")
        absent = F.raise_error(F.lit(f"template variable {name!r} is NULL"))
        pieces += [F.lit(template[end : place.start()]), F.coalesce(values[name], absent)]
        end = place.end()
    return F.concat(*pieces, F.lit(template[end:]))


def with_schema(questions: DataFrame, schemas: DataFrame, *keys: str) -> DataFrame:
    """Questions with the ``schema_text`` of their dataset and language (NULL if there is none). Schemas are measured first: as long as they can be
    broadcast, a dataset that most questions belong to is no hot key; beyond that, adaptive execution splits it."""
    keys = list(keys or ("dataset", "lang"))
    return questions.join(broadcast_if_small(schemas.select(*keys, "schema_text"), "schema_text"), keys, "left")


def prompt(lang: Column, question: Column, schema_text: Column, templates: dict[str, str] | None = None) -> Column:
    """The prompt of a question by query language; without a schema or a template it is the question itself."""
    text = question
    for name, template in (templates or PROMPTS).items():
        filled = render(template, {"question": question, "schema": schema_text})
        text = F.when((lang == name) & schema_text.isNotNull(), filled).otherwise(text)
    return text


def message(role: Column | str, content: Column) -> Column:
    """One chat message."""
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def messages_json(*messages: Column) -> Column:
    """The message list of one request, as JSON."""
    return F.to_json(F.array(*messages))


def run_id(dataset: Column, method: Column, lang: Column, model: Column) -> Column:
    """The name of a configuration's run."""
    return F.concat_ws("-", dataset, method, lang, model)
