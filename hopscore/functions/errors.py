"""Error texts: their category and the relations they name as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order of precedence, each with the words that give it away.
ERROR_WORDS = (
    ("timeout", ("timeout",)),
    ("connection", ("connection",)),
    ("syntax", ("syntax",)),
    ("missing_relationship", ("relationship", "rel_type")),
    ("missing_label", ("label", "node")),
    ("missing_property", ("property",)),
    ("no_query", ("no query",)),
)
OTHER = "other"

# The phrases in which engines name an unknown relation.
MISSING_RELATION = (
    r"Unknown relationship type '([^']+)'",
    r"Relationship type `([^`]+)` not found",
    r"relationship type (\w+) does not exist",
    r"\[:(\w+)\].*not found",
)


def classify_error(error: Column) -> Column:
    """The first category one of whose words occurs in the text."""
    text = F.lower(F.coalesce(error, F.lit("")))
    category = F.lit(OTHER)
    for name, words in reversed(ERROR_WORDS):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(text, F.lit(word))
        category = F.when(found, name).otherwise(category)
    return category


def missing_relations(error: Column) -> Column:
    """The relations an error text names, at most one per phrase."""
    text = F.coalesce(error, F.lit(""))
    captures = [F.regexp_extract(text, "(?iudU)" + phrase, 1) for phrase in MISSING_RELATION]
    return F.filter(F.array(*captures), lambda name: name != "")
