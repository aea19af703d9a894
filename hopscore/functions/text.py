"""Text functions: stripping, query extraction and query clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a strip removes (all Unicode white space and the four ASCII separators).
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The marks of fenced code and the tags that belong to the fence, not to the query.
FENCE = "```"
FENCE_TAG = r"(?iu)^(?:cypher|sparql|gremlin)"
INLINE_CODE = "`([^`]+)`"

# Fixed value: an upper-case relationship type just before its closing bracket or its property map.
UPPER_RELATION = rf":[{SPACE_CLASS}]*([A-Z_]+)(?=[{SPACE_CLASS}]*[\]\{{])"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often it is used: it becomes the variable of a
    lambda. For values that are dear to make, such as parsed JSON."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space at both ends; Spark's plain ``trim`` removes blanks only."""
    return F.btrim(text, F.lit(SPACES))


def fold(text: Column) -> Column:
    """The form in which answers and decoded texts are compared."""
    return F.lower(strip(text))


def capitalize(text: Column) -> Column:
    """First letter up, all others down (``initcap`` would raise every word)."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def extract_query(completion: Column) -> Column:
    """The query inside a model completion: first fenced block, else first inline code, else the whole text."""
    parts = F.split(completion, FENCE, 3)
    fenced = F.regexp_replace(F.get(parts, F.lit(1)), FENCE_TAG, "")
    inline = F.nullif(F.regexp_extract(completion, INLINE_CODE, 1), F.lit(""))
    return strip(F.when(F.size(parts) == 3, fenced).otherwise(F.coalesce(inline, completion)))


def lower_relations(query: Column) -> Column:
    """Lower-case relationship types. The text between matches is kept and woven with the lowered captures."""
    between = F.split(query, UPPER_RELATION)
    lowered = F.transform(F.regexp_extract_all(query, F.lit(UPPER_RELATION), 1), lambda r: F.concat(F.lit(":"), F.lower(r)))
    woven = F.zip_with(between, lowered, lambda text, rel: F.concat(text, F.coalesce(rel, F.lit(""))))
    return F.array_join(woven, "")


# The clean-up steps a connection may ask for by name.
CLEANUPS = {"lowercase_relationships": lower_relations}


def clean_query(query: Column, steps: list[str]) -> Column:
    """Apply the named clean-up steps in order; unknown names change nothing."""
    for step in steps:
        query = CLEANUPS[step](query) if step in CLEANUPS else query
    return query


def python_quoted(text: Column) -> Column:
    """A string as it appears inside a printed list."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def float_text(number: Column) -> Column:
    """A double in shortest decimal form: plain from 1e-4 up to 1e16, with an exponent outside that range."""
    raw = number.cast("string")
    moved = F.get(F.transform(F.array(raw), _moved_point), F.lit(0))  # a bound name: repeated in the plan, it makes methods too long to be compiled
    return (
        F.when(F.isnan(number), "nan")
        .when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when(~F.contains(raw, F.lit("E")), raw)
        .otherwise(moved)
    )


def _moved_point(raw: Column) -> Column:
    """A number written with an exponent, in the form of ``float_text``."""
    sign = F.when(F.startswith(raw, F.lit("-")), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(raw, r"E.*|[.\-]", ""), "(?<=.)0+$", "")
    exponent = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    fraction = F.substr(digits, exponent + 2)
    large = F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    tail = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    power = F.abs(exponent).cast("string")
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.when(F.length(power) < 2, "0").otherwise(""), power)
    scientific = F.concat(F.left(digits, F.lit(1)), tail, F.lit("e"), power)
    return (
        F.when(exponent.between(0, 15), F.concat(sign, large))
        .when(exponent.between(-4, -1), F.concat(sign, small))
        .otherwise(F.concat(sign, scientific))
    )
