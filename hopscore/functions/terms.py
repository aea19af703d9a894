"""RDF terms: from their written form to a struct, and from the struct to an answer text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopscore.functions.text import float_text

XSD = "http://www.w3.org/2001/XMLSchema#"
TERM = "struct<kind string, value string, datatype string, lang string>"

# The written forms of a term and the escapes inside a quoted literal.
IRI = r"<[^<>\s]*>"
BLANK = r"_:[^\s<>\"]*[^\s<>\".]"
LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:@[A-Za-z0-9\-]+|\^\^<[^<>\s]*>)?'
ESCAPE = r"""\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tbnrf"'\\])"""
ESCAPED = (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"))

# Datatypes by the kind of value they hold.
INTEGERS = (
    "integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger",
    "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte",
)
FLOATS = ("double", "float")
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
DOUBLE = r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"
BOOLEANS = (("true", "true"), ("1", "true"), ("false", "false"), ("0", "false"))


def _unescape(text: Column) -> Column:
    def plain(code: Column) -> Column:
        unicode = F.decode(F.unhex(F.lpad(F.substr(code, F.lit(2)), 8, "0")), "UTF-32")
        out = F.when(F.lower(F.left(code, F.lit(1))) == "u", unicode).otherwise(code)
        for letter, char in ESCAPED:
            out = F.when(code == letter, char).otherwise(out)
        return out

    between = F.split(text, ESCAPE)
    codes = F.regexp_extract_all(text, F.lit(ESCAPE), 1)
    woven = F.zip_with(between, codes, lambda t, c: F.concat(t, F.when(c.isNull(), "").otherwise(plain(c))))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(woven, "")).otherwise(text)


def parse_term(text: Column) -> Column:
    """A written term as ``struct<kind, value, datatype, lang>``; NULL if it is none of the three kinds."""
    none = F.lit(None).cast("string")

    def term(kind: str, value: Column, datatype: Column = none, lang: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), datatype.alias("datatype"), lang.alias("lang")
        )

    suffix = F.substring_index(text, '"', -1)  # what follows the closing quote
    lexical = _unescape(F.substr(text, F.lit(2), F.length(text) - F.length(suffix) - 2))
    datatype = F.when(F.startswith(suffix, F.lit("^^<")), F.substr(suffix, F.lit(4), F.length(suffix) - 4))
    lang = F.when(F.startswith(suffix, F.lit("@")), F.substr(suffix, F.lit(2)))
    return (
        F.when(F.startswith(text, F.lit("<")), term("uri", F.substr(text, F.lit(2), F.length(text) - 2)))
        .when(F.startswith(text, F.lit("_:")), term("bnode", F.substr(text, F.lit(3))))
        .when(F.startswith(text, F.lit('"')), term("literal", lexical, datatype, lang))
    )


def term_text(term: Column) -> Column:
    """The answer text of a term: URIs as they are, blank nodes with their prefix, literals by datatype. A literal that is not
    written as its datatype asks keeps its text."""
    value, datatype = term["value"], term["datatype"]
    types = {name: XSD + name for name in (*INTEGERS, *FLOATS, "boolean", "decimal")}
    boolean = F.lit(None).cast("string")
    for written, truth in BOOLEANS:
        boolean = F.when(value == written, truth).otherwise(boolean)
    unsigned = F.regexp_replace(F.regexp_replace(value, r"^\+|\.$", ""), r"^(-?)0+(?=[0-9])", "$1")
    decimal = F.regexp_replace(unsigned, r"^(-?)\.", "$10.")
    number = (
        F.when(datatype.isin([types[n] for n in INTEGERS]) & value.rlike(INTEGER), value.try_cast("decimal(38,0)").cast("string"))
        .when(datatype.isin([types[n] for n in FLOATS]) & value.rlike(DOUBLE), float_text(value.try_cast("double")))
        .when(datatype == types["boolean"], boolean)
        .when((datatype == types["decimal"]) & value.rlike(DECIMAL), decimal)
    )
    blank = F.concat(F.lit("_:"), value)
    return F.when(term["kind"] == "bnode", blank).when(datatype.isNull(), value).otherwise(F.coalesce(number, value))
