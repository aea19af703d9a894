"""Graphs as tables: property-graph edges and RDF triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscore.functions.terms import BLANK, IRI, LITERAL, parse_term

BLANKS = " \t\r\n\f\x0b"  # what may stand between the terms of a line


def edges_from(relations: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """``edges(src, rel, dst)`` from tables: each item names a relation, its table, and both ends as columns.

    An edge comes once per item, however many rows stand for it, so that a pair repeated in most rows of a table does
    not multiply in the joins. The relation is a literal per branch, so a filter on ``rel`` drops the tables it does
    not need from the plan.
    """

    def part(rel: str, table: DataFrame, src: Column, dst: Column) -> DataFrame:
        pairs = table.select(src.cast("string").alias("src"), dst.cast("string").alias("dst")).distinct()
        return pairs.select("src", F.lit(rel).alias("rel"), "dst")

    return reduce(DataFrame.unionByName, [part(*relation) for relation in relations])


def parse_triples(lines: DataFrame, text: str = "value") -> DataFrame:
    """N-Triples lines -> ``s, p, o`` in written form. Blank lines and comments are skipped, bad ones are an error."""
    wanted = lines.select(F.col(text).alias("line")).filter(F.rlike("line", F.lit(r"^\s*[^#\s]")))
    subject = F.regexp_extract("line", rf"^\s*({IRI}|{BLANK})", 0)
    heads = wanted.select("line", subject.alias("s")).select("line", "s", F.substr("line", F.length("s") + 1).alias("rest"))
    heads = heads.select("line", "s", F.regexp_extract("rest", rf"^\s*{IRI}", 0).alias("p"), "rest")
    rest = F.substr("rest", F.length("p") + 1)
    value = F.regexp_extract(rest, rf"^\s*({IRI}|{BLANK}|{LITERAL})\s*\.\s*(?:#.*)?$", 1)
    parsed = heads.select("line", "s", "p", value.alias("o"))
    bad = F.raise_error(F.concat(F.lit("not a triple: "), "line"))
    whole = (F.col("s") != "") & (F.col("p") != "") & (F.col("o") != "")
    return parsed.select(*[F.when(whole, F.ltrim(c, F.lit(BLANKS))).otherwise(bad).alias(c) for c in ("s", "p", "o")])


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples files, splittable by line."""
    return parse_triples(spark.read.text(path))


def triple_terms(triples: DataFrame) -> DataFrame:
    """Each part of a triple as a term struct."""
    return triples.select(*[parse_term(F.col(c)).alias(c) for c in ("s", "p", "o")])
