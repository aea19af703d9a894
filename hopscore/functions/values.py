"""Canonical answer values of property graphs: temporal values, nodes, relationships, traversal elements, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields by which a struct column is recognised.
DATE = {"year", "month", "day"}
TIME = {"hour", "minute", "second", "nanosecond"}
NODE = {"element_id", "labels", "properties"}
RELATIONSHIP = {"element_id", "type", "start_node", "end_node", "properties"}
PATH = {"nodes", "relationships"}
VERTEX = {"id", "label"}
EDGE = {"id", "label", "inV", "outV"}
TRAVERSAL_PATH = {"labels", "objects"}


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def date_text(value: Column) -> Column:
    """Calendar date as ``2024-01-31``."""
    return F.concat_ws("-", F.lpad(value["year"].cast("string"), 4, "0"), _two(value["month"]), _two(value["day"]))


def time_text(value: Column) -> Column:
    """Time of day; nanoseconds are cut to microseconds, a zero fraction is left out."""
    micros = F.floor(value["nanosecond"] / 1000).cast("bigint")
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    clock = F.concat_ws(":", _two(value["hour"]), _two(value["minute"]), _two(value["second"]))
    return F.concat(clock, fraction)


def graph_value(value: Column, dtype: T.DataType) -> Column:
    """Canonical form of a property-graph value, following lists, maps and path members down.

    Properties of nodes and relationships are handed on as they are.
    """
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: graph_value(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: graph_value(item, dtype.valueType))
    if not isinstance(dtype, T.StructType):
        return value
    names = set(dtype.names)
    if names == DATE:
        out = date_text(value)
    elif names == TIME:
        out = time_text(value)
    elif names == DATE | TIME:
        out = F.concat_ws(" ", date_text(value), time_text(value))
    elif names == NODE:
        out = F.struct(value["element_id"].alias("id"), value["labels"].alias("labels"), value["properties"].alias("properties"))
    elif names == RELATIONSHIP:
        out = F.struct(
            value["element_id"].alias("id"),
            value["type"].alias("type"),
            value["start_node"].alias("start"),
            value["end_node"].alias("end"),
            value["properties"].alias("properties"),
        )
    elif names == PATH:
        out = F.struct(*[graph_value(value[n], dtype[n].dataType).alias(n) for n in ("nodes", "relationships")])
    else:  # a projected record: each member by itself
        out = F.struct(*[graph_value(value[n], dtype[n].dataType).alias(n) for n in dtype.names])
    return F.when(value.isNotNull(), out)


def traversal_value(value: Column, dtype: T.DataType) -> Column:
    """Canonical form of a traversal value: vertices, edges with the ids of both ends, and paths."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: traversal_value(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: traversal_value(item, dtype.valueType))
    if not isinstance(dtype, T.StructType):
        return value
    names = set(dtype.names)
    if names == VERTEX:
        fields = [value["id"].alias("id"), value["label"].alias("label")]
    elif names == EDGE:
        fields = [value["id"].alias("id"), value["label"].alias("label")]
        fields += [value[end]["id"].alias(end) for end in ("inV", "outV")]
    elif names == TRAVERSAL_PATH:
        fields = [value["labels"].alias("labels")]
        fields.append(traversal_value(value["objects"], dtype["objects"].dataType).alias("objects"))
    else:  # a projected record: each member by itself
        fields = [traversal_value(value[n], dtype[n].dataType).alias(n) for n in dtype.names]
    return F.when(value.isNotNull(), F.struct(*fields))


def value_text(value: Column, dtype: T.DataType) -> Column:
    """Answer text of a canonical value: scalars bare, anything nested as JSON with NULLs kept."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")
