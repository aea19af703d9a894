"""Reports as JSON documents and as Markdown lines, for all configurations at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.model import CONFIG
from hopscore.operators.execution import json_cell
from hopscore.operators.prompts import run_id
from hopscore.operators.report import (
    STATS,
    by_field,
    error_categories,
    report_cells,
    summary,
    total_errors,
    unknown_relations,
)
from hopscore.operators.scoring import pair_results
from hopscore.session import cut_lineage


class Report:
    """The tables of a report on all configurations: ``summary``, ``by_field``, ``total_errors``, ``error_types`` and
    ``missing_relations``, each with a ``run_id``. Results without a question are left out.

    Making one reads the results and questions once and keeps the cells; the tables are sums over those.
    """

    def __init__(self, results: DataFrame, questions: DataFrame, dataset: str, fields: list[str]):
        self._tables(cut_lineage(report_cells(pair_results(results, questions), fields)), dataset, fields)

    @classmethod
    def of_cells(cls, cells: DataFrame, dataset: str, fields: list[str]) -> Report:
        """A report from cells that are stored."""
        report = cls.__new__(cls)
        report._tables(cells, dataset, fields)
        return report

    def _tables(self, cells: DataFrame, dataset: str, fields: list[str]) -> None:
        self.fields = fields
        name = run_id(F.lit(dataset), *map(F.col, CONFIG)).alias("run_id")

        def named(table: DataFrame) -> DataFrame:
            return table.select(name, *[c for c in table.columns if c not in CONFIG])

        self.summary = named(summary(cells))
        self.by_field = named(by_field(cells, fields))
        self.total_errors = named(total_errors(cells))
        self.error_types = named(error_categories(cells))
        self.missing_relations = named(unknown_relations(cells))

    def json_pieces(self) -> DataFrame:
        """``run_id, section, item, value, part, line``: lines that, sorted by these columns, are one JSON document per run."""
        return json_pieces(self)

    def json(self) -> DataFrame:
        """``run_id, json``: one document per row. ``write_json`` does the same without holding a document in one place."""
        place = ("section", "item", "value", "part", "line")
        lines = F.array_sort(F.collect_list(F.struct(*place)))
        whole = F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("json")
        return self.json_pieces().groupBy("run_id").agg(whole)

    def markdown(self) -> DataFrame:
        """``run_id, section, item, value, part, line``: sort by these columns to read a report from top to bottom."""
        return markdown_lines(self)


# Headings and row layouts of the Markdown report.
SUMMARY_HEAD = ("", "## Summary", "", "| Metric | Value |", "|--------|-------|")
SUMMARY_ROWS = (("Count", "count"), ("Errors", "error_count"))
SUMMARY_SCORES = (
    ("Accuracy", "accuracy"),
    ("Avg F1", "avg_f1"),
    ("Avg Precision", "avg_precision"),
    ("Avg Recall", "avg_recall"),
)
TITLE, TOTAL, BY_FIELD, FIELD = "# Report: ", "**Total:** ", "## By Field", "### "
ERRORS, TOTAL_ERRORS, MISSING, TYPES = "## Errors", "**Total Errors:** ", "**Missing Relations:**", "**Error Types:**"
FIELD_ROW = "| %s | %d | %d | %s | %s |"
FIELD_HEAD = ("", "| Value | Count | Errors | Accuracy | F1 |", "|-------|-------|--------|----------|-----|")


def _block(table: DataFrame, section: int, item: Column, value: Column, lines: list[Column]) -> DataFrame:
    numbered = F.posexplode(F.array(*lines)).alias("part", "line")
    return table.select("run_id", F.lit(section).alias("section"), item.alias("item"), value.alias("value"), numbered)


def _four(column: str) -> Column:
    """Four decimals, ties to the even digit."""
    return F.format_number(F.col(column), 4)


def _members(table: DataFrame, section: int, item: Column, value: str, text: Column) -> DataFrame:
    """One line per entry of a JSON list or object, in text order of ``value``; all but the first begin with a comma."""
    first = table.groupBy("run_id").agg(F.min(value).alias("_first"))
    comma = F.when(F.col(value) == F.col("_first"), "").otherwise(",")
    entries = table.withColumn("_text", text).join(first, "run_id")
    return _block(entries, section, item, F.concat(F.lit(" "), F.col(value)), [F.concat(comma, "_text")])


def json_pieces(report: Report) -> DataFrame:
    """Lines of all JSON reports with their sort columns: opening and closing lines, and one line per entry between."""
    first, last, zero = F.lit(""), F.lit("\U0010ffff"), F.lit(0)
    stats = F.to_json(F.struct(*STATS))
    head = F.to_json(F.struct("run_id", F.col("count").alias("total"), F.struct(*STATS).alias("summary")))
    opening = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"by_field":{'))
    blocks = [_block(report.summary, 1, zero, first, [opening])]
    runs = report.summary.select("run_id")
    for i, field in enumerate(report.fields):
        start = F.concat(F.lit("," if i else ""), json_cell(F.lit(field)), F.lit(":{"))
        blocks.append(_block(runs, 2, F.lit(i), first, [start]))
        entry = F.concat(json_cell(F.col("value")), F.lit(":"), stats)
        blocks.append(_members(report.by_field.filter(F.col("field") == field), 2, F.lit(i), "value", entry))
        blocks.append(_block(runs, 2, F.lit(i), last, [F.lit("}")]))
    errors = F.concat(F.lit('},"errors":{"total_errors":'), F.col("total_errors").cast("string"), F.lit(',"missing_relations":['))
    blocks.append(_block(report.total_errors, 3, zero, first, [errors]))
    blocks.append(_members(report.missing_relations, 4, zero, "relation", json_cell(F.col("relation"))))
    blocks.append(_block(runs, 5, zero, first, [F.lit('],"error_types":{')]))
    entry = F.concat(json_cell(F.col("category")), F.lit(":"), F.col("n").cast("string"))
    blocks.append(_members(report.error_types, 6, zero, "category", entry))
    blocks.append(_block(runs, 7, zero, first, [F.lit('}},"metadata":{}}')]))
    return reduce(DataFrame.unionByName, blocks)


def markdown_lines(report: Report) -> DataFrame:
    """Lines of all reports with their sort columns. Within a section, items are fields in the order asked for, then
    their values; a heading sorts before its values, a closing blank line after them."""
    first, last = F.lit(""), F.lit("\U0010ffff")
    zero = F.lit(0)
    head = [F.concat(F.lit(TITLE), "run_id"), F.lit(""), F.concat(F.lit(TOTAL), F.col("count").cast("string"))]
    head += [F.lit(line) for line in SUMMARY_HEAD]
    head += [F.format_string(f"| {label} | %d |", F.col(name)) for label, name in SUMMARY_ROWS]
    head += [F.format_string(f"| {label} | %s |", _four(name)) for label, name in SUMMARY_SCORES]
    blocks = [_block(report.summary, 1, zero, first, [*head, F.lit("")])]

    if report.fields:
        position = F.array_position(F.array(*map(F.lit, report.fields)), F.col("field")).cast("int")
        runs = report.summary.select("run_id")
        blocks.append(_block(runs, 2, zero, first, [F.lit(BY_FIELD), F.lit("")]))
        asked = runs.select("run_id", F.explode(F.array(*map(F.lit, report.fields))).alias("field"))
        opening = [F.concat(F.lit(FIELD), "field"), *map(F.lit, FIELD_HEAD)]
        blocks.append(_block(asked, 2, position, first, opening))
        blocks.append(_block(asked, 2, position, last, [F.lit("")]))
        row = F.format_string(
            FIELD_ROW, "value", "count", "error_count", _four("accuracy"), _four("avg_f1")
        )
        # A value's lines sort after the heading, also when the value is the empty string.
        values = report.by_field.select("*", row.alias("row"))
        blocks.append(_block(values, 2, position, F.concat(F.lit(" "), F.col("value")), [F.col("row")]))

    failing = report.total_errors.filter(F.col("total_errors") > 0)
    opening = [
        F.lit(ERRORS),
        F.lit(""),
        F.concat(F.lit(TOTAL_ERRORS), F.col("total_errors").cast("string")),
        F.lit(""),
    ]
    blocks.append(_block(failing, 3, zero, first, opening))
    for item, heading, table, label in (
        (1, MISSING, report.missing_relations, F.col("relation")),
        (2, TYPES, report.error_types, F.col("category")),
    ):
        line = F.concat(F.lit("- "), label)
        if item == 2:
            line = F.concat(line, F.lit(": "), F.col("n").cast("string"))
        present = table.select("run_id").distinct()
        blocks.append(_block(present, 3, F.lit(item), first, [F.lit(heading)]))
        blocks.append(_block(table, 3, F.lit(item), F.concat(F.lit(" "), label), [line]))
        blocks.append(_block(present, 3, F.lit(item), last, [F.lit("")]))
    return reduce(DataFrame.unionByName, blocks)


def _not_empty(report: Report) -> None:
    if report.summary.isEmpty():
        raise ValueError("no results to report on")


def _write(lines: DataFrame, path: str) -> None:
    ordered = lines.orderBy("run_id", "section", "item", "value", "part")
    ordered.select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(path)


def write_json(report: Report, path: str) -> None:
    """A folder per run; the files of a folder, in name order, are its JSON document."""
    _not_empty(report)
    _write(report.json_pieces(), path)


def write_markdown(report: Report, path: str) -> None:
    """A folder per run; the files of a folder, in name order, are the report."""
    _not_empty(report)
    _write(report.markdown(), path)
