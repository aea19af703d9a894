"""Array files read by blocks: the same records as a whole-file parse, whatever the blocks cut through."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException

from hopscore.sources.json_arrays import read_array_elements

STRINGS = ['a}b{"', "\\", '"]', "{[", "é}ü", "\n\t\r", '\\"}', "", "}}}", '","{', "}\\", " }", " , { "]


def _value(draw, depth=0):
    kind = draw.randint(0, 7 if depth < 3 else 4)
    if kind == 6 or kind == 5:
        return [_value(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    if kind == 7:
        return {draw.choice(["k", "}", '{"', "z"]): _value(draw, depth + 1) for _ in range(draw.randint(0, 3))}
    return [draw.choice(STRINGS), draw.randint(-9, 99), None, True, "x" * draw.randint(0, 400)][kind]


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "10"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def _read(spark, path):
    out = {}
    for row in read_array_elements(spark, str(path)).orderBy("file", "place").collect():
        out.setdefault(os.path.basename(row.file), []).append(json.loads(row.value))
    return out


def test_blocks_give_the_records_of_the_whole_file(small_blocks, tmp_path):
    draw = random.Random(3)
    records = [{"id": f"i{i}", "v": _value(draw), "w": _value(draw)} for i in range(150)]
    written = {
        "line.json": (records, json.dumps(records)),
        "pretty.json": (records[:40], json.dumps(records[:40], indent=2, ensure_ascii=False)),
        "objects.json": ([{}, {"a": {}}, {}], " [{}, {\"a\": {}},\n{}]  \n"),
        "long.json": ([{"v": "}{" * 3000}, {"v": ["]"] * 900}], json.dumps([{"v": "}{" * 3000}, {"v": ["]"] * 900}])),
        "mark.json": ([{"a": 1}], "﻿[{\"a\": 1}]"),
    }
    for name, (_, text) in written.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "none.json").write_text("\n[ ]\n")
    assert _read(small_blocks, tmp_path) == {name: wanted for name, (wanted, _) in written.items()}
    pieces = small_blocks.read.option("lineSep", "}").text(str(tmp_path / "line.json"))
    assert pieces.rdd.getNumPartitions() > 5


def test_blocks_of_any_size_give_the_same_rows(spark, small_blocks, tmp_path):
    draw = random.Random(9)
    text = json.dumps([{"id": str(i), "v": _value(draw)} for i in range(40)])
    (tmp_path / "x.json").write_text(text)
    for size in (97, 331, 100_000):
        small_blocks.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        assert _read(small_blocks, tmp_path)["x.json"] == json.loads(text)


BROKEN = [
    " ", "\n\n", "{\"id\": 1}", "[{\"id\": 1}", "[{\"id\": 1}] x", "[1, 2]", "[{\"id\": 1} {\"id\": 2}]", "[{\"id\": 1},]", "[{\"a\": 1}, 3, {\"b\": 2}]",
    "[{\"id\": \"1}]", "[[{\"id\": 1}]]", "[{\"id\": 1}]]", "x[{\"id\": 1}]", "[{\"id\": 1}, {\"id\": 2", "[{\"id\": 1}][{\"id\": 2}]", "[{\"a\": [}]",
]


@pytest.mark.parametrize("text", BROKEN)
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    (tmp_path / "y.json").write_text("[{\"id\": 1}]")
    with pytest.raises(PySparkException, match="not a JSON array"):
        read_array_elements(spark, str(tmp_path)).filter("trim(value) <> ''").collect()
    with pytest.raises(PySparkException, match="not a JSON array"):
        read_array_elements(spark, str(tmp_path)).collect()
