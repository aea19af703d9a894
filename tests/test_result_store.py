"""The merged results against the same saves and clears on plain dictionaries; what a save writes; how a read is planned."""

import os
import random

import pytest

from hopscore.model import EVAL_TYPE, EXEC_TYPE, GEN_TYPE, KEY, RESULTS
from hopscore.sources import result_store
from hopscore.sources.result_store import ResultStore

TYPES = {"gen": GEN_TYPE, "exec": EXEC_TYPE, "eval": EVAL_TYPE}
CONFIGS = [("llm", "cypher", "m1"), ("llm", "sparql", "m1"), ("seq2seq", "cypher", "m2")]


def gen(n):
    return (f"query {n}", (float(n), n, n, None))


def outcome(n):
    return ([f"a{n}"], True, None) if n % 3 else (None, False, f"error {n}")


def score(n):
    return (float(n), 0.5, None, 1.0)


def updates(spark, stage, rows):
    fields = ", ".join(f"{k} string" for k in KEY) + f", {stage} {TYPES[stage].simpleString()}, n int"
    return spark.createDataFrame([(*key, value, n) for n, (key, value) in enumerate(rows)], fields)


def table(rows):
    return {tuple(r[k] for k in KEY): (r.gen, r.exec, r.eval) for r in rows.collect()}


def plain(value):
    """Rows as tuples, so that they compare with what was saved."""
    return tuple(plain(x) for x in value) if isinstance(value, tuple) else value


def test_any_order_of_saves_and_clears(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(result_store, "MOST_COMMITS", 9)
    draw = random.Random(17)
    keys = [(f"q{i}", *config) for i in range(8) for config in CONFIGS]
    held = {k: [gen(i) if i % 4 else None, outcome(i) if i % 3 else None, score(i) if i % 6 == 1 else None] for i, k in enumerate(keys[:15])}
    store = ResultStore.create(spark.createDataFrame([(*k, *v) for k, v in held.items()], RESULTS), str(tmp_path / "store"), buckets=3)
    for n in range(100, 130):
        stage = draw.choice(["gen", "exec", "eval", "clear"])
        some = draw.sample(keys, draw.randint(0, 8))
        if stage == "clear":
            config, which = draw.choice(CONFIGS), draw.choice(["gen", "exec", "eval"])
            counted = store.clear_stage(*config, which)
            own = [k for k in held if k[1:] == config]
            assert counted == len(own)
            for k in own:
                for i in range(["gen", "exec", "eval"].index(which), 3):
                    held[k][i] = None
            continue
        make = {"gen": gen, "exec": outcome, "eval": score}[stage]
        values = [(k, make(n * 10 + i) if draw.random() < 0.9 else None) for i, k in enumerate(some)]
        {"gen": store.save_generation, "exec": store.save_execution, "eval": store.save_evaluation}[stage](updates(spark, stage, values))
        for k, value in values:
            if stage == "gen":
                held[k] = [value, None, None]
            elif k in held:
                held[k][["gen", "exec", "eval"].index(stage) :] = [value, None] if stage == "exec" else [value]
    got = {k: plain(v) for k, v in table(ResultStore(spark, str(tmp_path / "store")).merged()).items()}
    assert got == {k: tuple(v) for k, v in held.items()}
    assert sum(name.startswith("base-") for name in os.listdir(tmp_path / "store")) > 1  # it has been compacted on the way
    before = table(store.merged())
    store.compact()
    assert table(store.merged()) == before


def test_several_updates_of_a_key(spark, tmp_path):
    key = ("q1", *CONFIGS[0])
    store = ResultStore.create(spark.createDataFrame([(*key, None, None, None)], RESULTS), str(tmp_path / "store"), buckets=2)
    twice = updates(spark, "gen", [(key, gen(1)), (key, gen(2))])
    with pytest.raises(Exception, match="several updates"):
        store.save_generation(twice)
    assert table(store.merged())[key][0] is None  # what the failed save wrote is not read
    store.save_generation(twice, order="n")
    assert table(store.merged())[key][0].query == "query 2"
    with pytest.raises(ValueError):
        store.clear_stage(*CONFIGS[0], "other")


def _files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_save_writes_what_it_changes(spark, tmp_path):
    keys = [(f"question-{i}", *CONFIGS[0]) for i in range(4000)]
    rows = spark.createDataFrame([(*k, gen(i), outcome(i), score(i)) for i, k in enumerate(keys)], RESULTS)
    store = ResultStore.create(rows, str(tmp_path / "store"), buckets=4)
    before = _files(tmp_path)
    store.save_execution(updates(spark, "exec", [(k, outcome(1)) for k in keys[:40]]))
    after = _files(tmp_path)
    assert all(after[name] == size for name, size in before.items())
    assert sum(after.values()) - sum(before.values()) < 0.25 * sum(before.values())
    assert store.merged().filter("eval IS NULL").count() == 40


def test_a_read_exchanges_neither_base_nor_changes(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i}", *CONFIGS[i % 3], None, None, None) for i in range(60)], RESULTS)
    store = ResultStore.create(rows, str(tmp_path / "store"), buckets=8)
    store.save_generation(updates(spark, "gen", [((f"q{i}", *CONFIGS[0]), gen(i)) for i in range(9)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.merged()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
