import json
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopscore.model import KEY
from hopscore.operators import encode, vocabulary
from hopscore.operators.generation import generation_of, predict, response_columns, translate
from hopscore.sources.examples import read_examples, write_encoded

TRAIN = [{"question": "List the bridges over the Aare.", "LF": "spans(river:Aare)"}, {"question": "How old is the Nydegg bridge?", "LF": "age(bridge:Nydegg)"}]
VAL = [{"question": "Is the Kirchenfeld bridge made of iron?", "LF": "made_of(bridge:Kirchenfeld, iron)", "options": ["iron", "stone"], "gold": "iron"}]
TEST = [{"question": "Which bridge is the longest?", "LF": "argmax(bridge, length)"}]
COLUMNS = {"input": "question", "target": "LF", "choices": "options", "answer": "gold"}


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "data"
    (data / "1shot").mkdir(parents=True)
    (data / "train.json").write_text(json.dumps(TRAIN, indent=2))
    (data / "val.json").write_text(json.dumps(VAL))
    (data / "test.jsonl").write_text("\n".join(map(json.dumps, TEST)))
    (data / "1shot" / "train.json").write_text(json.dumps(TRAIN[:1]))
    return data


@pytest.mark.parametrize("name, text", [("train.json", json.dumps(TRAIN)[:-9]), ("test.jsonl", json.dumps(TEST[0]) + '\n{"question": "cut')])
def test_broken_files_are_errors(spark, folder, name, text):
    (folder / name).write_text(text)
    with pytest.raises(PySparkException):
        read_examples(spark, str(folder), COLUMNS).collect()


def test_read_splits(spark, folder):
    rows = read_examples(spark, str(folder), COLUMNS).collect()
    assert Counter(r.split for r in rows) == {"train": 2, "val": 1, "test": 1}
    assert len({r.example_id for r in rows}) == 4
    (val,) = [r for r in rows if r.split == "val"]
    assert (val.input, val.target, val.choices, val.answer) == ("Is the Kirchenfeld bridge made of iron?", "made_of(bridge:Kirchenfeld, iron)", ["iron", "stone"], "iron")
    shot = read_examples(spark, str(folder), COLUMNS, shot="1shot", prepare=lambda records: records.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("gold"), F.lit("new")))))
    assert [(r.split, r.answer) for r in shot.collect()] == [("train", "new")]
    with pytest.raises(FileNotFoundError):
        read_examples(spark, str(folder / "nothing"), COLUMNS)


def tokens(text):
    return re.findall(r"\w+|[^\w\s]", text.lower())


def test_vocabulary_numbers_by_frequency(spark):
    texts = ["b b b a a c c", "d Ärger e f", "<PAD> b", "z" * 5000]
    built = vocabulary.build_vocabulary(spark.createDataFrame([(t,) for t in texts], "t string").select(vocabulary.tokenize(F.col("t")).alias("tokens")))
    counts = Counter(t for text in texts for t in tokens(text))
    ranked = sorted(counts, key=lambda t: (-counts[t], t.encode()))
    assert {r.token: r.idx for r in built.collect()} == {"<PAD>": 0, "<UNK>": 1, "<START>": 2, "<END>": 3} | {t: i for i, t in enumerate(ranked, 4)}


def test_special_tokens_stay_whole(spark):
    special = ["<E>", "</E>", "has part"]
    frame = spark.createDataFrame([("train", 1, "a <E> b </e>", "x HAS PART <")], "split string, example_id long, input string, target string")
    cut = vocabulary.tokenize(F.col("input"), special)
    assert frame.select(cut).first()[0] == ["a", "<e>", "b", "</e>"]
    words = vocabulary.build_vocabulary(frame.select(cut.alias("tokens")), special)
    assert {r.token: r.idx for r in words.collect()} == {"<PAD>": 0, "<UNK>": 1, "<START>": 2, "<END>": 3, "<e>": 4, "</e>": 5, "has part": 6, "a": 7, "b": 8}
    row = encode.encode_examples(frame, words, special).first()
    assert (row.source_ids, row.target_ids) == ([2, 7, 4, 8, 5, 3], [2, 1, 6, 1, 3, 0])


def test_number_rows_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    numbered = vocabulary.number_rows(rows, [F.desc("x")], "n", start=10)
    assert {r.x: r.n for r in numbered.collect()} == {x: 10 + 4999 - x for x in range(5000)}


def test_invert(spark):
    table = spark.createDataFrame([("yes", 0), ("no", 1), ("nope", 1)], "token string, idx long")
    assert {r.idx: r.token for r in vocabulary.invert(table).collect()} == {0: "yes", 1: "nope"}


@pytest.fixture
def examples(spark):
    rows = [
        ("train", 1, "What is X?", "MATCH x", ["yes", "huh"], "no"),
        ("train", 2, "", "RETURN x x x x x x", None, "no"),
        ("val", 3, "new words", "RETURN", ["no"], None),
        ("val", 4, "x", "y", [], "yes"),
    ]
    return spark.createDataFrame(rows, "split string, example_id long, input string, target string, choices array<string>, answer string")


@pytest.mark.parametrize("head", [vocabulary.HEAD, 6])
def test_encode(spark, examples, head, monkeypatch):
    """With the whole vocabulary broadcast, and with most of it in the shuffled rest."""
    monkeypatch.setattr(vocabulary, "HEAD", head)
    train = examples.filter("split = 'train'")
    both = train.select(F.explode(F.array("input", "target")).alias("t")).select(vocabulary.tokenize(F.col("t")).alias("tokens"))
    words = vocabulary.build_vocabulary(both)
    ids = {r.token: r.idx for r in words.collect()}
    lengths = {"train": 9, "val": 4}

    def row(text, split):
        sequence = [2, *[ids.get(t, 1) for t in tokens(text)], 3]
        return sequence + [0] * (lengths[split] - len(sequence)), [1] * len(sequence) + [0] * (lengths[split] - len(sequence))

    encoded = encode.encode_examples(examples, words)
    got = {r.example_id: (r.source_ids, r.source_mask, r.target_ids) for r in encoded.collect()}
    want = {r.example_id: (*row(r.input, r.split), row(r.target, r.split)[0]) for r in examples.collect()}
    assert got == want
    assert {r.split: r.max_length for r in encode.split_lengths(examples).collect()} == lengths
    for label in encode.decoder_labels(encoded).collect():
        target = want[label.example_id][2]
        assert label.decoder_input_ids == target[:-1]
        assert label.labels == [t if t else -100 for t in target[1:]]


def test_choices_stay_aligned(spark, examples):
    answers = vocabulary.build_answer_vocabulary(spark.createDataFrame([("yes",), ("no",), ("yes",), (None,)], "answer string"))
    assert {r.token: r.idx for r in answers.collect()} == {"no": 0, "yes": 1}
    rows = {r.example_id: (r.choices, r.answer) for r in encode.encode_choices(examples, answers).collect()}
    assert rows == {1: ([1, 0], 0), 2: ([0], 0), 3: ([0], 0), 4: ([], 1)}


def test_unknown_split_is_an_error(spark, examples):
    with pytest.raises(PySparkException):
        encode.split_lengths(examples.withColumn("split", F.lit("dev"))).collect()


def test_pad_cuts_too(spark):
    row = spark.createDataFrame([([1, 2, 3],)], "x array<int>").select(
        encode.pad(F.col("x"), F.lit(2)).alias("cut"), encode.mask(F.col("x"), F.lit(2)).alias("m"), encode.pad(F.col("x"), F.lit(4)).alias("fill")
    )
    assert tuple(row.first()) == ([1, 2], [1, 1], [1, 2, 3, 0])


def test_write_encoded(spark, folder, tmp_path):
    examples = read_examples(spark, str(folder), COLUMNS).filter("split <> 'test'")
    words = vocabulary.build_vocabulary(examples.select(vocabulary.tokenize(F.col("input")).alias("tokens")))
    write_encoded(encode.encode_examples(examples, words), words, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "examples").iterdir() if p.is_dir()) == ["split=train", "split=val"]
    assert spark.read.parquet(str(tmp_path / "out" / "vocabulary")).count() == words.count()


# Models as batch functions


def test_predict_loads_once_per_task(spark):
    def load():
        import pandas as pd

        calls = []

        def run(batch):
            calls.append(len(batch))
            return pd.DataFrame({"content": batch["prompt"].str.upper(), "input_tokens": [len(calls)] * len(batch)})

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        prompts = spark.range(0, 6, 1, 1).select(F.col("id").cast("string").alias("question_id"), F.lit("ab").alias("prompt"))
        rows = predict(prompts, load, ["question_id"]).collect()
        spread = predict(prompts, load, ["question_id"], workers=3)
        assert spread.rdd.getNumPartitions() == 3 and spread.count() == 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.content for r in rows] == ["AB"] * 6
    assert [r.stats.input_tokens for r in rows] == [1, 1, 2, 2, 3, 3] and rows[0].stats.duration is None


def test_predict_without_stats(spark):
    def load():
        return lambda batch: batch.rename(columns={"prompt": "content"})

    row = predict(spark.createDataFrame([("q", "`a`")], "question_id string, prompt string"), load, ["question_id"]).first()
    assert row.stats is None and row.content == "`a`"
    frame = spark.createDataFrame([("see `a`",)], "c string")
    stats = F.lit(None).cast("struct<duration: double>")
    kept = frame.select(generation_of(F.col("c"), stats).alias("a"), generation_of(F.col("c"), stats, extract=False).alias("b")).first()
    assert (kept.a.query, kept.b.query) == ("a", "see `a`")


def test_translate_falls_back(spark):
    def translator(text):
        if text == "bad":
            raise ValueError
        return text.upper()

    frame = spark.createDataFrame([("ok",), ("bad",), (None,)], "ir string")
    for lang, want in (("cypher", ["OK", "bad", None]), ("kopl", ["OK", "bad", None]), ("gremlin", ["ok", "bad", None])):
        assert [r[0] for r in frame.select(translate(F.col("ir"), lang, translator)).collect()] == want


def test_response_columns(spark):
    log = spark.createDataFrame([("q1", "none", "{}")], "question_id string, provider string, payload string")
    assert response_columns(log, ["question_id"]).columns == ["question_id", "content", "input_tokens", "output_tokens", "cached_tokens"]
    assert response_columns(log, ["question_id"]).first().content is None
    assert KEY[0] == "question_id"


def test_predict_gives_freed_memory_back_between_batches(spark):
    def load():
        import gc

        import pandas as pd

        collected, collect = [], gc.collect
        gc.collect = lambda *generation: collected.append(1) or collect(*generation)
        return lambda batch: pd.DataFrame({"content": [str(len(collected))] * len(batch)})

    prompts = spark.range(0, 60, 1, 1).selectExpr("cast(id AS string) AS question_id", "'x' AS prompt")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = predict(prompts, load, ["question_id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == 60 and max(int(r.content) for r in rows) >= 3
