"""The pipeline stage by stage against plain versions, with odd rows, and the whole run."""

import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, keep_id string"


def grams(text, width):
    found = text.split()
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of a given table, with copies, near copies, a shared passage and rows without a text; and columns with clashing names."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 300 and 4000").orderBy("doc_id").limit(60).collect()
    texts = [r.text for r in base]
    rows = [(i, t, r.lang, r.source) for i, (t, r) in enumerate(zip(texts, base))]
    source = [(base[i].lang, base[i].source) for i in range(8)]
    rows += [(100 + i, texts[i], *source[i]) for i in range(3)] + [(100, texts[0], *source[0])]
    words = texts[3].split()
    rows += [(200, " ".join([*words[:4], "changed", *words[5:]]), *source[3])]
    passage = " ".join(f"passage{i} words" for i in range(40))
    rows += [(300 + i, f"{texts[4 + i]} {passage} {texts[6 + i]}", *source[4 + i]) for i in range(2)]
    rows += [(400, None, "en", "s"), (401, "", None, None), (402, " 12 ... ", "en", None), (None, texts[7] + " and so on", *source[7])]
    frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", "x") for r in rows], SCHEMA)
    path = str(tmp_path_factory.mktemp("pipeline"))
    frame.write.parquet(f"{path}/documents.parquet")
    return path


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    kept, names = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, folder), f"test-{name}")
        kept[name] = docs
        assert name == "packing" or docs.columns == names
    rows = {name: [(r.doc_id, r.text) for r in frame.collect()] for name, frame in kept.items() if name != "packing"}

    letters = [(i, t) for i, t in given if t and any(c.isalpha() for c in t)]
    assert sorted(rows["language_id"], key=repr) == sorted(letters, key=repr)  # clean documents stay, texts without letters go

    before = rows["language_id"]
    largest = {t: max((i for i, s in before if s == t and i is not None), default=None) for _, t in before}
    assert sorted(rows["exact_dedup"], key=repr) == sorted(((i, t) for i, t in before if i == largest[t]), key=repr)

    before = sorted({t for _, t in rows["exact_dedup"]})
    sets = [grams(t, 5) for t in before]
    label = list(range(len(before)))
    for _ in before:
        for a in range(len(before)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    left = {t for _, t in rows["ngram_jaccard_join"]}
    assert left <= set(before) and sorted(label[before.index(t)] for t in left) == sorted(set(label))

    before, after = rows["ngram_jaccard_join"], rows["substring_dedup"]
    shared = [{g for _, s in before if s is not t for g in grams(s, 50)} for _, t in before]
    touched = {i for (i, t), other in zip(before, shared) if len(t.split()) >= 50 and grams(t, 50) & other}
    whole = dict(before)
    assert touched >= {300, 301} and all(t == whole[i] for i, t in after if i not in touched)
    fifty = [grams(t, 50) for _, t in after if len(t.split()) >= 50]
    assert all(not a & b for k, a in enumerate(fifty) for b in fifty[:k])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in after:
        want.setdefault(i, []).append(np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4"))
    pieces = kept["packing"].collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) for own in want.values() for x in own)
    for p in pieces:
        assert p.ids_crc32 in {zlib.crc32(x[p.start : p.start + p["length"]].tobytes()) for x in want[p.doc_id]}


def test_run_gives_the_last_stage(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ends = {}
    for row in found.collect():
        ends.setdefault(row.sequence_id, []).append((row.offset, row["length"]))
    for own in ends.values():
        assert [o for o, _ in sorted(own)] == np.concatenate(([0], np.cumsum([n for _, n in sorted(own)])))[:-1].tolist()


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
