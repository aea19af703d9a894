"""Every operator against a brute-force version, and on nulls, empty and long texts, repeats, clashing names and empty tables."""

import base64
import hashlib
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from hopscore.llm import (  # noqa: E402
    byte_bpe,
    exact_dedup,
    html_text,
    jaccard_join,
    language,
    nearest,
    packed_ids,
    packing,
    passages,
    storage,
    warc,
    words,
)
from hopscore.llm.tokens import encoder  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string"


def sentence(seed: int, count: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in draw.integers(0, 10**6, count))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows: null, empty, blank, long, repeated, with null ids and columns whose names the operators use themselves."""
    long = sentence(1, 9_000)
    texts = [
        (1, None), (2, ""), (3, " \n "), (4, "x" * 3_000), (5, "one two"), (5, "one two"), (6, "one two"), (None, "one two"),
        (7, long), (8, long), (9, long.replace("w1", "v1", 40)), (None, None), (10, "É è ç <|endoftext|> 's  \n\n\t end"),
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t), "k", "s") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    """Documents with known copies: near copies, a shared passage, and others."""
    passage = sentence(100, 60)
    base = sentence(200, 120)
    rows = [(i, sentence(i, 150)) for i in range(20)]
    rows += [(100, base), (101, base.replace(base.split()[60], "changed")), (102, base + " more words here")]
    rows += [(110, f"{sentence(300, 80)} {passage} {sentence(301, 70)}"), (111, f"{sentence(302, 90)} {passage}")]
    rows += [(112, f"{passage} {sentence(303, 200)}")]
    return spark.createDataFrame([(i, t, "en", "s", len(t), "k", "s") for i, t in rows], SCHEMA)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    texts = ["a b c d e f", "", None, "x", "  z a b c d e ", "long " * 400]
    values, first = words.Texts(texts).shingles()
    assert [int(b - a) for a, b in zip(first, first[1:])] == [2, 0, 0, 1, 2, 396]
    assert values[0] == values[4] and values[0] != values[1]
    whole = words.hash_words(texts[5].encode())[0]
    monkeypatch.setattr(words, "PART", 50)
    assert (words.hash_words(texts[5].encode())[0] == whole).all()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_encode_as_the_library_does(path):
    texts = [
        "", "a", " a  b", "It's, the end.\nNew line. ", "a\n\n b", "tab\there \r\n", "\0x y", "<|endoftext|> ok",
        "É́ é ΑΣ Σ", "x" * 500 + " y", "1,2 a, b.", "Ab, aB. AB.", "wide　space and more",
    ]
    tokens = encoder(path)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, tokens.encode(texts)):
            assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_the_library_gets_new_pieces_many_at_a_time(path, monkeypatch):
    tokens = type(encoder(path))(path)
    marks = ["", ".", ",", "'s", "'", "###", "1", "é", "É", "H\u0331", "h\u0331", "İ", "ß", "Σ", "\u0301x", "Ⅷ", "中", "a\u0327", "\x01", "\x7f"]
    texts = [" ".join(f"{m}Ab{chr(97 + i % 26)}{chr(97 + i // 26)}x{m}" for i in range(a, a + 130)) for a in range(0, 520, 130) for m in marks]
    given, library = [], tokens._library
    monkeypatch.setattr(tokens, "_library", lambda some: given.append(len(some)) or library(some))
    found = tokens.encode(texts)
    assert sum(given) < len(texts) * 130 / 20  # nearly all pieces are different
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_known_words_are_looked_up_together(path, monkeypatch):
    """Words of a batch come from one table, also where they share its slots; a table is kept from one partition to the next."""
    tokens = type(encoder(path))(path)
    texts = [" ".join(f"ab{i * j % 997}x{'y' * (i % 18)}" for i in range(200)) + end for j in range(20) for end in ("", " ", "\n\n")]
    plain = [tokens.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [x.tolist() for x in tokens.encode(texts)] == plain
    tokens.forget()
    given, library = [], tokens._library
    monkeypatch.setattr(tokens, "_library", lambda some: given.extend(some) or library(some))
    assert [x.tolist() for x in tokens.encode(texts)] == plain
    assert sum(map(len, given)) < sum(map(len, texts)) / 3
    monkeypatch.setattr("hopscore.llm.tokens.SLOT_BITS", 2)
    few = type(tokens)(path)
    assert [x.tolist() for x in few.encode(texts[:9])] == plain[:9] and [x.tolist() for x in few.encode(texts)] == plain


def test_exact_duplicates(odd, empty):
    found = exact_dedup.exact_duplicates(odd)
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = []
    for doc_id, text in texts:
        same = [i for i, t in texts if t == text]
        keep = max((i for i in same if i is not None), default=None)
        want.append((doc_id, keep, len(same), doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(found) == sorted(want, key=repr)
    weak = exact_dedup.exact_duplicates(odd, capacity=3, hashed=lambda c: F.xxhash64(F.length(c) % 2))
    assert rows_of(weak) == sorted(want, key=repr)  # collisions are chained
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.text or "" for r in kept.dropDuplicates(["text"]).collect()) == sorted({t for _, t in texts})


def test_index_buckets_split(spark, plain):
    index = exact_dedup.build_index(plain, capacity=3)
    sizes = [r["count"] for r in index.entries.groupBy("depth", "slot").count().collect()]
    assert max(sizes) <= 3 and sum(sizes) == plain.select("text").distinct().count()
    places = {r.place: (r.depth, r.slot) for r in index.places.collect()}
    assert sorted(places) == list(range(2**index.bits)) and index.bits > 2  # doubled, and every place points to a bucket
    assert all(slot == place >> (index.bits - depth) for place, (depth, slot) in places.items())
    assert len({depth for depth, _ in places.values()}) > 1


def test_a_lookup_reads_its_bucket_only(spark, plain):
    index = exact_dedup.build_index(plain, capacity=3)
    for row in plain.limit(5).collect():
        (entry,) = exact_dedup.lookup(index, row.text).collect()
        assert (entry.keep_id, entry.group_size) == (row.doc_id, 1)
        assert index.entries.where((F.col("depth") == entry.depth) & (F.col("slot") == entry.slot)).count() <= 3
    assert exact_dedup.lookup(index, "no such text").count() == 0
    # What the directory says decides: with the places of two buckets exchanged, their texts are not found.
    first, second = index.entries.select("depth", "slot").distinct().orderBy("depth", "slot").take(2)
    swapped = index.places.withColumns(
        {
            name: F.when((F.col("depth") == first.depth) & (F.col("slot") == first.slot), second[name])
            .when((F.col("depth") == second.depth) & (F.col("slot") == second.slot), first[name])
            .otherwise(F.col(name)).cast(kind)
            for name, kind in (("depth", "int"), ("slot", "long"))
        }
    )
    lost = exact_dedup.Index(index.entries, swapped, index.bits)
    here = index.entries.where((F.col("depth") == first.depth) & (F.col("slot") == first.slot)).select("keep_id").collect()
    text = plain.where(F.col("doc_id") == here[0].keep_id).first().text
    assert exact_dedup.lookup(index, text).count() == 1 and exact_dedup.lookup(lost, text).count() == 0


def test_only_repeated_texts_are_shuffled(spark):
    rows = [(i, f"{i} " + "long text " * 400) for i in range(200)] + [(900 + i, "twice " * 300) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.build_index(docs)
    assert index.entries.where("text is not null").count() == 0
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert found[905] == (919, 20) and found[7] == (7, 1)


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (300, 60)])
def test_byte_bpe(odd, empty, chunk, overlap):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = []
    for row in odd.collect():
        ids = bpe.encode_ordinary(row.text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((row.doc_id, len(ids), digest, hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert rows_of(byte_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN, chunk, overlap)) == sorted(want, key=repr)
    assert byte_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def shingle_set(text):
    found = (text or "").split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_similarity_join(spark, plain, odd, empty):
    docs = plain.where("doc_id is not null").union(odd.where("doc_id > 4").selectExpr("doc_id + 1000", *odd.columns[1:]).distinct())
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    near = {(a, b) for a in sets for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    label = {a: a for a in sets}
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = sorted((a, label[a], sum(x == a for x, _ in near)) for a in sets)
    assert rows_of(jaccard_join.similarity_join(docs)) == sorted(want, key=repr)
    assert jaccard_join.similarity_join(empty).count() == 0
    assert jaccard_join.similarity_join(odd).count() == odd.count()
    kept = {r.doc_id for r in jaccard_join.drop_near_duplicates(plain).collect()}
    assert kept == {label[r.doc_id] for r in plain.collect()}


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    base = sentence(9, 100).split()
    draw = np.random.default_rng(3)
    rows = []
    for i in range(60):
        copy = list(base)
        for at in draw.integers(0, 100, int(draw.integers(0, 4))):
            copy[at] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    sets = [shingle_set(t) for _, t in rows]
    links = [sum(1 for b in sets if len(a & b) >= 0.8 * len(a | b)) - 1 for a in sets]
    found = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_links for r in found.orderBy("doc_id").collect()] == links


def test_runs_keep_the_recall_when_all_levels_split():
    number, depth = jaccard_join.run_count(), jaccard_join.DEPTH
    draw = np.random.default_rng(5)
    shared = draw.binomial(jaccard_join.SKETCH, 0.8, 20_000)
    met = np.zeros(len(shared), bool)
    for _ in range(number):
        alive = np.ones(len(shared), np.int64)
        for _ in range(depth + 1):  # every bucket that the pair shares, by the tokens that both choose there
            alive = draw.binomial(alive * shared, 1 / (0.8 * jaccard_join.SKETCH))
        met |= alive > 0
    assert (~met).mean() <= 0.0018  # 0.001, and 3.5 times its spread


def test_windows_of_a_text_that_repeats_one_shingle_take_one_pass():
    first = np.array([0, 20_000])
    start = time.process_time()
    found = passages.compact_windows(np.zeros(20_000, np.uint64), first, 46)
    assert time.process_time() - start < 0.3  # by levels of the tree, one per repeat, 7.7 s
    assert found.tolist() == [[0, i, i, 19_999] for i in range(20_000 - 45)]


def test_verified_pieces_move_as_text(spark, tmp_path, monkeypatch):
    words = [f"word{i}" for i in range(4_000)]
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(20)] + words + ["end"])) for i in range(6)]
    sizes, plain = {}, passages.saved

    def saved(df, name):
        out = plain(df, name)
        sizes[name] = out.columns if name not in sizes else sizes[name]
        return out

    monkeypatch.setattr(passages, "saved", saved)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_id, r.start, r.end) for r in found if r.first_id == 0) == [(i, 0, 20, 4_021) for i in range(1, 6)]
    assert "piece" in sizes["passage-pieces"] and not any("shingles" in names for names in sizes.values())


def test_matches_are_shuffled_once(spark):
    """Matches of a pair meet in one exchange, repeats with them; a repeat changes nothing."""
    match = "struct<doc_id:long,copy:long>"
    rows = [((1, 0), (2, 0), 3, 10, 60, f) for f in (1, 2, 1)] + [((1, 0), (2, 0), 3, 50, 99, 4), ((1, 0), (2, 0), 0, 200, 260, 4), ((1, 0), (3, 0), 0, 10, 60, 1)]
    matches = spark.createDataFrame(rows, f"a {match}, b {match}, diagonal int, start int, end int, functions int")
    found = passages._intervals(matches)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(x.b.doc_id, x.start, x.end, x.low, x.high) for x in found.collect()] == [(2, 10, 99, 7, 96)]


def test_only_texts_of_clusters_are_shuffled(spark, tmp_path, monkeypatch):
    """Texts that are like no other do not move when the clusters are compared."""
    text, written = sentence(6, 200), []
    monkeypatch.setattr(jaccard_join, "saved", lambda df, name: written.append((name, df)) or storage.saved(df, name))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), *((i, sentence(i, 200)) for i in range(10, 60))], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    found = jaccard_join.similarity_join(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted((x.doc_id, x.class_id) for x in found.where("n_links > 0").collect()) == [(1, 1), (2, 1)]
    (links,) = [df for name, df in written if name == "join-links"]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("text_key", plan.index("Aggregate [text_key"))
    assert "LeftSemi" in plan[at:] and "strategy=broadcast" in plan[at:]


def test_few_dropped_texts_leave_the_rows_where_they_are(spark):
    text = sentence(4, 300)
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, sentence(5, 300))], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        kept = jaccard_join.drop_near_duplicates(docs)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(x.doc_id for x in kept.collect()) == [1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_go_when_a_step_is_written(spark):
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(name)

    class Watched:
        def __init__(self, df):
            self.df, self.sparkSession, self.schema = df, df.sparkSession, df.schema

        @property
        def write(self):
            seen.append(spark.conf.get(name))
            return self.df.write

    assert storage.saved(Watched(spark.range(10).repartition(3, "id")), "watched").count() == 10
    assert seen == ["true"] and spark.conf.get(name) == before


def test_compact_windows_cover_every_subsequence():
    draw = np.random.default_rng(5)
    values = draw.integers(0, 12, 60).astype(np.uint64)
    first = np.array([0, 25, 25, 60])
    found = passages.compact_windows(values, first, 4)
    for text, (a, b) in enumerate(zip(first, first[1:])):
        own = values[a:b]
        for i in range(len(own)):
            for j in range(i + 3, len(own)):
                least = i + int(own[i : j + 1].argmin())
                held = [w for w in found.tolist() if w[0] == text and w[1] <= i and j <= w[3] and i <= w[2] <= j]
                assert len(held) == 1 and held[0][2] == least


def test_repeated_passages(plain, odd, empty):
    found = {(r.doc_id, r.first_id): (r.start, r.end, r.first_start, r.first_end) for r in passages.repeated_passages(plain).collect()}
    assert found[111, 110] == (90, 150, 80, 140) and found[112, 110] == (0, 60, 80, 140)
    assert {d for d, _ in found} == {101, 102, 111, 112}
    kept = {r.doc_id: r for r in passages.drop_repeated_passages(plain).collect()}
    whole = {r.doc_id: r.text for r in plain.collect()}
    assert kept[112].text == whole[112].split(" ", 60)[60] and kept[112].n_chars == len(kept[112].text)
    assert all(kept[i].text == whole[i] for i in whole if i not in (101, 102, 111, 112))
    assert passages.repeated_passages(empty).count() == 0
    left = passages.drop_repeated_passages(odd)
    assert left.columns == odd.columns and left.where("doc_id = 8").count() == 0
    assert left.where("doc_id is null").count() == 2


@pytest.mark.parametrize("count", [50, 60, 75])
def test_passages_with_one_changed_word_at_every_place(count):
    passage = sentence(600, count).split()
    before, after, other = (sentence(601 + i, 20).split() for i in range(3))
    theirs = words.Texts([" ".join([*other, *passage, *other])]).shingles()[0]
    for place in range(count):
        changed = [*passage[:place], "changed", *passage[place + 1 :]]
        own = words.Texts([" ".join([*before, *changed, *after])]).shingles()[0]
        known = np.isin(own, theirs)
        best = 0  # of all stretches between matches, the longest that reaches the threshold
        for i in np.flatnonzero(known).tolist():
            for j in np.flatnonzero(known).tolist():
                low, high = i, j + 1  # places are the same on both sides
                same = len(np.intersect1d(own[low:high], theirs[low:high]))
                if high - low >= 46 and same >= 0.8 * (2 * (high - low) - same):
                    best = max(best, high - low)
        found = passages.shared_runs(own, theirs, 46, 0.8)
        assert max((end - start for start, end, *_ in found), default=0) == best
    edge = passages.shared_runs(theirs[20:76], theirs, 46, 0.8)
    assert edge == [(0, 56, 20, 76, 1.0)]


@pytest.mark.parametrize("local", [4_096, 6])
def test_passages_with_a_frequent_line(spark, monkeypatch, local):
    """Passages of 50 to 60 words, each in two documents, around a line of 40 words that stands in all, in the first one twice."""
    monkeypatch.setattr(passages, "LOCAL", local)
    line, texts, want = sentence(400, 40), [], set()
    texts.append(f"{sentence(401, 30)} {line} {sentence(402, 30)} {line} {sentence(403, 30)}")
    for i in range(24):
        extra, left = 10 + i % 11, i % 11
        words = sentence(500 + i, extra).split()
        passage = " ".join([*words[:left], line, *words[left:]])
        for copy in range(2):
            texts.append(f"{sentence(1000 + 2 * i + copy, 30)} {passage} {sentence(2000 + 2 * i + copy, 30)}")
        want.add((len(texts) - 1, len(texts) - 2, 30, 30 + 40 + extra))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.first_id, r.start, r.end) for r in found} == want


def test_passages_of_two_texts_under_one_id(spark):
    shared, other, clean = sentence(700, 60), sentence(701, 60), sentence(702, 200)
    rows = [(1, f"{sentence(703, 40)} {other}"), (2, clean), (2, f"{sentence(704, 20)} {other} {sentence(705, 20)}")]
    rows += [(3, f"{sentence(706, 10)} {shared}"), (3, f"{sentence(707, 30)} {shared}"), (3, f"{sentence(707, 30)} {shared}")]
    left = passages.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = rows_of(left)
    assert len(texts) == 6
    assert (2, clean) in texts and (2, f"{sentence(704, 20)} {sentence(705, 20)}") in texts and (1, rows[0][1]) in texts
    with_shared = {t for i, t in texts if i == 3 and shared in t}
    assert len(with_shared) == 1 and len({t for i, t in texts if i == 3}) == 2


def test_warc(spark):
    page = "<p>é " + "x" * 100
    rows = [(3, "u\r\nv", page), (1, "u", page), (2, None, "short"), (4, None, "short"), (5, "w", None), (6, "w", ""), (1, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [(i, size(t), digest(t), "revisit" if i == 3 else "response", 1 if i == 3 else None) for i, _, t in rows]
    assert rows_of(warc.round_trip(spark, pages)) == sorted(want, key=repr)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_reads_members_without_length_and_skips_payloads(tmp_path):
    import gzip
    import io

    text = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    raw = gzip.compress(text) + warc.record({"WARC-Type": "metadata"}, b"y" * 200_000) + gzip.compress(text)
    found = [(one.headers["warc-type"], one.block()[-5:]) for one in warc._Records(io.BytesIO(raw))]
    assert found == [("response", b"hello"), ("metadata", b"yyyyy"), ("response", b"hello")]
    assert [one.headers["warc-type"] for one in warc._Records(io.BytesIO(raw))] == ["response", "metadata", "response"]
    with pytest.raises(ValueError):
        list(warc._Records(io.BytesIO(raw[: len(raw) - 30])))


def test_main_text(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a
    href=x>Home</a></ul></nav><div id=main-story><h2>Title &amp; more</h2><p>First   paragraph, with <b>bold</b> words; enough of
    them.<p>Short.<ul><li>one thing<li>two things</ul><div class="ad-box">Buy</div><p>Last paragraph. It ends<br>here.</div><div
    class=sidebar><p>Side, long text. More.</p></div><section id=comments><p>I agree, really. Very much so.</p></section><form>Mail
    <input></form><footer>&copy; us</footer></body></html>"""
    blocks = ["Title & more", "First paragraph, with bold words; enough of them.", "Short.", "one thing", "two things"]
    assert html_text.main_text(page) == "\n\n".join([*blocks, "Last paragraph. It ends here."])
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain", "<!-- x")] == ["", "", "", "plain", ""]
    rows = spark.createDataFrame([(1, "u", page), (None, None, None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in html_text.extract_pages(rows).collect()}
    assert found[1].n_chars == len(found[1].text) and found[None].text == ""


PROSE = ["One sentence of the story, and a second one; it goes on for a while.", "Then there is more of it, with marks, and it ends here."]


def test_main_text_of_several_parts():
    one, two = (f"<p>{x}</p>" for x in PROSE)
    both = "\n\n".join(PROSE)
    assert html_text.main_text(f"<main><article>{one}{one}</article><article>{two}</article></main>") == f"{PROSE[0]}\n\n{both}"
    lead = f"<body><div id=x><div class=lead>{two}</div><div class=body>{one * 5}</div></div><div>Imprint</div></body>"
    assert html_text.main_text(lead) == "\n\n".join([PROSE[1], *PROSE[:1] * 5])
    assert html_text.main_text(f"<article>{one * 5}</article><div>{two}</div><ul><li><a>Home</a></ul>") == "\n\n".join([*PROSE[:1] * 5, PROSE[1]])


@pytest.mark.parametrize(
    "name", ["content has-sidebar", "layout no-sidebar", "post with-comments", "entry tags-news", "with-comments", "sidebar-left", "hasSidebar"]
)
def test_class_words_are_evidence_only(name):
    story = "".join(f"<p>{x}</p>" for x in PROSE)
    page = f"<body><div class='{name}'>{story}<div class=comments><p>I agree, really.</p></div></div><form>Mail</form></body>"
    assert html_text.main_text(page) == "\n\n".join(PROSE)


def test_parts_of_an_article_that_were_left_out():
    story = "".join(f"<p>{x}</p>" for x in PROSE)
    page = f"<article>{story}<section class=related-work><p>{PROSE[1]}</p></section><h2>Sources</h2><ul><li><a>A book</a></ul></article>"
    page += "<div class=related><a>Other</a></div><ul><li><a>Home</a></ul>"
    assert html_text.main_text(page) == "\n\n".join([*PROSE, PROSE[1], "Sources", "A book"])
    assert html_text.main_text(f"<body><form id=aspnet>{story}</form></body>") == "\n\n".join(PROSE)
    assert html_text.main_text("<div class=notice>Closed</div>") == "Closed"


def test_nearest(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(400, 8)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500 + i, vectors[7]) for i in range(40)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [float("inf")] + [1.0] * 7), (None, vectors[0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = nearest.search(frame, F.col("vec_id") % 50 == 0).collect()
    table = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    hits = 0
    queries = [i for i in ids.tolist() if i % 50 == 0]
    for query in queries:
        own = table[ids == query][0]
        score = (table * own).sum(axis=1) / np.sqrt((table * table).sum(axis=1) * (own * own).sum())
        order = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != query][:5]
        mine = sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len(set(order) & {r.vec_id for r in mine})
    assert hits >= 0.9 * 5 * len(queries)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert nearest.search(few, F.col("vec_id") % 50 == 0).count() == 2
    assert nearest.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = docs.where("doc_id % 5 = 0").withColumn("lang", F.lit(None).cast("string"))
    model = language.fit_text_model(language.as_rows(docs.where("doc_id % 5 != 0")))
    found = language.identify(language.as_rows(held_out), model, F.col("row.doc_id"))
    right = found.join(docs, found.key == docs.doc_id).where("language = lang").count()
    assert right >= 0.97 * held_out.count()
    assert language.identify_documents(odd).where("accepted").count() >= 1
    assert language.identify_documents(empty).count() == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_language_evidence_of_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_text_model(language.as_rows(docs))
    rows = [(f"http://h{i % 3}.site{i % 2}.{'de' if i % 4 else 'fr'}/x", "de" if i % 4 else "fr", "la") for i in range(40)]
    pages = spark.createDataFrame(rows, "url string, lang string, text string")
    found = language.identify(language.as_rows(pages, url="url"), model, F.col("row.url"))
    assert {r.key[-4:-2] for r in found.collect()} == {"de", "fr"}


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 20, 32])
def test_bits(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1_003, dtype=np.uint64).astype(np.uint32)
    raw = packed_ids.pack(ids, width)
    assert len(raw) == -(-1_003 * width // 8) and (packed_ids.unpack(raw, 1_003, width) == ids).all()


def test_packed_ids(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(packed_ids, "BLOCK", 64)
    tokens = encoder(WORDS)
    ordered = sorted(odd.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    found = packed_ids.round_trip(spark, odd, WORDS, 2).orderBy("start").collect()
    assert [r.doc_id for r in found] == [r.doc_id for r in ordered]
    start = 0
    for row in found:
        texts = [r.text for r in ordered if r.doc_id == row.doc_id]
        crcs = {zlib.crc32(np.append(tokens.encode([t])[0], 2).astype("<u4")) for t in texts}
        assert row.start == start and row.ids_crc32 in crcs
        start += row.n_tokens
    assert packed_ids.round_trip(spark, empty, WORDS, 2).count() == 0
    with open(tmp_path / "ids", "wb") as stream:
        writer = packed_ids.IdsWriter(stream, 13)
        for i, size in enumerate((0, 100, 1, 300)):
            writer.add(i, np.arange(size, dtype=np.uint32))
        writer.close()
    assert packed_ids.read_document(str(tmp_path / "ids"), 3).tolist() == list(range(300))


def test_cuts_have_the_least_cost():
    draw = np.random.default_rng(2)
    for _ in range(20):
        positions = np.concatenate(([0], np.cumsum(draw.integers(1, 6, 12))))
        penalties = draw.integers(0, 5, 13).astype(float)
        best = {0: 0.0}
        for i in range(1, 13):
            best[i] = min(best[k] + penalties[i] + 9 - (positions[i] - positions[k]) for k in range(i) if positions[i] - positions[k] <= 9)
        cuts = packing.choose_cuts(positions, penalties, 9)
        cost = sum(penalties[b] + 9 - (positions[b] - positions[a]) for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == 12 and cost == best[12]


def test_packing(odd, empty, plain):
    tokens = encoder(BYTES)
    for docs in (odd, plain):
        pieces = packing.pack_documents(docs, BYTES, 1, 512, 4_000).collect()
        sequences = {}
        for piece in pieces:
            sequences.setdefault(piece.sequence_id, []).append(piece)
        for held in sequences.values():
            at = 0
            for piece in sorted(held, key=lambda p: p.offset):
                assert piece.offset == at
                at += piece["length"]
            assert at <= 512
        want = {}
        for row in docs.collect():
            ids = np.append(tokens.encode([row.text])[0], 1).astype("<u4")
            want.setdefault((row.doc_id, len(ids)), []).append(ids)
        assert sum(p["length"] for p in pieces) == sum(len(x) for held in want.values() for x in held)
        for piece in pieces:
            crcs = {zlib.crc32(x[piece.start : piece.start + piece["length"]]) for x in want[piece.doc_id, piece.doc_tokens]}
            assert piece.ids_crc32 in crcs
    assert packing.pack_documents(empty, BYTES, 1).count() == 0


