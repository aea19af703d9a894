"""Decontamination, centroid clustering and prefix tries against brute force, and on odd rows; mended byte BPE and WARC cases."""

import base64
import hashlib
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from hopscore.llm import byte_bpe, centroids, decontaminate, html_text, language, prefix_trie, warc  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items):
    windows = set()
    for item, text in items:
        found = words_of(text)
        for i in range(max(1, len(found) - 9) if found else 0):
            windows.add((item, tuple(found[i : i + 10])))
    out = []
    for doc, text in docs:
        found, hit, names = words_of(text), set(), set()
        for item, window in windows:
            for i in range(len(found) - len(window) + 1):
                if tuple(found[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    names.add(item)
        listed = ",".join(sorted(str(x) for x in names if x is not None))
        out.append((doc, len(found), len(hit), len(names - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


DOCS = "doc_id long, text string, n_words string, window string, at string"
ITEMS = "item_id long, text string, gram string, doc_id string"


def test_decontamination_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    names = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "straße", "x9", "ＡＢＣ"]
    say = lambda n: " ".join(draw.choice(names, n))
    items = [(i, say(int(draw.integers(8, 30)))) for i in range(12)]
    items += [(20, "Lonely"), (21, "two Words"), (22, "a b c d"), (23, items[0][1].upper()), (24, None), (25, " -- "), (None, items[1][1]), (20, "again here now ok go on")]
    docs = [(i, say(60)) for i in range(10)]
    for i in range(30):
        text = items[int(draw.integers(0, 12))][1].split()
        a = int(draw.integers(0, max(1, len(text) - 9)))
        docs.append((100 + i, f"{say(int(draw.integers(0, 20)))} -{', '.join(text[a : a + int(draw.integers(7, 14))])}! {say(int(draw.integers(0, 9)))}"))
    docs += [(200, "so LONELY, two\n\nwords a B c d"), (201, "a b c d"), (202, None), (203, ""), (204, "..."), (None, items[2][1]), (205, items[2][1]), (205, items[2][1])]
    docs += [(206, " ".join([say(3_000), items[3][1], say(200), items[3][1]])), (207, items[1][1]), (208, items[0][1] + " " + items[0][1])]
    frame = spark.createDataFrame([(*d, "n", "w", "a") for d in docs], DOCS)
    bench = spark.createDataFrame([(*b, "g", "d") for b in items], ITEMS)
    want = brute_contamination(docs, items)
    assert rows_of(decontaminate.contamination_digests(spark, frame, bench)) == want
    assert sum(r[5] for r in want) > 20


def test_decontamination_of_empty_tables(spark):
    docs, items = [(1, "one two"), (2, None)], [(1, "one two")]
    frame, bench = spark.createDataFrame([(*d, "", "", "") for d in docs], DOCS), spark.createDataFrame([(*b, "", "") for b in items], ITEMS)
    assert decontaminate.contamination_digests(spark, frame.limit(0), bench).count() == 0
    assert rows_of(decontaminate.contamination_digests(spark, frame, bench.limit(0))) == brute_contamination(docs, [])
    assert rows_of(decontaminate.contamination_digests(spark, frame, bench)) == brute_contamination(docs, items)


def test_windows_join_on_their_rarest_shingle(spark):
    """A line that stands in all documents is part of every window; the join meets only documents with the rare rest."""
    line = "this line is everywhere today"
    items = [(1, f"{line} and only here it goes on")]
    docs = [(i, f"{line} plus {i}") for i in range(300)] + [(999, f"x {items[0][1]}")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    held = decontaminate.windows(bench)
    distinct = held.select("window", "n", "grams").dropDuplicates(["window"])
    bitmap = decontaminate.bitmap_of(held.selectExpr("explode(grams) gram"))
    scanned = decontaminate.occurrences(frame, bitmap, [5])
    counts = scanned.selectExpr("explode(gram) gram").groupBy("gram").count()
    assert counts.agg({"count": "max"}).first()[0] == 301
    chosen = decontaminate.necessary(distinct, counts).join(counts, "gram").collect()
    assert len(chosen) == 2 and {r["count"] for r in chosen} == {1}
    assert [r.n_hit for r in decontaminate.contamination(frame, bench).where("contaminated").collect()] == [11]


def test_occurrences_do_not_depend_on_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(decontaminate, "BITS_EACH", 1)
    docs, items = [(i, " ".join(f"a{j}" for j in range(i, i + 300))) for i in range(20)], [(1, "a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 a15"), (2, "a300")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.contamination_digests(spark, frame, bench)) == brute_contamination(docs, items)


def brute_clusters(rows, k, rounds):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, [int(np.floor(64 * float(x))) for x in vector]))
    digest = lambda key: (key is None, hashlib.sha256(f"1:{key}".encode()).hexdigest() if key is not None else "")
    held = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(held))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        held = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(held)]
    placed = [(key, *assign(v)[::-1]) for key, v in kept]
    total = sum(d for _, _, d in placed)
    inertia = {i: sum(d for _, c, d in placed if c == i) for i in range(k)}
    return sorted(((key, c, d, inertia[c], total, hashlib.sha256(",".join(map(str, held[c])).encode()).hexdigest()) for key, c, d in placed), key=repr)


VECTORS = "vec_id long, embedding array<float>, point string, cluster string, total string"


def test_clustering_equals_brute_force(spark):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(scale=0.1, size=64).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, [0.25] * 64) for i in range(40)] + [(300 + i, [float(i % 2) / 64] * 64) for i in range(20)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (400, None), (401, []), (402, [0.0] * 63), (403, [None] * 64), (404, [float("nan")] + [0.0] * 63)]
    rows += [(405, [float("inf")] * 64), (406, [0.0] * 64), (406, [0.0] * 64)]
    frame = spark.createDataFrame([(*r, "p", "c", "t") for r in rows], VECTORS)
    assert rows_of(centroids.cluster(frame)) == brute_clusters(rows, 16, 3)
    few = [r for r in rows if r[0] in (1, 2, 405)]
    assert rows_of(centroids.cluster(frame.where("vec_id in (1, 2, 405)"))) == brute_clusters(few, 16, 3)
    assert centroids.cluster(frame.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 64, "", "", ""), (2, [1.0] * 64, "", "", "")], VECTORS)
    assert [r.vec_id for r in centroids.cluster(huge).collect()] == [2]


@pytest.mark.parametrize("count", [1, 2, 3, 16, 200])
def test_tree_finds_the_nearest_and_prunes(count):
    draw = np.random.default_rng(count)
    middles = draw.integers(-300, 300, (max(1, count // 8), 6))
    points = middles[draw.integers(0, len(middles), count)] + draw.integers(-9, 9, (count, 6))
    points[count // 2] = points[0]  # equal centroids: the smaller number wins
    rows = np.concatenate([points[draw.integers(0, count, 300)] + draw.integers(-3, 3, (300, 6)), np.zeros((5, 6), int), (points[:1] + points[-1:]) // 2])
    number, distance, computed = centroids.VantageTree.over(points).nearest(rows)
    far = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (distance == far.min(axis=1)).all() and (number == far.argmin(axis=1)).all()
    if count == 200:
        assert computed < 0.5 * len(rows) * count


def brute_trie(rows, cut=True):
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [t[2:] for t in sorted(turns)] for c, turns in held.items()}
    rebuilt = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 4 if cut else 0
        rebuilt[c] = held.get(c - c % 20, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(members) if tuple(rebuilt[c]) == path)
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[:-1] == p for q in below if q) for p in below),
            sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, path string, steps string, low string"


def conversations(seed, count):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(count):
        if c in (40, 61):
            continue
        like = c if draw.random() < 0.5 else int(draw.integers(0, 4))
        own = np.random.default_rng(like)
        for turn in range(int(draw.integers(0, 7)) if c % 17 else 30):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", " ".join(own.choice(list("abcdefg"), int(own.integers(0, 5))))))
    rows += [(3, None, None, None), (3, 50, "user", None), (5, 60, "user", "x y"), (5, 60, "user", "x y"), (None, 0, "user", "lost")]
    return rows + [(1000 + i, 0, "user", "same start") for i in range(60)]


@pytest.mark.parametrize("partitions, block", [("1", 12), ("7", 2), ("40", 0)])
def test_trie_equals_brute_force(spark, monkeypatch, partitions, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(2, 130)
    frame = spark.createDataFrame([(*r, "p", "s", "l") for r in rows], TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = rows_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.steps(frame))))
        assert found == brute_trie(rows)
        assert rows_of(prefix_trie.trie(prefix_trie.steps(frame))) == brute_trie(rows, cut=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_no_and_of_turnless_conversations(spark):
    frame = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.steps(frame))).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 0, "user", "gone"), (c + 20, 0, None, "")]
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS)
    assert rows_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.steps(frame)))) == brute_trie(rows)


def test_long_conversations_have_splitters_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEEPEST", 3)
    rows = [(c, t, "user", f"t{t}" if t < 20 else f"{c} {t}") for c in range(30) for t in range(20 + c % 3)]
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS)
    assert rows_of(prefix_trie.trie(prefix_trie.steps(frame))) == brute_trie(rows, cut=False)


def test_skeleton_holds_every_node_of_several_shards():
    draw = np.random.default_rng(3)
    steps = [bytes([i]) * 16 + (1).to_bytes(4, "big") for i in range(3)]
    paths = sorted({b"".join(steps[x] for x in draw.integers(0, 3, int(draw.integers(0, 6)))) for _ in range(300)})
    skeleton = prefix_trie.Skeleton(paths, 8)
    shards = {}
    for path in paths:
        for d in range(len(path) // 20 + 1):
            shards.setdefault(path[: 20 * d], set()).add(skeleton.shard(path))
    prefixes = {s[:i] for s in skeleton.splitters for i in range(0, len(s) + 1, 20)}
    assert {p for p, own in shards.items() if len(own) > 1} <= prefixes | {b""}
    assert len(set().union(*shards.values())) == 8


@pytest.mark.parametrize("chunk, overlap", [(40, 24), (64, 32)])
def test_byte_bpe_cuts_between_white_space_and_words(spark, chunk, overlap):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    draw = np.random.default_rng(1)
    parts = ["word", "a", "it's", "\n\n", "  ", " ", "\t\n", "12", "!?", "é", "　 ", "\x85", "\r\n\r\n", "<|endoftext|>"]
    texts = ["".join(draw.choice(parts, int(draw.integers(20, 120)))) for _ in range(300)] + ["x" * 30 + " " * k + "y" * 200 for k in range(40)]
    texts.append("p" * (chunk - 2) + "\n\nword " * 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()}
    for i, text in enumerate(texts):
        ids = bpe.encode_ordinary(text)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(text)


def test_warc_appends_and_foreign_archives(spark, tmp_path):
    warc.register(spark)
    folder = str(tmp_path / "archive")
    for i in range(2):
        one = spark.createDataFrame([(i, "u", f"<p>{i}")], "page_id long, url string, html string")
        warc.page_records(one).write.format("warc").mode("append").save(folder)
    (tmp_path / "archive" / "other.warc.gz").write_bytes(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:9>"}, b"z"))
    (tmp_path / "archive" / f"part-{'0' * 32}.warc.gz").write_bytes(b"left by a task that failed")
    read = spark.read.format("warc").load(folder)
    assert sorted(r.record_id for r in read.collect()) == ["<urn:page:0>", "<urn:page:1>", "<urn:page:9>"]


STORY = ["One sentence of the story, and a second one; it goes on for a while.", "Then there is more of it, with marks, and it ends here."] * 3
MENU = "".join(f"<li><a href=x{i}>Item {i}</a></li>" for i in range(8))


def test_main_text_without_any_telling_name():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    page = f"<body><div><ul>{MENU}</ul></div><div><div><h1>The title</h1>{story}<p>Short.</p>{story}</div></div><div><span>Imprint</span> <a>Contact</a></div></body>"
    assert html_text.main_text(page) == "\n\n".join(["The title", *STORY, "Short.", *STORY])


def test_scores_decide_what_is_content(monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()[:60]
    before = [html_text.main_text(page) for page in pages]
    with monkeypatch.context() as patch:
        patch.setattr(html_text, "scores", lambda blocks, weights: np.ones(len(blocks)))
        assert sum(html_text.main_text(p) != b for p, b in zip(pages, before)) > 50
    with monkeypatch.context() as patch:
        patch.setattr(html_text, "scores", lambda blocks, weights: np.random.default_rng(len(blocks)).random(len(blocks)))
        assert sum(html_text.main_text(p) != b for p, b in zip(pages, before)) > 30


def test_ratios_equal_brute_force():
    page = f"<div><ul>{MENU}</ul><p>One, two.<p>Three <a>four</a>!</div><section><p>Five;</section>"
    blocks, elements = html_text.parse(page)
    paths = {}
    for block in blocks:
        chain, at = [], block.element
        while at >= 0:
            chain, at = [elements[at].tag, *chain], elements[at].parent
        paths.setdefault(tuple(chain), []).append(block)
    assert {tuple(sorted(p)) for p in paths} == {("div", "li", "ul"), ("div", "p"), ("p", "section")}
    found = html_text.ratios(blocks)
    for held in paths.values():
        assert len({b.path for b in held}) == 1
        length = sum(len(b.text) for b in held)
        marks = sum(len(html_text.PUNCTUATION.findall(b.text)) for b in held)
        want = [length / len(held), marks / len(held), sum(b.linked for b in held) / length]
        for block in held:
            assert found[blocks.index(block)].tolist() == pytest.approx(want)


def test_deep_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    def cost(depth):
        tracemalloc.start()
        begin = time.process_time()
        html_text.main_text("<div class=ad>text, " * depth)
        spent, peak = time.process_time() - begin, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return spent, peak

    cost(500)
    (short, little), (long, much) = cost(4_000), cost(16_000)
    assert much < 6 * little and long < 12 * short + 0.5


def test_pages_of_an_empty_table_and_with_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, path string"
    row = (1, "u", "<p>Some text, here.", "t", "n", "p")
    frame = spark.createDataFrame([row, row], schema)
    assert rows_of(html_text.extract_pages(frame)) == [(1, "u", "Some text, here.", 16)] * 2
    assert html_text.extract_pages(frame.limit(0)).count() == 0


def test_rare_and_unknown_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    greek = ["και το", "δεν είναι", "η πόλη", "μια μέρα", "θάλασσα", "καλημέρα σας", "όλοι μαζί"]
    cyrillic = ["и это", "не было", "город", "один день", "море", "доброе утро", "все вместе"]
    draw = np.random.default_rng(2)
    say = lambda words: " ".join(draw.choice(words, 40))
    rows = [(10_000 + i, say(greek), "el", "src1") for i in range(4)] + [(10_100, say(greek), "en", "src1"), (10_101, say(greek), None, "src2")]
    rows += [(10_200 + i, say(cyrillic), lang, "src1") for i, lang in enumerate(["en", "de", None])]
    found = {r.doc_id: r for r in language.identify_documents(docs.union(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 10000").collect()}
    assert all(found[i].accepted and found[i].language == "el" for i in (10_000, 10_001, 10_002, 10_003, 10_100, 10_101))
    assert not any(found[i].accepted for i in (10_200, 10_201, 10_202))
