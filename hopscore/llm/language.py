"""Language of documents by Bayesian evidence fusion.

posterior(language) is proportional to prior(language | host) * P(declared | language) * P(suffix | language) *
P(text | language) ** t. The text likelihood is that of hashed letter trigrams, fitted on a bounded sample of the rows of each declared
language, so that rare languages are as well known as frequent ones; long texts are tempered, as their trigrams are not independent. A text
that every language makes less likely than letters at random is of another one. All other terms are counts over all rows, made by grouped
aggregations of the language that the text alone speaks for. The prior of a host is smoothed towards that of its parent domain,
and this towards that of the corpus. Declared languages are primary subtags, suffixes those of countries; both are evidence, no
more: a wrong declaration is outvoted by the text.

Input rows have ``text`` and, where known, ``declared``, ``host`` and ``url``; ``as_rows`` makes them from a document table.
A row whose text has no letters, or that no language has half of the posterior for, is rejected (language null or as found), and so is
one of another language than those declared anywhere.
Null declared, host or url is no evidence. Rows that repeat are judged alike. Other columns are carried untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.llm.storage import released, saved
from hopscore.llm.words import in_parts

SAMPLE = 1_500  # texts per declared language that the text model is fitted on, by expectation: a share of them by hash
FEATURES = 1 << 14
OTHER_PRIOR = 0.01  # of a language that no row declares; its letters are all alike to it
TEMPER, FULL = 0.25, 200.0  # weight of a trigram, and the number of them that counts in full
SMOOTH = 20.0  # rows that a host's own counts must outweigh
CONFIDENT = 0.5
PART = 200_000  # characters scored at once

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def trigrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all texts in a row, and the first of each text; runs of other characters count as one gap."""
    lowered = [(text or "").lower() for text in texts]
    points = np.frombuffer("".join(f" {x} " for x in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 2 for x in lowered])
    letter = (points >= 0x10000) | _LETTERS[np.minimum(points, 0xFFFF)]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of every gap
    keep[starts] = True
    keep[ends - 1] = True
    codes = np.where(letter, points, np.uint32(32))[keep]
    first = np.concatenate(([0], np.cumsum(keep)))[np.concatenate((starts, ends[-1:])).astype(np.int64)]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.zeros(len(lowered) + 1, np.int64)
    with np.errstate(over="ignore"):
        mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA6B)) ^ (codes[2:] * np.uint32(0xC2B2AE35))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    buckets = ((mixed >> np.uint32(12)) % np.uint32(FEATURES)).astype(np.int64)
    whole = (codes[:-2] != 32).astype(np.int8) + (codes[1:-1] != 32) + (codes[2:] != 32) >= 2
    whole &= ~((codes[1:-1] == 32) & (codes[:-2] != 32) & (codes[2:] != 32))
    for edge in first[1:-1]:  # no trigram spans two texts
        whole[max(0, edge - 2) : edge] = False
    return buckets[whole], np.concatenate(([0], np.cumsum(whole), [whole.sum()] * 2))[first]


@dataclass
class TextModel:
    """Log probabilities of the features by language."""

    languages: list[str]
    table: np.ndarray

    def scores(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods of each text, and its number of trigrams."""
        total = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        for a, b in in_parts(list(texts), PART):
            for low, high in _cut(texts[a:b]):
                features, first = trigrams([x[low:high] for x in map(lambda t: t or "", texts[a:b])])
                sums = np.vstack((np.zeros(len(self.languages)), np.cumsum(self.table[features], axis=0, dtype=np.float64)))
                total[a:b] += sums[first[1:]] - sums[first[:-1]]
                counts[a:b] += np.diff(first)
        weight = TEMPER * np.minimum(1.0, FULL / np.maximum(counts, 1.0))
        return total * weight[:, None], counts


def _cut(texts: Sequence[str | None]) -> Iterator[tuple[int, int | None]]:
    """The whole of short texts; parts of a text that stands alone because it is long."""
    size = len(texts[0] or "") if len(texts) == 1 else 0
    if size <= PART:
        yield 0, None
    else:
        for low in range(0, size, PART):
            yield low, low + PART


def as_rows(docs: DataFrame, declared: str = "lang", host: str = "source", url: str | None = None) -> DataFrame:
    """Documents with their evidence: ``row`` (all columns), ``text``, ``declared``, ``host``, ``parent``, ``suffix``."""
    address = F.col(url).cast("string") if url else F.lit(None).cast("string")
    server = F.lower(F.parse_url(address, F.lit("HOST"))) if url else F.col(host).cast("string")
    labels = F.split("host", r"\.")
    subtag = F.regexp_extract(F.lower(F.trim(F.col(declared).cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    rows = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row"),
        F.col("text").alias("text"),
        F.nullif(subtag, F.lit("")).alias("declared"),
        F.nullif(server, F.lit("")).alias("host"),
    )
    suffix = F.nullif(F.regexp_extract("host", r"\.([a-z]{2})$", 1), F.lit("")) if url else F.lit(None).cast("string")
    parent = F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2)))
    return rows.withColumns({"suffix": suffix, "parent": parent})


def fit_text_model(rows: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fit the text likelihoods on about ``sample`` texts of each declared language, chosen by their hash; repeated texts count once."""
    named = rows.where("declared is not null and text is not null").select("text", "declared")
    named = named.withColumn("h", F.xxhash64("text", "declared"))
    sizes = dict(named.groupBy("declared").agg(F.approx_count_distinct("h")).collect())  # subtags of two or three letters
    if not sizes:
        return TextModel([], np.zeros((FEATURES, 0)))
    shares = [(name, int(-(2**63) + min(1.0, sample / max(n, 1)) * (2**64 - 2048))) for name, n in sorted(sizes.items())]
    bounds = rows.sparkSession.createDataFrame(shares, "declared string, bound long")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, texts in frame.groupby("declared")["text"]:
                counts, rows = np.zeros(FEATURES, np.int64), texts.tolist()
                for a, b in in_parts(rows, PART):
                    counts += np.bincount(trigrams(rows[a:b])[0], minlength=FEATURES)
                yield pd.DataFrame({"language": [name], "texts": [len(rows)], "counts": [counts.tolist()]})

    chosen = named.join(F.broadcast(bounds), "declared").where("h <= bound").select("text", "declared", "h").dropDuplicates(["h"])
    parts = chosen.mapInPandas(released(count), "language string, texts long, counts array<long>")
    summed = (
        parts.select("language", F.posexplode("counts").alias("feature", "n"))
        .where("n > 0")
        .groupBy("language", "feature")
        .agg(F.sum("n").alias("n"))
    )
    languages = sorted(sizes)
    counts = np.zeros((FEATURES, len(languages)))
    for language, feature, n in summed.where(F.col("language").isin(languages)).toPandas().itertuples(index=False):
        counts[feature, languages.index(language)] = n
    return TextModel(languages, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * FEATURES)))


def _evidence(rows: DataFrame, model: TextModel, key: Column) -> DataFrame:
    """Per row its key, its evidence and the log likelihoods of its text; no text."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            found, counts = model.scores(texts)
            best = np.where(counts > 0, found.argmax(axis=1), -1)
            letters = [bool(_LETTER.search(text or "")) for text in texts]
            other = -np.log(FEATURES) * TEMPER * np.minimum(counts, FULL)
            yield frame.drop(columns="text").assign(likelihoods=list(found), spoken=best, letters=letters, other=other)

    rows = rows.select(key.alias("key"), "text", "declared", "host", "parent", "suffix")
    kind = rows.schema["key"].dataType.simpleString()
    fields = "declared string, host string, parent string, suffix string, likelihoods array<double>, spoken int, letters boolean, other double"
    return rows.mapInPandas(released(score), f"key {kind}, {fields}")


def _counts(rows: DataFrame, by: str, languages: Sequence[str], name: str) -> DataFrame:
    spoken = [F.count_if(F.col("spoken") == i) for i in range(len(languages))]
    found = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*spoken).alias(name))
    return saved(found, f"language-{name}")


def identify(rows: DataFrame, model: TextModel, key: Column) -> DataFrame:
    """``key, language, probability, accepted`` for every row of ``as_rows``."""
    languages = model.languages
    if not languages:
        kind = rows.select(key.alias("key")).schema["key"].dataType.simpleString()
        nothing = {"language": F.lit(None).cast("string"), "probability": F.lit(0.0), "accepted": F.lit(False)}
        return rows.select(key.cast(kind).alias("key")).withColumns(nothing)
    found = saved(_evidence(rows, model, key), "language-evidence")
    spoken = [F.count_if(F.col("spoken") == i) for i in range(len(languages))]
    total = np.array(found.agg(F.array(*spoken)).first()[0], float)
    base = (total + 1) / (total + 1).sum()

    def likelihoods(column: str) -> dict[str, np.ndarray]:  # at most one entry per subtag or country
        return {name: np.log((np.array(n) + base) / (total + 1)) for name, n in _counts(found, column, languages, f"{column}_counts").collect()}

    declared, suffixes = likelihoods("declared"), likelihoods("suffix")
    hosts = _counts(found, "host", languages, "host_counts")
    parents = _counts(found, "parent", languages, "parent_counts")

    def fuse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(len(languages))
        for frame in frames:
            own, above = (np.array([none if x is None else x for x in frame[c]]) for c in ("host_counts", "parent_counts"))
            prior = (above + SMOOTH * base) / (above.sum(axis=1, keepdims=True) + SMOOTH)
            prior = (own + SMOOTH * prior) / (own.sum(axis=1, keepdims=True) + SMOOTH)
            logs = np.log(prior) + np.array(frame["likelihoods"].tolist())
            logs += np.array([declared.get(x, none) for x in frame["declared"]])
            logs += np.array([suffixes.get(x, none) for x in frame["suffix"]])
            logs = np.column_stack((logs, np.log(OTHER_PRIOR) + frame["other"].to_numpy(float)))
            logs -= logs.max(axis=1, keepdims=True)
            posterior = (np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True))[:, :-1]
            best, silent = posterior.argmax(axis=1), ~frame["letters"].to_numpy(bool)
            top = np.where(silent, 0.0, posterior.max(axis=1))
            names = np.where(silent, None, np.array(languages, object)[best])
            yield pd.DataFrame({"key": frame["key"], "language": names, "probability": top, "accepted": top >= CONFIDENT})

    joined = found.join(hosts, "host", "left").join(parents, "parent", "left")
    kind = found.schema["key"].dataType.simpleString()
    used = ["key", "likelihoods", "declared", "suffix", "letters", "other", "host_counts", "parent_counts"]
    return joined.select(used).mapInPandas(released(fuse), f"key {kind}, language string, probability double, accepted boolean")


def identify_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, language, probability, accepted`` of a document table."""
    rows = as_rows(docs)
    return identify(rows, fit_text_model(rows, sample), F.col("row.doc_id")).withColumnRenamed("key", "doc_id")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is found, unchanged. Rows are told apart by all that the decision depends on."""
    rows = as_rows(docs)
    key = F.sha2(F.to_json(F.struct(F.md5("text").alias("t"), "declared", "host")), 256)
    found = identify(rows, fit_text_model(rows, sample), key)
    rejected = saved(found.where("not accepted").select("key").distinct(), "language-rejected")
    return rows.withColumn("key", key).join(rejected, "key", "left_anti").select("row.*")
