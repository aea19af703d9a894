"""A results table that is merged when it is read: saving a stage writes the changed rows only.

The folder holds a base (all results at one moment), the changes since then and a log of commits. A change is a row with its key, the stage it
sets and the number of its commit; clearing a stage of a configuration is one line in the log, however many results it touches. Base and
changes are bucketed by the key, so that reading joins them bucket by bucket without an exchange. ``compact`` writes a new base.

A commit counts once its line is in the log: rows of a save that failed are never read. One writer at a time; readers see whole commits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopscore.model import CONFIG, EVAL_TYPE, EXEC_TYPE, GEN_TYPE, KEY, RESULTS, STAGES
from hopscore.operators.staging import cleared_rows, one_per_key
from hopscore.sources.bucketed import append_bucketed, create_bucketed, read_bucketed

TYPES = {"gen": GEN_TYPE, "exec": EXEC_TYPE, "eval": EVAL_TYPE}
MOST_COMMITS = 256  # commits on one base; the next one compacts first, so that the log on the driver stays small
LOG = "commit string, version long, base string, kind string, method string, lang string, model string, stage string"
CHANGES = T.StructType([*RESULTS.fields, T.StructField("stage", T.StringType()), T.StructField("commit", T.StringType()), T.StructField("version", T.LongType())])


class ResultStore:
    """Results at a path. ``create`` starts one; a later session opens it by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, results: DataFrame, path: str, buckets: int | None = None) -> ResultStore:
        store = cls(results.sparkSession, path)
        store._write_base(results, 0, buckets or int(store.spark.conf.get("spark.sql.shuffle.partitions")))
        return store

    def state(self) -> tuple[str, int]:
        """The base and the version of the last commit: what ``merged`` and ``changed_since`` take to name a moment."""
        base, commits = self._log()
        return base, max((c.version for c in commits), default=self._version_of(base))

    def changed_since(self, state: tuple[str, int]) -> DataFrame | None:
        """The keys of all results that commits after ``state`` may have changed; None if the results have got a new base since."""
        base, commits = self._log()
        if base != state[0]:
            return None
        later = [c for c in commits if c.version > state[1]]
        changes = read_bucketed(self.spark, f"{self.path}/{base}/changes").select(*KEY, "commit")
        keys = changes.filter(F.col("commit").isin([c.commit for c in later if c.kind == "save"])).select(*KEY)
        cleared = {tuple(getattr(c, name) for name in CONFIG) for c in later if c.kind == "clear"}
        for config in sorted(cleared):
            same = [F.col(name) == value for name, value in zip(CONFIG, config)]
            keys = keys.unionByName(self.merged().filter(same[0] & same[1] & same[2]).select(*KEY))
        return keys.distinct()

    def merged(self, state: tuple[str, int] | None = None) -> DataFrame:
        """All results as they are after the last commit, or were at a state of the same base."""
        base, commits = self._log()
        if state is not None:
            if state[0] != base:
                raise ValueError("the results have got a new base since")
            commits = [c for c in commits if c.version <= state[1]]
        rows = read_bucketed(self.spark, f"{self.path}/{base}/results").withColumn("_stored", F.lit(True))
        saves = [c.commit for c in commits if c.kind == "save"]
        changes = read_bucketed(self.spark, f"{self.path}/{base}/changes").filter(F.col("commit").isin(saves))
        last = changes.groupBy(*KEY).agg(
            *[F.max(F.when(F.col("stage") == s, F.col("version"))).alias(f"_{s}_at") for s in STAGES],
            *[F.max_by(s, F.when(F.col("stage") == s, F.col("version"))).alias(f"_{s}") for s in STAGES],
        )
        joined = rows.join(last, KEY, "full_outer")
        clears = [c for c in commits if c.kind == "clear"]
        joined = joined.select("*", *[self._cleared_at(clears, s).alias(f"_{s}_cleared") for s in STAGES])

        def at(name: str) -> Column:
            return F.coalesce(F.col(name), F.lit(-1))

        def value(stage: str, *resets: Column) -> Column:
            reset = F.greatest(*resets) if len(resets) > 1 else resets[0]
            return F.when(at(f"_{stage}_at") > reset, F.col(f"_{stage}")).when(reset < 0, F.col(stage))

        gen, execution = at("_gen_at"), at("_exec_at")
        cleared = [at(f"_{s}_cleared") for s in STAGES]
        known = joined.filter(F.col("_stored") | F.col("_gen_at").isNotNull())  # only a generation inserts a result
        return known.select(
            *KEY,
            value("gen", cleared[0]).alias("gen"),
            value("exec", gen, *cleared[:2]).alias("exec"),
            value("eval", gen, execution, *cleared).alias("eval"),
        )

    def save_generation(self, updates: DataFrame, order: str | None = None) -> None:
        """Insert or replace ``gen``; the later stages of these results are void from now on."""
        self._save(updates, "gen", order)

    def save_execution(self, updates: DataFrame, order: str | None = None) -> None:
        """Replace ``exec`` of results that are there; their ``eval`` is void from now on."""
        self._save(updates, "exec", order)

    def save_evaluation(self, updates: DataFrame, order: str | None = None) -> None:
        """Replace ``eval`` of results that are there."""
        self._save(updates, "eval", order)

    def clear_stage(self, method: str, lang: str, model: str, stage: str = "gen") -> int:
        """Void a stage and the later ones of one configuration; writes one line. Returns how many results it has."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}, expected one of {', '.join(STAGES)}")
        self._commit("clear", uuid.uuid4().hex, (method, lang, model), stage)
        return cleared_rows(self.merged(), method, lang, model).first()[0]

    def compact(self) -> None:
        """Write the merged results as a new base; what was there before stays until it is removed by its owner."""
        base, commits = self._log()
        buckets = self.spark.read.parquet(f"{self.path}/{base}/results/about").first().buckets
        self._write_base(self.merged(), max((c.version for c in commits), default=self._version_of(base)) + 1, buckets)

    def _write_base(self, results: DataFrame, version: int, buckets: int) -> None:
        base = f"base-{version:09d}-{uuid.uuid4().hex[:8]}"
        create_bucketed(self.spark, f"{self.path}/{base}/results", RESULTS, KEY, buckets)
        create_bucketed(self.spark, f"{self.path}/{base}/changes", CHANGES, KEY, buckets)
        append_bucketed(results.select(*RESULTS.names), f"{self.path}/{base}/results")
        self._append_log([(base, version, base, "base", None, None, None, None)])

    def _save(self, updates: DataFrame, stage: str, order: str | None) -> None:
        base, version = self._next()
        commit = uuid.uuid4().hex
        rows = one_per_key(updates, stage, order).select(*KEY, F.col("_new").cast(TYPES[stage]).alias("_new"))
        stages = [F.col("_new").alias(s) if s == stage else F.lit(None).cast(TYPES[s]).alias(s) for s in STAGES]
        rows = rows.select(*KEY, *stages, F.lit(stage).alias("stage"), F.lit(commit).alias("commit"), F.lit(version).cast("long").alias("version"))
        append_bucketed(rows, f"{self.path}/{base}/changes")
        self._append_log([(commit, version, base, "save", None, None, None, stage)])

    def _commit(self, kind: str, commit: str, config: tuple[str, str, str], stage: str) -> None:
        base, version = self._next()
        self._append_log([(commit, version, base, kind, *config, stage)])

    def _next(self) -> tuple[str, int]:
        """The base and the number of the next commit."""
        base, commits = self._log()
        if len(commits) >= MOST_COMMITS:
            self.compact()
            base, commits = self._log()
        return base, max((c.version for c in commits), default=self._version_of(base)) + 1

    def _append_log(self, lines: list[tuple]) -> None:
        self.spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _version_of(self, base: str) -> int:
        return int(base.split("-")[1])

    def _log(self) -> tuple[str, list]:
        """The newest base and the commits on it."""
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        base = log.filter("kind = 'base'").agg(F.max_by("base", "version")).first()[0]
        return base, log.filter((F.col("base") == base) & (F.col("kind") != "base")).orderBy("version").collect()

    def _cleared_at(self, clears: list, stage: str) -> Column:
        """The last commit that cleared a stage, by configuration; an own column, as there are only a few clears on a base."""
        out = F.lit(None).cast("long")
        for clear in clears:  # in order: a later one wraps the earlier ones
            if clear.stage == stage:
                config = [F.col(name) == getattr(clear, name) for name in CONFIG]
                out = F.when(config[0] & config[1] & config[2], F.lit(clear.version)).otherwise(out)
        return out
