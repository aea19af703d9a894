"""JSON files that hold one array of objects each, read by as many tasks as they have blocks.

A file is cut at every ``}`` (the text reader's record separator), so that any block of it can be read alone. What stands between two cuts, a
piece, is looked at twice, as if it began outside of a string and inside of one: quotes turn one state into the other, and only brackets outside
count for the depth. Sums over a block for both cases, then a running sum over the few blocks of each file, tell in which state every
block really begins; with it, the pieces of a block give the depth and the number of the object that each belongs to. An object ends where
the depth falls back to that of the array. Everything is a column expression; only numbers are summed per file, one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block"]

# The parts of the format that a piece is looked through for.
ESCAPE = r"\\."
STRING, OPEN_STRING, REST_OF_STRING = r'"[^"]*"', r'"[^"]*$', r'^[^"]*"'
FIRST, LATER = r"^[\s\x{FEFF}]*\[\s*\{", r"^\s*,\s*\{"
END, EMPTY = r"^\s*\]\s*$", r"^[\s\x{FEFF}]*\[\s*\]\s*$"


def _depth(text: Column, inside: bool) -> Column:
    """How much deeper the end of a piece lies than its beginning, without the ``}`` that follows it."""
    plain = F.regexp_replace(text, REST_OF_STRING, "") if inside else text
    plain = F.when(F.contains(text, F.lit('"')), plain).otherwise("") if inside else plain
    bare = F.regexp_replace(F.regexp_replace(plain, STRING, ""), OPEN_STRING, "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, text``, whether the piece has an odd number of quotes, and its change of depth in both cases."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    plain = F.regexp_replace("text", ESCAPE, "")
    odd = (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))) % 2
    return raw.select("*", odd.alias("odd"), _depth(plain, False).alias("d0"), _depth(plain, True).alias("d1"))


def _running(pieces: DataFrame) -> DataFrame:
    """Per piece, for a block that begins outside (``0``) or inside (``1``) of a string: the state before and after the piece, the depth
    after its ``}`` relative to the block's beginning, all within the block."""
    earlier = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    quotes = pieces.withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    for start in (0, 1):
        inside = F.col("before") != start
        ends_inside = (F.col("before") + F.col("odd")) % 2 != start
        change = F.when(inside, F.col("d1")).otherwise(F.col("d0"))
        quotes = quotes.withColumns({f"ends{start}": ends_inside, f"change{start}": change - F.when(ends_inside, 0).otherwise(1), f"deep{start}": change})
    summed = {f"depth{start}": F.sum(f"change{start}").over(so_far) for start in (0, 1)}
    return quotes.withColumns(summed)


def _blocks(running: DataFrame) -> DataFrame:
    """Where every block begins: in a string or not, and at which depth; and the last piece of the file, in its last block."""
    ends = running.groupBy(*BLOCK).agg(
        (F.sum("odd") % 2).alias("odd"), *[F.sum(f"change{s}").alias(f"total{s}") for s in (0, 1)], F.max("at").alias("last")
    )
    of_file = Window.partitionBy("file").orderBy("block")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    placed = ends.withColumn("start", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    placed = placed.withColumn("total", F.when(F.col("start") == 0, F.col("total0")).otherwise(F.col("total1")))
    placed = placed.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    last = F.when(F.lead("block").over(of_file).isNull(), F.col("last"))
    return placed.select(*BLOCK, "start", "base", last.alias("last"))


def _broken(file: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not a JSON array: "), file))


def read_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, place``: the objects of every array as JSON texts. ``place`` orders them within a file.

    A file that is not one array of objects is an error: one that is blank, cut off, followed by other text, or whose elements are other
    values. Files without a single byte are not listed by Spark's readers. What an object holds is checked where it is parsed.
    """
    running = _running(_pieces(spark, path))
    placed = running.join(_blocks(running), BLOCK)

    def own(name: str) -> Column:
        return F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    depth = F.col("base") + own("depth")
    known = placed.select(
        *BLOCK,
        "at",
        "text",
        F.coalesce(F.col("at") == F.col("last"), F.lit(False)).alias("is_last"),
        (~own("ends") & (depth == 1)).alias("closes"),
        (F.col("start") == F.col("before")).alias("begins_outside"),
        (F.col("base") + own("depth") - own("change")).alias("depth_before"),
    )
    # A piece continues an object unless the one before it closed one; the first piece of a block needs no neighbour for that.
    begins = F.col("begins_outside") & (F.col("depth_before") <= 1)
    known = known.withColumn("begins", begins)
    first = F.col("depth_before") == 0
    good = F.when(first, F.col("text").rlike(FIRST)).otherwise(F.col("text").rlike(LATER))
    end = F.when(first, F.col("text").rlike(EMPTY)).otherwise(F.col("text").rlike(END))
    ended = F.col("begins") & end
    # Most objects are one piece. Lists are made of them, as no later filter can run before a list is made: errors are of this file alone.
    none, error = F.array().cast("array<string>"), F.array(_broken(F.col("file")).cast("string"))
    alone = F.when(F.col("is_last"), F.when(ended, none).otherwise(error)).otherwise(
        F.when(F.col("begins") & F.col("closes"), F.when(good, F.array("text")).otherwise(error)).otherwise(none)
    )
    lone = known.select("file", "at", "block", F.explode(alone).alias("text"))
    checked = F.when(good | ~F.col("begins") | F.col("is_last"), True).otherwise(_broken(F.col("file")).cast("boolean"))
    order = Window.partitionBy(*BLOCK).orderBy("at")
    several = known.filter("NOT is_last AND NOT (begins AND closes)").filter(checked)
    numbered = several.withColumn("object", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    carried = _carried(numbered)
    whole = carried.groupBy("file", "owner", "object").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts"))
    joined = whole.select(
        "file", F.col("parts")[0]["at"].alias("at"), F.col("parts")[0]["block"].alias("block"), F.array_join(F.col("parts")["text"], "}").alias("text")
    )
    objects = lone.unionByName(joined)
    value = F.concat(F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[,]\s*", ""), F.lit("}"))
    return objects.select(value.alias("value"), "file", F.struct("block", "at").alias("place"))


def _carried(numbered: DataFrame) -> DataFrame:
    """``owner``: the block in which an object began. The pieces at the beginning of a block that continue an object (number 0) belong
    to the last object of the nearest earlier block that began one."""
    last = numbered.groupBy(*BLOCK).agg(F.max("object").alias("objects"))
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    began = F.when(F.col("objects") > 0, F.struct("block", "objects"))
    owners = last.select(*BLOCK, F.last(began, ignorenulls=True).over(of_file).alias("previous"))
    placed = numbered.join(owners, BLOCK)
    continues = F.col("object") == 0
    return placed.select(
        "file", "block", "at", "text",
        F.when(continues, F.col("previous.block")).otherwise(F.col("block")).alias("owner"),
        F.when(continues, F.col("previous.objects")).otherwise(F.col("object")).alias("object"),
    )

