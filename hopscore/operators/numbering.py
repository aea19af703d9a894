"""Places of rows in groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopscore.session import stored

BITS = 33  # of a row number within a partition, in monotonically_increasing_id


def number_within(rows: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their ``place``, from 1, among the rows of their ``key`` in the order of some columns (ties in any order).

    Rows are range-partitioned by key and order, so that a large group is spread over many partitions; the partitions' counts, one row per
    partition and key, give each partition the offset at which it goes on.
    """
    ranged = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(key, *order)
    at = F.monotonically_increasing_id()
    kept = stored(ranged.withColumns({"_part": F.shiftright(at, BITS), "_at": at}), "numbered")
    counts = kept.groupBy("_part", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = kept.join(offsets.drop("_n"), (kept["_part"] == offsets["_part"]) & F.col(key).eqNullSafe(F.col("_key")))
    place = (F.col("_at") - F.col("_first") + F.col("_offset") + 1).cast("int")
    return joined.select(*rows.columns, place.alias(name))
