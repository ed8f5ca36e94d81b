"""Numbers of sorted rows, without sorting all of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: the number of each row from 0 in the order of ``order`` (no ties).

    Rows are dealt to ranges, sorted and written there with partition and place; the partitions' counts, a row each,
    come to the driver. There is one exchange.
    """
    spark = df.sparkSession
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).cast("int")
    base, at = [], 0
    for r in sorted(placed.groupBy(part.alias("_p")).count().collect()):
        base.append((r[0], at))
        at += r[1]
    bases = F.broadcast(spark.createDataFrame(base, "_p int, _base long"))  # a row for each partition
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", part).join(bases, "_p").withColumn(name, place + F.col("_base")).drop("_p", "_at", "_base")
