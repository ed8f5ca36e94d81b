"""Tables written once to the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast.
BROADCAST = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where both are unset, a temporary one, but only if
    everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is derived from it doesn't compute it again, and a lost
    executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/loomline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, size: Column) -> DataFrame:
    """``df`` (a written table), to be broadcast where its bytes allow. ``size``: the bytes of a row."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST else df


def bytes_of(tokens: Column) -> Column:
    """About the bytes that an array of tokens takes."""
    return F.aggregate(tokens, F.lit(32), lambda a, t: a + F.octet_length(t["slice"]) + 32)


def release(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stored``."""
    spark = df.sparkSession
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomline-" in top:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
