"""Tables written to the shared folder, so that a plan read several times is computed once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a local session writes that names no shared folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/agora"
_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a folder of this machine, if the session runs on no other."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


def written(df: DataFrame) -> DataFrame:
    """The same table, read from Parquet files in the shared folder: readers fetch only the columns they need, and lost
    executors lose nothing of it. The files go when the Python process ends, since lazy results may read them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/agora-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner removes what is left
            return


atexit.register(_clean)
