"""Session settings the operators rely on, and lineage cutting."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Let measured sizes, not estimates, decide about broadcasts.

    Exploded grids are thousands of times larger than the header rows they come
    from, so the optimizer's static estimate is far too low. Static broadcasts
    are switched off; the adaptive ones, which look at real shuffle sizes, stay.
    """
    conf = spark.conf
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 << 20))
    conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that are read at once of a table whose rows are arrays: a reader's batch, of up to 4,096 rows, ends with the row group.
ARRAYS_AT_ONCE = {"parquet.block.row.count.limit": 16}


def cut_lineage(df: DataFrame, arrays: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short plan, exact
    sizes for the next join, and nothing to recompute when an executor is lost.

    ``arrays``: rows are blocks of voxels, so few of them are read at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voxelspark-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**(ARRAYS_AT_ONCE if arrays else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grid_partitions(spark: SparkSession) -> int:
    """Partitions for exploding header rows into grids."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)
