"""Intermediate tables in the folder that all executors share; they cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def safe_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of equally partitioned inputs for partitioned itself, and then skips the exchange that a
    window behind it needs; with partitions coalesced at run time the rows no longer line up and row numbers repeat."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only where it is unset (tests), a temporary folder of one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lexspan-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Tables that lazy results may still read, by the session that wrote them.
_MADE: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialized(df: DataFrame) -> DataFrame:
    """A written table; `sweep` deletes it, at the latest when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def sweep() -> None:
    """Delete all tables that `materialized` wrote; results that read them can no longer be computed."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # a session that has ended takes its connection with it
            delete(spark, path)
