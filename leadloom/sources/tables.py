"""Access to the Parquet tables and to the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scanned table over all cores, where its files come in fewer splits than half of them: for steps that compute much a row.

    The rows are dealt out by the hash of unique keys. A larger table has splits enough and is left as it is. Only for
    scans and what is selected from them: the splits of a plan with exchanges aren't known before it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > cores else df.repartition(cores, *keys)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getConf().get("spark.checkpoint.dir", "")
    if not folder:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif re.match(r"local(\[|$)", sc.master):
            folder = tempfile.mkdtemp(prefix="leadloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone
        pass


#: Folders of the scratch tables that haven't been dropped.
_HELD: dict[str, SparkSession] = {}


@atexit.register
def release() -> None:
    """Drop the scratch tables written so far, for long sessions, once the results that read them have been written; the rest goes at exit."""
    while _HELD:
        path, spark = _HELD.popitem()
        _drop(spark, path)


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder; `release` drops it."""
    path = f"{scratch_dir(spark).rstrip('/')}/leadloom-{uuid.uuid4().hex}"
    _HELD[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: its plan is computed once, and a lost executor loses nothing.

    The rows and the schema stay as they are; an empty frame stays empty.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
