"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session
    on one machine gets a temporary folder, which is then set as the checkpoint
    folder of the session; on a cluster, whose machines share no such folder,
    that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="framequarry-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back, which cuts
    its lineage: a lost executor costs no more than the stage that is running.
    The table stays until `cleared`, as results are read from it later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Delete the tables that this process has stored, once all results that
    read them are written; the number of them."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
