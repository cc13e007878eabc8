"""Tables in the folder that driver and executors share, to cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on a local master, where it may be unset, a temporary folder of our own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pairwell-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cohorts/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that written gave and that nothing reads any more."""
    for t in tables:
        target, files = _path(t.sparkSession, t._written_to)
        files.delete(target, True)
