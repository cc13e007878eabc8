"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern [^\x20\x09-\x0D]+, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a local master has none (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pairwell-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    Cuts the lineage with files that outlive any executor, and gives the planner the table's true size, so
    that a later join broadcasts it only if it is below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairwell/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where the optimizer moves the whole into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A staged table, with a broadcast hint if it is at most so many (short) rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df
