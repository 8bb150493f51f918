"""Helpers the operators share: tables on shared storage and checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long key that may be broadcast: 500,000 x 8 bytes.
BROADCAST_ROWS = 500_000
#: Column of a row's text hash; a name that tables do not have.
KEY = "__factloom_key"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: a lost executor costs its running tasks, not the stages
    before.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind materialised tables that nothing reads any more.

    A collection in the driver's JVM follows, for Spark deletes the shuffle
    files of finished queries only once their plans are collected.
    """
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            target = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    tables[0].sparkSession._jvm.System.gc()


def release() -> None:
    """Give memory that a Python worker holds but no longer uses back to the system.

    Workers live on between tasks, several to an executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``, a hash of the text, which with ``doc_id`` tells rows of one id apart."""
    return docs.withColumn(KEY, F.xxhash64("text"))


def with_short_key(docs: DataFrame) -> DataFrame:
    """As ``with_key``, but 0 for every ``doc_id`` that has one text only, which tables of positions hold in no space."""
    own = with_key(docs.select(F.col("doc_id").alias("several"), "text"))
    several = own.groupBy("several").agg(F.min(KEY).alias("low"), F.max(KEY).alias("high")).where("low < high").select("several")
    joined = sized_join(docs, materialise(several, "several-texts"), F.expr("doc_id = several"), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.when(F.col("several").isNull(), F.lit(0)).otherwise(F.xxhash64(docs["text"])).cast("long").alias(KEY))


def is_small(keys: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether at most ``limit`` rows are there; reads no more than it must."""
    return keys.limit(limit + 1).count() <= limit


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` when a count shows it is small, and shuffles otherwise.

    ``right`` should be a materialised table, for it is counted first.
    """
    return left.join(F.broadcast(right) if is_small(right, limit) else right, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
