"""Tables staged in the shared folder, to end lineage and to read a result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of staged tables that this process has made.
_STAGED: list[str] = []

#: Bytes of a table that is broadcast at most, by its rows and the bytes of a row; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset a local session gets a new one; on a cluster that is an error, since executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, which `clean` deletes like staged tables."""
    folder = f"{shared_folder(spark)}/sparkloom/{uuid.uuid4().hex}"
    _STAGED.append(folder)
    return folder


def stage(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this process has staged; results that still read them must have been written."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def sized(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """df, broadcast if its rows take BROADCAST_BYTES at most."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
