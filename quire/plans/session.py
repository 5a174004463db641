"""Session helpers: table access, lineage cuts, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast.
SMALL_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only ``columns`` of ``df``: operators start here, so that further columns of a caller's table never clash with the names they add."""
    return df.select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset and the session is local, a temporary folder. On a cluster it must be set: a folder of one machine is none that others can read."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


_folders: set[str] = set()


def _remove(spark: SparkSession, where: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        pass


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: like cut(), but compressed, and later reads take only the columns they need. Rows are what one successful attempt of each task gave. Tables are removed when Python ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/quire-tables-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    where = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, so that a join of it is planned by the sizes found."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
