"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs inside one JVM.
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: Where the tables of ``cut`` are.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application inside the one named in ``spark.checkpoint.dir``.

    A session without that setting gets ``LOCAL_FOLDER`` when its master is
    ``local`` or ``local[...]``; on a cluster the setting is required.
    """
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or LOCAL_FOLDER
    return f"{folder.rstrip('/')}/placelens/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Later jobs start from the written rows, so losing an executor never
    repeats what came before.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over as many tasks as a shuffle has, for joins that make many rows of each one.

    Spark would leave a small table in the one task that reads it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables of ``cut`` that nothing will read again; other tables are left alone."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written with ``cut``; results not yet stored elsewhere are lost."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
