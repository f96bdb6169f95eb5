"""Where intermediate results go: the shared folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Base folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder is made and kept for the session.
    """
    folder = spark.conf.get(_FOLDER_KEY, None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError(f"set {_FOLDER_KEY} to a folder all executors can reach")
    # the engine itself adds a session folder below the one it is given
    folder = sc.getCheckpointDir()
    if folder is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="noticegrade-"))
        folder = sc.getCheckpointDir()
    return folder


_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def discard(spark: SparkSession) -> int:
    """Delete the intermediates that this process made; call it when their results are stored.

    Returns the number of folders that were there.
    """
    hadoop, jvm, gone = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(hadoop).delete(path, True)
    return gone


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back.

    For a result that several branches read: they scan Parquet with column pruning
    instead of repeating the work, and a lost executor costs a re-read at most.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
