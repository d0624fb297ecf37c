"""Intermediate tables that survive lost executors.

``cut`` writes a DataFrame as Parquet into the folder the cluster shares
(``spark.checkpoint.dir``) and reads it back: the lineage ends there, no block
lives on a single executor, and AQE sees exact sizes of what follows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` where it is set, else one made for this session.

    Only a local session without that setting (tests) gets a temporary folder; on a cluster, whose machines would not share it, that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.getCheckpointDir():
        if not is_local(sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, ours: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs run inside; the session's own afterwards."""
    was = {name: spark.conf.get(name) for name in ours}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one path of the shared folder (used for tables that are no longer needed)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by ``cut``."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])
