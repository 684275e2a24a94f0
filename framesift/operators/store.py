"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="framesift-"))


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders written inside each open `scratch` block, innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables that operators write inside the block are deleted at its end. Write or collect what is wanted of their results before.

        with scratch(spark):
            select_frames(...)[0].write.parquet(target)

    Blocks may be nested. One thread at a time may have open blocks. Without a block the tables stay until their folder is cleared.
    """
    mine: list[str] = []
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        for folder in mine:
            delete_path(spark, folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which an open `scratch` block deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write and read again: cuts lineage, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and nothing refers to any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if shared_dir(spark).split(":", 1)[-1].lstrip("/") in folder:
                delete_path(spark, folder)
