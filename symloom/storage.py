"""The shared folder of a cluster, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (a local master, as in tests), a
    local folder is made and set; on a cluster that is an error.
    """
    name = "spark.checkpoint.dir"
    found = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir() and not context.master.startswith("local"):
            raise ValueError(f"set {name} to a folder that driver and executors share")
        found = context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(found)
        spark.conf.set(name, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a Parquet table into the shared folder and read it again.

    Cuts the lineage in a way that survives the loss of executors, and makes what is not
    repeatable (partition numbers, answers from outside) a fact.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        df.write.parquet(path)
    for made in _watched:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_PASSING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run within takes its shuffle files away at its end: for writes, which nothing reads again
    by way of their plan. Else they stay until the driver's memory is swept, those of all steps of a
    query together. Set for the time of the write only, as a frame that is run twice would build its
    shuffles anew."""
    before = spark.conf.get(_PASSING, None)
    spark.conf.set(_PASSING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PASSING)
        else:
            spark.conf.set(_PASSING, before)


#: The largest table that joins send to all tasks by themselves.
MOST_SENT = "1m"


def _bytes(size: str) -> int:
    """Bytes of a size as Spark's settings have it: ``10485760``, ``10MB``, ``256k``."""
    number, unit = re.fullmatch(r"(-?[0-9]+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


def broadcast_by_measure(spark: SparkSession) -> None:
    """Let the session broadcast a table by what a stage measured of it, not by the size of its files.

    Sorted keys shrink in Parquet to a hundredth and less: a file of 1 MB can be a table of 160 MB,
    which Spark would send through the driver as a small one. Adaptive execution knows the bytes of
    rows; it takes over the session's threshold, where that is no more than ``MOST_SENT``: each table that
    is sent stands on the driver several times over until its query ends, and a query has dozens of joins
    whose smaller side grows with the files. A broadcast that a query asks for stays one.
    """
    files, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(files)
    if before != "-1" and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, str(min(_bytes(before), _bytes(MOST_SENT))))
        spark.conf.set(files, "-1")


_watched: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes within go at the end: for work whose result is written
    elsewhere by then. After an error they stay."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched.remove(made)
    for path in made:
        remove(spark, path)


def whole_folders(spark: SparkSession, folder: str) -> list[str]:
    """Sub-folders that a finished write has marked; none if the folder is not there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    marks = system.globStatus(context._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS"))
    return sorted(m.getPath().getParent().toString() for m in marks or [])


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a written table; only where nothing that is still to run reads it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
