"""Session set-up and the few settings the operators read from it."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Rows one task may hold for a single group before the group is split into blocks.
GROUP_ROWS = "spark.lapsewise.groupRows"

_DEFAULTS = {GROUP_ROWS: "4000000"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lapsewise") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def require_utc(spark: SparkSession) -> None:
    """Calendar days are taken in the session's time zone; another zone would shift every label."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC; it is {zone}")


def setting(spark: SparkSession, key: str) -> float:
    return float(spark.conf.get(key, _DEFAULTS[key]))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which every executor must reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.path.join(tempfile.gettempdir(), "lapsewise-checkpoints")
    return folder.rstrip("/")


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage: later steps see exactly the rows (and partition numbers) this step saw, also
    after executors were lost. Unlike a row checkpoint the table keeps column pruning, filter
    pushdown and true size statistics. What the step shuffled is deleted once the table is written. Options go
    to the Parquet writer.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4()}"
    with shuffles_deleted(df.sparkSession):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    for paths in _scratches:
        paths.append(path)
    return table


def written(df: DataFrame) -> DataFrame:
    """The table itself if `materialise` made it, else a written copy."""
    return df if getattr(df, "_written_at", None) else materialise(df)


def part_of(table: DataFrame, part: DataFrame) -> DataFrame:
    """`part`, some columns or filtered rows of `table`, counts as written where `table` does: reading it again costs no step."""
    if place := getattr(table, "_written_at", None):
        part._written_at = place
    return part


_cleaning: dict[str, tuple[int, str | None]] = {}  # writes under way and the setting before them, by session
_lock = Lock()


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Delete shuffle files when the action that wrote them ends, and not only when the driver collects its garbage.

    Plans that run again write them anew. Writes of several threads may overlap.
    """
    key = str(spark._jsparkSession.sessionUUID())
    with _lock:
        count, before = _cleaning.get(key, (0, spark.conf.get(_CLEANUP, None)))
        _cleaning[key] = (count + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _cleaning.pop(key)
            if count > 1:
                _cleaning[key] = (count - 1, before)
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def replace_folder(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a complete folder in the place of another one by renaming."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"cannot move {fresh} to {path}")


_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Delete the intermediate tables written inside the block when it ends; results must be stored before."""
    paths: list[str] = []
    _scratches.append(paths)
    try:
        yield
    finally:
        _scratches.remove(paths)
        for path in paths:
            delete_folder(spark, path)
