"""Session helpers shared by every part of the library.

``get_session`` builds the session used by tests, the benchmark and ad-hoc
runs. On a cluster the caller brings their own session; nothing here overrides
a setting that is already there.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidegauge", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution and dynamic overwrite."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEGAUGE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark only (the path may be any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of an application on one machine that names none, by application id.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a session on one machine may do without that setting (tests, a laptop): a
    temporary folder is made then, which goes when the process ends. On a cluster its
    absence is an error, since no one else could read what an executor wrote there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            folder = tempfile.mkdtemp(prefix="spark-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own_folders[app] = "file://" + folder
        found = _own_folders[app]
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system and path of a folder, as Spark itself reaches it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: What is written within each ``scratch`` block that is open, innermost last.
_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what ``materialise`` wrote within it.

    A result that reads such frames must be written or collected inside the block.
    """
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that outlives a lost executor. What is written goes
    with ``release``, at the end of a ``scratch`` block, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _folder(spark, path)
    files.deleteOnExit(place)
    if _scratches:
        _scratches[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def release(df: DataFrame) -> None:
    """Removes what ``materialise`` wrote; frames that still read it fail from here on."""
    files, place = _folder(df.sparkSession, df._written_at)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in any store that Spark reaches."""
    files, place = _folder(spark, path)
    return files.exists(place)


def children(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names in a folder that begin with ``prefix``; none where there is no such folder."""
    files, place = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().startswith(prefix)] if files.exists(place) else []


def modified_at(spark: SparkSession, path: str) -> float:
    """When a file was last changed, in seconds since 1970."""
    files, place = _folder(spark, path)
    return files.getFileStatus(place).getModificationTime() / 1000


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder and all in it."""
    files, place = _folder(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder removed when the application ends."""
    files, place = _folder(spark, path)
    files.deleteOnExit(place)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
