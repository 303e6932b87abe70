"""Sessions and what executors need."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; a local master's workers only need it where their path hasn't got it."""
    app = spark.sparkContext.applicationId
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _SHIPPED or _is_local(spark) and _ROOT in paths:
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tessera"), "zip", _ROOT, "tessera")
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves a ``local`` master (tests);
    on a cluster that is an error, since executors would not see the driver's folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses; ``cleanup`` removes what is written there."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there, and no executor's loss repeats the work."""
    return stored_at(df, fresh_path(df.sparkSession, label))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """As ``stored``, to a given path."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path that ``fresh_path`` gave, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    made = _MADE.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)


def cleanup(spark: SparkSession) -> int:
    """Removes all that this application has kept in the shared folder so far, and says how many tables that were.

    Frames that this library returned before read from there: write or collect them first.
    """
    made = [*_MADE.get(spark.sparkContext.applicationId, [])]
    for path in made:
        remove(spark, path)
    return len(made)
