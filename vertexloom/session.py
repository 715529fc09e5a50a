"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vertexloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only where nothing is set and the master is local is a temporary folder made; on a cluster
    an unset folder is an error, since a machine-local one would be lost with its machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vertexloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder and forget the lineage; partitions and their order stay as they are.

    Only for what needs that order; tables and the states of loops are ``stored``.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, measures: Observation | None = None, **metrics: Column) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage.

    The table is columnar, compressed and pruned on reading, and its plan is a plain scan. ``metrics``
    are aggregates of the written rows, taken in ``measures`` by the same job. The table is there until
    ``discard`` or the end of the application.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    if not getattr(spark.sparkContext, "_vertexloom_cleanup", False):
        atexit.register(_clean, spark)
        spark.sparkContext._vertexloom_cleanup = True
    (df.observe(measures, *[c.alias(k) for k, c in metrics.items()]) if measures is not None else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames made by ``stored`` (others are left alone)."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            remove(df.sparkSession, path)
            _WRITTEN.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)


def fixed_plans(spark: SparkSession, size: int) -> SparkSession:
    """A session of the same application for loops whose plans need no choosing: without adaptive planning, and
    with exchanges in as many partitions as ``size`` bytes of state are worth."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    wanted = int(own.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, min(wanted, -(-size // PARTITION_BYTES)))))
    return own


def carried(df: DataFrame, session: SparkSession) -> tuple[DataFrame, DataFrame | None]:
    """``df`` as a written table read in ``session``, and what to discard afterwards (None if it was a table before)."""
    table = df if hasattr(df, "_stored_at") else stored(df)
    out = session.read.schema(table.schema).parquet(table._stored_at)
    return out, None if table is df else table


#: Bytes of a partition of a small state.
PARTITION_BYTES = 4_000_000
#: Tables written by ``stored`` that are still there, by application.
_WRITTEN: dict[str, set[str]] = {}


def _clean(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None:  # stopped: local tables only
        for path in (p for paths in _WRITTEN.values() for p in paths if p.startswith("file:")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    for path in _WRITTEN.get(spark.sparkContext.applicationId, ()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the folder is the cluster's to clean, too
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it; once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_vertexloom_shipped", False):
        return
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="vertexloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/vertexloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(path)
    sc._vertexloom_shipped = True
