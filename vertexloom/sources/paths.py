"""Files of any file system, read in ranges by Python workers and written by tasks or through Hadoop's streams."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Hadoop's names of schemes for which the Arrow library has another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def is_local(path: str) -> bool:
    """Whether ``path`` is a file of the machine's (or a mounted, shared) file system."""
    return path.startswith("file:") or "://" not in path


def local_path(path: str) -> str:
    """The plain path of a local one, as Hadoop reads it (nothing is unescaped)."""
    if not path.startswith("file:"):
        return path
    return "/" + path[len("file:") :].lstrip("/")


def arrow_file(path: str):
    """An open file that seeks and reads ranges, wherever it lies; OSError if no Arrow file system knows the scheme."""
    import pyarrow.fs as fs

    if is_local(path):
        return fs.LocalFileSystem().open_input_file(local_path(path))
    scheme, rest = path.split("://", 1)
    try:
        system, name = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except Exception as e:
        raise OSError(f"{path}: no file system for {scheme}://") from e
    return system.open_input_file(name)


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path objects, on the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def make_parent(spark: SparkSession, path: str) -> None:
    system, p = hadoop(spark, path)
    system.mkdirs(p.getParent())
