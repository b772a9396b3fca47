"""Parquet tables: the driver's inputs, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; a cluster is
    refused, because its executors would write where nobody else reads.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="plumbago-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        folder = "file://" + _local[0]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is there when the program ends is removed."""
    path = f"{shared_folder(spark)}/plumbago-{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, hadoop = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, hadoop = _file_system(spark, path)
        fs.delete(hadoop, True)
    except Exception:  # the session has ended; the folder belongs to it
        pass


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename within one file system; fails if the target is there."""
    fs, hadoop = _file_system(spark, path)
    if not fs.rename(hadoop, _file_system(spark, to)[1]):
        raise OSError(f"cannot rename {path} to {to}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, such as a manifest, whole; None if it is not there."""
    fs, hadoop = _file_system(spark, path)
    if not fs.exists(hadoop):
        return None
    stream = fs.open(hadoop)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there at all under its name."""
    temporary = f"{path}.{uuid.uuid4().hex[:8]}"
    fs, hadoop = _file_system(spark, temporary)
    stream = fs.create(hadoop, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    move(spark, temporary, path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    path = getattr(df, "_plumbago_path", None)
    if path:
        remove(df.sparkSession, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and it outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._plumbago_path = path
    return back
