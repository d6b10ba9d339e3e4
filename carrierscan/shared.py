"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; where that is unset, below a temporary folder for a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/carrierscan-shared"
    return f"{base.rstrip('/')}/carrierscan/{name}-{uuid.uuid4().hex}"


_made: list[tuple] = []


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table when the driver's Python ends: until then a result may read it."""
    _made.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))


@atexit.register
def _forget() -> None:
    for jvm, conf, path in _made:
        with contextlib.suppress(Exception):  # the JVM may be gone
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage is cut, and executors may be lost. It goes when the driver's Python ends."""
    path = shared_dir(df.sparkSession, name)
    forget_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
