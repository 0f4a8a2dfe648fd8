"""Session-level helpers: table loading, lineage cuts, action-free size facts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where it is unset and the
    session runs on one machine, as in tests, a local folder is used and
    remembered; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidelog.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.tidelog.shared.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a Parquet table in the shared folder.

    The written table survives the loss of executors and keeps the plan of an
    iterative operator at constant size; unlike ``checkpoint()`` it also stores
    the columns compressed and lets later reads prune them.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` (no-op on failure)."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def drop_cuts() -> None:
    """Delete all tables that :func:`cut` left behind in this process: call it
    when the results that read them are written. Also runs at exit."""
    while _made:
        spark, path = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; local folders go with it
            if path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def micros(col) -> "F.Column":
    """Epoch microseconds of a timestamp, whatever the session's time zone."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def ship(spark: SparkSession) -> None:
    """Make sure that Python workers can import this package.

    Where the environment or the working folder already gives it to them there
    is nothing to do; else the package goes to the executors as a zip file, once
    a session.
    """
    root = Path(__file__).resolve().parent.parent
    given = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in given or Path.cwd() == root or spark.conf.get("spark.tidelog.shipped", None):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidelog-"), "tidelog"), "zip", root, "tidelog")
    spark.sparkContext.addPyFile(made)
    spark.conf.set("spark.tidelog.shipped", "true")


atexit.register(drop_cuts)
