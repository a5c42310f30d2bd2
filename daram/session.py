"""Session helpers: table reading, package shipping and lineage cuts."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_kept: set[str] = set()
_stored: dict[str, list[str]] = {}
_made: list[str] = []
atexit.register(lambda: [shutil.rmtree(f.removeprefix("file://"), ignore_errors=True) for f in _made])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the directory, as parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Without one a local session (one machine, as in tests) gets a temporary folder; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    if not folder:
        if not set_dir.isEmpty():
            return set_dir.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="daram-")
        _made.append(folder)
    if set_dir.isEmpty():
        context.setCheckpointDir(folder)
    return folder if spark.conf.get("spark.checkpoint.dir", None) else context._jsc.sc().getCheckpointDir().get()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the application ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/daram-{context.applicationId}"
    if folder not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _kept.add(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Delete the tables that were stored so far; results that read them must be written before."""
    for folder in _stored.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A folder for one stored table or stream, which ``release`` deletes."""
    folder = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    _stored.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage with a parquet table in the shared folder: compressed and columnar, for what is read several times."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, whatever their path is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(PACKAGE):
            for f in sorted(files):
                if f.endswith(".py"):
                    whole = os.path.join(top, f)
                    z.write(whole, os.path.join("daram", os.path.relpath(whole, PACKAGE)))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{own_dir(spark)}/daram.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    _shipped.add(context.applicationId)
