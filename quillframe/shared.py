"""Storage that every executor and the driver see, and shipping of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may do without: it gets a folder of its own, removed at
    exit. On a cluster a folder of one machine would lose rows silently, so an
    unset one is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset, and {master} has more than one machine: name a folder that all of them see")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="quillframe-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return "file://" + _OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quillframe/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for release()
    return out


def materialize_counted(df: DataFrame, name: str, *measures) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates of the rows that are observed while they are written; no second job."""
    seen = Observation(name)
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures)
    return materialize(watched, name), seen.get


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path is None:
            continue
        jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
        parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
        parent.getFileSystem(sc._jsc.hadoopConfiguration()).delete(parent, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillframe-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quillframe_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("quillframe", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
