"""Session helpers: builder defaults, table reading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "engram", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine is tested with; an existing session is returned as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one is set only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = configured
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # tests and notebooks on one machine
        local = tempfile.mkdtemp(prefix="engram-ckpt-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise once, as a table in the shared folder, and go on from there: lineage is cut and a lost executor loses
    nothing. (Dataset.checkpoint would compute the plan a second time.)"""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """``persist`` that never takes up what another call has kept: Spark finds kept data by plan, and a plan over a path is
    the same after the files there have changed. Lost blocks are computed again from lineage."""
    return df.where(F.lit(uuid.uuid4().hex).isNotNull()).persist()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, so that they need not have it installed."""
    context = spark.sparkContext
    name = f"engram-{context.applicationId}.zip"
    if any(name in f for f in context._python_includes):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="engram-ship-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("engram", os.path.relpath(full, root)))
    context.addPyFile(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def local_path(spark: SparkSession, name: str) -> str:
    """A scratch folder of the shared folder as a plain path, for stores, whose log is kept with the driver's file calls."""
    path = scratch_path(spark, name)
    return path[len("file:") :].replace("//", "/", 1) if path.startswith("file:") else path
