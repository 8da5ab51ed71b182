"""Materialised intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder set here (tests, one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="glyphmill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str = "part", release: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts lineage: later reads need no executor that took part in the write. release: let the driver collect its garbage, upon
    which Spark deletes the shuffle files of the jobs behind it; worth it after large shuffles.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if release:
        for _ in range(2):  # what the job leaves to listeners is let go a little later
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)
