"""Intermediate tables in the folder that all executors share.

They are ordinary Parquet files below ``spark.checkpoint.dir``, so a lost
executor costs a re-read and never a re-computation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when the query that wrote them has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder.  Only where the session names none and all of
    it runs on this machine, as in tests, a temporary folder is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or None
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write *df* once into the shared folder and return it as a fresh scan.

    Cuts the lineage; unlike a cache the result survives executor loss, and
    Catalyst still prunes columns and pushes filters into the re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # What the write has shuffled is deleted with its end, and not some time later with the driver's garbage.
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._riskloom_path = path
    return kept


def drop(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` made, once nothing reads them any more."""
    for df in kept:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._riskloom_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
