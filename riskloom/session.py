"""Session set-up that queries share."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch, where the session has Spark's own defaults.
#: Whole texts are wide rows: Spark's 10000 a batch would be tens of MB on both sides.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once a session.

    Spark's own file server hands it out, so that executors need neither the
    repository nor a shared folder for it.  Sets the session's sizes of Arrow
    batches, unless the caller has set others.
    """
    for name, (default, ours) in ARROW.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    sc = spark.sparkContext
    if getattr(sc, "_riskloom_shipped", None):
        return spark
    here = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="riskloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path("riskloom") / f.relative_to(here))
    sc.addPyFile(path)
    sc._riskloom_shipped = path
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    return spark
