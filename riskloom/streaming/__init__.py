"""Optional: scores that follow a folder of coverage rows.

Duplicates and ranks are global, so every batch scores anew over all rows seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..operators.scoring import score


def follow_coverage(spark: SparkSession, folder: str, functions: DataFrame, idioms: DataFrame, sink: Callable[[DataFrame, int], None], project: str = ""):
    """A stream writer over Parquet coverage rows in *folder*; *sink* gets the
    records of every batch.  Start it with a checkpoint location of your own."""

    def each(_: DataFrame, batch: int) -> None:
        sink(score(functions, spark.read.schema(S.COVERAGE).parquet(folder), idioms, project), batch)

    return spark.readStream.schema(S.COVERAGE).parquet(folder).writeStream.foreachBatch(each)
