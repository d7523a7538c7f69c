"""Helpers that every operator of this folder uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, keep

#: One word, by the contract's own definition: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class Kept:
    """Tables that one operator writes into the shared folder on its way.  What
    has been read for the last time is deleted, and nothing but what the result
    reads is left in the end."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(keep(df, name))
        return self.made[-1]

    def done(self, *tables: DataFrame) -> None:
        """Deletes these tables."""
        drop(*tables)
        self.made = [t for t in self.made if all(t is not x for x in tables)]

    def leave(self, *tables: DataFrame) -> None:
        """Deletes all but these."""
        self.done(*[t for t in self.made if all(t is not x for x in tables)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(wanted: str, taken) -> str:
    """*wanted*, with underscores added until no column in *taken* has it
    (Spark compares names without regard to case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def whole_text(text: str = "text"):
    """The text column, null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
