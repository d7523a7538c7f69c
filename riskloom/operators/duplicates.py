"""Duplicate detection over all functions, and demerits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..storage import keep


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Values of *key* that two rows or more have; null and empty ones don't count.

    A count with partial sums: a key that a third of all rows share costs one
    row a task, where a window would bring all its rows to one.
    """
    return rows.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("_n")).filter("_n >= 2").select(key)


def flag_repeated(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """All rows, with a boolean column *flag*: whether *key* is repeated."""
    # Written first: the join then deals both sides anew, and adaptive execution can split a key that very many rows share.
    repeated = keep(repeated_keys(rows, key).select(F.col(key).alias("_repeated")), "repeated")
    return rows.join(repeated, F.col(key) == F.col("_repeated"), "left").withColumn(flag, F.col("_repeated").isNotNull()).drop("_repeated")


def check_duplicates(idioms: DataFrame) -> DataFrame:
    """Sets both duplicate flags of all rows and adds three demerits for each."""
    out = flag_repeated(idioms.drop("sig_duplicate", "body_duplicate"), "sig_fingerprint", "sig_duplicate")
    out = flag_repeated(out, "body_fingerprint", "body_duplicate")
    more = S.DUPLICATE_WEIGHT * (F.col("sig_duplicate").cast("bigint") + F.col("body_duplicate").cast("bigint"))
    return out.withColumn("demerits", F.col("demerits") + more)
