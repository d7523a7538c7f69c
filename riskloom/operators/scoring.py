"""Risk scores: functions with their best coverage and idioms, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as X
from ..storage import keep
from .coverage import merge_spans

#: Lines in a cell of the interval join.
CELL = 64


def best_overlap(functions: DataFrame, coverage: DataFrame, cell: int = CELL) -> DataFrame:
    """*functions* with coverage_pct: of the coverage rows of the file that
    share a line, the one that shares most, the last by (start, end) of equals;
    0 where none does.

    Intervals meet in cells of *cell* lines, so a file with very many functions
    compares neighbours only, and an equi-join on (file, cell) can be dealt out
    and split.  A pair that meets in several cells changes no maximum.  Coverage
    rows take cells only as far as functions of their file reach, whatever line
    they claim to end at.
    """
    left = functions.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_line") / cell), F.floor(F.greatest("start_line", "end_line") / cell))))
    reach = functions.groupBy(F.col("file").alias("_of")).agg(F.min("start_line").alias("_low"), F.max(F.greatest("start_line", "end_line")).alias("_high"))
    reach = keep(reach, "reach")
    right = coverage.join(reach, (F.col("file") == F.col("_of")) & F.col("start_line").between(0, F.col("_high")) & (F.col("end_line") >= F.greatest("start_line", "_low")))
    first, last = F.floor(F.greatest("start_line", "_low") / cell), F.floor(F.least("end_line", "_high") / cell)
    right = right.select(F.col("file").alias("_file"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), F.col("line_coverage_pct").alias("_pct"), F.explode(F.sequence(first, last)).alias("_at"))
    meets = (F.col("file") == F.col("_file")) & (F.col("_cell") == F.col("_at")) & (F.col("start_line") <= F.col("_e")) & (F.col("_s") <= F.col("end_line"))
    shared = X.overlap(F.col("start_line"), F.col("end_line"), F.col("_s"), F.col("_e"))
    best = left.join(right, meets).groupBy("ord").agg(F.max(F.struct(shared.alias("n"), F.col("_s"), F.col("_e"), F.col("_pct"))).alias("_best"))
    best = keep(best, "overlaps")
    out = functions.join(best.withColumnRenamed("ord", "_ord"), F.col("ord") == F.col("_ord"), "left")
    return out.withColumn("coverage_pct", F.coalesce(F.col("_best._pct"), F.lit(0.0))).drop("_best", "_ord")


def consume_once(left: DataFrame, right: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Left join in which the last row of *right* with a key is taken by the
    first row of *left* with it, and later ones get nothing.  *order* is unique
    within a key of *left*."""
    cols = [c for c in right.columns if c not in (*key, order)]
    # First and last rows by minimum and maximum, with partial sums: one row a key, however many share it.
    first = left.groupBy(*key).agg(F.min(order).alias("_turn"))
    last = right.groupBy(*key).agg(F.max(F.struct(F.col(order), *cols)).alias("_last"))
    taken = keep(first.join(last, key).select(*[F.col(c).alias(f"_{c}") for c in key], "_turn", "_last"), "taken")
    same = F.col(order) == F.col("_turn")
    for c in key:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return left.join(taken, same, "left").select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in cols])


def score(functions: DataFrame, coverage: DataFrame, idioms: DataFrame, project: str = "", strict_identity: bool = False) -> DataFrame:
    """Risk records, with ``ord`` for a stable order.

    ``strict_identity`` joins idioms on the function's place rather than on its
    name, where *idioms* has start_line: then functions of one name keep their own.
    """
    rows = best_overlap(functions, merge_spans(coverage))
    key = ["file", "qualified_name"] + (["start_line"] if strict_identity else [])
    rows = consume_once(rows, idioms.select(*key, "demerits", "checks", "sig_duplicate", "body_duplicate", "ord"), key)
    penalty = X.idiom_penalty(F.coalesce("demerits", F.lit(0)))
    rows = rows.withColumn("crap_score", X.crap(F.col("complexity"), F.col("coverage_pct"))).withColumn("idiom_penalty", penalty)
    path = F.col("file") if not project else F.when(F.col("file").startswith(project.rstrip("/") + "/"), F.expr(f"substring(file, {len(project.rstrip('/')) + 2})")).otherwise(F.col("file"))
    return rows.select(
        path.alias("file"), F.col("qualified_name").alias("name"), "complexity", "coverage_pct", "crap_score", "idiom_penalty",
        (F.col("crap_score") * F.col("idiom_penalty")).alias("risk_score"), "start_line",
        F.coalesce("checks", F.array().cast("array<string>")).alias("checks"),
        F.coalesce("sig_duplicate", F.lit(False)).alias("sig_duplicate"), F.coalesce("body_duplicate", F.lit(False)).alias("body_duplicate"), "ord",
    )


def rank(records: DataFrame) -> DataFrame:
    """Highest risk first; of equals, the earlier in the source."""
    return records.orderBy(F.desc("risk_score"), "ord")
