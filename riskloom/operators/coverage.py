"""Coverage: from exported regions to a percentage of lines for each function."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..errors import BAD_JSON
from ..functions.scores import saturate, under
from ..session import ship
from ..sources.export import CUT, functions


def _missing(kind: str) -> Column:
    return F.raise_error(F.lit(f"{BAD_JSON}: a field is missing")).cast(kind)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An exported coverage document: filenames and regions, a row a function.
    A document that cannot be decoded, or lacks a field, is an error.

    Documents are cut into functions as they are read and never held whole;
    Spark decodes a function at a time."""
    ship(spark)

    def run(pieces):
        pieces = (text for _, text in pieces)
        first = next(pieces, None)
        if first is not None:
            try:
                yield from functions(itertools.chain([first], pieces))
            except ValueError as e:
                raise RuntimeError(f"{BAD_JSON}: {e}") from None

    conf = {
        "mapreduce.input.fileinputformat.inputdir": path.replace("\\", "\\\\").replace(",", "\\,"),
        "mapreduce.input.fileinputformat.split.minsize": str(2**62),  # a document is read from its start to its end, by one task
        "textinputformat.record.delimiter": CUT,
    }
    pieces = spark.sparkContext.newAPIHadoopRDD("org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=conf)
    rows = spark.createDataFrame(pieces.mapPartitions(run), "d bigint, f bigint, text string", verifySchema=False)
    rows = rows.select("d", "f", F.from_json("text", S.COVERED_FUNCTION, {"mode": "FAILFAST"}).alias("fn"))
    missing = F.col("fn.filenames").isNull() | F.col("fn.regions").isNull()
    return rows.select(
        F.struct("d", "f").alias("fn_id"),
        F.when(missing, _missing("array<string>")).otherwise(F.col("fn.filenames")).alias("filenames"),
        F.col("fn.regions").alias("regions"),
    )


def region_span(regions: Column) -> Column:
    """(start, end) over regions of every kind with three numbers or more; null
    without one, or where the start is the largest 32-bit number."""
    long = F.filter(regions, lambda r: F.size(r) >= 3)
    start = F.array_min(F.transform(long, lambda r: saturate(F.get(r, 0))))
    end = F.array_max(F.transform(long, lambda r: saturate(F.get(r, 2))))
    return F.when(start < S.U32_MAX, F.struct(start.alias("start_line"), end.alias("end_line")))


def code_regions(regions: Column) -> Column:
    """Regions that count lines: five numbers or more, and kind 0 where there is one."""
    return F.filter(regions, lambda r: (F.size(r) >= 5) & ((F.size(r) <= 7) | (F.get(r, 7) == 0)))


def line_ranges(rows: DataFrame, keep: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """The columns *keep* and each line of a region; regions that end before they start have none."""
    return rows.filter(F.col(start) <= F.col(end)).select(*keep, F.explode(F.sequence(start, end)).alias("line"))


def line_hits(rows: DataFrame, key: list[str], start: str = "start_line", end: str = "end_line", hits: str = "hits") -> DataFrame:
    """key, line, hits: each line has the largest count of the regions that cover it."""
    return line_ranges(rows, [*key, hits], start, end).groupBy(*key, "line").agg(F.max(hits).alias("hits"))


def line_coverage(rows: DataFrame, key: list[str], start: str = "start_line", end: str = "end_line", hits: str = "hits") -> DataFrame:
    """key, line_coverage_pct from code regions (key, start, end, hits), for
    regions that come as rows.  A group without a line has no row here: what it
    is compared with counts it as fully covered."""
    hit = F.sum(F.when(F.col("hits") > 0, 1.0).otherwise(0.0))
    return line_hits(rows, key, start, end, hits).groupBy(*key).agg((hit / F.count("*") * 100.0).alias("line_coverage_pct"))


def line_coverage_in_row(regions: Column) -> Column:
    """The same within one row, without a shuffle: regions of one function are
    one array.  Lines are never listed: a line is covered exactly if a region
    with a hit covers it, so the lengths of two unions of ranges say it all,
    whatever line a region claims to end at."""
    code = F.filter(F.transform(code_regions(regions), lambda r: F.struct(saturate(F.get(r, 0)).alias("s"), saturate(F.get(r, 2)).alias("e"), (F.get(r, 4) > 0).alias("hit"))), lambda r: r["s"] <= r["e"])

    def lines(rs):
        none = F.struct(F.lit(-1).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))

        def step(acc, r):
            more = F.greatest(r["e"] - F.greatest(r["s"], acc["last"] + 1) + 1, F.lit(0).cast("bigint"))
            return F.struct(F.greatest(acc["last"], r["e"]).alias("last"), (acc["n"] + more).alias("n"))

        return F.aggregate(F.array_sort(rs), none, step, lambda acc: acc["n"])

    total, covered = lines(code), lines(F.filter(code, lambda r: r["hit"]))
    return F.when(total > 0, covered.cast("double") / total * 100.0).otherwise(100.0)


def function_coverage(export: DataFrame, project: str) -> DataFrame:
    """file, start_line, end_line, line_coverage_pct of the functions whose
    first file lies in *project*; functions without regions or span are left out."""
    rows = export.filter((F.size("filenames") > 0) & (F.size("regions") > 0)).withColumn("file", F.get("filenames", 0))
    rows = rows.filter(under(F.col("file"), project)).withColumn("span", region_span(F.col("regions"))).filter("span is not null")
    return rows.select("file", "span.start_line", "span.end_line", line_coverage_in_row(F.col("regions")).alias("line_coverage_pct"))


def merge_spans(coverage: DataFrame) -> DataFrame:
    """One row for a (file, start, end): generic instantiations count once, with
    the best of their percentages."""
    return coverage.groupBy("file", "start_line", "end_line").agg(F.max("line_coverage_pct").alias("line_coverage_pct"))
