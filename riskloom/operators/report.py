"""What is shown of the ranked records, as columns; the driver only prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scores as X
from .scoring import rank

TOOL = "riskloom"
#: What the score is called in a report, unless the caller says otherwise.
LABEL = "RISK"


def exclude(records: DataFrame, paths=(), names=()) -> DataFrame:
    """Without records whose shown path contains one of *paths* or whose name is
    one of *names*; after scoring, so a hidden function still makes a duplicate."""
    for p in paths:
        records = records.filter(~F.contains(F.col("file"), F.lit(p)))
    return records.filter(~F.col("name").isin(*names)) if names else records


def displayed(records: DataFrame, threshold: float | None = None, top: int | None = None) -> DataFrame:
    """The records a report shows, ranked: the first *top* before clean ones are
    left out, or without *top* those that reach the threshold."""
    t = S.DEFAULT_THRESHOLD if threshold is None else threshold
    rows = rank(records)
    rows = rows.limit(top) if top is not None else rows.filter(F.col("risk_score") >= t)
    return rows.filter(~X.is_clean())


def diagnostics(records: DataFrame, threshold: float | None = None, bold=lambda kind, c: c, label: str = LABEL) -> DataFrame:
    """Adds report_line: the block of lines that tells of a record.  *bold*
    wraps a column for a terminal (kind: warning, note, blue or white)."""
    t = S.DEFAULT_THRESHOLD if threshold is None else threshold
    c, lit, concat = F.col, F.lit, F.concat
    note, help_ = bold("white", lit("note:")), bold("white", lit("help:"))
    lead = concat(lit("  "), bold("blue", lit("=")), lit(" "))
    level = F.when(c("risk_score") >= t, bold("warning", lit("warning"))).otherwise(bold("note", lit("note")))
    code = X.lint_code(c("coverage_pct"), c("complexity"), c("idiom_penalty"))
    pct = X.fixed(c("coverage_pct"), 0)
    suggestions = X.rule_map(2)
    head = F.array(
        concat(level, lit("["), bold("white", code), lit("]: `"), bold("white", c("name")), lit("` has high change-risk score")),
        concat(lit(" "), bold("blue", lit("-->")), lit(" "), c("file"), lit(":"), c("start_line").cast("string")),
        concat(lit("  "), bold("blue", lit("|"))),
        concat(lead, note, lit(f" {label} = "), X.fixed(c("risk_score"), 1), lit(", CRAP = "), X.fixed(c("crap_score"), 1), lit(", CC = "), c("complexity").cast("string"), lit(", Cov = "), pct, lit("%")),
        F.when(c("coverage_pct") < S.LOW_COVERAGE, concat(lead, help_, lit(" coverage is "), pct, lit("% — add tests to reduce risk"))),
        F.when(c("complexity") >= S.HIGH_COMPLEXITY, concat(lead, help_, lit(" cyclomatic complexity is "), c("complexity").cast("string"), lit(" — consider splitting into smaller functions"))),
        F.when(c("idiom_penalty") > 1.0, concat(lead, note, lit(" idiom penalty "), X.fixed(c("idiom_penalty"), 2), lit("x applied"))),
    )
    checks = F.transform("checks", lambda k: concat(lead, help_, lit(" "), F.coalesce(F.try_element_at(suggestions, k), k)))
    tail = F.array(
        F.when(c("sig_duplicate"), concat(lead, help_, lit(" signature duplicate — another function has the same (params)->return type"))),
        F.when(c("body_duplicate"), concat(lead, help_, lit(" body duplicate — another function has the same structure"))),
        lit(""),
    )
    lines = F.filter(F.concat(head, checks, tail), lambda x: x.isNotNull())
    return records.withColumn("report_line", F.array_join(lines, "\n"))


def summary(records: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: warnings, functions and the last line of a report, over all
    records, shown or not."""
    t = S.DEFAULT_THRESHOLD if threshold is None else threshold
    counts = records.agg(F.count_if(F.col("risk_score") >= t).alias("warnings"), F.count("*").alias("functions"))
    said = F.concat(F.lit(f"warning: `{TOOL}` generated "), F.col("warnings").cast("string"), F.lit(" warnings"))
    if threshold is not None:
        said = F.concat(said, F.lit(" (threshold "), X.fixed(F.lit(float(t)), 0), F.lit(")"))
    quiet = F.concat(F.lit(f"note: `{TOOL}` analyzed "), F.col("functions").cast("string"), F.lit(" functions, no warnings"))
    return counts.withColumn("summary_line", F.when(F.col("warnings") > 0, said).otherwise(quiet))


def any_exceeds(records: DataFrame, threshold: float) -> DataFrame:
    """One row: whether any score is above the threshold."""
    return records.agg(F.coalesce(F.bool_or(F.col("risk_score") > threshold), F.lit(False)).alias("exceeds"))


def exit_code(records: DataFrame, threshold: float | None = None) -> int:
    """1 if a threshold is given and any score is above it."""
    return 0 if threshold is None else int(any_exceeds(records, threshold).first().exceeds)


def row_counts(**tables: DataFrame) -> DataFrame:
    """One row: how many rows each of *tables* has, in one pass over all."""
    one = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("_of"))
        one = part if one is None else one.unionByName(part)
    return one.agg(*[F.count_if(F.col("_of") == name).alias(name) for name in tables])


def report_text(records: DataFrame, threshold: float | None = None, top: int | None = None, bold=lambda kind, c: c, label: str = LABEL) -> str:
    """The whole report.  Rows come to the driver one partition at a time."""
    if not records.limit(1).count() or top == 0:
        return "No functions to report.\n"
    shown = displayed(records, threshold, top)
    if top is None and not records.filter(F.col("risk_score") >= (S.DEFAULT_THRESHOLD if threshold is None else threshold)).limit(1).count():
        blocks = []
    else:
        blocks = [r.report_line + "\n" for r in diagnostics(shown, threshold, bold, label).orderBy(F.desc("risk_score"), "ord").select("report_line").toLocalIterator()]
    return "".join(blocks) + summary(records, threshold).first().summary_line + "\n"
