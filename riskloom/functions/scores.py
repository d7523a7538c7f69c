"""Scalar functions as Column expressions: no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def crap(complexity: Column, coverage: Column) -> Column:
    """CC**2 * (1 - cov/100)**3 + CC, by explicit products."""
    cc, x = complexity.cast("double"), F.lit(1.0) - coverage / F.lit(100.0)
    return cc * cc * x * x * x + cc


def idiom_penalty(demerits: Column) -> Column:
    return F.lit(1.0) + F.lit(0.25) * demerits.cast("double")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Lines that two closed intervals share."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def saturate(x: Column) -> Column:
    """An unsigned 64-bit number cut to 32 bits."""
    return F.least(x, F.lit(S.U32_MAX)).cast("bigint")


def rule_map(field: int) -> Column:
    """A literal map from rule to weight (1) or suggestion (2)."""
    return F.create_map(*[F.lit(v) for r in S.RULES for v in (r[0], r[field])])


def demerits(checks: Column) -> Column:
    weights = rule_map(1)
    return F.aggregate(checks, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(F.try_element_at(weights, c), F.lit(0)))


def lint_code(coverage: Column, complexity: Column, penalty: Column) -> Column:
    low, high = coverage < S.LOW_COVERAGE, complexity >= S.HIGH_COMPLEXITY
    return F.when(low & high, "high-risk").when(low, "low-coverage").when(high, "high-complexity").when(penalty > 1.0, "idiom-violation").otherwise("risky")


def level(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "warning").otherwise("note")


def is_clean() -> Column:
    """Over a risk record: nothing to say about it."""
    c = F.col
    return (c("coverage_pct") >= S.LOW_COVERAGE) & (c("complexity") < S.HIGH_COMPLEXITY) & (c("idiom_penalty") <= 1.0) & (F.size("checks") == 0) & ~c("sig_duplicate") & ~c("body_duplicate")


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, ties to even, without grouping."""
    return F.call_function("format_number", x, F.lit("0" if digits == 0 else "0." + "0" * digits))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is *prefix* or lies below it, by whole components."""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")


def duration(seconds: Column) -> Column:
    """'S.mmms' below a minute, else 'Mm S.mmms', cut to milliseconds."""
    ms = F.floor(seconds * 1000).cast("bigint")
    whole, rest = F.floor(ms / 1000).cast("bigint"), F.lpad((ms % 1000).cast("string"), 3, "0")
    short = F.concat(whole.cast("string"), F.lit("."), rest, F.lit("s"))
    long = F.concat(F.floor(whole / 60).cast("bigint").cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("."), rest, F.lit("s"))
    return F.when(whole < 60, short).otherwise(long)


def rustc_host(text: Column) -> Column:
    """The host triple in the compiler's version text, null without one."""
    found = F.regexp_extract(text, r"(?m)^host: (.*)$", 1)
    return F.when(found != "", found)
