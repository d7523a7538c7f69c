"""Schemas of the engine's tables, and the dimension of idiom rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = "file string, qualified_name string, start_line bigint, end_line bigint, complexity bigint, ord bigint"
COVERAGE = "file string, start_line bigint, end_line bigint, line_coverage_pct double"
IDIOMS = "file string, qualified_name string, demerits bigint, checks array<string>, sig_duplicate boolean, body_duplicate boolean, sig_fingerprint string, body_fingerprint string, ord bigint"
RISK = "file string, name string, complexity bigint, coverage_pct double, crap_score double, idiom_penalty double, risk_score double, start_line bigint, checks array<string>, sig_duplicate boolean, body_duplicate boolean"
REGION = "array<decimal(20,0)>"
COVERED_FUNCTION = f"filenames array<string>, regions array<{REGION}>"
ARTIFACT = "reason string, executable string, profile struct<test: boolean>"
METADATA = "packages array<struct<name: string, targets: array<struct<kind: array<string>, src_path: string>>>>"

U32_MAX = 4294967295
#: Percentage below which, complexity from which, and score from which a function stands out.
LOW_COVERAGE, HIGH_COMPLEXITY, DEFAULT_THRESHOLD = 50.0, 10, 30.0
DUPLICATE_WEIGHT = 3

# Idiom rules, their weights and what they suggest.
RULES = (
    ("FreeMethodCandidate", 2, "first parameter is &Struct — consider making this a method"),
    ("MatchOnLiteral", 2, "match on literal values — consider using an enum instead"),
    ("PrimitiveCastInComparison", 2, "primitive `as` cast in comparison/arithmetic — use From/Into traits"),
    ("Unwrap", 1, ".unwrap() call — use `?` or `.expect(\"reason\")`"),
    ("ExplicitDrop", 1, "explicit drop() call — use a scoped block instead"),
    ("EmptyVecMacro", 1, "vec![] for empty vector — use Vec::new()"),
    ("FromIterInsteadOfCollect", 1, "FromIterator::from_iter() — use .collect() instead"),
    ("BoxDynError", 1, "Box<dyn Error> in return type — use a concrete error type"),
)


def idiom_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, weight bigint, suggestion string")
