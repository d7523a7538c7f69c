"""The analysis as a whole."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import coverage as C
from .operators import report as R
from .operators import static
from .operators.duplicates import check_duplicates
from .operators.scoring import score
from .sources.tree import read_sources


@dataclass
class Options:
    threshold: float | None = None
    top: int | None = None
    package: str | None = None
    exclude_paths: list[str] = field(default_factory=list)
    exclude_fns: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    all_features: bool = False
    no_default_features: bool = False
    allowance: str = static.ALLOWANCE
    label: str = R.LABEL


def analyze_static(sources: DataFrame, allowance: str = static.ALLOWANCE) -> tuple[DataFrame, DataFrame]:
    """(functions, idioms) of source rows (file, content).  The nodes are kept in
    memory and on disk between the relations; executors that are lost parse
    their files again."""
    nodes = static.ast_nodes(sources, allowance=allowance, kinds=static.FUNCTIONS).persist()
    return static.complexity(nodes), check_duplicates(static.idioms(nodes))


def analyze(spark: SparkSession, project: str, dirs: list[str], export: str, options: Options = Options(), strict_identity: bool = False) -> DataFrame:
    """Risk records of a project from its source directories and its exported coverage."""
    return tables(spark, project, dirs, export, options, strict_identity)[2]


def tables(spark: SparkSession, project: str, dirs: list[str], export: str, options: Options = Options(), strict_identity: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coverage rows, functions and risk records of a project."""
    functions, idioms = analyze_static(read_sources(spark, dirs), options.allowance)
    covered = C.function_coverage(C.read_export(spark, export), project)
    return covered, functions, R.exclude(score(functions, covered, idioms, project, strict_identity), options.exclude_paths, options.exclude_fns)
