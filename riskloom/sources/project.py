"""Project metadata, test artifacts and manifests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def target_dirs(metadata: DataFrame, package: str | None = None) -> DataFrame:
    """dir of each library and binary target of *metadata*, distinct."""
    p = metadata.select(F.explode("packages").alias("p"))
    if package is not None:
        p = p.filter(F.col("p.name") == package)
    t = p.select(F.explode("p.targets").alias("t")).filter(F.exists("t.kind", lambda k: k.isin("lib", "bin")))
    return t.select(F.regexp_replace("t.src_path", r"/[^/]*$", "").alias("dir")).distinct()


def source_dirs(spark: SparkSession, metadata_json: str, project: str, package: str | None = None) -> list[str]:
    """Existing directories of the targets that a metadata document names; if it
    can't be read or names none, the project's ``src``, if that exists."""
    raw = spark.createDataFrame([(metadata_json,)], "v string").select(F.from_json("v", S.METADATA).alias("m")).select("m.*")
    dirs = [r.dir for r in target_dirs(raw, package).orderBy("dir").collect() if os.path.isdir(r.dir)]
    return dirs or [d for d in (os.path.join(project, "src"),) if os.path.isdir(d)]


def test_binaries(lines: DataFrame, column: str = "value") -> DataFrame:
    """executable of each test artifact among the lines of a build's output;
    lines that are no such message are passed over."""
    m = lines.filter(F.col(column).startswith("{")).select(F.from_json(column, S.ARTIFACT).alias("m"))
    return m.filter((F.col("m.reason") == "compiler-artifact") & F.coalesce("m.profile.test", F.lit(False)) & F.col("m.executable").isNotNull()).select("m.executable")


def detect_package(project: str) -> str | None:
    """The package name in a manifest's [package] section."""
    try:
        text = Path(project, "Cargo.toml").read_text(encoding="utf-8")
    except OSError:
        return None
    here = False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("["):
            here = line == "[package]"
        elif here and line.startswith("name"):
            _, found, value = line.partition("=")
            if not found:
                return None
            if value := value.strip().strip('"'):
                return value
    return None


def is_workspace_member(project: str) -> bool:
    """Whether a directory above has a manifest with a workspace."""
    for d in Path(project).resolve().parents:
        try:
            if "[workspace]" in (d / "Cargo.toml").read_text(encoding="utf-8"):
                return True
        except OSError:
            continue
    return False
