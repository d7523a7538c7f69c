"""The queries of this folder over the tables of a data folder.

Each applies its operator, with production parameters, to the whole of its
table; what holds for nulls, empty and very long texts, ties, repeated rows,
empty tables and columns of any name is said by the operator it calls.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

from . import decontaminate, media, mixing, pages, quality, secrets, similarity, substrings, tokens, toxicity
from .oracles import ORACLES
from .shared import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, base spans and those of entropy: ``secrets.scan``."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: ``mixing.mix``."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passages of earlier documents leave of each: ``substrings.removed_words``."""
    return substrings.removed_words(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document's near copies: ``similarity.similar_components``."""
    return similarity.similar_components(table(spark, sf_dir, "documents"))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and hashes of each text as audio: ``media.audio_digests``."""
    return media.audio_digests(table(spark, sf_dir, "documents"))


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each text: ``quality.scores``."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page: ``pages.main_texts``."""
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each text: ``toxicity.scores``."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each text: ``tokens.token_counts``."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items of the benchmark occur: ``decontaminate.occurrences``."""
    return decontaminate.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shipped(f):
    """The query, with this package sent to the workers first."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(ship(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(f) for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
