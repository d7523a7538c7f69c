"""A training corpus from raw documents: five stages, each one operator of
``riskloom.llm``, each written as Parquet and read again before the next.

Toxic documents go; one document of each group of near copies stays; documents
with benchmark passages go; secrets are blanked out in place; and the rest is
mixed to the target weights of their sources.  The last stage returns the
columns of documents with each document's size and how many of its words the
mix takes, for documents of which it takes any.

In every stage null and empty texts are clean, alike with nothing and without
secrets or passages, and rows that repeat are judged alike; an empty table stays
empty, and columns of any name stay as they are.  Each stage's docstring says
what else holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, mixing, secrets, similarity, toxicity
from riskloom.llm.shared import free_name, keep, table
from riskloom.session import ship

#: Near copies, for the stage: similarity of word 5-grams, in hundredths.  (The
#: operator's own defaults are the contract of its query.)
SHINGLE, PERCENT = 5, 80


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts score below the operator's threshold of toxicity.
    Without labels of both kinds nothing is learnt, and all rows stay."""
    return toxicity.keep_clean(docs, table(ship(spark), sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the one with the smallest id, a
    null id before any other.  Rows without words all stay."""
    ship(spark)
    return similarity.one_of_each(docs, shingle=SHINGLE, percent=PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts hold no item of the benchmark, whatever the item's id."""
    return decontaminate.remove(docs, table(ship(spark), sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret in a text replaced by a mark; n_chars, if
    there is such a column, follows."""
    done = secrets.redact(docs, "text")
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else done


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id, source and size, as in the mix.  Columns of
    *docs* keep their names; a new one of the same name gets underscores."""
    mine = {"doc_id": F.col("doc_id").cast("bigint"), "source": F.col("source").cast("string"), "size": mixing.word_count()}
    names = {c: free_name(f"_mixed_{c}", docs.columns) for c in mine}
    results = {c: free_name(c, docs.columns) for c in ("size", "source_size", "target", "taken")}
    took = mixing.mix(docs).filter("taken > 0").distinct()
    took = took.select(*[F.col(c).alias(n) for c, n in names.items()], *[F.col(c).alias(n) for c, n in results.items()])
    same = F.lit(True)
    for c, n in names.items():
        same = same & mine[c].eqNullSafe(F.col(n))
    return docs.join(took, same).drop(*names.values())


STAGES = [
    ("toxicity", clean_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("source_mixing", mixed),
]

#: Trained models and edit distances are not for SQL.  Each stage's rows are
#: tested against plain Python or, for the mix, against SQL over its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
