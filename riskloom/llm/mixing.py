"""Mixing sources to target weights (operator 2), in DataFrame functions only.

Weighted fair queueing: within its source every document has a place in a
shuffled order; its virtual finish time is the source's words up to and
including it, divided by the source's target.  All documents are ordered by
finish time, and the mix is what fits the budget.

Both running sums are taken in two levels, so that no task holds a source or
the whole corpus: sums by (source, slice of the shuffle order) and by slice of
virtual time are small tables that are summed up first.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Kept, whole_text

#: Slices of each source's shuffle order and of virtual time at least, and rows
#: of one where there are more: how work is dealt, without influence on the result.
SLICES, ROWS = 1024, 1 << 16


def word_count(text: str = "text"):
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: Fraction = Fraction(3, 2), epochs: int = 2, keep: Kept | None = None) -> DataFrame:
    """source, source_size, target for every source of *sizes* (source, size).

    Sources in the order of their code points, null last, weigh *weights*,
    repeating, and share *share* times all words.  No target exceeds *epochs*
    times its source's size; what is cut off is shared out again by weight.
    That fixed point is weight * level or the cap, whichever is less, with one
    level for all; it comes from running sums over sources by cap / weight.
    Sources are pre-aggregated, a row each, and dealt by range, so that even a
    source for every site is ranked by many tasks.  Without words all targets
    are 0.
    """
    keep = keep or Kept()

    def ranged(rows: DataFrame, order: list, name: str) -> DataFrame:
        # Written, so that each row stays with the number of its range.
        return keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)

    by_name = [F.col("source").asc_nulls_last()]
    per = ranged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), by_name, "mix-sources")
    per = _running(per.withColumn("_one", F.lit(1)), ["_range"], by_name, "_one", "_rank").drop("_range", "_one")
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = [F.col("ratio").asc(), *by_name]
    per = ranged(per, by_ratio, "mix-ratios")
    words, weighs = per.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    per = _running(_running(per, ["_range"], by_ratio, "cap", "_capped"), ["_range"], by_ratio, "weight", "_weighed")
    level = (F.lit(float(words or 0)) * share.numerator / share.denominator - (F.col("_capped") - F.col("cap"))) / (F.lit(float(weighs or 0)) - F.col("_weighed") + F.col("weight"))
    # The first source whose cap isn't reached sets the level; if all reach theirs, none is held back.
    first = per.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("ratio", "level"))["level"]).first()[0]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _running(rows: DataFrame, within: list[str], order: list, amount: str, out: str) -> DataFrame:
    """Adds *out*: the sum of *amount* over the rows of *within* up to and with
    this one, where *within* ends in a slice column whose sums are added up
    over slices first."""
    *whole, slice_ = within
    sums = rows.groupBy(*within).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*whole) if whole else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_before", F.sum("_sum").over(before.orderBy(slice_).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum"))
    sums = sums.select(*[F.col(c).alias("_" + c) for c in within], "_before")
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    inner = F.sum(amount).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_inner", inner).join(sums, same).withColumn(out, F.col("_inner") + F.col("_before")).drop("_inner", "_before", *["_" + c for c in within])


def mix(df: DataFrame, weights=(3, 1, 2), share: Fraction = Fraction(3, 2), epochs: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and source for every row of *df*.

    A document is taken whole, *epochs* times at most, in as many rounds over
    its source.  Words are runs of anything but ASCII white space; null and
    empty texts have none and take no part.  A null source is a source.  The
    shuffle order is a hash of id and seed, ties by id, so reruns agree;
    repeated rows with one id are taken each on its own count.  Other columns,
    whatever their names, are neither read nor returned.
    """
    keep = Kept()
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    # The first 60 bits of a hash that other engines have as well; it orders, and no more.
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    rows = keep(rows.withColumn("place", place), "mix-sizes")
    n, words = rows.agg(F.count("*"), F.sum("size")).first()
    slices = max(SLICES, n // ROWS)
    rows = rows.withColumn("slot", F.floor(F.col("place") / 2.0**60 * slices).cast("int"))
    # Rows alike in everything are one entry, so that the order has no ties.
    alike = rows.groupBy("doc_id", "source", "size", "place", "slot").agg(F.count("*").alias("rows"))
    targets = source_targets(rows, weights, share, epochs, keep)
    queue = _running(alike.withColumn("words", F.col("size") * F.col("rows")), ["source", "slot"], ["place", "doc_id", "size"], "words", "done")
    t = targets.select(F.col("source").alias("_of"), "source_size", "target")
    queue = keep(queue.join(t, F.col("source").eqNullSafe(F.col("_of"))).drop("_of"), "mix-queue")
    keep.leave(queue)
    # One entry for each round over a source.  Entries beyond the target end after
    # virtual time 1 and cannot be within the budget, save the one on the border.
    entries = queue.filter("size > 0 and target > 0").withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(epochs)])))
    entries = entries.withColumn("finish", (F.col("done") + F.col("round") * F.col("source_size")) / F.col("target"))
    entries = entries.filter(F.col("finish") <= 1 + (F.col("words") / F.col("target")))
    entries = entries.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(2 * slices)).cast("int"))
    lined = _running(entries, ["slice"], ["finish", "doc_id", "source", "size", "round"], "words", "total")
    budget = (words or 0) * share.numerator // share.denominator  # one number
    within = lined.filter(F.col("total") <= budget)
    got = within.groupBy("doc_id", "source", "size").agg((F.sum("size")).alias("taken"))
    got = got.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "taken")
    out = queue.join(got, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "left")
    out = out.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source")
