r"""Secret scans (operator 1), in DataFrame functions only.

Base spans come from three patterns, every match leftmost and non-overlapping.
Their places are sums over the pieces between and inside matches: Spark's
``split`` and ``regexp_extract_all`` walk the same matches of one pattern.

The method adds spans: each character class has candidate strings, long runs of
its characters; a window slides over each, and the Shannon entropy of the
window, over the alphabet of its class, is kept up by counts that change by one
character in and one character out.  Windows at or above the class's threshold
are joined into spans.  An allow-list suppresses whole candidates that are known
to be none, and cuts known words and fillers out of others, whose rest is
scanned.  Base spans stay as they are.

Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, whole_text

#: The base kinds, in the order in which ties of a start are listed.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of 24 or more are the same spans as all runs of which shorter ones are dropped.
HEX_LONG = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

NO_SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"

WINDOW = 20


class CharacterClass(NamedTuple):
    """Spans of *kind* are windows of candidates, matches of a pattern with the
    window's length for ``%d``, that are *such*; of one alphabet, with so many
    bits a character.  *cut* is what the allow-list cuts out of a candidate."""

    kind: str
    candidate: str
    such: Callable[[Column], Column]
    alphabet: str
    threshold: float
    cut: str | None = None


#: Cut out: placeholders that stand by themselves, runs of one character, and sequences.
FILLERS = r"(?i)(?<![a-z0-9])(?:example|sample|placeholder|changeme|dummy|redacted|your|insert)(?![a-z0-9])|(.)\1{7,}|0123456789|abcdefghijkl"
CLASSES = (
    # Letters and digits of either case, not glued to others: a name before them, as in KEY_9F86, is no part of it.
    CharacterClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{%d,}(?![A-Za-z0-9])", lambda v: v.rlike("[0-9]") & v.rlike("[a-fA-F]"), "0123456789abcdefABCDEF", 3.0),
    # Words have neither digits nor many changes from lower to upper case.
    CharacterClass(
        "entropy_base64", r"[A-Za-z0-9+/_=-]{%d,}", lambda v: v.rlike("[G-Zg-z]") & (v.rlike("[0-9]") | (F.regexp_count(v, F.lit("[a-z][A-Z]")) >= 4)),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8, FILLERS,
    ),
)
#: Suppressed candidates: documented example keys, UUIDs, and paths or names of words.
ALLOWED = (
    r"EXAMPLE(?:KEY)?$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/?(?:[A-Z]?[a-z]*|[A-Z]*)[0-9]{0,4}(?:[/_=-]+(?:[A-Z]?[a-z]*|[A-Z]*)[0-9]{0,4})*$",
)
#: Matches that are put together at a time.
CHUNK = 256


def pattern_spans(text: Column, pattern: str, kind: str, order: int, least=None, values: bool = False) -> Column:
    """array<struct<start, ord, kind, end>> of all matches of *pattern* that
    are *least* characters long (or whose group is, given as (group, length));
    with *values*, array<struct<start, value>> instead.

    Matches are put together in chunks, and chunks then moved to their places,
    so that time grows with their number and not with its square."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group, size = least if isinstance(least, tuple) else (0, least)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    steps = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"), found.alias("value"))
    # The last gap has no match behind it.
    steps = F.filter(steps, lambda x: x["hit"].isNotNull())
    none = F.array().cast("array<struct<start:int,value:string>>" if values else NO_SPANS)
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), x["value"].alias("value")) if values else F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"))
        good = F.length(x["value"]) >= F.lit(size or 0)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def moved(part, by):
        if values:
            return F.transform(part["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["value"].alias("value")))
        return F.transform(part["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)), first, step))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    places = F.aggregate(parts, begin, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
    return F.when(text.rlike(pattern), F.flatten(F.zip_with(parts, places, moved))).otherwise(none)


def without(run: Column, pattern: str, least: int) -> Column:
    """The parts of a run (start, value) between matches of *pattern* that are
    *least* characters long."""
    gaps, hits = F.split(run["value"], pattern, -1), F.regexp_extract_all(run["value"], F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    first = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("parts"))

    def step(acc, x):
        part = F.struct(acc["at"].alias("start"), x["gap"].alias("value"))
        more = F.when(F.length(x["gap"]) >= least, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"])
        return F.struct((acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"), more.alias("parts"))

    return F.aggregate(steps, first, step)["parts"]


def _bits(n: int) -> Column:
    """c * log2(c) for counts of 0 to n, as a lookup array."""
    return F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(n + 1)])


def entropy_spans(codes: Column, window: int, alphabet: str, threshold: float) -> Column:
    """array<struct<start, end>> of the joined windows of a candidate, given as
    the places of its characters in *alphabet* (from 1), whose entropy reaches
    *threshold* bits.

    The state of the walk is a count for each letter of the alphabet and the
    sum of c * log2(c) over them; each step changes both by the character that
    enters and the one that leaves.  Entropy = log2(window) - sum / window.
    The walk meets both as it goes, so that its time grows with the length."""
    bits = _bits(window)
    most = window * (math.log2(window) - threshold) + 1e-9
    first = F.struct(
        F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )
    # 0 leaves while the first window fills up; the zip ends with the candidate.
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.size(codes))

    def bit(n):
        return F.element_at(bits, n + 1)

    def walk(acc, x):
        i, enters, leaves = acc["at"] + 1, x["enters"], x["leaves"]
        same = enters == leaves
        more = F.element_at(acc["counts"], enters)
        less = F.when(leaves > 0, F.get(acc["counts"], leaves - 1)).otherwise(F.lit(0))
        total = F.when(same, acc["sum"]).otherwise(acc["sum"] + bit(more + 1) - bit(more) + F.when(leaves > 0, bit(less - 1) - bit(less)).otherwise(0.0))
        counts = F.when(same, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0))
        )
        last = F.get(acc["spans"], F.size(acc["spans"]) - 1)
        begin = i - window
        joined = F.when(
            (F.size(acc["spans"]) > 0) & (begin <= last["end"]),
            F.concat(F.slice(acc["spans"], 1, F.greatest(F.size(acc["spans"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), i.alias("end")))),
        ).otherwise(F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), i.alias("end")))))
        spans = F.when((i >= window) & (total <= most), joined).otherwise(acc["spans"])
        return F.struct(i.alias("at"), counts.alias("counts"), total.alias("sum"), spans.alias("spans"))

    return F.aggregate(F.arrays_zip(codes.alias("enters"), leaving.alias("leaves")), first, walk)["spans"]


def letter_codes(value: Column, alphabet: str) -> Column:
    """The place in *alphabet*, from 1, of each character of *value*."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))


def _class_spans(candidates: Column, order: int, c: CharacterClass, window: int) -> Column:
    def span(run, s):
        return F.struct((run["start"] + s["start"]).alias("start"), F.lit(order).alias("ord"), F.lit(c.kind).alias("kind"), (run["start"] + s["end"]).alias("end"))

    def of(run):
        return F.transform(entropy_spans(run["codes"], window, c.alphabet, c.threshold), lambda s: span(run, s))

    # The codes are made once for a candidate, before the walk that reads them twice.
    coded = F.transform(candidates, lambda run: F.struct(run["start"].alias("start"), letter_codes(run["value"], c.alphabet).alias("codes")))
    return F.flatten(F.transform(coded, of))


def candidates(text: Column, c: CharacterClass, window: int, allowed) -> Column:
    """array<struct<start, value>> of what is scanned for a class."""
    runs = pattern_spans(text, c.candidate % window, c.kind, 0, window, values=True)

    def open_(run):
        good = c.such(run["value"])
        for pattern in allowed:
            good = good & ~run["value"].rlike(pattern)
        return good

    runs = F.filter(runs, open_)
    if c.cut is None:
        return runs
    parts = F.flatten(F.transform(runs, lambda run: F.when(run["value"].rlike(c.cut), without(run, c.cut, window)).otherwise(F.array(run))))
    return F.filter(parts, lambda run: c.such(run["value"]))


def with_spans(df: DataFrame, text: str = "text", out: str = "spans", window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """All columns of *df* and *out*: array<struct<start, ord, kind, end>>, base
    spans and those of the method, by start, then kind as listed.

    Null and empty texts have none.  Every row is handled by itself, without a
    shuffle.  If *df* has a column *out*, the new one gets underscores."""
    raw = free_name("_scan_text", df.columns)
    runs = [free_name(f"_scan_runs_{i}", df.columns) for i in range(len(classes))]
    out = free_name(out, df.columns)
    df = df.withColumn(raw, whole_text(text))
    t = F.col(raw)
    base = F.concat(
        pattern_spans(t, ASSIGN, "assign", 0, (1, 6)),
        pattern_spans(t, ACCESS, "access", 1, 20),
        pattern_spans(t, HEX_LONG, "hex", 2, 24),
    )
    df = df.withColumns({name: candidates(t, c, window, allowed) for name, c in zip(runs, classes)})
    parts = [base]
    for order, (name, c) in enumerate(zip(runs, classes), len(BASE_KINDS)):
        parts.append(F.when(F.size(name) > 0, _class_spans(F.col(name), order, c, window)).otherwise(F.array().cast(NO_SPANS)))
    return df.withColumn(out, F.array_sort(F.concat(*parts))).drop(raw, *runs)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added for every
    row.  Null and empty texts have no spans; repeated rows give repeated
    results; an empty table gives an empty one; other columns, whatever their
    names, are neither read nor returned."""
    df = with_spans(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")), "text", "found", **how)

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("found", lambda s: s["ord"] < len(BASE_KINDS))
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["ord"] >= len(BASE_KINDS))).cast("bigint").alias("n_added"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[REDACTED]", **how) -> DataFrame:
    """*df* with every found span of its texts replaced by *mark*; overlapping
    spans count as one.  Texts without a find, null and empty ones stay as they are."""
    found = free_name("_found", df.columns)
    df = with_spans(df, text, found, **how)
    t = whole_text(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        fresh = F.concat(acc["parts"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        # A span that begins inside the last one only moves its end.
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when((s["start"] >= acc["at"]) | (F.size(acc["parts"]) == 0), fresh).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate(F.col(found), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return df.withColumn(text, F.when(F.size(found) > 0, done).otherwise(F.col(text))).drop(found)
