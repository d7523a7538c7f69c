"""Quality classifier by Bradley-Terry pairwise ranking (operator 6).

Every text becomes a vector of shape features: shares of kinds of characters,
word lengths, repetition of words and lines.  From pairs of a preferred and a
rejected labelled text a Bradley-Terry model learns weights by logistic loss on
feature differences (Newton steps; their sums come from all pairs' tasks).  The score is the sigmoid of a
text's strength less the strength at that quantile of the training texts which
the share of rejected labels names, so 0.5 is the quantile threshold.

Every labelled row that is not held out is in pairs, and in the quantile and the
slope; tasks add them up, and the driver sees sums only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, keep
from . import kernel as K

STEPS = 12
#: Labelled rows that are paired among themselves, of either label how many at least, and pairs of a row.
GROUP, LEAST, ROUNDS = 8192, 64, 4
BINS = 4096
_CLASS = np.zeros(256, np.uint8)
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"-()", b"!", b"?", b"|", b"$%*&#@^~+=_", b"<>{}[]\\/`"), 1):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 12
KINDS = 13
NAMES = [f"share_{i}" for i in range(KINDS)] + ["log_words", "word_length", "equal_neighbours", "distinct_words", "equal_lines", "odd_ends", "upper_words"]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of a block."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * KINDS + _CLASS[raw], minlength=n * KINDS).reshape(n, KINDS)
    words = K.Words(raw, offsets, lower=True)
    owner, counts = words.owner(), np.maximum(words.counts, 1)

    def share(per_word) -> np.ndarray:
        return np.bincount(owner, per_word, n) / counts

    same = np.zeros(len(words))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((words.hash, owner))
    fresh = np.ones(len(words))
    fresh[order[1:]] = (words.hash[order[1:]] != words.hash[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    last = _CLASS[raw[words.ends - 1]] if len(words) else np.zeros(0, np.uint8)
    upper = (_CLASS[raw[words.starts]] == 2) & (_CLASS[raw[words.ends - 1 - (words.ends - words.starts > 1)]] != 1) if len(words) else np.zeros(0)
    # Lines that the same text has more than once.
    cuts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(raw == 10) + 1)))
    cuts = cuts[cuts < len(raw)]
    line_ends = np.append(cuts[1:], len(raw))
    line = K.spans_hash(raw, cuts, line_ends)
    line_owner = np.searchsorted(offsets, cuts, "right") - 1
    order = np.lexsort((line, line_owner))
    again = np.zeros(len(cuts))
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (line_owner[order[1:]] == line_owner[order[:-1]])
    repeated = np.bincount(line_owner, again * (line_ends - cuts), n) / np.maximum(size, 1)
    columns = [
        np.log1p(words.counts), share((words.ends - words.starts).astype(float)), share(same), share(fresh), repeated,
        share(np.isin(last, (7, 9, 10, 11)).astype(float)), share(upper.astype(float)),
    ]
    return np.column_stack([kinds / np.maximum(size, 1)[:, None], *columns])


def total(rows: DataFrame, part) -> np.ndarray:
    """The sum of *part* over all batches of *rows*; only sums reach the driver."""

    def run(batches):
        sums = None
        for batch in batches:
            if batch.num_rows:
                got = part(*[matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns])
                sums = got if sums is None else sums + got
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"sums": [sums.tolist()]}, pa.schema([("sums", pa.list_(pa.float64()))]))

    return np.sum([r.sums for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def standard(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -8, 8)


def differences(rows: DataFrame, model: dict, good: int, bad: int) -> DataFrame:
    """Feature differences of pairs: each row of the commoner label of a group
    with ROUNDS of the other.  Rows of a rare label are in several groups, so
    that no group lacks it."""
    groups = -(-(good + bad) // GROUP)
    rare, few = (1, good) if good < bad else (0, bad)
    copies = min(groups, -(-LEAST * groups // few))
    turns = F.sequence(F.lit(0), F.when(F.col("y") == rare, copies - 1).otherwise(0))
    dealt = rows.select(F.col("doc_id"), "y", "x", F.explode(turns).alias("c")).select(F.pmod(F.xxhash64("doc_id") + F.col("c"), F.lit(groups)).alias("g"), "doc_id", "y", "x")

    def pair(table):
        table = table.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
        z, y = standard(model, matrix(table["x"].combine_chunks())), table["y"].to_numpy()
        ups, downs = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(ups) or not len(downs):
            return pa.table({"d": pa.array([], pa.list_(pa.float64()))})
        m, out = np.arange(max(len(ups), len(downs))), []
        for r in range(ROUNDS):
            i, j = (m, m + r * len(downs) // ROUNDS) if len(ups) > len(downs) else (m + r * len(ups) // ROUNDS, m)
            out.append(z[ups[i % len(ups)]] - z[downs[j % len(downs)]])
        d = np.concatenate(out)
        return pa.table({"d": pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.reshape(-1)))})

    return dealt.groupBy("g").applyInArrow(pair, "d array<double>")


def ranked(strengths: DataFrame, weigh, rank: int, low: float, high: float) -> float:
    """The strength at *rank* of all: the bin that holds it, four times over."""
    for _ in range(4):
        edges = np.linspace(low, high, BINS + 1)
        counts = total(strengths, lambda x, edges=edges: np.bincount(np.searchsorted(edges, weigh(x), "right"), minlength=BINS + 2).astype(float))
        at = int(np.searchsorted(np.cumsum(counts), rank, "right"))
        if at > BINS:
            return high
        low, high = edges[at - 1] if at else low, edges[at]
    return (low + high) / 2


def fit(rows: DataFrame) -> dict:
    """A Bradley-Terry model from (doc_id, y, x) rows, all of them.  Without both
    labels every score is the share of label 1 (0.5 without any label)."""
    sums = total(rows.select("x", "y"), lambda x, y: np.concatenate(([len(y), y.sum()], x.sum(0))))
    size = len(NAMES)
    n, good = (int(sums[0]), int(sums[1])) if np.ndim(sums) else (0, 0)
    w = np.zeros(size)
    if not good or good == n:
        p = float(np.clip(good / n, 0.01, 0.99)) if n else 0.5
        return {"mean": w, "scale": np.ones(size), "w": w, "cut": -float(np.log(p / (1 - p))), "slope": 1.0}
    mean = sums[2:] / n
    scale = np.sqrt(total(rows.select("x"), lambda x: ((x - mean) ** 2).sum(0)) / n) + 1e-6
    model = {"mean": mean, "scale": scale}
    pairs = keep(differences(rows, model, good, n - good), "quality-pairs")
    for _ in range(STEPS):  # minimise mean log(1 + exp(-w.d)) + ridge

        def slopes(d, w=w):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            return np.concatenate(([len(d)], (d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).reshape(-1)))

        sums = total(pairs, slopes)
        grad = -sums[1 : size + 1] / sums[0] + 1e-3 * w
        step = np.linalg.solve(sums[size + 1 :].reshape(size, size) / sums[0] + 1e-3 * np.eye(size), grad)
        step = step / max(1.0, np.abs(step).max() / 2)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    drop(pairs)

    def strength(x, w=w):
        return standard(model, x) @ w

    x = rows.select("x")
    reach = np.abs(w).sum() * 8 + 1.0  # features are cut at 8
    at = (n - 1) * (n - good) / n
    low, high = (ranked(x, strength, k, -reach, reach) for k in (int(at), min(int(at) + 1, n - 1)))
    cut = float(low + (at - int(at)) * (high - low))
    # One slope turns distances from the cut into chances.
    slope = 1.0
    for _ in range(30):

        def curve(x, y, slope=slope):
            t = strength(x) - cut
            p = 1 / (1 + np.exp(-np.clip(slope * t, -30, 30)))
            return np.array([((p - y) * t).sum(), (p * (1 - p) * t * t).sum()])

        first, second = total(rows.select("x", "y"), curve) / n
        before, slope = slope, float(np.clip(slope - first / max(second, 1e-6) * 0.5, 0.05, 20))
        if abs(slope - before) < 1e-6:
            break
    return model | {"w": w, "cut": cut, "slope": slope}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = standard(model, x)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (z @ model["w"] - model["cut"]), -30, 30)))


def scores(df: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of *df*.

    Rows with crc32(doc_id as text) mod *folds* = *held_out* are held out: their
    labels are not read.  Null and empty texts have the features of an empty
    text.  Null labels are left out; a doc_id that is labelled more than once
    counts once for each distinct label.  A null doc_id is not held out and has
    no label.  Other columns, whatever their names, are neither read nor returned.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = K.string_bytes(batch.column(1))
            for i, j in K.blocks(offsets):
                x = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "x"])

    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shaped = keep(docs.mapInArrow(run, "doc_id bigint, x array<double>"), "quality-features")
    out_fold = fold(F.col("doc_id"), folds) == held_out
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~out_fold).distinct()
    # Only ids that *df* holds can be learnt from.
    rows = keep(shaped.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")), "quality-labelled")
    model = fit(rows)
    drop(rows)

    def rate(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(model, x))], ["doc_id", "score"])

    rated = shaped.mapInArrow(rate, "doc_id bigint, score double")
    return rated.select("doc_id", F.coalesce(out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string")) % folds
