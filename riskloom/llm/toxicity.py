"""Toxicity by subword-bag embeddings (operator 8).

A word's bag holds its character n-grams, with marks at its ends.  A text's
embedding is the average of its words' bags, and a linear softmax over two
classes reads it.  N-gram vectors and softmax begin at random and are trained
jointly in numpy, so that misspellings never seen share the vectors of the
n-grams they keep.

The average is first taken over all words of a text; from epoch to epoch it
draws in to the share of words that the model so far finds most toxic, so that
what a long text says besides doesn't drown them.  The score, too, is
read from the average over a text's most toxic share of words.

As everything after the vectors is linear, a trained model is one number for
each n-gram slot: bytes that are few and fixed, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .quality import fold

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 3_000
SLOTS = 1 << 18
SIZES = (3, 4, 5, 6)
DIMENSIONS = 8
#: The share of a text's words that its average is taken over, epoch by epoch, and in the end for its score.
SHARES = (1, 0.5, 0.2, 0.1, 0.05, 0.02, *[0.01] * 8)
SCORED = 0.01
#: Words in an average at least, if a text has as many.
LEAST = 2
BATCH = 64
#: Size of steps, and of the squares that their scale begins with.
RATE, GROUND = 0.2, 1e-3
#: The score of a text without words.
NOTHING = 0.001


def bags(words: K.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram slots of the chosen words, one word's after the other's, and how
    many each word has.  A word is its lower-cased bytes between two marks;
    if it is shorter than an n-gram, it is one itself."""
    a, b = words.starts[chosen], words.ends[chosen]
    size = b - a + 2
    first = np.cumsum(size) - size
    stream = np.empty(int(size.sum()), np.uint64)
    inner = K.ranges(first + 1, size - 2)
    stream[inner] = words.raw[K.ranges(a, size - 2)]
    stream[first], stream[first + size - 1] = 2, 3
    slots, owner = [], []
    value, width = stream, 1
    for n in SIZES:
        while width < n:
            value = value[: len(stream) - width] | stream[width:] << np.uint64(8 * width)
            width += 1
        counts = np.maximum(size - (n - 1), 0)
        starts = K.ranges(first, counts)
        slots.append((K.mix(value[starts], n) >> np.uint64(40)) & np.uint64(SLOTS - 1))
        owner.append(np.repeat(np.arange(len(chosen)), counts))
    whole = K.spans_hash(words.raw, a, b)
    slots.append((K.mix(whole, 9) >> np.uint64(40)) & np.uint64(SLOTS - 1))
    owner.append(np.arange(len(chosen)))
    slots, owner = np.concatenate(slots).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.bincount(owner, minlength=len(chosen))


def _distinct(raw, offsets):
    """The words of a block, where the distinct ones first stand, and for each
    text its distinct words and how often it has them, as (text, word, times)."""
    words = K.Words(raw, offsets, lower=True)
    _, chosen, back = np.unique(words.hash, return_index=True, return_inverse=True)
    pairs, times = np.unique(words.owner() * max(len(chosen), 1) + back, return_counts=True)
    return words, chosen, pairs // max(len(chosen), 1), pairs % max(len(chosen), 1), times


class _Sample:
    """Labelled texts as n-gram slots of their distinct words."""

    def __init__(self, texts: list[str], y: np.ndarray):
        raw, offsets = K.string_bytes(pa.array(texts, pa.large_string()))
        self.y, self.n = y, len(y)
        hashes, slots, counts, doc, word, times, held = [], [], [], [], [], [], 0
        for i, j in K.blocks(offsets):  # in blocks, so that the driver holds few numbers a byte
            words, chosen, of, which, often = _distinct(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(chosen):
                continue
            got, sizes = bags(words, chosen)
            hashes.append(words.hash[chosen])
            slots.append(got.astype(np.int32))
            counts.append(sizes)
            doc.append(i + of)
            word.append(held + which)
            times.append(often)
            held += len(chosen)
        none = [np.zeros(0, np.int64)]
        # Words that several blocks hold become one, the first: a mask takes less room than places would.
        _, first, same = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
        counts = np.concatenate(counts or none)
        once = np.zeros(len(counts), bool)
        once[first] = True
        self.slots = np.concatenate(slots or none)[np.repeat(once, counts)]
        self.counts, same = counts[once], (np.cumsum(once) - 1)[first][same]
        self.begin = np.cumsum(self.counts) - self.counts
        self.doc, self.word = np.concatenate(doc or none), same[np.concatenate(word or none)]
        self.times = np.concatenate(times or none)

    def bagged(self, reading: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The most toxic share of each text's words, text by text, as ``_top`` has it."""
        return _top(self.doc, self.word, self.times, self._words(reading)[self.word], self.n, share)

    def _words(self, reading: np.ndarray) -> np.ndarray:
        return np.add.reduceat(reading[self.slots], self.begin) / self.counts if len(self.slots) else np.zeros(0)

    def logits(self, reading: np.ndarray, share: float = SCORED) -> np.ndarray:
        """What is read from each text's average; minus infinity without words."""
        word, times, first = self.bagged(reading, share)
        return _means(self._words(reading)[word], times, first)

    def train(self, docs: np.ndarray, shares, rng) -> np.ndarray:
        """The reading of each slot: vectors and softmax, trained jointly by
        steps that shrink with the gradients a slot has seen."""
        share = self.y[docs].mean()
        weight = np.where(self.y == 1, 0.5 / share, 0.5 / (1 - share))
        vectors = rng.normal(0, 0.05, (SLOTS, DIMENSIONS)).astype(np.float32)
        softmax = rng.normal(0, 0.05, (2, DIMENSIONS)) + np.array([[-1], [1]]) / DIMENSIONS**0.5
        softmax, bias = softmax.astype(np.float32), np.zeros(2)
        seen, seen_top, seen_bias = np.full(SLOTS, GROUND, np.float32), GROUND, GROUND
        for share in shares:
            word, times, first = self.bagged(vectors @ (softmax[1] - softmax[0]), share)
            held, size = np.diff(first), np.diff(np.concatenate(([0], np.cumsum(times)))[first])
            some = docs[size[docs] > 0]
            for part in np.array_split(rng.permutation(some), max(1, len(some) // BATCH)):
                if not len(part):
                    continue
                mine = K.ranges(first[part], held[part])
                owner = np.repeat(np.arange(len(part)), held[part])
                share_of = times[mine] / np.repeat(size[part], held[part])
                words, back = np.unique(word[mine], return_inverse=True)
                counts = self.counts[words]
                flat = self.slots[K.ranges(self.begin[words], counts)]
                across = softmax[1] - softmax[0]
                read = np.add.reduceat(vectors[flat] @ across, np.cumsum(counts) - counts) / counts
                z = np.bincount(owner, read[back] * share_of, len(part)) + bias[1] - bias[0]
                # The error of the second class; that of the first is less it.
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y[part]) * weight[part]
                # It reaches a slot through every word that has it, so a slot's gradient is a number times the softmax.
                through = np.bincount(back, error[owner] * share_of, len(words)) / counts
                pull = np.bincount(flat, np.repeat(through, counts), SLOTS)
                at = np.flatnonzero(pull)
                pull = pull[at].astype(np.float32)
                turn = pull @ vectors[at] / len(part)
                seen[at] += pull * pull * float(across @ across)
                vectors[at] -= (RATE * pull / np.sqrt(seen[at]))[:, None] * across
                seen_top += float(turn @ turn)
                softmax += 0.02 * np.stack((turn, -turn)) / np.sqrt(seen_top)
                mean = error.mean()
                seen_bias += mean * mean
                bias += 0.05 * np.array([mean, -mean]) / np.sqrt(seen_bias)
        return (vectors @ (softmax[1] - softmax[0])).astype(np.float32)


def _top(doc: np.ndarray, word: np.ndarray, times: np.ndarray, z: np.ndarray, n: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (text, word, times) in the order of texts, those that make up each
    text's highest share of words by *z*: words, times, and where each text's
    begin.  Of the last word only as many times as are needed count."""
    order = np.lexsort((word, -z, doc))
    doc, word, times = doc[order], word[order], times[order]
    held = np.bincount(doc, times, n).astype(np.int64)
    before = np.cumsum(times) - times - (np.cumsum(held) - held)[doc]
    most = np.maximum(LEAST, np.ceil(share * held)).astype(np.int64)
    times = np.minimum(times, most[doc] - before)
    kept = times > 0
    return word[kept], times[kept], np.searchsorted(doc[kept], np.arange(n + 1))


def _means(values: np.ndarray, times: np.ndarray, first: np.ndarray) -> np.ndarray:
    total, size = (np.concatenate(([0], np.cumsum(x)))[first] for x in (values * times, times))
    size = np.diff(size)
    return np.where(size > 0, np.diff(total) / np.maximum(size, 1), -np.inf)


def fit(texts: list[str], labels: np.ndarray, shares=SHARES, seed: int = 42) -> tuple[np.ndarray, float]:
    """Slot weights and bias from texts and 0/1 labels.  The last scale and bias
    come from a fifth of the texts, which the vectors aren't trained on.  With
    fewer than five texts of either class, all weights are 0 and the bias is
    that of the share of label 1."""
    y = np.asarray(labels, float)
    share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.001
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return np.zeros(SLOTS, np.float32), float(np.log(share / (1 - share)))
    rng, sample = np.random.default_rng(seed), _Sample(texts, y)
    unseen = np.zeros(len(y), bool)
    for label in (0, 1):
        unseen[np.flatnonzero(y == label)[::5]] = True
    reading = sample.train(np.flatnonzero(~unseen), shares, rng)
    logit = sample.logits(reading)
    have = unseen & np.isfinite(logit)
    z, t = logit[have], y[have]
    slope, bias = 1.0, -float(np.median(z)) if len(z) else 0.0
    for _ in range(200 if len(z) else 0):  # logistic regression of one variable, with a weak pull of the slope to 1
        p = 1 / (1 + np.exp(-np.clip(slope * z + bias, -30, 30)))
        g = np.array([((p - t) * z).mean() + 1e-3 * (slope - 1), (p - t).mean()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * z * z).mean() + 1e-3, (v * z).mean()], [(v * z).mean(), v.mean() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        slope, bias = max(slope - step[0], 0.02), bias - step[1]
    return reading * np.float32(slope), bias


def logits(weights: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What is read from the average of each text of a block, without the bias;
    minus infinity for texts without words."""
    words, chosen, doc, word, times = _distinct(raw, offsets)
    if not len(chosen):
        return np.full(len(offsets) - 1, -np.inf)
    slots, counts = bags(words, chosen)
    read = np.add.reduceat(weights[slots].astype(np.float64), np.cumsum(counts) - counts) / counts
    word, times, first = _top(doc, word, times, read[word], len(offsets) - 1, SCORED)
    return _means(read[word], times, first)


def score(model: tuple[np.ndarray, float], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    weights, bias = model
    z = logits(weights, raw, offsets)
    return np.where(np.isinf(z), NOTHING, 1 / (1 + np.exp(-np.clip(z + bias, -30, 30))))


def trained(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample: int, doc_id: str, label: str):
    """A broadcast model from the labelled rows of *docs* (doc_id, text)."""
    out_fold = fold(F.col("doc_id"), folds) == held_out
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~out_fold).distinct()
    # Only ids that *docs* holds can be learnt from.
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y").limit(sample)
    rows = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def learn(batches):
        # One task of at most *sample* rows: the driver gets the finished model only.
        texts, y = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            y += batch.column("y").to_pylist()
        weights, bias = fit(texts, np.array(y, float))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    got = rows.repartition(1).sortWithinPartitions("doc_id", "y").mapInArrow(learn, "weights binary, bias double").first()
    weights, bias = (np.frombuffer(got.weights, np.float32), got.bias) if got else fit([], np.zeros(0))
    return docs.sparkSession.sparkContext.broadcast((weights, bias))


def scores(df: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of *df*.

    Rows with crc32(doc_id as text) mod *folds* = *held_out* are held out: their
    labels are not read.  The model is fitted on at most *sample* labelled rows,
    chosen by hash; it takes one text for each doc_id.  Null and empty texts
    score 0.001.  Null labels are left out, and of ids labelled differently all
    labels count.  A null doc_id is not held out and has no label.  Other
    columns, whatever their names, are neither read nor returned.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = trained(docs, labels, folds, held_out, sample, doc_id, label)
    out_fold = fold(F.col("doc_id"), folds) == held_out

    def run(batches):
        for batch in batches:
            raw, offsets = K.string_bytes(batch.column(1))
            for i, j in K.blocks(offsets):
                s = score(model.value, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s)], ["doc_id", "score"])

    rated = docs.mapInArrow(run, "doc_id bigint, score double")
    return rated.select("doc_id", F.coalesce(out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of *df*, with all columns, that are not predicted to be toxic;
    a filter where the rows lie.  Null and empty texts stay, and rows that repeat
    go or stay together.  Where too few labels are given to learn from, all
    rows stay."""
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model, place = trained(docs, labels, folds, held_out, sample, doc_id, label), df.columns.index(text)
    if not model.value[0].any():
        return df

    def run(batches):
        for batch in batches:
            raw, offsets = K.string_bytes(batch.column(place))
            parts = [score(model.value, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in K.blocks(offsets)]
            yield batch.filter(pa.array(np.concatenate([*parts, np.zeros(0)]) < threshold))

    return df.mapInArrow(run, df.schema)
