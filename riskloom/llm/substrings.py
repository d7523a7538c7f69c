"""Substring dedup by repeated-phrase automata (operator 3).

A word of a document goes if a window of 50 consecutive words that covers it
also starts in a document with a smaller id.

1. Winnowing picks short phrases of every document such that each window holds
   at least one, picked by the window's own words; so documents that share a
   window share a picked phrase.  Counting documents by phrase finds where
   anything can recur; windows there are grouped by 128-bit hashes, which gives
   each its first document and place.
2. Neighbouring windows with one first document are a recurring passage.  Its
   words are cut from that first document, never from the one to be searched.
3. Documents with passages are dealt into shards of bounded size.  The passages
   of a shard are compiled into Aho-Corasick automata over whole words, and its
   documents are streamed through them.  What the automata find, word by word,
   is what goes; hashes alone remove nothing.

Documents of equal words (by SHA-256) share one pass: only the first of them is
searched.  A document without a recurring phrase holds no passage and isn't
streamed.  All work grows with the rows; nothing is collected, and the groups
that a common passage makes are only ever reduced to a minimum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import Kept

WINDOW = 50
PHRASE = 25
#: Bytes of texts that one shard holds, but for a single longer text.
SHARD_BYTES = 1 << 20
#: Words of passages that one automaton holds, but for a single longer passage.
AUTOMATON_WORDS = 1 << 18
#: Places of a document in one cell; a passage begins in one cell and has as many windows at most.
CELL = 64


def picked(words: K.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the phrases that winnowing picks: the least hash
    among the phrases of each window, the rightmost of equals."""
    starts, hashes = words.windows(phrase)
    reach = window - phrase + 1  # phrases in a window
    at = np.full(len(words), -1, np.int64)
    at[starts] = np.arange(len(starts))
    counts = np.maximum(words.counts - (window - 1), 0)
    first = at[K.ranges(words.first[:-1], counts)]  # the first phrase of each window
    if not len(first):
        return starts[:0], hashes[:0]
    # Sliding minimum by doubling: best[i] is where the least of hashes[i : i + width] is.
    best, width = np.arange(len(hashes)), 1
    while width < reach:
        step = min(width, reach - width)
        other = best[step:]
        mine = best[: len(other)]
        best = np.where(hashes[other] <= hashes[mine], other, mine)
        width += step
    chosen = np.unique(best[first], return_index=True)[0]
    return starts[chosen], hashes[chosen]


def _text_digest(words: K.Words, i: int) -> bytes:
    """SHA-256 of the words of text i, joined by one space."""
    a, b = words.first[i], words.first[i + 1]
    if a == b:
        return hashlib.sha256(b"").digest()
    size = words.ends[a:b] - words.starts[a:b] + 1
    raw = words.raw[K.ranges(words.starts[a:b], size - (np.arange(b - a) == b - a - 1))]
    raw[np.cumsum(size)[:-1] - 1] = 32
    return hashlib.sha256(raw.tobytes()).digest()


def _blocks(batch, lower: bool = False, most: int = SHARD_BYTES):
    """(first row, words) of the blocks of a batch of (doc_id, text, ...)."""
    raw, offsets = K.string_bytes(batch.column(1))
    for i, j in K.blocks(offsets, most):
        yield i, j, K.Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)


def _phrases(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, words in _blocks(batch):
                starts, hashes = picked(words, window, phrase)
                doc = ids[i:j][np.searchsorted(words.first, starts, "right") - 1]
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(hashes[fresh])), pa.array(doc[fresh])], ["phrase", "doc"])

    return run


def _digests(batches):
    """doc_id, words and the digest of the words of each text."""
    for batch in batches:
        ids = batch.column(0)
        for i, j, words in _blocks(batch):
            digests = [_text_digest(words, k) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(words.counts.astype(np.int64)), pa.array(digests, pa.binary())], ["doc_id", "n_words", "digest"])


def _candidates(window: int, phrase: int):
    """Windows that hold a recurring phrase: their hashes and where they start."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for i, j, words in _blocks(batch):
                starts, hashes = words.windows(phrase)
                recurring = np.unique(np.asarray(lists.slice(i, j - i).flatten(), np.int64).view(np.uint64))
                hit = np.zeros(len(words) + 1, np.int64)
                hit[starts] = np.isin(hashes, recurring)
                hits = np.concatenate(([0], np.cumsum(hit)))
                starts, first = words.windows(window)
                second = words.windows(window, 1)[1]
                good = hits[starts + window - phrase + 1] > hits[starts]
                starts, first, second = starts[good], first[good], second[good]
                text = np.searchsorted(words.first, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(K.signed(first)), pa.array(K.signed(second)), pa.array(ids[i:j][text]), pa.array((starts - words.first[text]).astype(np.int32))],
                    ["h1", "h2", "doc", "start"],
                )

    return run


def _passages(batches):
    """(doc, leader, begin, windows): the recurring passages of each document,
    each once, as places in the document where they stand first."""
    for batch in batches:
        docs, out = batch.column(0).to_numpy(zero_copy_only=False), []
        for doc, places in zip(docs, batch.column(1)):
            start, leader, begin = (np.asarray(places.values.field(k), np.int64) for k in range(3))
            order = np.lexsort((leader, start))
            start, leader, begin = start[order], leader[order], begin[order]
            new = np.ones(len(start), bool)
            new[1:] = (start[1:] != start[:-1] + 1) | (leader[1:] != leader[:-1]) | (begin[1:] != begin[:-1] + 1) | (begin[1:] % CELL == 0)
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(start)))
            found = np.unique(np.stack((leader[heads], begin[heads], n), 1), axis=0)
            out.append(np.concatenate((np.full((len(found), 1), doc), found), 1))
        rows = np.concatenate([np.zeros((0, 4), np.int64), *out])
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], ["doc", "leader", "begin", "n"])


def _cells(window: int):
    """(leader, cell, words) for the cells that passages begin in: the words of
    a cell and as many more as passages from it can reach."""

    def run(batches):
        for batch in batches:
            ids, texts, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            out = []
            for k, leader in enumerate(ids):
                words = (texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b"").split()
                for cell in lists[k].as_py():
                    out.append((leader, cell, b" ".join(words[cell * CELL : (cell + 1) * CELL + window - 1])))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int32()), pa.array(list(columns[2]), pa.binary()).view(pa.string())], ["leader", "cell", "words"])

    return run


class Automata:
    """Passages compiled into Aho-Corasick automata over numbered words."""

    def __init__(self, passages: dict[bytes, int], number: dict[bytes, int]):
        """*passages*: words joined by one space, and the smallest document that holds them."""
        import ahocorasick

        self.parts, held, part = [], 0, None
        for passage, leader in passages.items():
            words = tuple(number.setdefault(w, len(number) + 1) for w in passage.split())
            if part is None or held + len(words) > AUTOMATON_WORDS:
                part, held = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
                self.parts.append(part)
            part.add_word(words, (len(words), leader))
            held += len(words)
        for part in self.parts:
            part.make_automaton()

    def removed(self, words: tuple, doc: int) -> np.ndarray:
        """Which words of a document stand in a passage of an earlier one."""
        change = np.zeros(len(words) + 1, np.int64)
        for part in self.parts:
            for last, (size, leader) in part.iter(words):
                if leader < doc:
                    change[last + 1 - size] += 1
                    change[last + 1] -= 1
        return np.cumsum(change[:-1]) > 0


def _streamed(batches):
    """What the passages of earlier documents leave of each document."""
    for batch in batches:
        ids, texts, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        out = []
        for i, j in K.blocks(K.string_bytes(texts)[1], SHARD_BYTES):
            number: dict[bytes, int] = {}
            passages: dict[bytes, int] = {}
            for row in lists.slice(i, j - i).to_pylist():
                for p in row:
                    key = p["words"].encode()
                    passages[key] = min(passages.get(key, p["leader"]), p["leader"])
            automata = Automata(passages, number)
            for k in range(i, j):
                words = texts[k].as_buffer().to_pybytes().split()
                gone = automata.removed(tuple(number.get(w, 0) for w in words), ids[k])
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((ids[k], hashlib.sha256(b" ".join(words)).digest(), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["doc", "of", "n_removed", "kept_sha256"])


def removed_words(df: DataFrame, window: int = WINDOW, phrase: int = PHRASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by
    one space) for every row.

    Null and empty texts have no words.  Rows that repeat an id and text give
    the same result each.  An id is taken to name one text: rows that share an
    id with different texts count as one document, so that none of its windows
    is removed for another of its rows' sake, and if one is a copy of an earlier
    document the others are kept as they are.  They get a result each.  A null id is
    smaller than any other.  Other columns, whatever their names, are neither
    read nor returned.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase is 1 word at least and a window at most")
    keep = Kept()
    docs = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = keep(docs.mapInArrow(_digests, "doc_id bigint, n_words bigint, digest binary"), "substrings-base")
    # Equal word sequences: only the first is searched; in the others every window goes.
    firsts = base.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("leader"), F.count("*").alias("copies"))
    copies = keep(firsts.filter("copies > 1").select("digest", "leader"), "substrings-classes")
    followers = keep(
        base.join(copies, "digest").filter("doc_id > leader").select("doc_id", F.col("digest").alias("gone")).distinct(), "substrings-copies"
    )
    pairs = docs.mapInArrow(_phrases(window, phrase), "phrase bigint, doc bigint")
    pairs = keep(pairs.join(followers.select(F.col("doc_id").alias("doc")), "doc", "left_anti"), "substrings-phrases")
    # What is joined to the rows it was made from is written first: the join then deals both sides anew, and
    # adaptive execution can split what very many documents share.
    recurring = pairs.groupBy("phrase").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("phrase")
    recurring = keep(recurring, "substrings-recurring")
    lists = pairs.join(recurring, "phrase").groupBy("doc").agg(F.collect_set("phrase").alias("phrases"))
    shards = keep(docs.join(lists, docs.doc_id == lists.doc).select("doc_id", "text", "phrases"), "substrings-shards")
    keep.done(copies, pairs, recurring)
    windows = keep(shards.mapInArrow(_candidates(window, phrase), "h1 bigint, h2 bigint, doc bigint, start int"), "substrings-windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("at"), F.max("doc").alias("most")).filter("at.doc < most")
    first = keep(first.select("h1", "h2", F.col("at.doc").alias("leader"), F.col("at.start").alias("begin")), "substrings-first")
    places = windows.join(first, ["h1", "h2"]).filter("doc > leader").groupBy("doc").agg(F.collect_list(F.struct("start", "leader", "begin")).alias("places"))
    passages = keep(places.mapInArrow(_passages, "doc bigint, leader bigint, begin int, n int"), "substrings-passages")
    keep.done(windows, first)
    # The words of every passage, from the document where it stands first.
    passages = passages.withColumn("cell", (F.col("begin") / CELL).cast("int"))
    needed = passages.groupBy(F.col("leader").alias("of")).agg(F.collect_set("cell").alias("cells"))
    cells = keep(shards.join(needed, shards.doc_id == needed.of).select("doc_id", "text", "cells").mapInArrow(_cells(window), "leader bigint, cell int, words string"), "substrings-cells")
    words = F.array_join(F.slice(F.split("words", " "), F.col("begin") % CELL + 1, F.col("n") + window - 1), " ")
    wanted = passages.join(cells, ["leader", "cell"]).groupBy("doc").agg(F.collect_set(F.struct("leader", words.alias("words"))).alias("passages"))
    texts = shards.select("doc_id", "text")
    left = texts.join(wanted, texts.doc_id == wanted.doc).select("doc_id", "text", "passages").mapInArrow(_streamed, "doc bigint, of binary, n_removed bigint, kept_sha256 string")
    left = keep(left.distinct(), "substrings-left")
    keep.leave(base, followers, left)
    empty = hashlib.sha256(b"").hexdigest()
    out = base.join(left, (F.col("doc_id") == F.col("doc")) & (F.col("digest") == F.col("of")), "left").join(followers.withColumnRenamed("doc_id", "follower"), (F.col("doc_id") == F.col("follower")) & (F.col("digest") == F.col("gone")), "left")
    follows = F.col("follower").isNotNull()
    return out.select(
        F.when(F.col("doc_id") == -(2**63), None).otherwise(F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(follows, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(follows, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
