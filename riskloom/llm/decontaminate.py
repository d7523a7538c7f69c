"""Benchmark decontamination by q-gram lemma filtering (operator 10).

An occurrence of an item of length L with at most k edits keeps at least
L - q + 1 - k * q of the item's q-grams, and all on diagonals (place in the
text less place in the item) within k of the first.  So q-grams that a text
shares with an item are counted in bands of diagonals, each overlapping the
next by half; a band below the bound holds no occurrence.  What remains is
verified by banded alignment.

Counting goes in stages, each over what the one before left, and each in slices
of bounded size, so that passages which very many items share cost neither
memory nor alignments: distinct q-grams of a text by item; distinct 4-grams,
whose bound (L - 3 - 4 * k) is the tighter; then places, in bands.

Texts are compared as bytes after folding A-Z to a-z and every run of ASCII
characters other than letters and digits to one space.  q is 8, so that a
q-gram is exactly one 64-bit word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

Q = 8
#: Share of an item's length that edits may make up.
EDITS = 0.1
#: Normalised items shorter than this are searched without edits, as whole words.
LEAST = 24
#: Bytes of item text that one pass holds; more items are searched in further passes.
PASS_BYTES = 8 << 20
#: Shared q-grams that are spread out at once, but for those of a single q-gram.
HITS = 1 << 21

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their offsets, and the place of each in *raw*."""
    folded = _FOLD[raw]
    blank = folded == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    keep[heads] = ~blank[heads]  # no blank at the head of a text
    at = np.flatnonzero(keep)
    return folded[at], np.searchsorted(at, offsets), at


def grams(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the q-grams within each text."""
    n = len(folded) - Q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = folded.astype(np.uint64)
    for width in (1, 2, 4):  # doubling: bytes, pairs, fours, eights
        value = value[:-width] | value[width:] << np.uint64(8 * width)
    counts = np.maximum(np.diff(offsets) - (Q - 1), 0)
    starts = K.ranges(offsets[:-1], counts)
    return starts, value[starts]


def fours(folded: np.ndarray) -> np.ndarray:
    """The 4-grams at every place, as 16-bit numbers; different ones may share one."""
    value = folded.astype(np.uint32)
    for width in (1, 2):
        value = value[:-width] | value[width:] << np.uint32(8 * width)
    return ((value * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


class Items:
    """A searchable set of items: (id, text) rows."""

    def __init__(self, rows, edits: float = EDITS):
        found, short = [], []
        for key, text in rows:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            folded = normalise(raw, np.array([0, len(raw)]))[0]
            if len(folded) and folded[-1] == 32:
                folded = folded[:-1]
            if key is not None and len(folded):
                (found if len(folded) >= LEAST else short).append((key, folded))
        self.ids = np.array([k for k, _ in found + short], np.int64)
        #: By length, the short texts and the items of each.
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for k, (_, t) in enumerate(short, len(found)):
            self.short.setdefault(len(t), {}).setdefault(t.tobytes(), []).append(k)
        self.texts = [t for _, t in found]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.size = size
        #: Edits allowed: never so many that the bound would let everything pass.
        self.edits = np.minimum((size * edits).astype(np.int64), (size - Q) // Q)
        self.bound = size - Q + 1 - self.edits * Q
        self.step = 2 * self.edits + 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        joined = np.concatenate(self.texts) if found else np.zeros(0, np.uint8)
        starts, value = grams(joined, offsets)
        item = np.searchsorted(offsets, starts, "right") - 1
        order = np.argsort(value, kind="stable")
        self.gram_item = item[order].astype(np.int32)
        self.fours: dict[int, np.ndarray] = {}
        self.present = np.zeros(1 << 16, bool)
        self.grams, self.gram_first = np.unique(value[order], return_index=True)
        self.gram_first = np.append(self.gram_first, len(order))
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.slot(self.grams)] = True

    def slot(self, value: np.ndarray) -> np.ndarray:
        return (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def search(self, raw: np.ndarray, offsets: np.ndarray):
        """(text, item index, first byte, last byte + 1, edits) of each occurrence in a block."""
        if not len(self.ids) or not len(raw):
            return
        folded, bounds, place = normalise(raw, offsets)
        if self.short:
            yield from self.exact(folded, bounds, place)
        if not self.texts:
            return
        starts, value = grams(folded, bounds)
        maybe = np.flatnonzero(self.seen[self.slot(value)])
        gram = np.searchsorted(self.grams, value[maybe])
        good = self.grams[np.minimum(gram, len(self.grams) - 1)] == value[maybe]
        where, value, gram = starts[maybe[good]], value[maybe[good]], gram[good]
        text = np.searchsorted(bounds, where, "right") - 1
        for t, near in self.sharing(text, gram):
            low, high = int(bounds[t]), int(bounds[t + 1])
            near = self.holding(folded[low:high], near)
            if not len(near):
                continue
            a, b = np.searchsorted(text, (t, t + 1))
            order = np.argsort(value[a:b], kind="stable") + a
            for k in near.tolist():
                for begin, end in self.places(k, where[order] - low, value[order], high - low):
                    for x, y, edits in self.verify(k, folded[low + begin : low + end]):
                        x, y = low + begin + x, low + begin + y
                        yield t, k, int(place[x]), int(place[y - 1]) + 1, edits

    def sharing(self, text: np.ndarray, gram: np.ndarray):
        """(text, items) where the text holds as many of an item's q-grams as the
        bound asks for, wherever they stand."""
        n = len(self.texts)
        pairs = np.unique(text * len(self.grams) + gram)
        text, gram = pairs // len(self.grams), pairs % len(self.grams)
        counts = self.gram_first[gram + 1] - self.gram_first[gram]
        total = np.concatenate(([0], np.cumsum(counts)))
        heads = np.append(np.flatnonzero(np.append(True, text[1:] != text[:-1])), len(text)) if len(text) else np.zeros(1, np.int64)
        i = 0
        while i < len(heads) - 1:
            a = heads[i]
            j = int(np.searchsorted(total[heads], total[a] + HITS, "right")) - 1
            if j > i:  # whole texts
                b = heads[j]
                at = K.ranges(self.gram_first[gram[a:b]], counts[a:b])
                found, held = np.unique(np.repeat(text[a:b], counts[a:b]) * n + self.gram_item[at], return_counts=True)
                found = found[held >= self.bound[found % n]]
                first = np.flatnonzero(np.append(True, found[1:] // n != found[:-1] // n)) if len(found) else found
                for part in np.split(found, first[1:]):
                    if len(part):
                        yield int(part[0]) // n, part % n
                i = j
                continue
            held, b = np.zeros(n, np.int64), heads[i + 1]
            while a < b:
                end = min(b, max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1))
                held += np.bincount(self.gram_item[K.ranges(self.gram_first[gram[a:end]], counts[a:end])], minlength=n)
                a = end
            found = np.flatnonzero(held >= self.bound)
            if len(found):
                yield int(text[heads[i]]), found
            i += 1

    def holding(self, part: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Those of *items* of whose 4-grams *part* holds as many as their bound."""
        have = fours(part)
        self.present[have] = True
        good = []
        for k in items.tolist():
            mine = self.fours.get(k)
            if mine is None:
                mine = self.fours[k] = fours(self.texts[k])
            good.append(np.count_nonzero(self.present[mine]) >= len(mine) - 4 * self.edits[k])
        self.present[have] = False
        return items[np.array(good, bool)]

    def places(self, k: int, where: np.ndarray, value: np.ndarray, length: int) -> list[tuple[int, int]]:
        """The parts of a text, apart from each other, that hold all occurrences
        of item k; *where* its known q-grams stand, by their ascending values."""
        size, most, step = int(self.size[k]), int(self.edits[k]), int(self.step[k])
        at, mine = grams(self.texts[k], np.array([0, size]))
        low = np.searchsorted(value, mine)
        counts = np.searchsorted(value, mine, "right") - low
        if counts.sum() > HITS:  # both repeat themselves all over
            return [(0, length)]
        within = np.repeat(at, counts)
        band = (where[K.ranges(low, counts)] - within + size) // step  # the diagonal is 0 at least
        # Each hit is in two bands: band b holds the diagonals from b to b + 2 steps; a place of the item counts once in a band.
        keys = (band + 1) * size + within
        keys = np.unique(np.concatenate((keys, keys - size)))
        which, count = np.unique(keys // size, return_counts=True)
        out: list[tuple[int, int]] = []
        for b in (which[count >= self.bound[k]] - 1).tolist():
            begin, end = max(0, b * step - size - most), min(length, (b + 2) * step + most)
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            else:
                out.append((begin, end))
        return out

    def verify(self, k: int, part: np.ndarray):
        """(begin, end, edits) of the occurrences of item k in a part of a text:
        the one of least edits first, the leftmost of equals, then those on
        either side of it."""
        item, size, most = self.texts[k], int(self.size[k]), int(self.edits[k])
        parts, found = [(0, len(part))], []
        while parts:
            a, b = parts.pop()
            if b - a < size - most or not len(self.holding(part[a:b], np.array([k]))):
                continue
            best = align(item, part[a:b], -most, b - a - size + most + 1, most)
            if best:
                edits, begin, end = best
                found.append((a + begin, a + end, edits))
                parts += [(a, a + begin), (a + end, b)]
        return sorted(found)

    def exact(self, folded, bounds, place):
        """The occurrences of short items, from one word border to another."""
        if not len(folded):
            return
        begins = np.append(True, folded[:-1] == 32) & (folded != 32)
        begins[bounds[:-1][bounds[:-1] < len(folded)]] = True
        begins = np.flatnonzero(begins)
        text = np.searchsorted(bounds, begins, "right") - 1
        stop = bounds[text + 1]
        for size, known in self.short.items():
            end = begins + size
            good = (end == stop) | (end < stop) & (folded[np.minimum(end, len(folded) - 1)] == 32)
            at, owner = begins[good], text[good]
            if not len(at):
                continue
            parts = np.ascontiguousarray(folded[at[:, None] + np.arange(size)]).view(f"S{size}")[:, 0]
            last: dict[bytes, tuple[int, int]] = {}  # where the last one of a text ended
            for i in np.flatnonzero(np.isin(parts, np.array(list(known), f"S{size}"))):
                t, a, key = int(owner[i]), int(at[i]), bytes(parts[i])
                if last.get(key, (-1, 0)) <= (t, a):
                    last[key] = (t, a + size)
                    for k in known[key]:
                        yield t, k, int(place[a]), int(place[a + size - 1]) + 1, 0


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits, *most* at most, of *item* against any part of *text* on
    diagonals low to high - 1, with where that part begins and ends; among
    equals the leftmost."""
    width = high - low
    if width <= 0 or not len(text):
        return None
    shift, columns = 32, np.arange(width, dtype=np.int64)
    one = np.int64(1) << shift
    never = one << 20
    # state: edits << shift | where in the text it begins, by diagonal
    begin, ramp = columns + low, columns * one
    state = np.where((begin >= 0) & (begin <= len(text)), np.clip(begin, 0, len(text)), never)
    # Beyond the text stand bytes that match nothing: never cheaper than to end before them.
    pad = max(0, -low)
    padded = np.zeros(max(pad + len(text), low + pad + len(item) + width), np.uint8)
    padded[pad : pad + len(text)] = text
    for i, c in enumerate(item):
        at = low + i + pad
        new = state + (padded[at : at + width] != c) * one
        np.minimum(new[:-1], state[1:] + one, out=new[:-1])
        new -= ramp
        state = np.minimum.accumulate(new, out=new)
        state += ramp
        if i % 32 == 31 and int(state.min() >> shift) > most:
            return None
    best = int(state.argmin())
    edits = int(state[best] >> shift)
    if edits > most:
        return None
    first, last = int(state[best] & (one - 1)), min(int(begin[best]) + len(item), len(text))
    return (edits, first, last) if 0 <= first < last else None


def _passes(benchmark: DataFrame, item_id: str, text: str):
    """The items in groups of bounded size, so that one fits a broadcast; without
    *item_id*, their texts alone."""
    rows = benchmark.select((F.col(item_id).cast("bigint") if item_id else F.lit(0).cast("bigint")).alias("item_id"), F.col(text).cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // PASS_BYTES))
    for i in range(n):
        yield rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).distinct().orderBy("item_id", "text").collect()


def occurrences(df: DataFrame, benchmark: DataFrame, edits: float = EDITS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, end (code points of the text, end exclusive) and
    edits, for every place in *df* where an item occurs with at most *edits*
    times its length of edits, counted on normalised bytes.

    Occurrences of one item don't overlap: the one of least edits counts first
    (the leftmost of equals), then those on either side of it.  Items under 24
    normalised bytes are searched as whole words, without edits.  Null and empty texts and items, and items with a null id, have no
    occurrences; repeated rows give repeated results; empty tables give none;
    other columns, whatever their names, are neither read nor returned.  Only
    the items are sent around, in passes of bounded size; documents are read
    where they lie, without a shuffle.
    """
    spark, out = df.sparkSession, None
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint"
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    for rows in _passes(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows])

        def run(batches, sent=sent):
            items = Items(sent.value, edits)
            for batch in batches:
                raw, offsets = K.string_bytes(batch.column(1))
                keys, found = batch.column(0).to_pylist(), []
                for i, j in K.blocks(offsets):
                    part = raw[offsets[i] : offsets[j]]
                    for t, k, a, b, e in items.search(part, offsets[i : j + 1] - offsets[i]):
                        head = part[offsets[i + t] - offsets[i] : b]
                        lead = np.cumsum((head & 0xC0) != 0x80)
                        a -= int(offsets[i + t] - offsets[i])
                        found.append((keys[i + t], int(items.ids[k]), int(lead[a - 1]) if a else 0, int(lead[-1]), e))
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "edits"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def remove(df: DataFrame, benchmark: DataFrame, edits: float = EDITS, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of *df*, with all columns, whose texts hold no occurrence of a
    benchmark item, whatever its id; a filter where the rows lie, in as many
    passes as the items take.  Null and empty texts stay, rows that repeat stay
    or go together, and null and empty items occur nowhere."""
    place, schema = df.columns.index(text), df.schema
    for rows in _passes(benchmark, None, item_text):
        sent = df.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows])

        def run(batches, sent=sent):
            items = Items(sent.value, edits)
            for batch in batches:
                raw, offsets = K.string_bytes(batch.column(place))
                clean = np.ones(batch.num_rows, bool)
                for i, j in K.blocks(offsets):
                    for t, *_ in items.search(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        clean[i + t] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(run, schema)
    return df
