"""Token counts by a finite-state transducer (operator 9).

A byte-level BPE tokenizer first cuts a text into pieces by a pattern, then
merges bytes within each piece.  Both are compiled into deterministic
transducers, one behind the other.

The first runs over character classes; its transitions say where pieces begin;
what has to be known of the following characters is part of the input symbol.
A text is dealt into chunks: every chunk yields the map from the state before it
to the state after it, the maps are composed by a parallel prefix scan, and then
every chunk runs from its true first state.

The second runs over bytes, for all pieces of a block at once.  A transition on
a byte leads on; the one on the end of a piece leads back to the first state and
emits the number of tokens that the merges leave of the piece.  Its transitions
are compiled from the merges as pieces are met.

The counts equal those of the vocabulary's own library with special tokens
neither added nor suppressed: special strings inside a text are one token each.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

CHUNK = 64
#: States of a worker's transducer over bytes before it begins anew; bounds its memory.
STATES = 3 << 20
#: Bytes of the longest piece that it takes; longer ones are weighed one by one.
LONGEST = 32
#: Pairs of tokens that are remembered.
PAIRS = 1_000_000

# Symbols: what a character is, and what follows it as far as it matters.
LETTER, DIGIT, OTHER, SHORT1, SHORT2, SPACES, BLANK, SPACE = range(8)
#: Added to the symbol of a text's first character.
FIRST = 8
# States: what the piece so far is.
BEGIN, IN_LETTERS, IN_DIGITS, IN_OTHERS, IN_SPACES, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and pieces begun, by state * 16 + symbol."""
    fresh = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHERS, SHORT1: ONE_MORE, SHORT2: TWO_MORE, SPACES: IN_SPACES, BLANK: AFTER_BLANK, SPACE: BEGIN}
    go, out = np.zeros((8, 16), np.uint8), np.ones((8, 16), np.uint8)
    for state in range(8):
        for symbol, then in fresh.items():
            go[state, symbol] = go[state, symbol + FIRST] = then
    for state, symbols, then in (
        (IN_LETTERS, [LETTER], IN_LETTERS),
        (IN_DIGITS, [DIGIT], IN_DIGITS),
        (IN_OTHERS, [OTHER, SHORT1, SHORT2], IN_OTHERS),
        (IN_SPACES, [SPACES], IN_SPACES),
        (AFTER_BLANK, [LETTER], IN_LETTERS),
        (AFTER_BLANK, [DIGIT], IN_DIGITS),
        (AFTER_BLANK, [OTHER, SHORT1, SHORT2], IN_OTHERS),
        (ONE_MORE, range(8), BEGIN),
        (TWO_MORE, range(8), ONE_MORE),
    ):
        for symbol in symbols:
            go[state, symbol], out[state, symbol] = then, 0
    return go.reshape(-1), out.reshape(-1)


GO, OUT = _compile()


def transduce(symbols: np.ndarray) -> np.ndarray:
    """Where pieces begin, for one run of symbols."""
    n = len(symbols)
    m = -(-n // CHUNK)
    grid = np.full(m * CHUNK, SPACE, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(m, CHUNK).T)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8)[:, None], (8, m)).copy()
    for row in grid:  # all chunks and all first states at once
        maps = GO[(maps << 4) | row]
    scan, step = maps, 1
    while step < m:  # scan[:, i] maps the first state to that after chunk i
        ahead = scan.copy()
        ahead[:, step:] = np.take_along_axis(scan[:, step:], scan[:, :-step], 0)
        scan, step = ahead, step * 2
    state = np.full(m, BEGIN, np.uint8)
    state[1:] = scan[BEGIN, :-1]
    begun = np.empty((CHUNK, m), bool)
    for j, row in enumerate(grid):
        at = (state << 4) | row
        begun[j] = OUT[at]
        state = GO[at]
    return begun.T.reshape(-1)[:n]


_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """LETTER, DIGIT, OTHER or SPACE for every code point, by Unicode category."""
    global _classes
    if _classes is None:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        for name, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for low in range(0, 0x110000, 0x10000):
                chars = "".join(map(chr, range(low, low + 0x10000)))
                for m in regex.finditer(pattern, chars):
                    table[low + m.start() : low + m.end()] = name
        _classes = table
    return _classes


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Transducer symbols of code points; *first* marks where texts begin."""
    n = len(points)
    kind = char_classes()[points]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    space = kind == SPACE
    spaced = np.ones(n, bool)  # white space or the end of the text follows
    spaced[:-1] = space[1:] | first[1:]
    out = kind.copy()
    out[space & spaced] = SPACES
    out[space & ~spaced & (points == 32)] = BLANK
    for i in np.flatnonzero((points == 39) & ~last):
        a = points[i + 1]
        if a in _SHORT1:
            out[i] = SHORT1
        elif i + 2 < n and not last[i + 1] and (a, points[i + 2]) in _SHORT2:
            out[i] = SHORT2
    return out + first * np.uint8(FIRST)


def characters(raw: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points and where each begins.  A text that is no UTF-8 counts by
    its bytes: each byte of a faulty character is one character of no class."""
    try:
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        return points, np.flatnonzero((raw & 0xC0) != 0x80)
    except UnicodeDecodeError:
        text = data.decode("utf-8", "surrogateescape")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        faulty = (points >= 0xDC80) & (points <= 0xDCFF)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        size[faulty] = 1
        return points, np.cumsum(size) - size


_SHORT1 = set(map(ord, "stmd"))
_SHORT2 = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


class Pieces:
    """The transducer over bytes.  Transitions are a hash table of numpy arrays:
    from a state, on a byte, to a state.  What the end of a piece emits in a
    state is in ``emits``, -1 where it isn't compiled yet."""

    def __init__(self, weigh, most: int = STATES):
        self.weigh, self.most = weigh, most
        self.begin()

    def begin(self) -> None:
        self.bits = 16
        self.keys, self.to = np.zeros(1 << self.bits, K.U), np.zeros(1 << self.bits, np.int32)
        self.emits = np.full(1 << self.bits, -1, np.int32)
        self.states = 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (K.mix(keys) >> K.U(64 - self.bits)).astype(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """Where transitions lead; -1 where there is none."""
        out, slot = np.full(len(keys), -1, np.int64), self.slot(keys)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[slot]
            hit = held == keys
            out[left[hit]] = self.to[slot[hit]]
            more = ~hit & (held != 0)
            left, keys, slot = left[more], keys[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, to: np.ndarray) -> None:
        """New transitions, each once."""
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.to[slot[mine]] = to[mine]
            left = ~mine
            keys, to, slot = keys[left], to[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def room(self, more: int) -> None:
        """Makes room for as many states more, in a table that is half full at most."""
        while 2 * (self.states + more) > 1 << self.bits:
            kept = self.keys != 0
            keys, to = self.keys[kept], self.to[kept]
            self.bits += 1
            self.keys, self.to = np.zeros(1 << self.bits, K.U), np.zeros(1 << self.bits, np.int32)
            self.emits = np.concatenate((self.emits, np.full(len(self.emits), -1, np.int32)))
            self.add(keys, to)

    def walk(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, learn: bool = False) -> np.ndarray:
        """The state behind the last byte of each piece; -1 where a transition is
        missing, or, to *learn*, is made."""
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        state = np.zeros(len(order), np.int64)
        live = np.arange(len(order))
        for j in range(int(size[0]) if len(size) else 0):
            live = live[: np.searchsorted(-size[live], -j)]  # those of more than j bytes
            keys = (state[live].astype(K.U) + K.U(1)) << K.U(8) | raw[starts[live] + j]
            to = self.step(keys)
            new = np.flatnonzero(to < 0)
            if len(new) and learn:
                fresh, back = np.unique(keys[new], return_inverse=True)
                self.room(len(fresh))
                self.add(fresh, np.arange(self.states, self.states + len(fresh), dtype=np.int32))
                to[new] = self.states + back
                self.states += len(fresh)
            state[live] = to
            if len(new) and not learn:
                live = live[to >= 0]
        out = np.empty(len(order), np.int64)
        out[order] = state
        return out

    def run(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What each raw[start : start + size] emits."""
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= LONGEST)
        at, n = starts[short], size[short]
        state = self.walk(raw, at, n)
        emitted = np.where(state >= 0, self.emits[state], -1)
        new = np.flatnonzero(emitted < 0)
        if len(new):
            data = raw.tobytes()
            pieces = list({data[a : a + k] for a, k in zip(at[new].tolist(), n[new].tolist())})
            if self.states + sum(map(len, pieces)) > self.most:
                self.begin()
                pieces = list({data[a : a + k] for a, k in zip(at.tolist(), n.tolist())})
                new = np.arange(len(at))
            each = np.array([len(p) for p in pieces], np.int64)
            ends = self.walk(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(each) - each, each, learn=True)
            self.emits[ends] = [self.weigh(p) for p in pieces]
            emitted[new] = self.emits[self.walk(raw, at[new], n[new])]
        out[short] = emitted
        for k in np.flatnonzero(size > LONGEST).tolist():
            out[k] = self.weigh(raw[starts[k] : starts[k] + size[k]].tobytes())
        return out


class Counter:
    """Token counts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer or prefix space can be compiled")
        # The visible stand-ins of bytes: printable ones are themselves, others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.unbyte = unbyte = {c: b for b, c in self.byte.items()}
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.pieces = Pieces(self.weigh)

        unbyte = self.unbyte
        raw = [tuple(bytes(map(unbyte.__getitem__, side)) for side in p) for p in pairs]
        #: rank of each merge, and what each token was merged from
        self.seam = {p: i for i, p in enumerate(raw)}
        self.halves = {a + b: (a, b) for a, b in raw}
        self.vocabulary = frozenset(bytes([b]) for b in self.unbyte.values()) | self.halves.keys()
        #: size of the longest token that begins with these three bytes
        self.reach: dict[bytes, int] = {}
        for t in self.vocabulary:
            if len(t) > self.reach.get(t[:3], 2):
                self.reach[t[:3]] = len(t)
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.joint: dict[tuple[bytes, bytes], bool] = {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stood at the left (0) or right (1) edge of a token while it was
        merged, each with the rank of the merge that took it up."""
        got = self.edges.get((token, side))
        if got is None:
            got, part = [(token, 1 << 30)], token
            while halves := self.halves.get(part):
                part = halves[side]
                got.append((part, self.seam[halves]))
            self.edges[token, side] = got
        return got

    def beside(self, left: bytes, right: bytes) -> bool:
        """Whether the merges keep two tokens apart: no merge across their seam
        comes before the merge that takes up either side (of equal merges the
        leftmost comes first).  A token alone: whether merges make it at all."""
        if not left:
            return self.merge(right) == [right]
        if not self.fits(b"", right):
            return False
        seam = self.seam
        for x, x_ends in self.edge(left, 1):
            for y, y_ends in self.edge(right, 0):
                r = seam.get((x, y))
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True

    def fits(self, left: bytes, right: bytes) -> bool:
        got = self.joint.get((left, right))
        if got is None:
            if len(self.joint) > PAIRS:
                self.joint.clear()
            got = self.joint[left, right] = self.beside(left, right)
        return got

    def weigh(self, piece: bytes) -> int:
        """Tokens of a piece, from left to right.

        A sequence of tokens is the merges' own result exactly if every pair of
        neighbours is left as it is by the merges.  So the state is the last
        token: the next is the longest one that may stand beside it, and where
        none may, the last one is shortened.  Which tokens may stand side by
        side is compiled pair by pair, as pairs are met."""
        n, ok, joint, reach = len(piece), self.vocabulary, self.joint, self.reach
        if n > 64:
            return self._merge_long([self.byte[b] for b in piece])
        taken, at, size, last = [], 0, min(n, reach.get(piece[:3], 2)), b""
        while at < n:
            while size:
                token = piece[at : at + size]
                if token in ok:
                    fits = joint.get((last, token))
                    if fits or fits is None and self.fits(last, token):
                        break
                size -= 1
            if size:
                taken.append(last)
                last, at = token, at + size
                size = min(n - at, reach.get(piece[at : at + 3], 2))
            elif not taken:
                return len(self.merge(piece))
            else:
                at -= len(last)
                size, last = len(last) - 1, taken.pop()
        return len(taken)

    def merge(self, piece: bytes) -> list[bytes]:
        """What the merges leave of a piece: the best-ranked pair merges first,
        the leftmost first among equals."""
        parts, rank = [self.byte[b] for b in piece], self.rank
        while len(parts) > 1:
            ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            a, b = parts[i], parts[i + 1]
            merged, j = parts[:i], i
            while j < len(parts):
                if j + 1 < len(parts) and parts[j] == a and parts[j + 1] == b:
                    merged.append(a + b)
                    j += 2
                else:
                    merged.append(parts[j])
                    j += 1
            parts = merged
        unbyte = self.unbyte
        return [bytes(unbyte[c] for c in p) for p in parts]

    def _merge_long(self, parts: list[str]) -> int:
        """How many are left, by a heap over a linked list, for pieces of any length."""
        import heapq

        n, rank = len(parts), self.rank
        after, before, alive, left = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, n
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(p := (parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if before[i] >= 0 and (r := rank.get(p := (parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], p))
        return left

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts of one block."""
        total = np.zeros(len(offsets) - 1, np.int64)
        owner = np.arange(len(total))
        data = raw.tobytes()
        if self.cut and any(s in data for s in self.special):
            parts, owner, sizes = [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                for k, part in enumerate(self.cut.split(data[a:b])):
                    if k % 2:
                        total[i] += 1
                    else:
                        parts.append(part)
                        owner.append(i)
                        sizes.append(len(part))
            data, owner = b"".join(parts), np.array(owner)
            raw, offsets = np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(sizes)))
        if not data:
            return total
        points, place = characters(raw, data)
        first = np.zeros(len(points), bool)
        first[np.searchsorted(place, offsets[:-1][offsets[:-1] < len(raw)])] = True
        starts = place[transduce(symbols_of(points, first))]
        ends = np.append(starts[1:], len(raw))
        counts = self.pieces.run(raw, starts, ends - starts)
        text = owner[np.searchsorted(offsets, starts, "right") - 1]
        return total + np.bincount(text, counts, len(total)).astype(np.int64)

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of every text of an Arrow column; null counts as empty."""
        raw, offsets = K.string_bytes(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in K.blocks(offsets):
            out[i:j] = self.block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        return np.diff(offsets), out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for
    every row.

    *vocabulary* is a name that ``public_tokenizers.path`` knows on every
    worker, or a path.  Null and empty texts have 0 tokens; bytes
    that are no UTF-8 are characters of their own; repeated rows give
    repeated results; other columns, whatever their names, are neither read
    nor returned; an empty table gives an empty result.  A pass over the rows
    without a shuffle; a worker holds one block of texts and a bounded transducer.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches):
        path = vocabulary
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        count = counter(path)
        for batch in batches:
            size, n = count.column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
