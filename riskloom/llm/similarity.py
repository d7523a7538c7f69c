"""N-gram Jaccard join by prefix trees (operator 4).

Every text is the set of its word n-grams, as 63-bit numbers in one global
order: rarer n-grams first, by hash, then the frequent ones by their counts.  Texts link when the Jaccard similarity of their sets
reaches the threshold; the result is the components that the links make.

* Texts with equal sets are one class; only one of each goes on.
* Two sets that link share an n-gram among the first (1 - t) * n + 1 of either.
  Sets are compared within the groups that such an n-gram makes.  Any order is
  right; the rarer-first one keeps groups small.
* To lose no link and yet not list all pairs of a large group, there are two
  rounds.  In the first, each set is compared with the smallest id of its
  groups.  In the second, within groups that still hold several components,
  the sets outside the largest component are compared with those of others.
  Pairs inside a component need no comparison: they change nothing.
* Pairs whose counts over 256 hash classes rule a link out go at once.  The
  others are joined by a prefix tree: the ordered sets that are to be compared
  with one set are stored in a trie, so that a shared beginning is compared
  once, and a subtree is left when what remains of either side cannot reach
  the overlap that is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep as kept
from . import kernel as K
from .components import components
from .shared import Kept, free_name

SHINGLE = 4
#: Threshold in hundredths.
PERCENT = 85
#: Frequent n-grams that the order knows: a fixed bound on what is sent around
#: (16 bytes each).  It shapes the groups, not the result.
KNOWN = 1 << 17
#: N-grams counted together before counts are handed on.
COUNTED = 1 << 20
#: Sets in one prefix tree.
TREE = 256
CLASSES = 256
#: The frequent n-grams are numbered from here on.
OFTEN = np.uint64(1) << np.uint64(63)
NULL_ID = -(2**63)


def token_sets(batch, shingle: int, known=None, lower: bool = True, second: bool = False):
    """Blocks of a batch of (doc_id, text): first row, last, the text of each
    distinct n-gram, the n-grams in the global order within each text, sizes,
    and with *second* the n-grams' hashes in the other lane."""
    raw, offsets = K.string_bytes(batch.column(1))
    for i, j in K.blocks(offsets):
        for low in range(i, j, 4096):
            high = min(j, low + 4096)
            words = K.Words(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], lower)
            starts, hashes = words.windows(shingle)
            parts = [(np.searchsorted(words.first, starts, "right") - 1, hashes, words.windows(shingle, 1)[1] if second else None)]
            for size in range(1, shingle):  # the whole sequence as one
                short = np.flatnonzero(words.counts == size)
                if len(short):
                    at = words.first[short]
                    parts.append((short, K.runs_hash(words.hash, size)[at], K.runs_hash(words.lane(1), size, 1)[at] if second else None))
            text, tokens = np.concatenate([p[0] for p in parts]).astype(np.uint16), np.concatenate([p[1] for p in parts]) >> np.uint64(1)
            if known is not None and len(known[0]):
                at = np.minimum(np.searchsorted(known[0], tokens), len(known[0]) - 1)
                tokens = np.where(known[0][at] == tokens, OFTEN + known[1][at], tokens)
            order = np.argsort(tokens)
            order = order[np.argsort(text[order], kind="stable")]
            text, tokens = text[order].astype(np.int64), tokens[order]
            fresh = np.ones(len(tokens), bool)
            fresh[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
            other = np.concatenate([p[2] for p in parts])[order][fresh] if second else None
            text, tokens = text[fresh], tokens[fresh]
            yield low, high, text, tokens, np.bincount(text, minlength=high - low), other


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _survey(shingle: int):
    """Rows of documents (size and 128-bit key of the set) and rows of n-grams
    that more than one set of the same stretch of input holds."""

    def counted(parts):
        tokens = np.sort(np.concatenate(parts))
        head = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        count = np.diff(np.append(head, len(tokens)))
        tokens, count = tokens[head][count > 1], count[count > 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.int64())] * 4 + [pa.array(K.signed(tokens)), pa.array(count)], names)

    names = ["doc", "n", "k1", "k2", "token", "count"]

    def run(batches):
        parts, held, seen = [], 0, set()
        for batch in batches:
            ids = batch.column(0)
            for i, j, text, tokens, sizes, other in token_sets(batch, shingle, second=True):
                k1, k2 = _summed(K.mix(tokens, 1), sizes), _summed(K.mix(other, 2), sizes)
                fresh = np.zeros(j - i, bool)
                for t, k in enumerate(k1.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[t] = True
                parts.append(tokens[fresh[text]])
                held += len(parts[-1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(K.signed(k1)), pa.array(K.signed(k2)), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.int64())], names
                )
                if held >= COUNTED:
                    yield counted(parts)
                    parts, held, seen = [], 0, set()
        if held:
            yield counted(parts)

    return run


def _prefixes(shingle: int, percent: int, sent):
    """doc, n, its first n-grams in the global order, and counts by class."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, text, tokens, sizes, _ in token_sets(batch, shingle, sent.value):
                need = np.where(sizes > 0, sizes - (sizes * percent + 99) // 100 + 1, 0)
                first = np.cumsum(sizes) - sizes
                taken = np.flatnonzero(np.arange(len(tokens)) - first[text] < need[text])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[taken], minlength=j - i)))), pa.int32()), pa.array(K.signed(tokens[taken])))
                classes = np.bincount(text * CLASSES + (tokens & np.uint64(CLASSES - 1)).astype(np.int64), minlength=(j - i) * CLASSES)
                counts = np.minimum(classes, 65535).astype("<u2").reshape(j - i, CLASSES)
                full = (classes.reshape(j - i, CLASSES) > 65535).any(1)
                held = pa.array([None if f else c.tobytes() for c, f in zip(counts, full)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes.astype(np.int64)), lists, held], ["doc", "n", "prefix", "classes"])

    return run


def _possible(percent: int):
    """Keeps the pairs that the counts by class don't rule out."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("ca"), batch.column("cb")
            good = np.ones(batch.num_rows, bool)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            both = np.flatnonzero(np.asarray(left.is_valid()) & np.asarray(right.is_valid()))
            for part in np.array_split(both, max(1, len(both) // 4096)):
                if len(part):
                    x = np.frombuffer(b"".join(left.take(pa.array(part)).to_pylist()), "<u2").reshape(-1, CLASSES)
                    y = np.frombuffer(b"".join(right.take(pa.array(part)).to_pylist()), "<u2").reshape(-1, CLASSES)
                    most = np.minimum(x, y).sum(1, dtype=np.int64)
                    good[part] = 100 * most >= percent * (na[part] + nb[part] - most)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _sets(shingle: int, sent):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, _, tokens, sizes, _ in token_sets(batch, shingle, sent.value):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(K.signed(tokens)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), lists], ["doc", "tokens"])

    return run


class PrefixTree:
    """A radix trie of ordered sets.  A node holds a stretch of n-grams, its
    children by their first n-gram, the sets that end with it, and the sizes of
    the smallest and largest set below it."""

    __slots__ = ("stretch", "children", "ends", "least", "most")

    def __init__(self, sets: list[tuple[np.ndarray, object]], depth: int = 0):
        """*sets*: (ascending n-grams, name), sorted by their n-grams."""
        (low, _), (high, _) = sets[0], sets[-1]
        shared = min(len(low), len(high))
        differ = np.flatnonzero(low[depth:shared] != high[depth:shared])
        end = depth + int(differ[0]) if len(differ) else shared
        self.stretch = low[depth:end]
        self.least, self.most = min(len(s) for s, _ in sets), max(len(s) for s, _ in sets)
        self.ends = [(len(s), name) for s, name in sets if len(s) == end]
        self.children, group = [], []
        for s in sets:
            if len(s[0]) == end:
                continue
            if group and group[0][0][end] != s[0][end]:
                self.children.append(PrefixTree(group, end))
                group = []
            group.append(s)
        if group:
            self.children.append(PrefixTree(group, end))

    def join(self, probe: np.ndarray, percent: int):
        """Names of the stored sets whose similarity with *probe* reaches percent / 100."""
        n = len(probe)
        stack = [(self, 0, 0, 0)]
        while stack:
            node, depth, overlap, passed = stack.pop()
            if len(node.stretch):
                at = np.searchsorted(probe, node.stretch)
                overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == node.stretch))
                depth += len(node.stretch)
                passed = int(np.searchsorted(probe, node.stretch[-1], "right"))  # of the probe
            for size, name in node.ends:
                if 100 * overlap >= percent * (n + size - overlap):
                    yield name
            # What is left of the longest set below, and of the probe, bounds the
            # overlap; the smallest set below needs the least.
            most = overlap + min(node.most - depth, n - passed)
            if 100 * most >= percent * (n + node.least - most):
                stack.extend((child, depth, overlap, passed) for child in node.children)


def _links(percent: int):
    """Pairs (a, b, tokens of a, tokens of b), those of one a in a row, to links."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            left, right, i = [], [], 0
            while i < len(a):
                j = i
                while j < len(a) and a[j] == a[i] and j - i < TREE:
                    j += 1
                sets = [(np.asarray(tb[k].values).view(np.uint64), b[k]) for k in range(i, j)]
                sets.sort(key=lambda s: s[0].byteswap().tobytes())
                for name in PrefixTree(sets).join(np.asarray(ta[i].values).view(np.uint64), percent):
                    left.append(a[i])
                    right.append(name)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def frequent(counts: DataFrame, keep: Kept) -> np.ndarray:
    """The most frequent n-grams of (token, count) rows, rarer ones first: as
    many whole steps of frequency as hold KNOWN n-grams at most."""
    counts = keep(counts.groupBy("token").agg(F.sum("count").alias("count")), "similarity-counts")
    step = F.floor(F.log2("count") * 8).cast("int")
    held, least = 0, 1 << 30
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # a few hundred steps
        held += r.n
        if held > KNOWN:
            break
        least = r.step
    rows = counts.filter(step >= least).toPandas().sort_values(["count", "token"])
    return rows["token"].to_numpy(np.int64).view(np.uint64)


def similar_components(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of *df*.

    A-Z fold to a-z; words are runs of anything but ASCII white space; a text
    with fewer words than *shingle* is its whole sequence as one n-gram; null
    texts and texts without words have none, link with nothing and are their
    own component.  Rows that repeat an id get a result each.  A null id counts
    as smaller than any other and stays null.  Other columns, whatever their
    names, are neither read nor returned.
    """
    spark, keep = df.sparkSession, Kept()
    docs = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    survey = keep(docs.mapInArrow(_survey(shingle), "doc bigint, n bigint, k1 bigint, k2 bigint, token bigint, count bigint"), "similarity-survey")
    often = frequent(survey.filter("token is not null"), keep)
    place = np.argsort(often)
    sent = spark.sparkContext.broadcast((often[place], place.astype(np.uint64)))
    base = survey.filter("token is null").select("doc", "n", "k1", "k2")
    # Equal sets are one class, led by its smallest id.
    classes = base.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc").alias("leader"), F.count("*").alias("members"))
    # Written first, so that the join deals both sides anew and can split a text that very many rows share.
    classes = keep(classes.filter("members > 1").drop("members"), "similarity-classes")
    followers = keep(base.join(classes, ["n", "k1", "k2"]).filter("doc > leader").select("doc", "leader").distinct(), "similarity-copies")
    sets = docs.mapInArrow(_prefixes(shingle, percent, sent), "doc bigint, n bigint, prefix array<bigint>, classes binary")
    sets = keep(sets.filter("n > 0").join(followers.select("doc"), "doc", "left_anti"), "similarity-prefixes")
    entries = sets.select("doc", "n", F.posexplode("prefix").alias("place", "token"))
    hubs = entries.groupBy("token").agg(F.min(F.struct("doc", "n", "place")).alias("hub"), F.max("doc").alias("last")).filter("hub.doc < last")
    # Written first, like all that is joined to the rows it was made from: both sides are then dealt anew, and
    # adaptive execution can split a key that very many rows share.
    hubs = keep(hubs, "similarity-hubs")
    hubs = hubs.select("token", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.place").alias("hub_place"))
    members = keep(entries.join(hubs, "token"), "similarity-groups")

    def fits(x, y, n="n", place="place"):
        """Whether two sets can link if this is the first n-gram they share: all
        that they share stands behind its place in either order.  A pair that
        links meets this at its first shared n-gram."""
        return (100 + percent) * F.least(F.col(n) - F.col(place), F.col(x) - F.col(y)) >= percent * (F.col(n) + F.col(x))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs (a, b, na, nb), each once."""
        c = sets.select("doc", "classes")
        both = pairs.join(c.select(F.col("doc").alias("a"), F.col("classes").alias("ca")), "a").join(c.select(F.col("doc").alias("b"), F.col("classes").alias("cb")), "b")
        good = keep(both.mapInArrow(_possible(percent), "a bigint, b bigint"), f"similarity-pairs-{name}")
        ids = good.select(F.col("a").alias("doc_id")).unionByName(good.select(F.col("b").alias("doc_id"))).distinct()
        full = keep(docs.join(ids, "doc_id").mapInArrow(_sets(shingle, sent), "doc bigint, tokens array<bigint>"), f"similarity-sets-{name}")
        joined = good.join(full.select(F.col("doc").alias("b"), F.col("tokens").alias("tb")), "b").join(full.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")), "a")
        joined = joined.sortWithinPartitions("a")
        return keep(joined.mapInArrow(_links(percent), "a bigint, b bigint"), f"similarity-links-{name}")

    pairs = members.filter((F.col("doc") != F.col("hub")) & fits("hub_n", "hub_place"))
    pairs = keep(pairs.groupBy(F.col("hub").alias("a"), F.col("doc").alias("b")).agg(F.first("hub_n").alias("na"), F.first("n").alias("nb")), "similarity-round1")
    links = verified(pairs, "1")
    stars = components(links)
    # Second round, in groups that hold several components.
    label = F.coalesce("component", "doc").alias("label")
    placed = members.join(stars, F.col("doc") == F.col("node"), "left").select("token", "doc", "n", "place", label)
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    mixed = keep(mixed, "similarity-open")
    placed = keep(placed.join(mixed, "token"), "similarity-mixed")
    largest = placed.groupBy("token", "label").agg(F.count("*").alias("held")).groupBy("token").agg(F.max(F.struct("held", "label"))["label"].alias("main"))
    largest = keep(largest, "similarity-largest")
    rest = placed.join(largest, "token").filter("label <> main")
    other = placed.select("token", F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("label").alias("label2"))
    open_ = rest.join(other, "token").filter((F.col("label") != F.col("label2")) & fits("n2", "place2") & ((F.col("label2") == F.col("main")) | (F.col("doc") < F.col("doc2"))))
    swap = F.col("doc") > F.col("doc2")
    open_ = open_.select(
        F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b"), F.when(swap, F.col("n2")).otherwise(F.col("n")).alias("na"), F.when(swap, F.col("n")).otherwise(F.col("n2")).alias("nb")
    ).distinct()
    open_ = keep(open_.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "similarity-round2")
    more = verified(open_, "2")
    if more.limit(1).count():
        stars = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    keep.leave(survey, followers)
    led = base.join(followers.withColumnRenamed("doc", "copy"), F.col("doc") == F.col("copy"), "left").select("doc", "n", F.coalesce("leader", "doc").alias("leader"))
    out = led.join(stars, F.col("leader") == F.col("node"), "left").select("doc", "n", F.coalesce("component", "leader").alias("component_id"))
    back = [F.when(F.col(c) != NULL_ID, F.col(c)).alias(alias) for c, alias in (("doc", "doc_id"), ("component_id", "component_id"))]
    return out.select(back[0], F.col("n").alias("n_shingles"), back[1])


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of *df* for each component: the one with the smallest id, where a
    null id is smaller than any other.  Rows that share an id are told apart by
    their texts, so that each stays or goes by its own; among equal ones any one
    stays.  Texts without words link with nothing and all stay."""
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID))
    if not df.groupBy(key.alias("key")).count().filter("count > 1").limit(1).count():
        gone = free_name("_gone_id", df.columns)
        out = similar_components(df, doc_id=doc_id, text=text, **how).fillna(NULL_ID, ["doc_id", "component_id"])
        out = out.filter("component_id < doc_id").select(F.col("doc_id").alias(gone))
        return df.join(out, key == F.col(gone), "left_anti")
    # Ids that repeat don't name a row; written, so that each row keeps its number.
    row = free_name("_row", df.columns)
    rows = kept(df.withColumn(row, F.monotonically_increasing_id()), "similarity-rows")
    parts = similar_components(rows, doc_id=row, text=text, **how).join(rows.select(F.col(row).alias("doc_id"), key.alias("key")), "doc_id")
    stays = parts.groupBy("component_id").agg(F.min(F.struct("key", "doc_id"))["doc_id"].alias("stays"))
    return rows.join(stays, F.col(row) == F.col("stays"), "left_semi").drop(row)
