"""Nulls, repeated rows and ids, clashing names and long runs, for every
operator and stage: a result for each row, and no crash."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontaminate, media, mixing, quality, secrets, similarity, substrings, tokens, toxicity
from riskloom.llm.shared import keep

#: Names that the operators use inside.
CLASHING = ("size", "source_size", "target", "taken", "score", "predicted", "found", "doc", "n", "token", "node", "spans", "rows", "part", "label", "_id", "_gone_id", "_mixed_id", "_found", "_scan_text", "y")


@pytest.fixture(scope="module")
def nasty(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, long = text(80), text(30_000)
    rows = [
        (1, shared, "en", "a"), (2, text(150) + " " + shared, "en", "a"), (2, "short one", "en", "b"), (2, shared, None, "b"), (2, shared, None, "b"),
        (None, shared, None, None), (None, None, None, None), (None, text(9), "en", "a"), (3, None, "en", None), (3, "", "en", None), (4, " \n\t ", "", ""),
        (5, long, "en", "a"), (6, long + " x", "en", "a"), (6, long + " x", "en", "a"), (-7, text(60), "de", "c"), (8, "token = " + "aB3" * 40_000 + "z", "en", "a"),
    ]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return keep(df.withColumns({c: F.lit("kept") for c in CLASHING}).repartition(3), "nasty")


@pytest.fixture(scope="module")
def side(spark):
    """Benchmark and labels, with nulls, repeated rows and clashing names."""
    bench = spark.createDataFrame([(1, "nothing like it " * 12, "k"), (1, "nothing like it " * 12, "k"), (None, None, None), (2, "", "k")], "item_id bigint, text string, doc_id string")
    labels = spark.createDataFrame([(1, 1, 0, "k"), (1, 1, 0, "k"), (2, 0, 0, "k"), (None, 1, 0, "k"), (5, None, None, None), (99, 1, 1, "k")], "doc_id bigint, quality int, toxic int, text string")
    return bench, labels


OPERATORS = {
    "secrets": lambda df, b, k: secrets.scan(df),
    "mixing": lambda df, b, k: mixing.mix(df),
    "substrings": lambda df, b, k: substrings.removed_words(df),
    "similarity": lambda df, b, k: similarity.similar_components(df),
    "media": lambda df, b, k: media.audio_digests(df),
    "quality": lambda df, b, k: quality.scores(df, k),
    "toxicity": lambda df, b, k: toxicity.scores(df, k),
    "tokens": lambda df, b, k: tokens.token_counts(df),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_result_a_row(nasty, side, name):
    got = OPERATORS[name](nasty, *side).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in nasty.select("doc_id").collect())


def test_decontaminate(nasty, side):
    assert decontaminate.occurrences(nasty, side[0]).count() == 0
    assert decontaminate.remove(nasty, side[0]).count() == nasty.count()


def test_decontaminate_finds_in_odd_rows(spark, nasty):
    """Repeated rows, null ids and a very long text hold items, too; null and empty items are nowhere."""
    rows = nasty.collect()
    shared, long = (next(r.text for r in rows if r.doc_id == d) for d in (1, 5))
    items = [(1, shared[20:160]), (1, shared[20:160]), (2, long[-150:]), (None, shared[40:100]), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter((r.doc_id, i) for r in rows for i, t in {x for x in items if x[0] and x[1]} if t in (r.text or ""))
    got = decontaminate.occurrences(nasty, bench).filter("edits = 0")
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want and len(want) == 5
    left = Counter((r.doc_id, r.text) for r in rows if not any(t and t in (r.text or "") for _, t in items))
    assert Counter((r.doc_id, r.text) for r in decontaminate.remove(nasty, bench).collect()) == left


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, nasty, side, tmp_path, empty):
    for name, table in (("benchmark", side[0]), ("labels", side[1])):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = nasty.limit(0) if empty else nasty
    whole = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, str(tmp_path)), f"nasty-{name}")
        before, after = (Counter(tuple(r) for r in x.select("doc_id", "lang", "source", *CLASHING).collect()) for x in (docs, out))
        assert not after - before and out.columns[: len(whole)] == whole and bool(after) != empty
        docs = out
    assert len(docs.columns) == len(whole) + 4


def test_substrings_of_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(90)) for c in "ab")
    got = substrings.removed_words(spark.createDataFrame([(1, a), (9, b + " " + a), (9, "short")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 90, 0), (9, 1, 0), (9, 180, 90)]


def test_one_of_each_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(90)) for x in "abc")

    def kept(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, _row string").repartition(3)
        out = similarity.one_of_each(df)
        assert out.columns == df.columns
        return Counter((r.doc_id, r.text) for r in out.collect())

    # One null id in a group of copies: it counts as the smallest.
    assert kept([(None, a, "x"), (1, a + " end", "x"), (2, a, "x"), (3, b, "x")]) == Counter([(None, a), (3, b)])
    # Exact repeats, two null ids, and an id that names a copy and a text of its own.
    rows = [(7, a, "x"), (7, a, "x"), (None, b, "x"), (None, b + " end", "x"), (8, b, "x"), (8, c, "x"), (9, None, "x"), (9, "", "x")]
    got = kept(rows)
    assert sum(got.values()) == 5 and got[7, a] == got[8, c] == got[9, None] == got[9, ""] == 1 and got[None, b] + got[None, b + " end"] == 1
