"""What equality of words rests on: hashes, automata, and the lexicon of pieces."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import kernel as K
from riskloom.llm import similarity, substrings, tokens


def thue_morse(n: int, a: str, b: str) -> str:
    """Words of 2**n letters that polynomial hashes modulo a power of 2 can't tell from their complements."""
    w = a
    for _ in range(n):
        w += w.translate(str.maketrans(a + b, b + a))
    return w


A, B = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")


def test_hashes_tell_words_apart():
    rng = random.Random(1)
    words = {A, B, "a\0", "a", "\0a", *(thue_morse(n, x, y) for n in range(12) for x, y in ("ab", "ba", "et", "te"))}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(20_000)}
    words = [w.encode() for w in sorted(words)]
    raw, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words])))
    for lane in (0, 1):
        assert len(set(K.spans_hash(raw, offsets[:-1], offsets[1:], lane).tolist())) == len(words)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 25, 50])
def test_hashes_of_runs(k):
    values = K.mix(np.random.default_rng(2).integers(0, 2, 4000).astype(np.uint64))
    for lane in (0, 1):
        got = K.runs_hash(values, k, lane).tolist()
        want = [tuple(values[i : i + k].tolist()) for i in range(len(values) - k + 1)]
        assert len(got) == len(want) and len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_pieces_are_counted_by_their_bytes(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [A, B, thue_morse(10, "e", "t"), thue_morse(10, "t", "e"), A + " " + B, "a\0 \0a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_bytes_that_are_no_text():
    public = pytest.importorskip("public_tokenizers")
    bad = pa.array([b"abc \xff\xfe def \xe2\x82 x", b"fine"], pa.binary()).view(pa.string())
    size, n = tokens.counter(public.path("byte_bpe_50k.json")).column(bad)
    assert size.tolist() == [15, 4] and n[0] > 0 and n[1] == 1


def test_words_alike_for_polynomials_link_nothing(spark):
    same = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, A + " " + same), (2, B + " " + same), (3, A), (4, B)], "doc_id bigint, text string")
    gone = {r.doc_id: r.n_removed for r in substrings.removed_words(df).collect()}
    assert gone == {1: 0, 2: 60, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in similarity.similar_components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def streamed(doc, text, passages):
    kind = pa.list_(pa.struct([("leader", pa.int64()), ("words", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([text]), pa.array([[{"leader": d, "words": w} for d, w in passages]], kind)], ["doc_id", "text", "passages"])
    out = next(substrings._streamed([batch])).to_pylist()[0]
    return out["n_removed"], out["kept_sha256"]


def test_only_what_automata_find_goes():
    """A passage that stands for a document by a false hash removes nothing; a true one goes wherever it stands."""
    words = [f"w{i % 70}" for i in range(300)]
    text, passage = " ".join(words), " ".join(words[5:60])
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    assert streamed(9, text, []) == (0, sha(words))
    assert streamed(9, text, [(1, passage.replace("w7 ", "w7x "))]) == (0, sha(words))
    assert streamed(9, text, [(9, passage)]) == (0, sha(words))
    want = [w for i, w in enumerate(words) if not (5 <= i % 70 < 60 and i - i % 70 + 60 <= 300)]
    assert streamed(9, text, [(1, passage), (3, passage)]) == (300 - len(want), sha(want))


def test_automata_are_sharded(monkeypatch):
    monkeypatch.setattr(substrings, "AUTOMATON_WORDS", 100)
    words = [f"w{i}" for i in range(400)]
    passages = {" ".join(words[i : i + 60]).encode(): 1 for i in range(0, 340, 17)}
    number: dict = {}
    automata = substrings.Automata(passages, number)
    assert len(automata.parts) == len(passages)
    gone = automata.removed(tuple(number.get(w.encode(), 0) for w in words), 2)
    assert gone.tolist() == [i < 340 + 60 - 17 for i in range(400)]


def test_passages_of_many_leaders(spark):
    """Near copies of near copies, with passages over many cells."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 500)}" for _ in range(900)]
    rows = []
    for d in range(14):
        w = list(base[rng.randint(0, 200) :])
        for _ in range(d % 5):
            w[rng.randrange(len(w))] = f"x{d}"
        rows.append((d, " ".join(w)))
    first: dict = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.removed_words(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d, t in rows:
        w = t.split()
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        assert got[d] == (len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_transducer_over_bytes():
    """Every piece emits what it weighs, new or known, before and after it has begun anew."""
    rng = random.Random(9)
    weighed = []

    def weigh(piece: bytes) -> int:
        weighed.append(piece)
        return sum(piece) % 97

    small = tokens.Pieces(weigh, most=3000)
    known = [rng.randbytes(rng.randint(1, 40)) for _ in range(300)] + [b"", b"\0", b"\0\0", b"a" * 31, b"a" * 32, b"a" * 33]
    known = [p for p in known if p]
    for _ in range(12):
        pieces = [rng.choice(known) if rng.random() < 0.7 else bytes(rng.choices(b"ab", k=rng.randint(1, 34))) for _ in range(400)]
        size = np.array([len(p) for p in pieces])
        got = small.run(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)
        assert got.tolist() == [sum(p) % 97 for p in pieces] and small.states <= 3000 + 400 * 34
    assert len(weighed) < 12 * 400
