"""Search for benchmark items against a scan by edit distance."""

import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import decontaminate


def best(item: str, text: str):
    """(edits, begin, end) of the part of *text* next to *item*, by the whole table."""
    row = [(0, j) for j in range(len(text) + 1)]
    for c in item:
        new = [(row[0][0] + 1, row[0][1])]
        for j, t in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (c != t), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return min(((e, b, j) for j, (e, b) in enumerate(row) if b < j), default=None)


def scan(item: str, text: str, most: int, shift: int = 0):
    found = best(item, text)
    if found is None or found[0] > most:
        return []
    e, a, b = found
    return [*scan(item, text[:a], most, shift), (shift + a, shift + b, e), *scan(item, text[b:], most, shift + b)]


def search(items: dict, texts: dict):
    got = decontaminate.Items(items.items())
    raw = [t.encode() for t in texts.values()]
    ids = list(texts)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    block = np.frombuffer(b"".join(raw), np.uint8)
    return Counter((ids[t], int(got.ids[k]), a - int(starts[t]), b - int(starts[t]), e) for t, k, a, b, e in got.search(block, starts))


def changed(rng, text: str, n: int) -> str:
    for _ in range(n):
        p = rng.randrange(len(text))
        text = rng.choice([text[:p] + text[p + 1 :], text[:p] + "q" + text[p:], text[:p] + "z" + text[p + 1 :]])
    return text


def test_both_sides_of_a_find():
    item = "abc def ghi jkl " * 8 + "m"
    rng = random.Random(1)
    edited = changed(rng, item, 4)
    for text in (edited + " " + item, item + " " + edited, edited + " " + item + " " + edited):
        want = Counter((1, 7, *x) for x in scan(item, text, len(item) // 10))
        assert search({7: item}, {1: text}) == want and sum(want.values()) == text.count(" m") + text.count("m ") - text.count(" m ") or want


@pytest.mark.parametrize("seed", range(6))
def test_by_edit_distance(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(decontaminate, "HITS", 50)  # every way around a bound
    rng = random.Random(seed)
    part = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    unit = part(rng.randint(2, 9), "abc")
    items = {
        1: part(60, "abcd"), 2: (unit * 40)[: rng.randint(30, 90)], 3: part(24, "ab"), 4: "a" * 40, 5: part(30, "abcdefgh") + part(40, "ij"), 6: part(200, "abcdefghijk"),
    }
    items[7] = items[5][:30] + part(40, "kl")
    texts = {0: "", 1: part(300, "ab"), 2: "a" * 130, 3: unit * 60}
    for d in range(10, 40):
        pieces = [changed(rng, items[rng.randint(1, 7)], rng.choice([0, 0, 1, 2, 3, 5, 8])) for _ in range(rng.randint(1, 3))]
        texts[d] = part(rng.randint(0, 30), "abcdefgh") + part(rng.randint(0, 9), "xyz").join(pieces) + part(rng.randint(0, 30), "abcd")
    want = Counter()
    for i, item in items.items():
        most = min(len(item) // 10, (len(item) - 8) // 8)
        for d, text in texts.items():
            want.update((d, i, *x) for x in scan(item, text, most))
    assert search(items, texts) == want and len(want) > 30


def test_items_that_share_an_opening():
    """Ten thousand items with one opening, and a text that repeats it: neither memory nor time grows with their product."""
    code = """
import random, resource, numpy as np
from riskloom.llm import decontaminate as D
rng = random.Random(1)
opening = "read the passage below and then answer the question that follows it "
items = [(i, opening + "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))) for i in range(10_000)]
text = (opening * 40 + items[77][1] + " " + opening * 5).encode()
got = list(D.Items(items).search(np.frombuffer(text * 20, np.uint8), np.arange(21) * len(text)))
assert sorted((t, k) for t, k, *_ in got) == [(t, 77) for t in range(20)], len(got)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 1000


def test_invalid_bytes_and_long_texts():
    item = "the quick brown fox jumps over the lazy dog again and again"
    filler = "lorem ipsum dolor sit amet " * 8000
    got = search({1: item}, {5: filler + item + " " + filler, 6: item.upper().replace(" ", " -- ")})
    assert sorted((d, e) for d, _, _, _, e in got) == [(5, 0), (6, 0)]
    block = np.frombuffer(b"\xff\xfe " + item.encode() + b" \x80", np.uint8)
    assert [x[1] for x in decontaminate.Items([(1, item)]).search(block, np.array([0, len(block)]))] == [0]
