"""Secrets against a scan by plain loops, and planted ones among decoys."""

import hashlib
import math
import random
import re

from riskloom.llm import secrets

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LETTERS + LETTERS.upper() + "0123456789"


def base(text: str):
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 6:
            yield m.start(), 0, m.end()
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if m.end() - m.start() >= least:
                yield m.start(), k, m.end()


def entropy(value: str, threshold: float, window: int = 20):
    out = []
    for i in range(len(value) - window + 1):
        w = value[i : i + window]
        if -sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w)) >= threshold - 1e-9:
            if out and i <= out[-1][1]:
                out[-1][1] = i + window
            else:
                out.append([i, i + window])
    return out


def added(text: str):
    def allowed(v):
        return any(re.search(p, v) for p in secrets.ALLOWED)

    for m in re.finditer(r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[a-fA-F]", v) and not allowed(v):
            yield from ((m.start() + a, 3, m.start() + b) for a, b in entropy(v, 3.0))

    def such(v):
        return re.search("[G-Zg-z]", v) and (re.search("[0-9]", v) or len(re.findall("[a-z][A-Z]", v)) >= 4)

    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if such(m[0]) and not allowed(m[0]):
            at = 0
            for cut in [*re.finditer(secrets.FILLERS, m[0]), None]:
                part = m[0][at : cut.start() if cut else len(m[0])]
                if len(part) >= 20 and such(part):
                    yield from ((m.start() + at + a, 4, m.start() + at + b) for a, b in entropy(part, 3.8))
                at = cut.end() if cut else at


def planted(rng):
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kind = rng.randrange(7)
    if kind == 0:
        return "ghp_" + pick(ALNUM, 36)
    if kind == 1:
        return pick(ALNUM + "+/", 40)
    if kind == 2:
        return pick("0123456789ABCDEF", 40)
    if kind == 3:
        return f"eyJ{pick(ALNUM, 33)}.eyJ{pick(ALNUM + '_-', 60)}.{pick(ALNUM + '_-', 43)}"
    if kind == 4:
        return f"xoxb-{pick('0123456789', 12)}-{pick(ALNUM, 24)}"
    if kind == 5:
        return "SIGNING_KEY=" + pick("0123456789ABCDEF", 32)
    return "sample_" + pick(LETTERS + LETTERS.upper(), 32)


def decoy(rng):
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    kind = rng.randrange(8)
    if kind == 0:
        h = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    if kind == 1:
        return "/".join(("usr", "local", "lib", word(6), word(7) + "3", word(9)))
    if kind == 2:
        return "_".join(word(rng.randint(3, 8)) for _ in range(5)) + "_2024"
    if kind == 3:
        return "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    if kind == 4:
        return "x" * rng.randint(20, 40)
    if kind == 5:
        return "".join(word(6).capitalize() for _ in range(4))
    if kind == 6:
        return "0123456789abcdefghijklmnopqrstuvwxyz"
    return word(rng.randint(20, 30))


def texts(rng, n, token):
    filler = lambda: " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30)))
    return [f"{filler()} 😀 {token(rng)} {filler()}" for _ in range(n)]


def found(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    return {r.doc_id: r for r in secrets.scan(df).collect()}


def test_spans_by_loops(spark):
    rng = random.Random(3)
    rows = texts(rng, 150, planted) + texts(rng, 150, decoy)
    pieces = ["token=", "Secret: '", "api_key =", "AKIA", "abcdef0123456789" * 2, "example", "_", "-", "=", " ", "aaaaaaaaaa", "9F86D081884C7D659A2FEAA0C55AD015", "é", '"']
    rows += ["".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice(ALNUM + "+/_=-") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    rows += ["token = " + "deadbeef" * 4 + " ", "token = abcdef " * 1500, "", None]
    for i, r in found(spark, rows).items():
        text = rows[i] or ""
        want = sorted(base(text))
        digest = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(digest(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
        every = sorted([*want, *added(text)])
        assert r.spans == digest(every) and r.n_added == len(every) - len(want), text


def test_planted_secrets_that_no_pattern_names(spark):
    """The share of planted characters that the added spans cover, and of decoys with any."""
    rng = random.Random(11)
    secret, other = texts(rng, 400, planted), texts(rng, 400, decoy)
    rows = found(spark, secret + other)
    hit = covered = total = wrong = 0
    for i, text in enumerate(secret):
        token = text.split(" 😀 ")[1].split(" ")[0]
        at = text.index(token)
        body = token.split("=")[-1].removeprefix("sample_")  # the name before it is no secret
        spans = [tuple(map(int, s.split(":")[1:])) for s in rows[i].spans.split(",") if s.startswith("entropy")]
        mine = {k for a, b in spans for k in range(a, b)} & set(range(at + len(token) - len(body), at + len(token)))
        hit += bool(mine)
        covered += len(mine)
        total += len(body)
    wrong = sum(rows[i].n_added > 0 for i in range(400, 800))
    assert hit / 400 >= 0.98 and covered / total >= 0.9 and hit / (hit + wrong) >= 0.95, (hit, covered / total, wrong)


def test_many_matches_in_one_text(spark):
    text = "token=abcdef " * 20_000 + "AbcDefGhiJklMnoPqrStu0123" * 200
    got = found(spark, [text])[0]
    assert got.n_assign == 20_000
