"""Tokens of Rust source text."""

from __future__ import annotations

import re

class RustSyntaxError(ValueError):
    pass


class Token(str):
    """As it stands in the source; equal tokens differ by their lines only."""

    __slots__ = ("kind", "text", "joint", "raw", "word")

    #: kind: ident, life, int, float, str, char, byte, bytes, punct, open, close, end
    #: joint: the next character follows without a space; word: the text, where it can be part of the grammar
    def __new__(cls, kind: str, text: str, joint: bool, raw: bool = False):
        t = str.__new__(cls, ("r#" if raw else "") + text + ("" if joint else " "))
        t.kind, t.text, t.joint, t.raw = kind, text, joint, raw
        t.word = text if kind in PLAIN and not raw else None
        return t


class Piece:
    """Tokens of a part of a line; *statement* is what the parser makes of them, once it has met them as one."""

    __slots__ = ("tokens", "n", "statement", "closed")

    def __init__(self, tokens: tuple[Token, ...]):
        self.tokens, self.n, self.statement, self.closed = tokens, len(tokens), None, False


PLAIN = frozenset(("ident", "punct", "open", "close"))
_SIGNS = "-+*/%^!&|=<>@.,;:#$?~"
#: What ends with a semicolon or a balanced bracket before a space, two brackets deep at most: a statement, where one begins.
_STATEMENT = r"[^;{}]{0,200}+(?:;|\{(?:[^{}]++|\{[^{}]*+\})*+\})(?=\s)"
#: Names, signs and plain numbers with the spaces behind them.
_TOKEN = r"(?<![\w'])[^\W\d]\w*+\s*+|[-+*/%^!&|=<>@.,;:#$?~()\[\]{}]\s*+|(?<![\w.])[0-9]++(?![\w.])\s*+"
_TOKENS = re.compile(_TOKEN)
#: The same, or a whole statement, at the beginning of a line or behind what ends one.
_PARTS = re.compile(rf"(?:^|(?<=[;{{}}]\s)){_STATEMENT}\s*+|{_TOKEN}")
_KEPT, _PIECE_LENGTH = 20_000, 400
_IDENT = re.compile(r"[^\W\d]\w*")
_RAW_STRING = re.compile(r"(b|c)?r(#*)\"")
_QUOTED = re.compile(r'(b|c)?"(?:[^"\\]|\\.)*"', re.S)
_CHAR = re.compile(r"(b)?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))'", re.S)
_LIFE = re.compile(r"'(?:r#)?[^\W\d]\w*")
_NUMBER = re.compile(r"0x[0-9a-fA-F_]+\w*|0o[0-7_]+\w*|0b[01_]+\w*|\d[\d_]*")
_SUFFIX = re.compile(r"[^\W\d]\w*")


def tokens(source: str, pieces: dict[int, Piece] | None = None) -> tuple[list[Token], list[int], list[int]]:
    """Tokens, the lines they begin in and the lines they end in; *pieces* takes those that begin at a token's index."""
    pieces = {} if pieces is None else pieces
    out: list[Token] = []
    lines: list[int] = []
    ends: list[int] = []
    at, n, line = 0, len(source), 1
    if source.startswith("﻿"):
        at = 1
    if source.startswith("#!", at) and not re.match(r"#!\s*\[", source[at:]):
        at = source.find("\n", at)
        at = n if at < 0 else at
    while at < n:  # a line begins here, or the source
        end = source.find("\n", at)
        end = n if end < 0 else end
        n_known = _line(source[at:end], out, pieces)
        if n_known < 0:
            at, line = _step_by_step(source, at, line, out, lines, ends)
        else:
            numbers = [line] * n_known
            lines += numbers
            ends += numbers
            at, line = end + 1, line + 1
    line = 1 + source.count("\n")
    out.append(Token("end", "", False))
    lines.append(line)
    ends.append(line)
    return out, lines, ends


class _Known(dict):
    """Tokens, and pieces of several, by their text with the spaces behind it: equal ones are made once."""

    def __missing__(self, text: str):
        got = _made(text)
        if len(self) >= _KEPT:
            self.clear()
        if len(text) <= _PIECE_LENGTH:
            self[text] = got
        return got


_KNOWN = _Known()


def _made(text: str) -> Token | Piece | None:
    m = _IDENT.match(text)
    end = m.end() if m else 1
    if end == len(text) or text[end:].isspace():
        kind = "ident" if m else "open" if text[0] in "([{" else "close" if text[0] in ")]}" else "int" if text[0].isdigit() else "punct"
        return Token(kind, text[:end], end == len(text))
    if text.rstrip().isdigit():
        return Token("int", text.rstrip(), not text[-1].isspace())
    parts = _TOKENS.findall(text)
    return Piece(tuple([_KNOWN[p] for p in parts])) if len("".join(parts)) == len(text) else None


def _line(text: str, out: list[Token], pieces: dict[int, Piece]) -> int:
    """Adds the tokens of a line that has no quotes, and no comments in brackets; how many, or -1 where more has to be known."""
    if '"' in text or "'" in text or "/*" in text or "r#" in text:
        return -1
    if "//" in text:
        cut = text.index("//")
        if cut and not text[cut - 1].isspace():
            return -1  # it joins what is before
        text = text[:cut]
    text = text.strip() + " "
    parts = _PARTS.findall(text)
    if len("".join(parts)) != len(text):
        return 0 if text == " " else -1
    first, known = len(out), _KNOWN
    if ";" not in text and "}" not in text:  # no statement
        out += [known[part] for part in parts]
        return len(parts)
    for part in parts:
        got = known[part]
        if got.__class__ is Token:
            out.append(got)
        elif got is None:
            for i in range(first, len(out)):
                pieces.pop(i, None)
            del out[first:]
            return -1
        else:
            pieces[len(out)] = got
            out += got.tokens
    return len(out) - first


def _step_by_step(source: str, at: int, line: int, out: list, lines: list, ends: list) -> tuple[int, int]:
    """Adds tokens up to the end of a line that ends no token's midst; where it stops."""
    n = len(source)

    def add(kind: str, end: int, text: str | None = None, raw: bool = False):
        nonlocal at, line
        got = source[at:end]
        last = line + got.count("\n")
        joint = end < n and not source[end].isspace()
        out.append(Token(kind, got if text is None else text, joint, raw))
        lines.append(line)
        ends.append(last)
        at, line = end, last

    while at < n:
        c = source[at]
        if c == "\n":
            return at + 1, line + 1
        if c.isspace():
            at += 1
        elif c not in "bcr" and (m := _IDENT.match(source, at)):  # those may begin a string
            add("ident", m.end())
        elif source.startswith("//", at):
            end = source.find("\n", at)
            at = n if end < 0 else end
        elif source.startswith("/*", at):
            depth, i = 1, at + 2
            while depth:
                a, b = source.find("/*", i), source.find("*/", i)
                if b < 0:
                    raise RustSyntaxError(f"line {line}: comment without end")
                if 0 <= a < b:
                    depth, i = depth + 1, a + 2
                else:
                    depth, i = depth - 1, b + 2
            line += source.count("\n", at, i)
            at = i
        elif m := _RAW_STRING.match(source, at):
            end = source.find('"' + m[2], m.end())
            if end < 0:
                raise RustSyntaxError(f"line {line}: string without end")
            add("bytes" if m[1] else "str", end + 1 + len(m[2]))
        elif (c == '"' or c in "bc" and source.startswith('"', at + 1)) and (m := _QUOTED.match(source, at)):
            add("bytes" if m[1] else "str", m.end())
        elif (c == "'" or source.startswith("b'", at)) and (m := _CHAR.match(source, at)):
            add("byte" if m[1] else "char", m.end())
        elif c == "'" and (m := _LIFE.match(source, at)):
            add("life", m.end())
        elif source.startswith("r#", at) and (m := _IDENT.match(source, at + 2)):
            add("ident", m.end(), m[0], True)
        elif m := _IDENT.match(source, at):
            add("ident", m.end())
        elif c.isdigit():
            m = _NUMBER.match(source, at)
            end, kind = m.end(), "int"
            field = out and out[-1].text == "." and out[-1].kind == "punct" and out[-1].joint and (len(out) < 2 or out[-2].text != ".")
            if not m[0].startswith(("0x", "0o", "0b")) and not field:
                if source.startswith(".", end) and not source.startswith("..", end) and not _IDENT.match(source, end + 1):
                    kind, end = "float", end + 1
                    while end < n and (source[end].isdigit() or source[end] == "_"):
                        end += 1
                if e := re.compile(r"[eE][+-]?[\d_]+").match(source, end):
                    kind, end = "float", e.end()
                if s := _SUFFIX.match(source, end):
                    kind, end = "float" if s[0] in ("f32", "f64") else kind, s.end()
            add(kind, end)
        elif c in "([{":
            add("open", at + 1)
        elif c in ")]}":
            add("close", at + 1)
        elif c in "+-*/%^!&|=<>@.,;:#$?~":
            add("punct", at + 1)
        else:
            raise RustSyntaxError(f"line {line}: unexpected {c!r}")
    return at, line
