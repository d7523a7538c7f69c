"""The functions of a coverage export, cut out of its text.

A whole workspace is exported as one JSON document, so a document may be of any
size.  No more of it is held here than one function, or one element of what else
it lists.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

#: What the pieces of a document are cut at; it stands behind most functions and ends no document.
CUT = "},"
_SPACE = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()


class _Text:
    def __init__(self, pieces: Iterable[str]):
        self.pieces = iter(pieces)
        self.next, self.buffer, self.at = next(self.pieces, None), "", 0

    def more(self) -> bool:
        """Adds a piece to what is held and forgets what has been read."""
        if self.next is None:
            return False
        piece, self.next = self.next, next(self.pieces, None)
        self.buffer = self.buffer[self.at :] + piece + ("" if self.next is None else CUT)
        self.at = 0
        return True

    def peek(self) -> str:
        """The next character that is no white space, empty at the end."""
        while True:
            self.at = _SPACE.match(self.buffer, self.at).end()
            if self.at < len(self.buffer):
                return self.buffer[self.at]
            if not self.more():
                return ""

    def take(self, *wanted: str) -> str:
        c = self.peek()
        if c not in wanted:
            raise ValueError(f"{' or '.join(wanted)} expected, not {c or 'its end'}")
        self.at += 1
        return c

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        n = 1
        while True:
            try:
                value, end = _DECODER.raw_decode(self.buffer, self.at)
                break
            except json.JSONDecodeError as e:
                cut = e.msg.startswith("Unterminated string") or _SPACE.fullmatch(self.buffer, e.pos)
                if not cut or not self.more():
                    raise
            for _ in range(n - 1):  # twice as much each time, so that a long value is not decoded once for each of its pieces
                self.more()
            n *= 2
        text, self.at = self.buffer[self.at : end], end
        return value, text

    def items(self, opens: str, closes: str) -> Iterator[int]:
        """Stands before each item of a list in turn; the caller reads it."""
        self.take(opens)
        if self.peek() == closes:
            self.at += 1
            return
        n = 0
        while True:
            yield n
            n += 1
            if self.take(",", closes) == closes:
                return

    def members(self) -> Iterator[str]:
        """The name of each member of an object; the caller reads its value."""
        for _ in self.items("{", "}"):
            if self.peek() != '"':
                raise ValueError("a member has no name")
            name = self.value()[0]
            self.take(":")
            yield name

    def skip(self) -> None:
        if self.peek() == "[":
            for _ in self.items("[", "]"):
                self.value()
        else:
            self.value()


def functions(pieces: Iterable[str]) -> Iterator[tuple[int, int, str]]:
    """(d, f, text) of function f of entry d, from the text of a document
    between its CUTs.  What is no document of this form is a ValueError."""
    doc, data = _Text(pieces), False
    for name in doc.members():
        if name != "data" or doc.peek() == "n":  # null is as good as nothing
            doc.skip()
            continue
        data = True
        for d in doc.items("[", "]"):
            listed = False
            for name in doc.members():
                if name != "functions" or doc.peek() == "n":
                    doc.skip()
                    continue
                listed = True
                for f in doc.items("[", "]"):
                    value, text = doc.value()
                    if not isinstance(value, dict):
                        raise ValueError("a function is no object")
                    yield d, f, text
            if not listed:
                raise ValueError("a field is missing")
    if not data:
        raise ValueError("a field is missing")
    if doc.peek():
        raise ValueError("something stands behind its end")
