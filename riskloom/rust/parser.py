"""A recursive-descent parser for Rust that yields syntax nodes.

Nodes keep what the metrics need: kind, name, operator, lines and children in
source order.  Arguments of macros stay opaque.  Assumptions where the language
definition leaves room: a negative literal pattern is a literal, an inner
``cfg(test)`` attribute counts for its module, and a macro that is a statement
is no expression.
"""

from __future__ import annotations

import gc
import sys
from bisect import bisect_right

from .lexer import Piece, RustSyntaxError, Token, tokens

# Fixed values of the language: binary operators by how tightly they bind.
_BINARY = {"||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}
_OPERATORS = frozenset([*_BINARY, *_ASSIGN, "..", "..=", "=>", "->", "::", "..."])
#: How far the grammar looks ahead of a token that it is at, at most, unless it stops at the end.
AHEAD = 8
#: What makes one token more part of a statement that could end in a block.
_GOES_ON = frozenset((".", "?", "else", ";"))
#: Statements of one line by their tokens: equal ones are parsed once.  Their lengths by their first two tokens.
_SHARED: dict = {}
_LENGTHS: dict = {}
_SHARED_KEPT, _SHARED_TOKENS = 10_000, 64
#: What stands between the name of a function and the body that begins at the end of the line, by its tokens.
_SIGNATURES: dict = {}
_SIGNATURES_KEPT = 5_000
_BLOCKS = frozenset(("block", "if", "match", "loop", "while", "for"))
#: Words of items, whose place in a file matters, or of types that may look for a word behind them.
_UNSHARED = frozenset("fn struct enum union mod use trait impl static type pub const extern unsafe async safe default auto macro_rules".split())
NUMERIC = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split())
_FN_WORDS = {"const", "async", "unsafe", "safe", "extern", "default"}


class Node:
    __slots__ = ("kind", "name", "op", "line", "end_line", "children", "data")

    def __init__(self, kind: str, line: int, children=(), name=None, op=None, **data):
        self.kind, self.name, self.op, self.line, self.end_line = kind, name, op, line, line
        self.children, self.data = list(children), data


class Shared:
    """A statement that stands elsewhere too, in the place of its node."""

    __slots__ = ("statement", "line")
    kind = "shared"

    def __init__(self, statement: Node, line: int):
        self.statement, self.line = statement, line


class Signature:
    """What a function's inputs and output say; its text has OWN where the context belongs."""

    __slots__ = ("text", "refers", "boxes", "line", "loose")

    def __init__(self, inputs, output, line: int):
        self.text, self.refers, self.boxes = signature_text(inputs, output, OWN), referenced_type(inputs), boxes_error(output)
        self.line, self.loose = line, ()


class Parser:
    def __init__(self, source: str):
        self.pieces: dict[int, Piece] = {}
        self.t, self.lines, self.ends = tokens(source, self.pieces)
        self.i, self.loose, self.n = 0, [], len(self.t)
        self.t += [self.t[-1]] * AHEAD

    # Tokens.
    def fail(self, wanted: str):
        t = self.peek()
        raise RustSyntaxError(f"line {self.line()}: expected {wanted}, found {t.text or 'end of file'!r}")

    def peek(self, k: int = 0) -> Token:
        return self.t[self.i + k]

    def line(self) -> int:
        return self.lines[self.i if self.i < self.n else -1]

    def is_(self, text: str, k: int = 0) -> bool:
        return self.t[self.i + k].word == text

    def next(self) -> Token:
        if self.i >= self.n:
            self.fail("more")
        self.i += 1
        return self.t[self.i - 1]

    def eat(self, text: str) -> bool:
        if self.t[self.i].word == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.is_(text):
            self.fail(repr(text))
        return self.next()

    def op(self) -> str:
        """The longest operator that begins here."""
        t = self.peek()
        if t.kind != "punct":
            return ""
        run = t.text  # as many as stand without a space between, three at most
        while t.joint and len(run) < 3:
            t = self.peek(len(run))
            if t.kind != "punct":
                break
            run += t.text
        while len(run) > 1 and run not in _OPERATORS:
            run = run[:-1]
        return run

    def eat_op(self, o: str) -> bool:
        if self.op() == o:
            self.i += len(o)
            return True
        return False

    def ident(self) -> str:
        if self.peek().kind != "ident":
            self.fail("a name")
        return self.next().text

    def group(self) -> tuple[int, int]:
        """Passes over a bracketed group; the range of tokens inside."""
        if self.peek().kind != "open":
            self.fail("a bracket")
        first, depth = self.i + 1, 0
        while True:
            t = self.next()
            depth += (t.kind == "open") - (t.kind == "close")
            if t.kind == "end":
                self.i -= 1
                self.fail("a closing bracket")
            if not depth:
                return first, self.i - 1

    # Attributes.
    def attributes(self, inner: bool = False) -> list[tuple[str, list[str]]]:
        """(path, arguments) of each; arguments are the plain names of a list, if
        it is one.  *inner*: only those of what they stand in, as #![...]."""
        out = []
        while self.is_("#") and (not inner and self.is_("[", 1) or self.is_("!", 1) and self.is_("[", 2)):
            self.i += 1
            self.eat("!")
            a, b = self.group()
            inside = self.t[a:b]
            path, args = "".join(t.text for t in inside), []
            cut = next((k for k, t in enumerate(inside) if t.kind == "open" or t.text == "="), None)
            if cut is not None:
                path = "".join(t.text for t in inside[:cut])
                part, listed = [], inside[cut + 1 : -1]
                if inside[cut].text == "(":
                    if any(t.kind not in ("ident",) and t.text not in (",", ":") for t in listed):
                        listed = []  # not a list of paths
                    for t in [*listed, None]:
                        if t is None or t.text == ",":
                            args.append("".join(part))
                            part = []
                        else:
                            part.append(t.text)
            out.append((path, args))
        return out

    # Types: plain tuples; expressions in them go to self.loose.
    def type_(self, plus: bool = True):
        if self.eat("("):
            items, comma = [], False
            while not self.is_(")"):
                items.append(self.type_())
                comma = self.eat(",")
                if not comma:
                    break
            self.need(")")
            # One type in parentheses without a comma is no tuple.
            return ("tuple", items) if comma or len(items) != 1 else ("other",)
        if self.eat("["):
            inner = self.type_()
            if self.eat(";"):
                self.loose.append(self.expr())
                self.need("]")
                return ("other",)
            self.need("]")
            return ("slice", inner)
        if self.eat("!"):
            return ("other",)
        if self.eat("_"):
            return ("other",)
        if self.is_("*") and (self.is_("const", 1) or self.is_("mut", 1)):
            self.i += 2
            self.type_(False)
            return ("other",)
        if self.eat("&"):
            if self.eat("&"):
                return ("ref", False, self._reference())
            return self._reference(True)
        if self.is_("impl") or self.is_("dyn") and not self.is_("::", 1) and (self.peek(1).kind in ("ident", "life") or self.peek(1).text in ("(", "?", "for")):
            word = self.next().text
            bounds = self.bounds(plus)
            return ("impl",) if word == "impl" else ("dyn", bounds)
        if self.is_("for") and self.is_("<", 1):
            self.i += 1
            self.generics()
            if self.is_("fn") or self.peek().text in ("unsafe", "extern"):
                return self.type_(plus)
            self.bounds(plus)
            return ("other",)
        if self.is_("fn") or (self.is_("unsafe") or self.is_("extern")) and any(self.is_("fn", k) for k in (1, 2, 3)):
            while not self.eat("fn"):
                self.next()
            self.need("(")
            while not self.eat(")"):
                self.attributes()
                if self.op() == "...":
                    self.i += 3
                else:
                    if self.peek().kind == "ident" and self.is_(":", 1) and not self.is_(":", 2):
                        self.i += 2
                    self.type_()
                self.eat(",")
            if self.eat_op("->"):
                self.type_(False)
            return ("other",)
        path = self.path(True)
        if self.is_("!") and not self.is_("=", 1):
            self.i += 1
            self.group()
            return ("other",)
        if plus and self.is_("+"):
            while self.eat("+"):
                if self.peek().kind in ("ident", "life") or self.peek().text in ("?", "(", "for", "~", ":", "<"):
                    self.bound()
            return ("other",)
        return ("path", path)

    def _reference(self, first: bool = False):
        if self.peek().kind == "life":
            self.i += 1
        mutable = self.eat("mut")
        return ("ref", mutable, self.type_(False))

    def bounds(self, plus: bool = True) -> list[str]:
        out = []
        while self.peek().kind in ("ident", "life") or self.peek().text in ("?", "(", "~", "<") or self.op() == "::":
            out.append(self.bound())
            if not (plus and self.eat("+")):
                break
        return out

    def bound(self) -> str:
        """The last name of a trait bound, empty for anything else."""
        if self.peek().kind == "life":
            self.i += 1
            return ""
        if self.eat("("):
            name = self.bound()
            self.need(")")
            return name
        self.eat("?")
        if self.eat("~"):
            self.need("const")
        if self.is_("use") and self.is_("<", 1):
            self.i += 1
            self.generics()
            return ""
        if self.eat("for"):
            self.generics()
        self.eat("async")
        return self.path(True)[-1][0]

    def path(self, in_type: bool) -> list[tuple[str, list, bool]]:
        """(name, type arguments, in angle brackets) of each segment."""
        out = []
        if self.eat("<"):  # <T as Trait>::name
            self.type_()
            if self.eat("as"):
                out = self.path(True)
            self._close_angle()
        elif self.op() == "::":
            pass
        else:
            out.append(self._segment(in_type))
        while self.op() == "::":
            self.i += 2
            out.append(self._segment(in_type)) if not self.is_("<") else out.__setitem__(-1, (out[-1][0], self._angle(), True))
        return out

    def _segment(self, in_type: bool):
        name = self.ident()
        if in_type and self.is_("<") and self.op() != "<=":
            return name, self._angle(), True
        if in_type and self.is_("(") :
            self.i += 1
            while not self.eat(")"):
                self.type_()
                self.eat(",")
            if self.eat_op("->"):
                self.type_(False)
            return name, [], False
        if self.op() == "::" and self.is_("<", 2):
            self.i += 2
            return name, self._angle(), True
        return name, [], False

    def _close_angle(self):
        if not self.eat(">"):
            self.fail("'>'")

    def _angle(self) -> list:
        """Type arguments of <...>; lifetimes, constants and bindings are passed over."""
        self.need("<")
        out = []
        while not self.is_(">"):
            t = self.peek()
            if t.kind == "life":
                self.i += 1
            elif t.kind in ("int", "float", "str", "char", "byte", "bytes") or self.is_("-") or self.is_("{") or t.text in ("true", "false") and t.kind == "ident":
                if self.is_("{"):
                    self.loose.append(self.block())
                else:
                    self.eat("-")
                    self.next()
            else:
                kind = self.type_()
                if self.is_("=") :
                    self.i += 1
                    if self.is_("{"):
                        self.loose.append(self.block())
                    elif self.peek().kind in ("int", "str", "char"):
                        self.next()
                    else:
                        self.type_()
                elif self.is_(":") and not self.is_(":", 1):
                    self.i += 1
                    self.bounds()
                else:
                    out.append(kind)
            if not self.eat(","):
                break
        self._close_angle()
        return out

    def generics(self):
        """Passes over the parameters in <...> of a declaration."""
        if not self.is_("<"):
            return
        depth = 0
        while True:
            if self.op() == "->":
                self.i += 2
                continue
            t = self.peek()
            if t.kind == "open":
                self.group()
                continue
            if t.kind == "end":
                self.fail("'>'")
            self.i += 1
            depth += (t.text == "<" and t.kind == "punct") - (t.text == ">" and t.kind == "punct")
            if not depth:
                return

    def where(self):
        if self.eat("where"):
            while not (self.is_("{") or self.is_(";") or self.is_("=") and self.op() == "="):
                if self.peek().kind == "open":
                    self.group()
                elif self.peek().kind == "end":
                    self.fail("'{'")
                else:
                    self.i += len(self.op()) or 1 if self.op() in ("->", "==", "::") else 1

    # Patterns: whether one is a literal; expressions in them go to self.loose.
    def pattern(self) -> bool:
        self.eat("|")
        literal = self.one_pattern()
        while self.is_("|") and self.op() != "||":
            self.i += 1
            literal |= self.one_pattern()
        return literal

    def _range_end(self) -> bool:
        if self.op() not in ("..", "..=", "..."):
            return False
        self.i += len(self.op())
        if self.peek().kind in ("int", "float", "char", "byte", "ident", "str") and not self.is_("if") or self.is_("-") or self.op() == "::":
            self.eat("-")
            if self.peek().kind == "ident" or self.op() == "::":
                self.path(False)
            else:
                self.next()
        return True

    def one_pattern(self) -> bool:
        self.attributes()
        t = self.peek()
        if t.kind in ("int", "float", "str", "char", "byte", "bytes") or self.is_("-"):
            if self.eat("-"):
                t = self.peek()
            self.next()
            return not self._range_end() and t.kind in ("int", "str", "char")
        if self.op() in ("..", "..=", "..."):
            self._range_end()
        elif self.op() == "&&":
            self.i += 2
            self.eat("mut")
            self.one_pattern()
        elif self.eat("&"):
            self.eat("mut")
            self.one_pattern()
        elif t.text in ("(", "["):
            self.i += 1
            close = ")" if t.text == "(" else "]"
            while not self.eat(close):
                self.pattern()
                if not self.eat(","):
                    self.need(close)
                    break
        elif self.is_("_"):
            self.i += 1
        elif self.is_("const") and self.is_("{", 1):
            self.i += 1
            self.loose.append(self.block())
        elif t.kind == "ident" or t.text == "<" or self.op() == "::":
            if self.is_("box") and self.peek(1).kind == "ident":
                self.i += 1
                return self.one_pattern() and False
            named = False
            while self.is_("ref") or self.is_("mut"):
                self.i += 1
                named = True
            if named or self.peek().kind == "ident" and self.is_("@", 1):
                self.ident()
                if self.eat("@"):
                    self.one_pattern()
                return False
            self.path(False)
            if self.is_("!"):
                self.i += 1
                self.group()
            elif self.is_("("):
                self.i += 1
                while not self.eat(")"):
                    self.pattern()
                    if not self.eat(","):
                        self.need(")")
                        break
            elif self.is_("{"):
                self.i += 1
                while not self.eat("}"):
                    self.attributes()
                    if self.op() == "..":
                        self.i += 2
                    elif (self.peek().kind in ("ident", "int")) and self.is_(":", 1) and not self.is_(":", 2):
                        self.i += 2
                        self.pattern()
                    else:
                        self.one_pattern()
                    self.eat(",")
            else:
                self._range_end()
        else:
            self.fail("a pattern")
        return False

    def drained(self, mark: int) -> list[Node]:
        """Expressions that types and patterns have left since *mark*."""
        out, self.loose[mark:] = self.loose[mark:], []
        return out

    # Expressions.
    def expr(self, least: int = 0, struct: bool = True) -> Node:
        self.attributes()
        left = self._prefix(least, struct)
        return self._binary(left, least, struct)

    def _binary(self, left: Node, least: int, struct: bool) -> Node:
        while True:
            o = self.op()
            if self.is_("as"):
                if least > 12:
                    return left
                self.i += 1
                mark = len(self.loose)
                kind = self.type_(False)
                name = kind[1][-1][0] if kind[0] == "path" and len(kind[1]) == 1 and not kind[1][0][2] else None
                left = Node("cast", left.line, [left, *self.drained(mark)], name)
            elif o in _BINARY:
                p = _BINARY[o]
                if p < least:
                    return left
                self.i += len(o)
                right = self.expr(p + 1, struct)
                left = Node("binary", left.line, [left, right], op=o)
            elif o in ("..", "..="):
                if least > 2:
                    return left
                self.i += len(o)
                children = [left]
                if self._begins(struct):
                    children.append(self.expr(3, struct))
                left = Node("range", left.line, children)
            elif o in _ASSIGN:
                if least > 1:
                    return left
                self.i += len(o)
                right = self.expr(1, struct)
                left = Node("assign" if o == "=" else "binary", left.line, [left, right], op=o)
            else:
                return left

    def _begins(self, struct: bool) -> bool:
        """Whether an expression begins here."""
        t = self.peek()
        if t.kind in ("end", "close"):
            return False
        if t.kind == "punct":
            return t.text in "-*!&|<" and self.op() != "=>" or self.op() == "::"
        return not (self.is_("{") and not struct) and not (self.is_("as") or self.is_("else"))

    def _prefix(self, least: int, struct: bool) -> Node:
        t, o, at = self.peek(), self.op(), self.line()
        if t.text in ("-", "!", "*") and t.kind == "punct":
            self.i += 1
            return Node("unary", at, [self.expr(13, struct)], op=t.text)
        if t.text == "&" and t.kind == "punct":
            self.i += 2 if o.startswith("&&") else 1
            if self.is_("raw") and (self.is_("const", 1) or self.is_("mut", 1)):
                self.i += 2
            else:
                self.eat("mut")
            inner = Node("reference", at, [self.expr(13, struct)])
            return Node("reference", at, [inner]) if o.startswith("&&") else inner
        if o in ("..", "..="):
            self.i += len(o)
            return Node("range", at, [self.expr(3, struct)] if self._begins(struct) else [])
        if self._closure_ahead():
            return self.closure(struct)
        if t.kind == "ident" and not t.raw:
            if t.text == "let":
                self.i += 1
                mark = len(self.loose)
                self.pattern()
                self.need("=")
                return Node("let_expr", at, [*self.drained(mark), self.expr(5, struct)])
            if t.text in ("return", "break", "yield", "become"):
                self.i += 1
                if t.text == "break" and self.peek().kind == "life" and not self.is_(":", 1):
                    self.i += 1
                return Node(t.text, at, [self.expr(1, struct)] if self._begins(struct) else [])
            if t.text == "continue":
                self.i += 1
                if self.peek().kind == "life":
                    self.i += 1
                return Node("continue", at)
        return self._postfix(self._primary(struct))

    def _closure_ahead(self) -> bool:
        k = 0
        if self.is_("for") and self.is_("<", 1):
            return True
        while self.peek(k).kind == "ident" and self.peek(k).text in ("static", "async", "move", "const"):
            k += 1
        return self.peek(k).kind == "punct" and self.peek(k).text == "|"

    def closure(self, struct: bool) -> Node:
        line, mark = self.line(), len(self.loose)
        if self.eat("for"):
            self.generics()
        while self.peek().kind == "ident":
            self.i += 1
        self.need("|")
        while not self.eat("|"):
            self.attributes()
            self.one_pattern()
            if self.eat(":"):
                self.type_()
            self.eat(",")
        if self.eat_op("->"):
            self.type_(False)
            body = self.block()
        else:
            body = self.expr(1, struct)
        return Node("closure", line, [*self.drained(mark), body])

    def _postfix(self, left: Node) -> Node:
        while True:
            if self.eat("?"):
                left = Node("try", left.line, [left])
            elif self.is_("(") :
                left = Node("call", left.line, [left, *self.arguments()], left.name if left.kind == "path" else None)
            elif self.is_("["):
                self.i += 1
                index = self.expr()
                self.need("]")
                left = Node("index", left.line, [left, index])
            elif self.is_(".") and self.op() not in ("..", "..=", "..."):
                self.i += 1
                if self.eat("await"):
                    left = Node("await", left.line, [left])
                elif self.peek().kind in ("int", "float"):
                    self.next()
                    left = Node("field", left.line, [left])
                else:
                    name, mark = self.ident(), len(self.loose)
                    if self.op() == "::":
                        self.i += 2
                        self._angle()
                    if self.is_("("):
                        left = Node("method_call", left.line, [left, *self.drained(mark), *self.arguments()], name)
                    else:
                        left = Node("field", left.line, [left], name)
            else:
                return left

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.eat(")"):
            out.append(self.expr())
            if not self.eat(","):
                self.need(")")
                break
        return out

    def _primary(self, struct: bool) -> Node:
        t, at = self.peek(), self.line()
        if t.kind in ("int", "float", "str", "char", "byte", "bytes"):
            self.i += 1
            return Node("literal", at, op=t.kind)
        if t.kind == "life":
            self.i += 1
            self.need(":")
            return self._block_like() or self.fail("a loop or block")
        if t.text == "(" and t.kind == "open":
            self.i += 1
            items, comma = [], False
            while not self.is_(")"):
                items.append(self.expr())
                comma = self.eat(",")
                if not comma:
                    break
            self.need(")")
            return Node("tuple" if comma or len(items) != 1 else "paren", at, items)
        if t.text == "[" and t.kind == "open":
            self.i += 1
            items = []
            while not self.is_("]"):
                items.append(self.expr())
                if not (self.eat(",") or self.eat(";")):
                    break
            self.need("]")
            return Node("array", at, items)
        if (node := self._block_like()) is not None:
            return node
        if t.kind == "ident" or t.text == "<" or self.op() == "::":
            mark = len(self.loose)
            path = self.path(False)
            name = path[-1][0] if path else None
            if self.is_("!") and self.op() != "!=":
                self.i += 1
                brace = self.is_("{")
                a, b = self.group()
                return Node("macro", at, name=name if len(path) == 1 else None, op="{" if brace else "", empty=a == b)
            if struct and self.is_("{"):
                return Node("struct_literal", at, [*self.drained(mark), *self.fields()])
            return Node("path", at, self.drained(mark), name)
        self.fail("an expression")

    def fields(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.eat("}"):
            self.attributes()
            if self.op() == "..":
                self.i += 2
                if not self.is_("}"):
                    out.append(self.expr())
            else:
                self.next()
                if self.eat(":"):
                    out.append(self.expr())
            if not self.eat(","):
                self.need("}")
                break
        return out

    def _block_like(self) -> Node | None:
        """If, match, loops and blocks."""
        t = self.peek()
        if t.kind == "life" and self.is_(":", 1):
            self.i += 2
        t, at = self.peek(), self.line()
        if self.is_("{"):
            return self.block()
        if t.kind != "ident" or t.raw:
            return None
        if t.text in ("unsafe", "const") and self.is_("{", 1) or t.text == "async" and (self.is_("{", 1) or self.is_("move", 1) and self.is_("{", 2)) or t.text == "try" and self.is_("{", 1):
            self.i += 2 if self.is_("move", 1) else 1
            return self.block()
        if t.text == "if":
            self.i += 1
            children = [self.expr(0, False), self.block()]
            if self.eat("else"):
                children.append(self._block_like() or self.fail("a block"))
            return Node("if", at, children)
        if t.text == "while":
            self.i += 1
            return Node("while", at, [self.expr(0, False), self.block()])
        if t.text == "loop":
            self.i += 1
            return Node("loop", at, [self.block()])
        if t.text == "for" and not self.is_("<", 1):
            self.i += 1
            mark = len(self.loose)
            self.pattern()
            self.need("in")
            return Node("for", at, [*self.drained(mark), self.expr(0, False), self.block()])
        if t.text == "match":
            self.i += 1
            children = [self.expr(0, False)]
            self.need("{")
            self.attributes(True)
            while not self.eat("}"):
                self.attributes()
                line, mark = self.line(), len(self.loose)
                literal = self.pattern()
                arm = self.drained(mark)
                if self.eat("if"):
                    arm.append(self.expr())
                if not self.eat_op("=>"):
                    self.fail("'=>'")
                block = self.is_("{")
                arm.append(self.statement_expr() if block else self.expr())
                children.append(Node("arm", line, arm, literal=literal))
                if not self.eat(",") and not self.is_("}") and arm[-1].kind not in ("block", "if", "match", "loop", "while", "for"):
                    self.fail("','")
            return Node("match", at, children)
        return None

    def statement_expr(self) -> Node:
        """An expression where one with a block ends at the block."""
        node = self._block_like()
        if node is None:
            return self.expr()
        if self.is_("?") or self.is_(".") and self.op() == ".":
            return self._binary(self._postfix(node), 0, True)
        return node

    def block(self) -> Node:
        node = Node("block", self.line())
        self.need("{")
        t, pieces, children = self.t, self.pieces, node.children
        while True:
            i = self.i
            piece = pieces.get(i)
            if piece is not None and piece.statement is not None and (piece.closed or t[i + piece.n].word not in _GOES_ON):
                children.append(Shared(piece.statement, self.lines[i]))
                self.i = i + piece.n
            elif self.is_("}"):
                break
            elif not self.eat(";"):
                children += self.shared() or self.statement_to_share()
        node.end_line = self.ends[self.i]
        self.next()
        return node

    def shared(self) -> list[Node] | None:
        """A statement met before, with lines counted from its own."""
        i, t = self.i, self.t
        for n in _LENGTHS.get((t[i], t[i + 1]), ()):
            node = _SHARED.get(tuple(t[i : i + n]))
            if node is not None and (node.data["closed"] or t[i + n].word not in _GOES_ON):
                self.i += n
                self._of_piece(i, node)
                return [Shared(node, self.lines[i])]
        return None

    def _of_piece(self, i: int, node: Node):
        """Keeps the statement *node*, which ends here, with the piece that begins at *i*, if they are the same tokens."""
        piece = self.pieces.get(i)
        if piece is not None and piece.n == self.i - i:
            piece.statement, piece.closed = node, node.data["closed"]

    def statement_to_share(self) -> list[Node]:
        i, loose, line = self.i, len(self.loose), self.line()
        got = self.statement()
        n = self.i - i
        key = self.t[i : self.i]
        closed = key[-1].word == ";"
        if n > _SHARED_TOKENS or len(got) != 1 or len(self.loose) != loose or self.ends[self.i - 1] != line:
            return got
        if not closed and (got[0].kind not in _BLOCKS or self.t[self.i].word in _GOES_ON) or any(t.word in _UNSHARED for t in key):
            return got
        if len(_SHARED) >= _SHARED_KEPT:
            _SHARED.clear()
            _LENGTHS.clear()
        _SHARED[tuple(key)] = node = Node("statement", line, got, closed=closed, summary=summary(got[0]))
        self._of_piece(i, node)
        lengths = _LENGTHS.setdefault((self.t[i], self.t[i + 1]), [])
        if n not in lengths:
            lengths.append(n)
        return got

    def statement(self) -> list[Node]:
        start = self.i
        attributes = self.attributes()
        if self.is_("let"):
            line, mark = self.line(), len(self.loose)
            self.next()
            self.pattern()
            if self.eat(":"):
                self.type_()
            children = self.drained(mark)
            if self.eat("="):
                children.append(self.expr())
                if self.eat("else"):
                    children.append(self.block())
            self.need(";")
            return [Node("let", line, children)]
        if self._item_ahead():
            self.i = start
            return self.item()
        node = self.statement_expr()
        if node.kind == "macro" and (self.is_(";") or node.op == "{"):
            node.kind = "macro_statement"
        ended = node.kind in ("block", "if", "match", "loop", "while", "for", "macro_statement")
        if not self.eat(";") and not self.is_("}") and not ended:
            self.fail("';'")
        return [node]

    # Items.
    def _item_ahead(self) -> bool:
        t, after = self.peek(), self.peek(1)
        if t.kind != "ident" or t.raw:
            return False
        if t.text in ("fn", "struct", "enum", "mod", "use", "trait", "impl", "static", "type", "pub"):
            return not (t.text == "static" and after.text in ("|", "move", "async"))
        if t.text == "const":
            return (after.kind == "ident" and after.text not in ("move", "async") or after.text == "_") or after.text == "async" and self.peek(2).text in ("fn", "unsafe")
        if t.text == "unsafe":
            return after.text in ("fn", "impl", "trait", "extern", "mod")
        if t.text == "async":
            return after.text in ("fn", "unsafe", "extern")
        if t.text == "extern":
            return True
        if t.text == "union" or t.text == "auto" or t.text == "safe" or t.text == "default":
            return after.kind == "ident" and after.text not in ("as",)
        return t.text == "macro_rules" and after.text == "!"

    def visibility(self):
        if self.eat("pub") and self.is_("(") and self.peek(1).text in ("crate", "self", "super", "in"):
            self.group()

    def file(self) -> list[Node]:
        out = []
        self.attributes(True)
        while self.peek().kind != "end":
            if not self.eat(";"):
                out.extend(self.item())
        return out

    def item(self, inside: str = "") -> list[Node]:
        """One item; *inside* is 'trait' or 'impl' for associated ones."""
        attributes = self.attributes()
        self.visibility()
        t, at = self.peek(), self.line()
        k = 0
        while self.peek(k).text in _FN_WORDS and self.peek(k).kind == "ident" or k and self.peek(k).kind == "str":
            k += 1
        if self.is_("fn", k):
            self.i += k + 1
            return [self.function(attributes, inside)]
        while self.peek().text in ("unsafe", "auto", "default", "safe") and self.peek().kind == "ident" and self.peek(1).kind == "ident":
            self.i += 1
        word = self.peek().text
        if word in ("struct", "union", "enum") and self.peek(1).kind == "ident":
            self.i += 1
            name = self.ident()
            self.generics()
            self.where()
            if self.is_("(") :
                self.group()
                self.where()
                self.need(";")
            elif self.is_("{"):
                self.group()
            else:
                self.need(";")
            return [Node(word, at, name=name)]
        if word == "impl":
            self.i += 1
            if self.is_("<") and not self._path_after_impl():
                self.generics()
            self.eat("const")
            self.eat("!")
            mark, first = len(self.loose), self.type_(False)
            trait = None
            if self.eat("for"):
                trait, first = first, self.type_()
            self.where()
            own = first[1][-1][0] if first[0] == "path" else "_"
            context = own if trait is None else f"<{own} as {trait[1][-1][0] if trait[0] == 'path' else '_'}>"
            loose = self.drained(mark)
            return [Node("impl", at, [*loose, *self._body("impl")], context=context)]
        if word == "trait":
            self.i += 1
            name = self.ident()
            self.generics()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.bounds()
                self.where()
                self.need(";")
                return []
            self.where()
            return [Node("trait", at, self._body("trait"), name=name, context=name)]
        if word == "mod":
            self.i += 1
            name = self.ident()
            if self.eat(";"):
                return []
            self.need("{")
            attributes += self.attributes(True)
            children = []
            while not self.eat("}"):
                if not self.eat(";"):
                    children.extend(self.item())
            return [Node("mod", at, children, name=name, attributes=attributes)]
        if word in ("const", "static") and not self.is_("{", 1):
            self.i += 1
            self.eat("mut")
            self.generics()
            self.next()
            mark = len(self.loose)
            if self.eat(":"):
                self.type_()
            children = self.drained(mark)
            if self.eat("="):
                children.append(self.expr())
            self.where()
            self.need(";")
            return [Node("constant", at, children)]
        if word == "extern" and (self.is_("{", 1) or self.peek(1).kind == "str" and self.is_("{", 2)):
            while not self.is_("{"):
                self.next()
            self.group()
            return []
        if word in ("use", "type") or word == "extern":
            while not self.eat(";"):
                if self.peek().kind == "open":
                    self.group()
                elif self.next().kind == "end":
                    self.i -= 1
                    self.fail("';'")
            return []
        if t.kind == "ident" or self.op() == "::":  # a macro
            self.path(False)
            self.need("!")
            if self.peek().kind == "ident":
                self.i += 1
            brace = self.is_("{")
            self.group()
            if not brace:
                self.need(";")
            return [Node("macro_item", at)]
        self.fail("an item")

    def _path_after_impl(self) -> bool:
        """Whether 'impl <' begins a qualified type and not parameters."""
        k, depth = 0, 0
        while self.peek(k).kind != "end":
            depth += self.is_("<", k) - (self.is_(">", k) and not self.is_("-", k - 1))
            if not depth:
                return self.is_(":", k + 1) and self.is_(":", k + 2)
            k += 1
        return False

    def _body(self, inside: str) -> list[Node]:
        self.need("{")
        self.attributes(True)
        out = []
        while not self.eat("}"):
            if not self.eat(";"):
                out.extend(self.item(inside))
        return out

    def function(self, attributes, inside: str) -> Node:
        t, at = self.peek(), self.line()
        name = self.ident()
        signature = self.signature(at)
        node = Node("fn", at, [Shared(x, x.line + at - signature.line) for x in signature.loose], name, attributes=attributes, signature=signature, inside=inside, body=False)
        if not self.eat(";"):
            body = self.block()
            node.children.append(body)
            node.data["body"] = True
            node.end_line = max(at, body.end_line)
        return node

    def signature(self, at: int) -> Signature:
        """What stands between a function's name and its body; equal ones that fill their line up to the body's bracket are parsed once."""
        i, mark = self.i, len(self.loose)
        end = bisect_right(self.lines, at, i, self.n) - 1
        key = tuple(self.t[i:end]) if i < end and self.t[end].word == "{" else None
        known = _SIGNATURES.get(key)
        if known is not None:
            self.i = end
            return known
        self.generics()
        self.need("(")
        inputs = []
        while not self.eat(")"):
            self.attributes()
            if not inputs and (got := self._receiver()) is not None:
                inputs.append(("self", got))
            elif self.op() == "...":
                self.i += 3
            else:
                self.pattern()
                self.need(":")
                if self.op() == "...":
                    self.i += 3
                else:
                    inputs.append(("typed", self.type_()))
            if not self.eat(","):
                self.need(")")
                break
        output = self.type_() if self.eat_op("->") else None
        self.where()
        out = Signature(inputs, output, at)
        out.loose = [Node("statement", x.line, [x], summary=summary(x)) for x in self.drained(mark)]
        if key is not None and self.i == end and not any(t.word in ("unsafe", "extern") for t in key):
            if len(_SIGNATURES) >= _SIGNATURES_KEPT:
                _SIGNATURES.clear()
            _SIGNATURES[key] = out
        return out

    def _receiver(self) -> bool | None:
        """Whether self is mutable; None if the first input is no receiver."""
        k = 0
        if self.is_("&"):
            k += 1
            if self.peek(k).kind == "life":
                k += 1
        mutable = self.is_("mut", k)
        k += mutable
        if not self.is_("self", k) or self.is_(":", k + 1) and self.is_(":", k + 2):
            return None
        self.i += k + 1
        if self.eat(":"):
            self.type_()
        return mutable


# What a function's signature says.
#: Stands for a context that is not known yet; no name has it.
OWN = "\0"


def type_text(kind, context: str | None) -> str:
    if kind[0] == "path":
        name, args, _ = kind[1][-1]
        base = context if name == "Self" and context is not None else name
        return f"{base}<{','.join(type_text(a, context) for a in args)}>" if args else base
    if kind[0] == "ref":
        return ("&mut " if kind[1] else "&") + type_text(kind[2], context)
    if kind[0] == "tuple":
        return "(" + ",".join(type_text(a, context) for a in kind[1]) + ")"
    if kind[0] == "slice":
        return f"[{type_text(kind[1], context)}]"
    return "impl_" if kind[0] == "impl" else "_"


def signature_text(inputs, output, context: str | None) -> str:
    own = "Self" if context is None else context
    parts = [("&mut " if x else "&") + own if kind == "self" else type_text(x, context) for kind, x in inputs]
    return f"({','.join(parts)})->{type_text(output, context) if output else '()'}"


def boxes_error(kind) -> bool:
    """Whether a return type holds Box<dyn ...Error...>, through generics only."""
    if not kind or kind[0] != "path":
        return False
    name, args, _ = kind[1][-1]
    if name == "Box" and any(a[0] == "dyn" and "Error" in a[1] for a in args):
        return True
    return any(boxes_error(a) for a in args)


def referenced_type(inputs) -> str | None:
    """The type of a first parameter &T or &mut T."""
    if inputs and inputs[0][0] == "typed" and inputs[0][1][0] == "ref" and inputs[0][1][2][0] == "path":
        return inputs[0][1][2][1][-1][0]
    return None


def has(attributes, path: str, arg: str | None = None, only: bool = False) -> bool:
    return any(p == path and (arg is None or (args == [arg] if only else arg in args)) for p, args in attributes)


# What the metrics take from a node.
#: Node kinds that add a branch, besides lazy boolean operators.
BRANCHES = frozenset(("if", "arm", "while", "for", "loop", "try"))
COMPARISONS = frozenset(("<", "<=", ">", ">=", "==", "!=", "+", "-", "*", "/", "%"))
#: Fingerprint token of a node kind; other kinds say nothing.
TOKENS = {"if": "if", "match": "match", "arm": "arm", "while": "while", "for": "for", "loop": "loop", "return": "return", "try": "?", "call": "call", "method_call": "method", "binary": "binop", "unary": "unop", "assign": "assign", "closure": "closure", "let": "let"}
#: Kinds that the metrics take something from.
_TELLING = frozenset((*TOKENS, "macro"))


def casts(node: Node) -> bool:
    return any(c.kind == "cast" and c.name in NUMERIC for c in node.children)


def on_literals(node: Node) -> bool:
    """Whether two arms of a match or more are literals."""
    return sum(c.kind == "arm" and c.data["literal"] for c in node.children) >= 2


def finding(node: Node) -> str | None:
    """The idiom rule that a node breaks."""
    kind, name = node.kind, node.name
    if kind == "binary":
        return "PrimitiveCastInComparison" if node.op in COMPARISONS and casts(node) else None
    if kind == "match":
        return "MatchOnLiteral" if on_literals(node) else None
    if kind == "macro":
        return "EmptyVecMacro" if name == "vec" and node.data["empty"] else None
    if kind == "method_call" and name == "unwrap":
        return "Unwrap"
    if kind == "call" and name == "drop":
        return "ExplicitDrop"
    return "FromIterInsteadOfCollect" if kind in ("call", "method_call") and name == "from_iter" else None


def branches(node: Node) -> bool:
    return node.kind in BRANCHES or node.kind == "binary" and node.op in ("&&", "||")


class Summary:
    """Of nodes in pre-order: how many, their kinds, and what those outside closures say of the functions around them."""

    __slots__ = ("nodes", "kinds", "branches", "tokens", "rules")

    def __init__(self):
        self.nodes, self.kinds, self.branches, self.tokens, self.rules = 0, set(), 0, [], []

    def add(self, node: Node, at: int):
        self.branches += branches(node)
        if token := TOKENS.get(node.kind):
            self.tokens.append(token)
        if rule := finding(node):
            self.rules.append((at, rule))

    def extend(self, more: Summary, at: int):
        self.branches += more.branches
        self.tokens += more.tokens
        if more.rules:
            self.rules += [(at + p, rule) for p, rule in more.rules]


def summary(top: Node) -> Summary:
    out, todo = Summary(), [(top, True)]
    while todo:
        node, counts = todo.pop()
        if node.kind == "shared":
            inner = node.statement.data["summary"]
            if counts:
                out.extend(inner, out.nodes)
            out.nodes += inner.nodes
            out.kinds |= inner.kinds
            continue
        if counts:
            out.add(node, out.nodes)
        out.nodes += 1
        out.kinds.add(node.kind)
        counts = counts and node.kind != "closure"
        todo.extend((c, counts) for c in reversed(node.children))
    return out


def rows(source: str, allowance: str, kinds=None) -> list[dict]:
    """Flat rows of a file, in pre-order: all, or those of *kinds*.  Functions that allow the lint *allowance* are not emitted.  ``owners`` are the functions around a
    node with no closure between; a closure itself belongs to its owners.  A function's own row sums up the nodes that it owns."""
    limit, collects = sys.getrecursionlimit(), gc.isenabled()
    sys.setrecursionlimit(max(limit, 20_000))
    gc.disable()  # trees have no cycles
    try:
        return _rows(Parser(source).file(), allowance, kinds)
    finally:
        sys.setrecursionlimit(limit)
        if collects:
            gc.enable()


def _rows(top: list[Node], allowance: str, kinds) -> list[dict]:
    out: list[dict] = []
    functions: list[tuple[dict, Summary]] = []
    structs = set()
    pre = -1
    # Sums are those of the owners. Lines of a statement that stands elsewhere too are moved by *shift*.
    todo = [(n, None, [], (), None, False, True, 0) for n in reversed(top)]
    while todo:
        node, parent, owners, sums, context, hidden, at_top, shift = todo.pop()
        kind = node.kind
        if kind == "shared":
            statement = node.statement
            said = statement.data["summary"]
            if kinds is None or not said.kinds.isdisjoint(kinds):
                todo.append((statement.children[0], parent, owners, sums, context, hidden, False, node.line + shift - statement.line))
            else:
                for one in sums:
                    one.extend(said, pre + 1)
                pre += said.nodes
            continue
        d = node.data
        pre += 1
        at = pre
        if kind in _TELLING:
            for one in sums:
                one.add(node, pre)
        wanted = kinds is None or kind in kinds
        if wanted:
            row = {"pre": pre, "parent": parent, "kind": kind, "name": node.name, "op": node.op, "line": node.line + shift, "end_line": node.end_line + shift, "owners": owners, "context": context}
            out.append(row)
        if kind == "fn":
            skip = has(d["attributes"], "test") or has(d["attributes"], "allow", allowance)
            owners = [*owners, pre]
            if wanted:
                signature = d["signature"]
                row["emitted"] = d["body"] and not hidden and not skip
                row["is_free"] = not d["inside"]
                row["sig_fp"] = signature.text.replace(OWN, "Self" if context is None else context)
                row["ref_type_name"], row["ret_box_dyn_error"] = signature.refers, signature.boxes
                said = Summary()
                functions.append((row, said))
                sums = (*sums, said)
            # What is skipped takes its nested functions along, but for trait functions.
            hidden = hidden or skip and d["inside"] != "trait"
        elif kind in ("impl", "trait"):
            context = d["context"]
        elif kind == "mod":
            hidden = hidden or has(d["attributes"], "cfg", "test", True)
        elif kind == "closure":
            owners, sums = [], ()
        elif kind == "struct":
            if at_top:
                structs.add(node.name)
            if wanted:
                row["at_top"] = at_top
        elif not wanted:
            pass
        elif kind == "match":
            row["lit_match"] = on_literals(node)
        elif kind == "arm":
            row["lit_pattern"] = d["literal"]
        elif kind == "binary":
            row["casts"] = casts(node)
        elif kind == "macro":
            row["macro_empty"] = d["empty"]
        children = node.children
        if kind == "block" and kinds is not None:  # statements at its beginning that hold no row are summed up at once
            n = 0
            for c in children:
                if c.kind != "shared":
                    break
                said = c.statement.data["summary"]
                if not said.kinds.isdisjoint(kinds):
                    break
                for one in sums:
                    one.extend(said, pre + 1)
                pre += said.nodes
                n += 1
            children = children[n:]
        if children:
            todo += [(c, at, owners, sums, context, hidden, False, shift) for c in reversed(children)]
    for row, said in functions:
        row["on_struct"] = row["ref_type_name"] in structs
        rules = said.rules
        if row["is_free"] and row["on_struct"]:
            rules.append((-2, "FreeMethodCandidate"))
        if row["ret_box_dyn_error"]:
            rules.append((-1, "BoxDynError"))
        row["branches"], row["tokens"], row["checks"] = said.branches, " ".join(said.tokens), [r for _, r in sorted(rules)]
    return out
