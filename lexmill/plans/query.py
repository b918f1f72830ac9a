"""The query language: its tree, lexer and parser.

    query   := or                           or      := and ("OR" and)*
    and     := unary (["AND"] unary)*       unary   := "NOT" unary | primary
    primary := "(" or ")" | phrase | filter | word
    phrase  := '"' text '"' ["~" integer]   word    := a bare word, at most one "*" at its end
    filter  := (path | extension | size | mtime) ":" (quoted | bare)

Places in messages are byte offsets of the UTF-8 expression.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from lexmill.functions.text import byte_size, tokenize

MOST_BYTES, MOST_DEPTH, MOST_PREFIX_TERMS = 4096, 32, 256


class QueryError(ValueError):
    pass


def at(offset: int, why: str) -> QueryError:
    return QueryError(f"query syntax error at byte {offset}: {why}")


@dataclass(frozen=True)
class Term:
    value: str


@dataclass(frozen=True)
class Prefix:
    value: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    proximity: int = 0


@dataclass(frozen=True)
class PathGlob:
    pattern: str


@dataclass(frozen=True)
class Extension:
    value: str


@dataclass(frozen=True)
class Size:
    op: str
    n: int


@dataclass(frozen=True)
class Mtime:
    op: str
    day: int


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Term | Prefix | Phrase | PathGlob | Extension | Size | Mtime | Not | And | Or
FILTERS = ("path", "extension", "size", "mtime")
_SPACE = b" \t\n\v\f\r"
_FIELD = re.compile(rb"(path|extension|size|mtime):", re.IGNORECASE)
_WILD = re.compile(r"[*?~^\[\]{}]")


@dataclass(frozen=True)
class Token:
    kind: str
    offset: int
    text: str = ""
    proximity: int = 0


def lex(raw: bytes) -> list[Token]:
    out, i = [], 0

    def quoted(i: int) -> tuple[str, int]:
        """The text that opens at raw[i] and where it is over; a backslash may stand before a quote or a backslash."""
        start, text = i, bytearray()
        i += 1
        while i < len(raw):
            c = raw[i]
            if c == 34:
                return text.decode("utf-8", "replace"), i + 1
            if c == 92:
                i += 1
                if i >= len(raw):
                    break
                if raw[i] not in b'"\\':
                    raise at(i - 1, "only a quote or a backslash can be escaped")
            text.append(raw[i])
            i += 1
        raise at(start, "a quote is not closed")

    def ends(i: int) -> bool:
        return i >= len(raw) or raw[i] in _SPACE or raw[i] == 41

    def bare(i: int) -> tuple[str, int]:
        start = i
        while i < len(raw) and raw[i] not in _SPACE and raw[i] not in b"()":
            if raw[i] == 34:
                raise at(i, "a quote inside of a word")
            i += 1
        return raw[start:i].decode("utf-8", "replace"), i

    while True:
        while i < len(raw) and raw[i] in _SPACE:
            i += 1
        if i >= len(raw):
            return [*out, Token("end", i)]
        start = i
        if raw[i] in b"()":
            out.append(Token(chr(raw[i]), i))
            i += 1
        elif raw[i] == 34:
            text, i = quoted(i)
            near = 0
            if raw[i:i + 1] == b"~":
                m = re.compile(rb"[0-9]+").match(raw, i + 1)
                if not m or int(m[0]) >= 1 << 32:
                    raise at(i, "~ needs an integer of 32 bits")
                near, i = int(m[0]), m.end()
            if not ends(i):
                raise at(i, "white space must follow a phrase")
            out.append(Token("phrase", start, text, near))
        elif m := _FIELD.match(raw, i):
            if raw[m.end():m.end() + 1] == b'"':
                text, i = quoted(m.end())
                if not ends(i):
                    raise at(i, "white space must follow a filter")
            else:
                text, i = bare(m.end())
            out.append(Token(m[1].decode().lower(), start, text))
        else:
            text, i = bare(i)
            out.append(Token(text.upper() if text.upper() in ("AND", "OR", "NOT") and text.isascii() else "word", start, text))


_COMPARISON = re.compile(r"(!=|<=|>=|=|<|>)?(.*)", re.DOTALL)


class _Parser:
    def __init__(self, raw: bytes):
        self.tokens, self.i, self.nested = lex(raw), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def parse(self) -> Node:
        if self.now.kind == "end":
            raise at(0, "the expression is empty")
        node = self.disjunction()
        if self.now.kind != "end":
            raise at(self.now.offset, "nothing can follow here")
        if depth(node) > MOST_DEPTH:
            raise QueryError(f"the query is deeper than {MOST_DEPTH}")
        return node

    def disjunction(self) -> Node:
        node = self.conjunction()
        while self.now.kind == "OR":
            self.i += 1
            node = Or(node, self.conjunction())
        return node

    def conjunction(self) -> Node:
        node = self.unary()
        while self.now.kind not in ("OR", ")", "end"):
            if self.now.kind == "AND":
                self.i += 1
            node = And(node, self.unary())
        return node

    def deeper(self) -> None:
        if self.nested >= MOST_DEPTH:
            raise QueryError(f"the query is deeper than {MOST_DEPTH}")
        self.nested += 1
        self.i += 1

    def unary(self) -> Node:
        if self.now.kind != "NOT":
            return self.primary()
        self.deeper()
        node = Not(self.unary())
        self.nested -= 1
        return node

    def primary(self) -> Node:
        token = self.now
        if token.kind == "(":
            self.deeper()
            node = self.disjunction()
            if self.now.kind != ")":
                raise at(token.offset, "a parenthesis is not closed")
            self.i += 1
            self.nested -= 1
            return node
        make = {"word": self.word, "phrase": self.phrase, **{f: self.filter for f in FILTERS}}.get(token.kind)
        if not make:
            raise at(token.offset, "an operand is missing")
        node = make(token)
        self.i += 1
        return node

    def word(self, token: Token) -> Node:
        text, kind = token.text, Term
        if wild := _WILD.search(text):
            if text[-1] != "*" or wild.start() != len(text) - 1 or len(text) < 2:
                raise at(token.offset, "a word can only have one *, at its end")
            text, kind = text[:-1], Prefix
        terms = tokenize(text)
        if len(terms) != 1:
            raise at(token.offset, "a word must hold exactly one term")
        return kind(terms[0])

    def phrase(self, token: Token) -> Node:
        terms = tokenize(token.text)
        if not terms:
            raise at(token.offset, "the phrase holds no terms")
        return Phrase(tuple(terms), token.proximity)

    def filter(self, token: Token) -> Node:
        text = token.text
        if not text:
            raise at(token.offset, "the filter has no value")
        if token.kind == "path":
            return PathGlob(text)
        if token.kind == "extension":
            if text == "." or "/" in text or "\\" in text:
                raise at(token.offset, "not an extension")
            return Extension(text.removeprefix("."))
        op, operand = _COMPARISON.fullmatch(text).groups()
        if token.kind == "size":
            try:
                return Size(op or "=", byte_size(operand))
            except OverflowError:
                raise
            except ValueError as e:
                raise at(token.offset, str(e)) from e
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", operand, re.ASCII):
            raise at(token.offset, "a day is written YYYY-MM-DD")
        try:
            day = datetime.date.fromisoformat(operand).toordinal() - 719_163
        except ValueError as e:
            raise at(token.offset, "there is no such day") from e
        return Mtime(op or "=", day)


def parse_query(expression: str) -> Node:
    raw = expression.encode("utf-8", "surrogateescape")
    if len(raw) > MOST_BYTES:
        raise QueryError(f"the query is longer than {MOST_BYTES} bytes")
    return _Parser(raw).parse()


def children(node: Node) -> tuple[Node, ...]:
    return (node.child,) if isinstance(node, Not) else (node.left, node.right) if isinstance(node, And | Or) else ()


def depth(node: Node) -> int:
    return 1 + max((depth(c) for c in children(node)), default=0)


def leaves(node: Node) -> list[Node]:
    below = children(node)
    return [x for c in below for x in leaves(c)] if below else [node]


def positive_terms(node: Node, prefixes: dict[str, list[str]], negated: bool = False) -> set[str]:
    """The terms that score: all below an even number of NOTs, whether or not they match."""
    if isinstance(node, Not):
        return positive_terms(node.child, prefixes, not negated)
    if below := children(node):
        return set().union(*(positive_terms(c, prefixes, negated) for c in below))
    return set() if negated else set(leaf_terms(node, prefixes))


def leaf_terms(node: Node, prefixes: dict[str, list[str]]) -> list[str]:
    if isinstance(node, Term):
        return [node.value]
    if isinstance(node, Prefix):
        return prefixes.get(node.value, [])
    return list(node.terms) if isinstance(node, Phrase) else []


def open_prefixes(node: Node, prefixes: dict[str, list[str]], positive: bool = False, negated: bool = False) -> set[str]:
    """The prefixes that are not expanded; `positive`: those whose terms score."""
    if isinstance(node, Not):
        return open_prefixes(node.child, prefixes, positive, not negated)
    if below := children(node):
        return set().union(*(open_prefixes(c, prefixes, positive, negated) for c in below))
    return {node.value} if isinstance(node, Prefix) and node.value not in prefixes and not (positive and negated) else set()


def can_match_nothing(node: Node) -> bool:
    """Whether a document without any of the query's terms may match."""

    def of(n: Node) -> tuple[bool, bool]:
        """(may be true, may be false) for such a document."""
        if isinstance(n, Not):
            t, f = of(n.child)
            return f, t
        if isinstance(n, And):
            a, b = of(n.left), of(n.right)
            return a[0] and b[0], a[1] or b[1]
        if isinstance(n, Or):
            a, b = of(n.left), of(n.right)
            return a[0] or b[0], a[1] and b[1]
        return (False, True) if isinstance(n, Term | Prefix | Phrase) else (True, True)

    return of(node)[0]
