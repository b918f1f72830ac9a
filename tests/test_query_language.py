import fnmatch
import random

import pytest

from lexmill.functions import text as tx
from lexmill.plans import query as q
from lexmill.plans.query import And, Extension, Mtime, Not, Or, PathGlob, Phrase, Prefix, Size, Term, parse_query


def test_precedence_and_associativity():
    a, b, c, d = map(Term, "abcd")
    assert parse_query("a OR b AND NOT c") == Or(a, And(b, Not(c)))
    assert parse_query("a b or c d") == Or(And(a, b), And(c, d))
    assert parse_query("a b c") == And(And(a, b), c)
    assert parse_query("(a OR b) not c") == And(Or(a, b), Not(c))
    assert parse_query("a(b)c") == And(And(a, b), c)


def test_operands():
    assert parse_query("TimeOut") == Term("timeout")
    assert parse_query("-foo.") == Term("foo")
    assert parse_query("Ab_1*") == Prefix("ab_1")
    assert parse_query('"Foo-bar baz"~12') == Phrase(("foo", "bar", "baz"), 12)
    assert parse_query('"and"') == Phrase(("and",))
    assert parse_query("path:src/*.c") == PathGlob("src/*.c")
    assert parse_query('PATH:"a (b)\\"\\\\"') == PathGlob('a (b)"\\')
    assert parse_query("extension:.Md") == Extension("Md")
    assert parse_query("size:>=2KiB") == Size(">=", 2048)
    assert parse_query("size:0") == Size("=", 0)
    assert parse_query("size:!=18446744073709551615") == Size("!=", (1 << 64) - 1)
    assert parse_query("mtime:<2024-02-29") == Mtime("<", 19782)
    assert parse_query("mtime:1969-12-31") == Mtime("=", -1)


@pytest.mark.parametrize(
    "bad",
    ["", "  ", "*", "a*b", "a?", "a**", "foo-bar", "é", '"a b"~', '"a b"~4294967296', '"a"b', "a AND", "OR a", "NOT", "(a OR b", "a)", '"a', '""', "path:", "a(",
     "extension:.", "extension:a/b", "size:1MB", "size:", "size:1kib", "size:-1", "mtime:2023-02-29", "mtime:0000-01-01", "mtime:2024-1-01", "a" * 4097, "NOT " * 32 + "a",
     "(" * 33 + "a" + ")" * 33, " ".join("a" * 33), 'path:"a\\b"', 'a"b"'],
)
def test_errors(bad):
    with pytest.raises(ValueError):
        parse_query(bad)


def test_limits():
    parse_query("a" * 256)
    with pytest.raises(ValueError):
        parse_query("a" * 257)
    parse_query(" ".join("a" * 32))
    parse_query("NOT " * 31 + "a")
    with pytest.raises(OverflowError):
        parse_query("size:18446744073709551616")
    with pytest.raises(OverflowError):
        parse_query("size:99999999999TiB")
    with pytest.raises(ValueError, match="byte 2"):
        parse_query("a *")


def test_positive_terms():
    def of(e):
        return q.positive_terms(parse_query(e), {"al": ["alpha", "alps"]})

    assert of("a NOT b") == {"a"}
    assert of("NOT NOT a") == {"a"}
    assert of('NOT (a OR NOT "b c") path:x') == {"b", "c"}
    assert of("al* OR NOT al*") == {"alpha", "alps"}


def test_can_match_nothing():
    for e, want in {"a": False, "NOT a": True, "a OR size:1": True, "a size:1": False, "NOT extension:md": True, "NOT NOT a": False, "NOT (a path:x)": True}.items():
        assert q.can_match_nothing(parse_query(e)) == want, e


def test_globs():
    for p, s, want in [
        ("*.txt", "a/b.txt", True), ("?.c", "/.c", True), ("???.txt", "é1.txt", True), ("?.txt", "é.txt", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[^a-c]x", "dx", True),
        ("[]a]", "]", True), ("[a-]", "-", True), ("[", "[", True), ("a\\*", "a*", True), ("a\\*", "ab", False), ("a\\", "a", False), ("[[:digit:]]x", "5x", True), ("[c-a]", "b", False), ("a*", "a\nb", True), ("*", "", True),
    ]:
        assert tx.glob_match(s, p) == want, (p, s)
    rng = random.Random(2)
    for _ in range(3000):
        p = "".join(rng.choice("ab*?.") for _ in range(rng.randrange(6)))
        s = "".join(rng.choice("ab./") for _ in range(rng.randrange(6)))
        assert tx.glob_match(s, p) == fnmatch.fnmatchcase(s, p), (p, s)


def test_tokens_and_snippets():
    assert tx.tokenize("Timeout retry_policy HTTP2") == ["timeout", "retry_policy", "http2"]
    assert tx.tokenize("camelCase 中文 end \u212a") == ["camelcase", "end"]
    assert tx.snippet_of("one\r\ntwo é unique\n", {"unique"}) == (2, "two é unique")
    assert tx.snippet_of("one\n", {"no"}) is None
    assert tx.snippet_of("", set()) is None and tx.snippet_of("\nx", set()) == (1, "")
    long = tx.snippet_of("token " + "é" * 300, {"token"})[1]
    assert len(long.encode()) <= 240 and long.endswith("...")
    with pytest.raises(ValueError):
        tx.tokenize("x" * 257)


def test_crc32c():
    from lexmill.functions.checksum import crc32c

    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    assert crc32c(b"6789", crc32c(b"12345")) == 0xE3069283
