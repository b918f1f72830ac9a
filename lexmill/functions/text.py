"""Text primitives: tokens, glob patterns, path parts, days. All give Catalyst expressions or plain Python values."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_]+"
MOST_TOKEN_BYTES = 256
DAY_NS = 86_400_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PY_TOKEN = re.compile(TOKEN, re.ASCII)


def tokens(text: Column) -> Column:
    """The terms of a text in order. They are cut out first and lowered after: lowering first could make ASCII of other letters."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def one_of(term: Column, terms: Iterable[str], prefixes: Iterable[str] = ()) -> Column:
    """Whether a term is one of terms or begins with one of prefixes."""
    return reduce(lambda found, p: found | term.startswith(p), prefixes, term.isin(list(terms)))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are worked out once a row. The optimizer copies the expression of a plain column into each use,
    also into filters below and into lambdas, where it runs for each element; it doesn't look into a generator."""
    for name, value in values.items():
        df = df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
    return df


def tokenize(text: str) -> list[str]:
    found = [t.lower() for t in _PY_TOKEN.findall(text)]
    for t in found:
        if len(t) > MOST_TOKEN_BYTES:
            raise ValueError(f"a token of {len(t)} bytes is longer than {MOST_TOKEN_BYTES}")
    return found


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


_POSIX = {
    "alnum": lambda b: chr(b).isalnum(), "alpha": lambda b: chr(b).isalpha(), "blank": lambda b: b in (9, 32), "cntrl": lambda b: b < 32 or b == 127,
    "digit": lambda b: 48 <= b <= 57, "graph": lambda b: 32 < b < 127, "lower": lambda b: 97 <= b <= 122, "print": lambda b: 31 < b < 127,
    "punct": lambda b: 32 < b < 127 and not chr(b).isalnum(), "space": lambda b: b == 32 or 9 <= b <= 13, "upper": lambda b: 65 <= b <= 90,
    "xdigit": lambda b: chr(b) in "0123456789abcdefABCDEF",
}


def _bracket(p: bytes, i: int) -> tuple[str, int] | None:
    """The class that opens at p[i] and where the pattern goes on, or None if it never closes."""
    k = i + 1
    negated = k < len(p) and p[k] in b"!^"
    k += negated
    members: set[int] = set()
    first = True
    while True:
        if k >= len(p):
            return None
        if p[k] == 93 and not first:
            break
        first = False
        named = re.compile(rb"\[:([a-z]+):\]").match(p, k)
        if named:
            if (name := named[1].decode()) not in _POSIX:
                raise ValueError(f"unknown character class [:{name}:]")
            members |= {b for b in range(128) if _POSIX[name](b)}
            k = named.end()
            continue
        if p[k:k + 2] in (b"[.", b"[="):
            raise ValueError("collating symbols are not supported in patterns")
        if p[k] == 92:
            k += 1
            if k >= len(p):
                return None
        low, k = p[k], k + 1
        if k + 1 < len(p) and p[k] == 45 and p[k + 1] != 93:
            k += 1
            if p[k] == 92:
                k += 1
                if k >= len(p):
                    return None
            members |= set(range(low, p[k] + 1))
            k += 1
        else:
            members.add(low)
    shown = "".join(f"\\x{b:02x}" for b in sorted(members))
    if negated:
        return (f"[^{shown}]" if members else "."), k + 1
    return (f"[{shown}]" if members else "(?!)"), k + 1


def glob_regex(pattern: str) -> str:
    """An anchored expression for the bytes of a path, each seen as one Latin-1 character.

    `*` and `?` match any bytes, `/` too; a lone backslash at the end makes a pattern that matches nothing.
    """
    p, out, i = pattern.encode("utf-8", "surrogateescape"), [], 0
    while i < len(p):
        c = p[i]
        if c == 42:
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == 63:
            out.append(".")
        elif c == 92:
            i += 1
            if i >= len(p):
                return r"\A(?!)"
            out.append(f"\\x{p[i]:02x}")
        elif c == 91 and (found := _bracket(p, i)):
            out.append(found[0])
            i = found[1]
            continue
        else:
            out.append(f"\\x{c:02x}")
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_matches(path: Column, pattern: str) -> Column:
    return F.decode(F.encode(path, "UTF-8"), "ISO-8859-1").rlike(glob_regex(pattern))


def glob_match(path: str, pattern: str) -> bool:
    """The same on the driver."""
    return re.search(glob_regex(pattern).replace(r"\z", r"\Z"), path.encode("utf-8", "surrogateescape").decode("latin-1")) is not None


def extension(path: Column) -> Column:
    """Without the dot, A-Z lowered: what follows the last dot of the file name, unless that dot leads it."""
    name = F.regexp_extract(path, r"(?s)([^/]*)\z", 1)
    return ascii_lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1))


def utc_day(mtime_ns: Column) -> Column:
    """Days since the epoch, rounded down also before it."""
    whole = mtime_ns - F.pmod(mtime_ns, F.lit(DAY_NS))
    return F.call_function("div", whole, F.lit(DAY_NS))


SNIPPET_BYTES = 240


def shortened(line: str) -> str:
    raw = line.encode("utf-8")
    if len(raw) <= SNIPPET_BYTES:
        return line
    cut = SNIPPET_BYTES - 3
    while cut and raw[cut] & 0xC0 == 0x80:
        cut -= 1
    return raw[:cut].decode("utf-8") + "..."


def snippet_of(text: str, terms: set[str]) -> tuple[int, str] | None:
    """The first line with one of the terms (any line will do if there are none), counted from 1, and its beginning."""
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        if n < len(lines):
            line = line[:-1] if line.endswith("\r") else line
        elif not line:
            return None
        if not terms or not terms.isdisjoint(tokenize(line)):
            return n, shortened(line)
    return None


_UNITS = {"": 1, "B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}


def byte_size(text: str, positive: bool = False, what: str = "size") -> int:
    """An integer with an optional IEC suffix, in bytes."""
    m = re.fullmatch(r"([0-9]+)(B|KiB|MiB|GiB|TiB)?", text, re.ASCII)
    if not m:
        raise ValueError(f"{what} must be an integer with an optional suffix of B, KiB, MiB, GiB or TiB")
    n = int(m[1]) * _UNITS[m[2] or ""]
    if n >= 1 << 64:
        raise OverflowError(f"{what} is beyond 64 bits")
    if positive and n == 0:
        raise ValueError(f"{what} must be positive")
    return n
