"""Spans of regular expressions with Spark's own functions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, even where then uses it inside of other lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(a: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(a, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out")), lambda acc: acc["out"])


def running_sums(a: Column) -> Column:
    """The inclusive running sums of an array of longs, in blocks: an array is only copied within its block."""

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(_BLOCK)).cast("int") - 1), lambda b: _running(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(blocks, lambda bs: let(_running(F.transform(bs, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.zip_with(bs, ends, lambda x, e: F.transform(x, lambda y: y + e - F.element_at(x, -1))))))

    return let(a, lambda v: F.when(F.size(v) <= _BLOCK, _running(v)).otherwise(blocked(v)))


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a Java pattern that never matches nothing: array of (start, end, value), in code points.

    The text between the matches comes from split(), which finds the same ones; the lengths add up to the places.
    """
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")

    def placed(m: Column) -> Column:
        between = F.split(text, pattern, -1)
        lengths = F.zip_with(m, F.slice(between, F.lit(1), F.size(m)), lambda x, p: (F.length(x) + F.length(p)).cast("long"))
        return F.zip_with(m, running_sums(lengths), lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes Luhn."""
    r = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters A-Z and digits, the first four moved to the end, leave 1 modulo 97."""
    s = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c < 58, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
