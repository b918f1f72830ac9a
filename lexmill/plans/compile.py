"""From a query's tree to one DataFrame: flags for its leaves, BM25 over its positive terms, top-k."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions.ranking import bm25
from lexmill.plans import query as q
from lexmill.sources.corpus import Corpus

EXPLANATION = "array<struct<term:string,tf:int,df:bigint,score:double>>"


@dataclass(frozen=True)
class Plan:
    node: q.Node
    prefixes: dict[str, list[str]]
    positive: list[str]  # sorted
    needed: list[str]
    has_phrase: bool
    open: tuple[str, ...] = ()  # prefixes that are not expanded, sorted
    open_positive: tuple[str, ...] = ()


def plan(node: q.Node, corpus: Corpus, most_prefix_terms: int | None = q.MOST_PREFIX_TERMS) -> Plan:
    """Expands prefixes against the corpus and lists the terms that take part. With None as their limit, prefixes stay open: they may
    stand for any number of terms, which nobody lists."""
    found = q.leaves(node)
    prefixes: dict[str, list[str]] = {}
    seen: set[str] = set()
    for leaf in found:
        if isinstance(leaf, q.Prefix) and leaf.value not in prefixes and most_prefix_terms is not None:
            prefixes[leaf.value] = corpus.terms_with_prefix(leaf.value, most_prefix_terms + 1)
            seen |= set(prefixes[leaf.value])
            if len(seen) > most_prefix_terms:
                raise q.QueryError(f"the query's prefixes stand for more than {most_prefix_terms} terms")
    has_phrase = any(isinstance(x, q.Phrase) for x in found)
    if has_phrase and not corpus.positions:
        raise q.QueryError("a phrase needs an index with positions; rebuild it with another profile")
    needed = sorted({t for x in found for t in q.leaf_terms(x, prefixes)})
    opened = (tuple(sorted(q.open_prefixes(node, prefixes, positive))) for positive in (False, True))
    return Plan(node, prefixes, sorted(q.positive_terms(node, prefixes)), needed, has_phrase, *opened)


def phrase_flag(m: Column, terms: tuple[str, ...], proximity: int) -> Column:
    """Whether the terms stand in order with at most `proximity` places between them in all.

    From each place of the first term the nearest later place of each next one is taken, which makes the end as
    near as it can be. Without places between, the sets of places are met instead.
    """
    def places(t: str) -> Column:
        return m[t]["positions"]

    def fits(start: Column) -> Column:
        # Each step's place is bound before the next one looks for a later one, so a step costs one pass of its list.
        end = F.aggregate(F.array(*map(places, terms[1:])), start, lambda before, p: F.array_min(F.filter(p, lambda x: x > before))) if len(terms) > 1 else start
        return F.coalesce(end - start - (len(terms) - 1) <= F.lit(proximity), F.lit(False))

    if proximity == 0:  # neighbours: places moved on by one, met with the next term's; linear in their numbers
        there = F.size(reduce(lambda found, t: F.array_intersect(F.transform(found, lambda x: x + 1), places(t)), terms[1:], places(terms[0]))) > 0
    else:
        there = F.exists(places(terms[0]), fits)
    return F.coalesce(reduce(lambda a, b: a & b, [F.map_contains_key(m, F.lit(t)) for t in dict.fromkeys(terms)]) & there, F.lit(False))


_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def compared(c: Column, op: str, n: int) -> Column:
    if n >= 1 << 63:  # beyond any size that a column can hold
        return F.lit(op in ("!=", "<", "<="))
    return getattr(c, _COMPARE[op])(F.lit(n))


def flag(node: q.Node, prefixes: dict[str, list[str]]) -> Column:
    """A two-valued Catalyst expression over DOC_COLUMNS and m."""
    m = F.col("m")
    match node:
        case q.Term(value):
            out = F.map_contains_key(m, F.lit(value))
        case q.Prefix(value) if value not in prefixes:
            out = F.exists(F.map_keys(m), lambda t: t.startswith(value))
        case q.Prefix(value):
            terms = prefixes[value]
            out = F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, terms))) if terms else F.lit(False)
        case q.Phrase(terms, proximity):
            out = phrase_flag(m, terms, proximity)
        case q.PathGlob(pattern):
            out = tx.glob_matches(F.col("path"), pattern)
        case q.Extension(value):
            wanted = value.translate(str.maketrans(tx.UPPER, tx.LOWER))
            out = tx.extension(F.col("path")) == wanted
        case q.Size(op, n):
            out = compared(F.col("file_size"), op, n)
        case q.Mtime(op, day):
            out = compared(tx.utc_day(F.col("mtime_ns")), op, day)
        case q.Not(child):
            return ~flag(child, prefixes)
        case q.And(left, right):
            return flag(left, prefixes) & flag(right, prefixes)
        case q.Or(left, right):
            return flag(left, prefixes) | flag(right, prefixes)
    return F.coalesce(out, F.lit(False))


def matching(corpus: Corpus, p: Plan) -> DataFrame:
    """DOC_COLUMNS and m of the documents that match."""
    rows = corpus.matched(p.needed, p.has_phrase, q.can_match_nothing(p.node) or not (p.needed or p.open), p.open)
    return rows.where(flag(p.node, p.prefixes))


@dataclass(frozen=True)
class Statistics:
    n: int
    mean_length: float
    df: dict[str, int]


def statistics(corpus: Corpus, terms: list[str]) -> Statistics:
    """Of all visible documents, in one row: their number, mean length, and how many hold each term."""
    counts = [F.sum(F.map_contains_key("m", F.lit(t)).cast("long")).alias(f"df{i}") for i, t in enumerate(terms)]
    row = corpus.matched(terms, False, keep_all=True).agg(F.count("*").alias("n"), F.sum("token_count").alias("length"), *counts).first()
    n = row["n"]
    return Statistics(n, (row["length"] or 0) / n if n else 0.0, {t: row[f"df{i}"] or 0 for i, t in enumerate(terms)})


def scored(matches: DataFrame, stats: Statistics, positive: list[str]) -> DataFrame:
    """path, score and explanation; the parts are added in the order of terms, so sums are the same on any cluster."""
    if not positive:
        return matches.select("path", F.lit(0.0).alias("score"), F.expr(f"cast(array() as {EXPLANATION})").alias("explanation"))
    terms = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(stats.df[t]).cast("long").alias("df")) for t in positive))
    # m goes out of the lambda by a map lookup; absent terms have no part.
    present = F.filter(terms, lambda t: F.map_contains_key(F.col("m"), t["term"]))

    def part(t: Column) -> Column:
        tf = F.element_at(F.col("m"), t["term"])["tf"]
        score = bm25(tf.cast("double"), t["df"].cast("double"), F.col("token_count").cast("double"), F.lit(float(stats.n)), F.lit(stats.mean_length))
        return F.struct(t["term"].alias("term"), tf.alias("tf"), t["df"].alias("df"), score.alias("score"))

    rows = matches.select("path", F.transform(present, part).alias("explanation"))
    return rows.select("path", F.aggregate("explanation", F.lit(0.0), lambda a, x: a + x["score"]).alias("score"), "explanation")


def scored_open(matches: DataFrame, corpus: Corpus, p: Plan) -> DataFrame:
    """As scored(), where terms are too many to be listed: their numbers of documents are a table, joined to the terms of the matches."""
    frequencies = corpus.matched(p.positive, False, False, p.open_positive).select(F.explode(F.map_keys("m")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = statistics(corpus, [])
    # A row stays one row, also beside others of its path.
    parts = F.filter(F.map_entries("m"), lambda e: tx.one_of(e["key"], p.positive, p.open_positive))
    numbered = matches.select("path", "token_count", "m", F.monotonically_increasing_id().alias("__row"))
    rows = numbered.select("path", "token_count", "__row", F.explode_outer(parts).alias("e")).select("path", "token_count", "__row", F.col("e.key").alias("term"), F.col("e.value.tf").alias("tf")).join(frequencies, "term", "left")
    score = bm25(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("token_count").cast("double"), F.lit(float(stats.n)), F.lit(stats.mean_length))
    part = F.when(F.col("term").isNotNull(), F.struct("term", "tf", "df", score.alias("score")))
    rows = rows.groupBy("__row", "path").agg(F.sort_array(F.collect_list(part)).alias("explanation"))
    return rows.select("path", F.aggregate("explanation", F.lit(0.0), lambda a, x: a + x["score"]).alias("score"), "explanation")


def search(corpus: Corpus, expression: str, top_k: int | None = 20, most_prefix_terms: int | None = q.MOST_PREFIX_TERMS) -> DataFrame:
    """path, score, explanation of the best matches, best first; ties in byte order of path. Without top_k, all, unsorted."""
    node = q.parse_query(expression)
    p = plan(node, corpus, most_prefix_terms)
    if p.open_positive:
        out = scored_open(matching(corpus, p), corpus, p)
    else:
        stats = statistics(corpus, p.positive) if p.positive else Statistics(0, 0.0, {})
        out = scored(matching(corpus, p), stats, p.positive)
    return out if top_k is None else best(out, top_k)


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k highest scores; ties in byte order of path. Spark keeps k rows a task and merges those."""
    return rows.orderBy(F.desc("score"), F.asc("path")).limit(k)
