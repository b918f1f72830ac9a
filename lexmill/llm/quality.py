"""Quality rules, with host-level verdicts.

Each document is held against four rules. The failures of a host's documents are counted by rule, and each rate is
shrunk towards the corpus by that rule's beta prior, which is fitted to all hosts (method of moments), so that a host
of few documents is judged by little more than the prior. A host one of whose shrunk rates, less `margin` posterior
standard deviations, still exceeds `most` is rejected, and its verdict is joined back to its documents. Two of the
rules also reject a document by itself; symbols and repeated lines are no fault of one document, only of a host
given to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import read_table, slices, written

_SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a text; a null one has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), 0, 0, 0
    # Code points are the bytes that don't continue one.
    chars = int(np.count_nonzero((np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else []
    repeat = 0
    if n > WINDOW:
        ids: dict[bytes, int] = {}
        x = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n)
        # The windows' numbers: pairs of numbers of half as long windows, told apart exactly.
        length = 1
        while length < WINDOW:
            pair = x[:-length] * (int(x.max()) + 1) + x[length:]
            x = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            length *= 2
        twice = np.bincount(x)[x] > 1
        if twice.any():
            mark = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(mark[:n])))
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, max(1, len(lines))


def measured(docs: DataFrame, host_col: str) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            m = [measures(t) for t in batch.column(2).to_pylist()]
            cols = list(zip(*m)) if m else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def rules(least_words: int = 20, most_repeat: int = 30, most_symbols: int = 10, most_dup_lines: int = 30) -> dict:
    """What fails each rule: too few words; percents of repeated words, of symbols to words and of repeated lines. Without words, the last two hold."""
    n = F.col("n_words")
    return {
        "words": n < least_words,
        "repeats": 100 * F.col("n_repeat_words") > most_repeat * n,
        "symbols": (n > 0) & (100 * F.col("n_symbols") > most_symbols * n),
        "lines": 100 * F.col("n_dup_lines") > most_dup_lines * F.col("n_lines"),
    }


BY_ITSELF = ("words", "repeats")


def _strength(docs: float, failed: float, hosts: int, ss: float, nn: float) -> tuple[float, float]:
    """Mean and strength (a + b) of a beta prior: from the variance between hosts in excess of binomial noise; where there is none, hosts are alike and the strength is large."""
    mean = min(max(failed / docs if docs else 0.0, 1e-6), 1 - 1e-6)
    spare = docs - nn / docs - (hosts - 1) if docs else 0.0
    tau2 = (ss - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / spare if hosts > 1 and spare > 0 else 0.0
    return mean, max(mean * (1 - mean) / tau2 - 1, 2.0) if tau2 > 0 else 1e6


def hosts(rows: DataFrame, failed: dict, most: float, margin: float) -> DataFrame:
    """Per host: host, n, rates (shrunk, by rule), host_failed. Counts are exact; the priors' moments come from all hosts, in one row."""
    per = written(rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(f"f_{r}") for r, c in failed.items())))
    n = F.col("n")
    sums = [x for r in failed for x in (F.sum(f"f_{r}").alias(f"k_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"ss_{r}"))]
    m = per.agg(F.sum("n").alias("docs"), F.count("*").alias("hosts"), F.sum(n * n).alias("nn"), *sums).first()
    rates, bad = [], F.lit(False)
    for r in failed:
        mean, strength = _strength(m["docs"] or 0, m[f"k_{r}"] or 0, m["hosts"], m[f"ss_{r}"] or 0.0, m["nn"] or 0)
        post = (F.col(f"f_{r}") + mean * strength) / (n + strength)
        rates.append(post.alias(r))
        bad = bad | (post - margin * F.sqrt(post * (1 - post) / (n + strength + 1)) > most)
    return per.select("host", "n", F.struct(*rates).alias("rates"), bad.alias("host_failed"))


def quality(docs: DataFrame, host_col: str = "source", most: float = 0.5, margin: float = 2.0, **limits) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, host_rates (by rule), host_failed, kept; limits: those of rules().

    A document fails by the first two rules alone. It is kept if neither it nor its host fails. A null text has no
    words; a null host is the host ''. Every row has its own result, whatever repeats and however long its text; other
    columns are ignored; an empty table gives an empty result. A host may hold any share of the rows: its counts are
    combined before the shuffle, and the hosts are written, so that their size decides how they are joined.
    """
    rows = written(measured(docs, host_col))
    failed = rules(**limits)
    base = F.lit(False)
    for r in BY_ITSELF:
        base = base | failed[r]
    by_host = written(hosts(rows, failed, most, margin).select("host", F.col("rates").alias("host_rates"), "host_failed"))
    out = rows.join(by_host, "host", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", base.alias("base_failed"), "host_rates", "host_failed", (~base & ~F.col("host_failed")).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; for null, empty, repeated and long texts see quality()."""
    return quality(read_table(spark, sf_dir, "documents")).drop("host_rates", "n_lines")


ORACLE = r"""
with d as (select doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
w as (select doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
b as (select doc_id, host, len(w) n_words, length(array_to_string(w, '')) word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines, w from w),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from w where len(w) >= 8)),
rep as (select doc_id, count(distinct k) n from (select doc_id, unnest(range(i, i + 8)) k from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) where c > 1) group by 1),
m as (select b.doc_id, host, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, greatest(len(lines), 1) n_lines, cast(coalesce(rep.n, 0) as bigint) n_repeat_words from b left join rep using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, {'words': n_words < 20, 'repeats': 100 * n_repeat_words > 30 * n_words, 'symbols': n_words > 0 and 100 * n_symbols > 10 * n_words,
  'lines': 100 * n_dup_lines > 30 * n_lines} r from m),
flags as (select host, unnest([{'rule': 'words', 'bad': r.words}, {'rule': 'repeats', 'bad': r.repeats}, {'rule': 'symbols', 'bad': r.symbols}, {'rule': 'lines', 'bad': r.lines}]) x from f),
per as (select host, x.rule as rule, count(*)::double n, sum(x.bad::int)::double n_failed from flags group by 1, 2),
tot as (select rule, sum(n) docs, count(*)::double k, sum(n_failed * n_failed / n) ss, sum(n * n) nn, least(greatest(sum(n_failed) / sum(n), 1e-6), 1 - 1e-6) mean from per group by 1),
tau as (select *, case when k > 1 and docs - nn / docs > k - 1 then (ss - docs * mean * mean - (k - 1) * mean * (1 - mean)) / (docs - nn / docs - (k - 1)) else 0 end tau2 from tot),
pr as (select rule, mean, case when tau2 > 0 then greatest(mean * (1 - mean) / tau2 - 1, 2.0) else 1e6 end s from tau),
post as (select host, (n_failed + mean * s) / (n + s) p, n + s + 1 den from per join pr using (rule)),
v as (select host, bool_or(p - 2.0 * sqrt(p * (1 - p) / den) > 0.5) host_failed from post group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, not base_failed and not host_failed kept from f join v using (host)
"""
