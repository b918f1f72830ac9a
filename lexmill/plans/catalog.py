"""The retrieval engine's queries over the given tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import maintenance as mt
from lexmill.operators import validation as vd
from lexmill.operators.search import Searcher
from lexmill.plans import compile as cp
from lexmill.plans import query as q
from lexmill.sources.corpus import DirectCorpus, documents_view, frequencies_of, postings_of, repeated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- corpora -----------------------------------------------------------------------------------------------------

VIEW = """v as (select source || '/' || lang || '/doc-' || doc_id || '.' || (['txt', 'md', 'LOG', 'cpp'])[doc_id % 4 + 1] path, text,
  strlen(text) file_size, (1704067200 + doc_id * 3600) * 1000000000 mtime_ns, doc_id from documents)"""


def _tokens_sql(source: str, key: str = "path") -> str:
    return f"""tok as materialized (select {key}, lower(u.t) term, cast(u.i - 1 as int) pos from (select {key},
  unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x, i: {{'t': x, 'i': i}})) u from {source}))"""


BASE = f"with {VIEW}, {_tokens_sql('v')}"
SCORES = """n as (select count(*) n from v), len as (select path, count(*) dl from tok group by 1), avg as (select (select count(*) from tok)::double / n a, n from n),
df as (select term, count(distinct path) df from tok group by 1), tf as (select path, term, count(*) tf from tok group by 1, 2),
part as (select path, term, tf, df, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) score from tf join df using (term) join len using (path), avg)"""


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.element_at(F.array(*map(F.lit, ("txt", "md", "LOG", "cpp"))), (F.col("doc_id") % 4).cast("int") + 1)
    path = F.concat_ws("", "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return documents_view(df, path, F.col("text"), (F.lit(1704067200) + F.col("doc_id") * 3600) * F.lit(1_000_000_000))


def corpus(spark: SparkSession, sf_dir: str) -> DirectCorpus:
    return DirectCorpus(view(spark, sf_dir))


def tokenized(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", tx.tokens(F.coalesce(F.col("text"), F.lit(""))))


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _postings(docs: DataFrame, key: tuple[str, ...] = ("path",), positions: bool = True) -> DataFrame:
    return postings_of(docs, list(key), positions, repeated(docs, list(key)))


# --- text and postings -------------------------------------------------------------------------------------------

register("tokenize", lambda s, d: tokenized(view(s, d)).select("path", F.posexplode("tokens").alias("pos", "term")), f"{BASE} select path, pos, term from tok")
register("token_count", lambda s, d: tokenized(view(s, d)).select("path", F.size("tokens").cast("long").alias("token_count")), f"{BASE} select path, count(term) token_count from v left join tok using (path) group by 1")
register(
    "postings",
    lambda s, d: _postings(view(s, d)).select("term", "path", F.col("tf").cast("long").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")),
    f"{BASE} select term, path, count(*) tf, string_agg(pos::varchar, ',' order by pos) positions from tok group by 1, 2",
)
register("term_df", lambda s, d: corpus(s, d).frequencies(), f"{BASE} select term, count(distinct path) df, count(*) cf from tok group by 1")
register("dictionary_size", lambda s, d: tokenized(view(s, d)).select(F.explode("tokens").alias("t")).agg(F.countDistinct("t").alias("terms")), f"{BASE} select count(distinct term) terms from tok")
register(
    "corpus_stats",
    lambda s, d: corpus(s, d).rows().agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens"), F.sum("file_size").alias("bytes"), F.round(F.avg("token_count"), 6).alias("mean_length")),
    f"{BASE} select (select count(*) from v) documents, (select count(*) from tok)::bigint tokens, (select sum(file_size) from v)::bigint bytes, round((select count(*) from tok)::double / (select count(*) from v), 6) mean_length",
)
register(
    "path_parts",
    lambda s, d: view(s, d).select("path", tx.extension(F.col("path")).alias("ext"), tx.utc_day(F.col("mtime_ns")).alias("day")),
    f"with {VIEW} select path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) ext, cast(mtime_ns // 86400000000000 as bigint) as day from v",
)
register(
    "glob_expressions",
    lambda s, d: view(s, d).select("path", *(tx.glob_matches(F.col("path"), g).alias(f"g{i}") for i, g in enumerate(("src[0-3]/*", "*/doc-?.txt", "*.[!m]*", "src1[0-9]/en/*7.md")))),
    f"with {VIEW} select path, path glob 'src[0-3]/*' g0, path glob '*/doc-?.txt' g1, path glob '*.[!m]*' g2, path glob 'src1[0-9]/en/*7.md' g3 from v",
)
register(
    "valid_utf8",
    lambda s, d: view(s, d).select("path", F.expr("make_valid_utf8(cast(cast(text as binary) as string))").alias("text")).select("path", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes")),
    f"with {VIEW} select path, length(text) chars, strlen(text) bytes from v",
)

# --- leaves and Boolean operators --------------------------------------------------------------------------------


def matches(expression: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir)
        return cp.matching(c, cp.plan(q.parse_query(expression), c, most_prefix_terms=None)).select("path")

    return run


def has(term: str) -> str:
    return f"select path from tok where term = '{term}'"


def near(terms: list[str], p: int) -> str:
    joins = " ".join(f"join tok t{i} on t{i}.path = t0.path and t{i}.pos > t{i - 1}.pos and t{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    last = len(terms) - 1
    return f"select t0.path from tok t0 {joins} where t0.term = '{terms[0]}' and t{last}.pos - t0.pos - {last} <= {p}"


_LEAVES = {
    "term": ("THE", has("the")),
    "term_missing": ("zzzzqqq", has("zzzzqqq")),
    "prefix": ("tionth*", "select path from tok where term like 'tionth%'"),
    "phrase_exact": ('"of the"', near(["of", "the"], 0)),
    "phrase_three": ('"and the of"~4', near(["and", "the", "of"], 4)),
    "phrase_proximity": ('"of and"~3', near(["of", "and"], 3)),
    "phrase_repeated": ('"the the"~2', near(["the", "the"], 2)),
    "phrase_one": ('"the"', has("the")),
    "and": ("tion AND the", f"{has('tion')} intersect {has('the')}"),
    "implicit_and": ("of that not", f"{has('of')} intersect {has('that')}"),
    "or": ("tion OR ndhe", f"{has('tion')} union {has('ndhe')}"),
    "not": ("NOT the", f"select path from v except {has('the')}"),
    "double_not": ("NOT NOT tion", has("tion")),
    "grouping": ("(of OR la) AND NOT (les der)", f"({has('of')} union {has('la')}) except ({has('les')} intersect {has('der')})"),
    "precedence": ("la OR of AND NOT the", f"{has('la')} union ({has('of')} except {has('the')})"),
    "filter_path": ("path:src1?/*", "select path from v where path glob 'src1?/*'"),
    "filter_path_class": ('path:"src[!0-4]/??/doc-*"', "select path from v where path glob 'src[!0-4]/??/doc-*'"),
    "filter_extension": ("extension:.lOg", "select path from v where lower(path) like '%.log'"),
    "filter_not_extension": ("NOT extension:md", "select path from v where path not like '%.md'"),
    "filter_quoted": ('path:"*\\"*" OR extension:"cpp"', "select path from v where path glob '*\"*' or path like '%.cpp'"),
}
for _name, (_op, _sql) in {"eq": ("=", "="), "ne": ("!=", "<>"), "lt": ("<", "<"), "le": ("<=", "<="), "gt": (">", ">"), "ge": (">=", ">=")}.items():
    _LEAVES[f"filter_size_{_name}"] = (f"size:{_op}2KiB", f"select path from v where file_size {_sql} 2048")
    _LEAVES[f"filter_mtime_{_name}"] = (f"mtime:{_op}2024-01-09", f"select path from v where mtime_ns // 86400000000000 {_sql} 19731")
# A size that documents have, so that "=" finds some.
_LEAVES["filter_size_eq"] = ("size:=416B OR size:=715", "select path from v where file_size in (416, 715)")
_LEAVES["implicit_and"] = ("of that", f"{has('of')} intersect {has('that')}")
for _name, (_expr, _sql) in _LEAVES.items():
    register(f"match_{_name}", matches(_expr), f"{BASE} select distinct path from ({_sql})")


def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same set by flags in one pass and by set operators; rows of either alone would show."""
    a, b, c = (matches(t)(spark, sf_dir) for t in ("of", "that", "the"))
    by_sets = a.intersect(b).unionByName(a.subtract(c)).distinct()
    by_flags = matches("(of that) OR (of NOT the)")(spark, sf_dir)
    return by_sets.withColumn("side", F.lit(1)).unionByName(by_flags.withColumn("side", F.lit(2))).groupBy("path").agg(F.sum("side").cast("long").alias("sides"))


register("set_algebra", set_algebra, f"{BASE} select distinct path, 3::bigint sides from (({has('of')} intersect {has('that')}) union ({has('of')} except {has('the')}))")

# --- ranking -----------------------------------------------------------------------------------------------------


def ranked(expression: str, k: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cp.search(corpus(spark, sf_dir), expression, k, most_prefix_terms=None).select("path", F.round("score", 6).alias("score"))

    return run


def ranked_sql(where: str, terms: str, k: int) -> str:
    return f"{BASE}, {SCORES}, hit as (select distinct path from ({where})) select path, round(coalesce(sum(p.score), 0), 6) score from hit left join (select * from part where {terms}) p using (path) group by 1 order by coalesce(sum(p.score), 0) desc, path limit {k}"


register("bm25_topk", ranked("the of", 20), ranked_sql(f"{has('the')} intersect {has('of')}", "term in ('the', 'of')", 20))
register("bm25_or", ranked("tion OR tionth* OR la", 50), ranked_sql("select path from tok where term in ('tion', 'la') or term like 'tionth%'", "term in ('tion', 'la') or term like 'tionth%'", 50))
register("bm25_phrase", ranked('"of and"~3 NOT la', 20), ranked_sql(f"{near(['of', 'and'], 3)} except {has('la')}", "term in ('of', 'and')", 20))
register("bm25_double_not", ranked("NOT NOT that AND of", 20), ranked_sql(f"{has('that')} intersect {has('of')}", "term in ('that', 'of')", 20))
register("rank_filter_only", ranked("extension:md", 30), f"with {VIEW} select path, 0.0::double score from v where path like '%.md' order by path limit 30")
register("rank_not_only", ranked("NOT the", 30), f"{BASE} select path, 0.0::double score from (select path from v except {has('the')}) order by path limit 30")
FLAGSHIP = '"the of"~3 OR ("and" NOT extension:md)'
register("flagship", ranked(FLAGSHIP, 20), ranked_sql(f"{near(['the', 'of'], 3)} union (select path from tok where term = 'and' and path not like '%.md')", "term in ('the', 'of', 'and')", 20))


def scores_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.search(corpus(spark, sf_dir), "that OR et", None).select("path", F.round("score", 6).alias("score"))


register("bm25_all", scores_of_all, f"{BASE}, {SCORES} select path, round(sum(score), 6) score from part where term in ('that', 'et') group by 1")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = cp.search(corpus(spark, sf_dir), "the that", 10)
    return top.select("path", F.explode("explanation").alias("e")).select("path", "e.term", F.col("e.tf").cast("long").alias("tf"), "e.df", F.round("e.score", 6).alias("score"))


register(
    "bm25_explain",
    explained,
    f"{BASE}, {SCORES}, top as (select path, sum(score) s from part where term in ('the', 'that') group by 1 having count(*) = 2 order by s desc, path limit 10) select path, term, tf, df, round(score, 6) score from part join top using (path) where term in ('the', 'that')",
)


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document with a term, the first line that holds it, without a carriage return at its end; of one over 240 bytes the characters within the first 237, and "..."."""
    lines = F.split(F.col("text"), "\n", -1)
    rows = view(spark, sf_dir).select("path", F.size(lines).alias("n"), F.posexplode(lines).alias("i", "line")).where(F.array_contains(tx.tokens(F.col("line")), "tion"))
    first = rows.groupBy("path").agg(F.min(F.struct("i", "line", "n")).alias("x"))
    line = F.when(F.col("x.i") + 1 < F.col("x.n"), F.regexp_replace("x.line", "\\r\\z", "")).otherwise(F.col("x.line"))
    raw = line.cast("binary")
    goes_on = lambda at: F.substring(F.hex(F.substring(raw, at + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    at = F.when(~goes_on(237), 237).when(~goes_on(236), 236).when(~goes_on(235), 235).otherwise(234)
    cut = F.concat(F.substring(raw, F.lit(1), at).cast("string"), F.lit("..."))
    return first.select("path", (F.col("x.i") + 1).cast("long").alias("line"), F.when(F.octet_length(line) <= 240, line).otherwise(cut).alias("text"))


register(
    "snippet",
    snippets,
    f"""with {VIEW}, l as (select path, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'l': x, 'i': i}})) u, len(string_split(text, chr(10))) n from v),
f as (select path, min(u.i)::bigint line, arg_min(u.l, u.i) l, any_value(n) n from l where list_contains(list_transform(regexp_extract_all(u.l, '[A-Za-z0-9_]+'), lambda x: lower(x)), 'tion') group by 1),
c as (select path, line, case when line < n and right(l, 1) = chr(13) then left(l, -1) else l end l from f)
select path, line, case when strlen(l) <= 240 then l else substring(l, 1, list_max(list_filter(range(59, 238), lambda k: strlen(substring(l, 1, k)) <= 237))) || '...' end as text from c""",
)

# --- visibility, maintenance and validation ----------------------------------------------------------------------
# Three segments are taken from the corpus: all of it; a newer version of every third document; tombstones of every fifth.

SEGMENTS = f"""{VIEW}, seg as (select 1::bigint segment_id, doc_id doc_ord, path, file_size, mtime_ns, false tombstone from v
  union all select 2, doc_id, path, file_size + 1, mtime_ns + 1000000000, false from v where doc_id % 3 = 0
  union all select 3, doc_id, path, 0, 0, true from v where doc_id % 5 = 0),
vis as (select * exclude (r) from (select *, row_number() over (partition by path order by segment_id desc, doc_ord desc) r from seg) where r = 1 and not tombstone)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir).withColumn("doc_ord", F.regexp_extract("path", r"doc-([0-9]+)", 1).cast("long"))
    cols = [F.col(c) for c in ("doc_ord", "path", "file_size", "mtime_ns")]
    one = v.select(F.lit(1).cast("long").alias("segment_id"), *cols, F.lit(False).alias("tombstone"))
    two = v.where("doc_ord % 3 = 0").select(F.lit(2).cast("long").alias("segment_id"), "doc_ord", "path", (F.col("file_size") + 1).alias("file_size"), (F.col("mtime_ns") + 1_000_000_000).alias("mtime_ns"), F.lit(False).alias("tombstone"))
    zero = F.lit(0).cast("long")
    three = v.where("doc_ord % 5 = 0").select(F.lit(3).cast("long").alias("segment_id"), "doc_ord", "path", zero.alias("file_size"), zero.alias("mtime_ns"), F.lit(True).alias("tombstone"))
    return one.unionByName(two).unionByName(three)


register("visibility", lambda s, d: mt.visible(segments(s, d)).select("segment_id", "doc_ord", "path", "file_size", "mtime_ns"), f"with {SEGMENTS} select segment_id, doc_ord, path, file_size, mtime_ns from vis")


def source_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later state of the source: every seventh document is gone, every fourth was changed."""
    n = F.regexp_extract("path", r"doc-([0-9]+)", 1).cast("long")
    return view(spark, sf_dir).where(n % 7 != 0).select("path", F.when(n % 4 == 0, F.col("file_size") + 5).otherwise(F.col("file_size")).alias("file_size"), "mtime_ns", F.xxhash64("text").alias("content_hash"))


def update_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = mt.visible(segments(spark, sf_dir)).join(view(spark, sf_dir).select("path", F.xxhash64("text").alias("content_hash")), "path")
    return mt.changes(old, source_now(spark, sf_dir)).select("path", "change")


register(
    "update_plan",
    update_plan,
    f"with {SEGMENTS}, new as (select path, case when doc_id % 4 = 0 then file_size + 5 else file_size end file_size, mtime_ns from v where doc_id % 7 <> 0) select coalesce(o.path, n.path) path, case when o.path is null then 'added' when n.path is null then 'removed' when o.file_size <> n.file_size or o.mtime_ns <> n.mtime_ns then 'modified' else 'unchanged' end as change from vis o full join new n on o.path = n.path",
)
register("change_counts", lambda s, d: update_plan(s, d).groupBy("change").agg(F.count("*").alias("n")), f"with p as ({ORACLE_SQL['update_plan']}) select change, count(*) n from p group by 1")
register("remove_plan", lambda s, d: mt.removals(mt.visible(segments(s, d)), ["src1/*", "*/es/*.md"]).select("path"), f"with {SEGMENTS} select path from vis where path glob 'src1/*' or path glob '*/es/*.md'")
register(
    "compact_stats",
    lambda s, d: segments(s, d).agg(F.count("*").alias("records"), F.sum(F.col("tombstone").cast("long")).alias("tombstones")).crossJoin(F.broadcast(mt.visible(segments(s, d)).agg(F.count("*").alias("visible")))).withColumn("discarded", F.col("records") - F.col("visible")),
    f"with {SEGMENTS} select (select count(*) from seg) records, (select count(*) from seg where tombstone) tombstones, (select count(*) from vis) visible, (select count(*) from seg) - (select count(*) from vis) discarded",
)
register(
    "visible_df",
    lambda s, d: _visible_df(s, d),
    f"with {SEGMENTS}, {_tokens_sql('v')} select term, count(distinct path) df from tok where path in (select path from vis) group by 1",
)


def _visible_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir).select("path", "text")
    shown = v.join(mt.visible(segments(spark, sf_dir)).select("path"), "path", "left_semi")  # texts are fewer bytes than their postings
    return frequencies_of(shown, ["path"], repeated(v, ["path"])).select("term", "df")


def broken(spark: SparkSession, sf_dir: str, positions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents and postings with planted faults, for the validation rules to find."""
    docs = tokenized(view(spark, sf_dir)).withColumn("doc_ord", F.regexp_extract("path", r"doc-([0-9]+)", 1).cast("long"))
    p = _postings(docs, ("doc_ord",), positions).select("term", F.lit(1).cast("long").alias("segment_id"), "doc_ord", "tf", "positions")
    p = p.withColumn("tf", F.when((F.col("doc_ord") % 50 == 0) & (F.col("term") == "the"), F.col("tf") + 1).otherwise(F.col("tf")))
    d = docs.select(F.lit(1).cast("long").alias("segment_id"), "doc_ord", F.when(F.col("doc_ord") % 40 == 3, F.concat(F.lit("/"), "path")).otherwise(F.col("path")).alias("path"), "file_size", "mtime_ns", F.size("tokens").alias("token_count"), (F.col("doc_ord") % 90 == 1).alias("tombstone"), F.xxhash64("text").alias("content_hash"))
    return d, p


def misnumbered(spark: SparkSession, sf_dir: str, positions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Three segments whose documents are numbered from 0, one with a gap and one with a number given twice; postings that are no terms, doubled, of no document, or empty."""
    docs = tokenized(view(spark, sf_dir)).withColumn("n", F.regexp_extract("path", r"doc-([0-9]+)", 1).cast("long"))
    order = F.floor(F.col("n") / 3)
    docs = docs.withColumns({"segment_id": F.col("n") % 3, "doc_ord": F.when(F.col("n") == 13, order + 1).otherwise(order)}).where("n <> 12")
    p = _postings(docs, ("segment_id", "doc_ord", "n"), positions)
    term = F.col("term")
    row = lambda **x: F.struct(*(x.get(c, F.col(c)).alias(c) for c in ("term", "segment_id", "doc_ord", "tf", "positions", "n")))
    # Each posting with its faulty copies, in one pass.
    copies = F.when(F.expr("n % 10 = 0 and term = 'the'"), row(term=F.upper(term))).when(F.expr("n % 25 = 1 and term = 'of'"), row())
    copies = copies.when(F.expr("n % 20 = 2 and term = 'and'"), row(doc_ord=F.col("doc_ord") + 1_000_000_000)).when(F.expr("n % 30 = 4 and term = 'to'"), row(tf=F.lit(0)))
    return docs, p.select(F.inline(F.when(copies.isNotNull(), F.array(row(), copies)).otherwise(F.array(row()))))


def validation(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    faulty = misnumbered if rule in ("ordinals", "terms", "postings") else broken
    return lambda s, d: vd.RULES[rule](*faulty(s, d, positions=rule == "positions")).agg(F.count("*").alias("violations"))


_MISNUMBERED = f"{BASE}, f as (select doc_id, doc_id % 3 s, doc_id // 3 + (doc_id = 13)::int o, term from (select distinct path, term from tok) join v using (path) where doc_id <> 12)"
_FAULTY_TF = f"{BASE}, t as (select path, term, count(*) tf from tok group by 1, 2), f as (select v.doc_id, term, tf from t join v using (path))"
for _rule, _sql in {
    "ordinals": "with d as (select doc_id % 3 s, doc_id // 3 + (doc_id = 13)::int o from documents where doc_id <> 12) select count(*) violations from (select s from d group by 1 having max(o) + 1 <> count(*) or count(distinct o) <> count(*))",
    "tombstones": "select count(*) violations from documents where doc_id % 90 = 1",
    "paths": "select count(*) violations from documents where doc_id % 40 = 3",
    # Documents 13 and 16 share a number in the faulty segment, so their common terms are there twice as well.
    "terms": f"""{_MISNUMBERED} select (select count(*) from f where doc_id % 10 = 0 and term = 'the') + (select count(*) from (select s, o, term, sum(1 + (doc_id % 25 = 1 and term = 'of')::int + (doc_id % 30 = 4 and term = 'to')::int) c from f group by all) where c > 1) violations""",
    "postings": f"{_MISNUMBERED} select count(*) violations from f where (doc_id % 20 = 2 and term = 'and') or (doc_id % 30 = 4 and term = 'to')",
    "positions": f"{_FAULTY_TF} select count(*) violations from f where doc_id % 50 = 0 and term = 'the'",
    "lengths": f"{_FAULTY_TF} select count(distinct doc_id) violations from f where doc_id % 50 = 0 and term = 'the'",
    "hidden": f"{_FAULTY_TF} select count(*) violations from f where doc_id % 90 = 1",
}.items():
    register(f"validate_{_rule}", validation(_rule), _sql)

# --- the same by way of an index on disk -------------------------------------------------------------------------


@functools.cache
def _home(root: str | None) -> Path:
    """Where the catalog's indexes go: the cluster's shared folder, or a temporary one where none is set."""
    path = Path(tempfile.mkdtemp(prefix="lexmill-index-", dir=root))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _new_index(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = root.removeprefix("file://").removeprefix("file:") if root else None
    if root:
        Path(root).mkdir(parents=True, exist_ok=True)
    elif not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return str(_home(root) / uuid.uuid4().hex)


def indexed(expression: str, k: int | None, later: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A search of an index of the corpus; `later`: after an update to a changed source and a removal."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = maintained(spark, sf_dir) if later else _new_index(spark)
        if not later:
            mt.IndexWriter(spark, index).rebuild(view(spark, sf_dir))
        return Searcher(spark, index).search_df(expression, k).select("path", F.round("score", 6).alias("score"))

    return run


def maintained(spark: SparkSession, sf_dir: str) -> str:
    index, n = _new_index(spark), F.regexp_extract("path", r"doc-([0-9]+)", 1).cast("long")
    w = mt.IndexWriter(spark, index)
    w.rebuild(view(spark, sf_dir))
    w.update(view(spark, sf_dir).where(n % 7 != 0).withColumn("text", F.when(n % 4 == 0, F.concat("text", F.lit(" updatedword"))).otherwise(F.col("text"))))
    w.remove(["src1/*"])
    return index


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = mt.validate_index(spark, maintained(spark, sf_dir))
    names = ("documents", "segments", "tombstones", "terms", "postings", "positions")
    return spark.createDataFrame([tuple(getattr(st, n) for n in names)], ", ".join(f"{n} long" for n in names))


_LATER = f"""with v0 as (select * from ({VIEW.removeprefix('v as (')}),
v as (select path, case when doc_id % 4 = 0 then text || ' updatedword' else text end as text from v0 where doc_id % 7 <> 0 and path not glob 'src1/*'), {_tokens_sql('v')}"""
register("indexed_bm25", indexed("the of", 20), ORACLE_SQL["bm25_topk"])
register("indexed_phrase", indexed('"of and"~3 NOT la', 20), ORACLE_SQL["bm25_phrase"])
register("indexed_after_update", indexed("updatedword OR that", None, later=True), f"{_LATER}, {SCORES} select path, round(sum(score), 6) score from part where term in ('updatedword', 'that') group by 1")
register(
    "index_counts",
    index_counts,
    f"""{_LATER} select (select count(*) from v)::bigint documents, 3::bigint segments, (select count(*) from v0 where doc_id % 7 = 0 or path glob 'src1/*')::bigint tombstones,
  (select count(distinct term) from tok)::bigint terms, (select count(*) from (select distinct path, term from tok))::bigint postings, (select count(*) from tok)::bigint positions""",
)

# --- the same operators over the other text tables -------------------------------------------------------------------


def _table(name: str, path: Callable[[], Column], text: str) -> Callable[[SparkSession, str], DirectCorpus]:
    def of(spark: SparkSession, sf_dir: str) -> DirectCorpus:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return DirectCorpus(documents_view(df, path(), F.col(text), F.lit(0)))

    return of


_OTHERS = {
    "pages": (_table("pages", lambda: F.concat_ws("#", "url", F.col("page_id").cast("string")), "html"), "select url || '#' || page_id path, html as text from pages", "div"),
    "conversations": (_table("conversations", lambda: F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text"), "select conv_id || '/' || turn path, text from conversations", "the"),
    "benchmark": (_table("benchmark", lambda: F.col("item_id").cast("string"), "text"), "select item_id::varchar path, text from benchmark", "the"),
    "parts": (_table("part", lambda: F.col("p_partkey").cast("string"), "p_name"), "select p_partkey::varchar path, p_name as text from part", "blue"),
}
for _name, (_corpus, _sql, _term) in _OTHERS.items():
    register(
        f"{_name}_df",
        lambda s, d, c=_corpus: c(s, d).frequencies().select("term", "df"),
        f"with v as ({_sql}), {_tokens_sql('v')} select term, count(distinct path) df from tok group by 1",
    )
    register(
        f"{_name}_bm25",
        lambda s, d, c=_corpus, t=_term: cp.search(c(s, d), t, None).select("path", F.round("score", 6).alias("score")),
        f"with v as ({_sql}), {_tokens_sql('v')}, {SCORES} select path, round(sum(score), 6) score from part where term = '{_term}' group by 1",
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
