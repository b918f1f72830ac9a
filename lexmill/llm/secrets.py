"""Secret scans with multipart credential linking, on Spark's own functions alone.

Assigned secrets, access identifiers and long hexadecimal strings are reported wherever they stand. Weaker parts
(random-looking strings, user or client identifiers, endpoints) are reported only where a complementary part
stands within `scope` code points: a secret needs an identifier or an endpoint, these need a secret. The parts of
a document are sorted by place, and two running windows give each part the nearest end before and the nearest
start after it of either class: an interval join that emits no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import read_table, written
from lexmill.llm.pii import cut
from lexmill.llm.spans import joined, let, matches

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
_ASSIGNED = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: Weaker parts. Random-looking: 24 or more characters with upper and lower case and a digit.
RANDOM = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=.-])"
IDENTIFIER = r"""(?i)\b(?:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
ENDPOINT = r"""(?i)\b(?:(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]{4,}+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}+)"""
BASE = ("assign", "access", "hex")
#: Kind: class of the part, whether it needs a complement.
PARTS = {"assign": ("secret", False), "access": ("identifier", False), "hex": ("secret", False), "random": ("secret", True), "identifier": ("identifier", True), "endpoint": ("endpoint", True)}
SCOPE = 400


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(list(PARTS).index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def found(text: Column) -> dict[str, Column]:
    """Of a text that is not null, the spans of each kind: array of (start, rank, end, kind), in code points."""
    return {
        "assign": _kind(F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], _ASSIGNED, 1)) >= 12), "assign"),
        "access": _kind(matches(text, ACCESS), "access"),
        "hex": _kind(matches(text, HEX), "hex"),
        "random": _kind(matches(text, RANDOM), "random"),
        "identifier": _kind(matches(text, IDENTIFIER), "identifier"),
        "endpoint": _kind(matches(text, ENDPOINT), "endpoint"),
    }


def secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, copy (a hash of the text), n_assign, n_access, n_hex, base (sorted spans), linked (sorted weaker spans).

    A null text counts as empty. Each row has its result, also where a doc_id is null or repeated: rows alike in
    doc_id and text share one, others have their own. Ties of place are sorted by kind. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("copy"), *(v.alias(k) for k, v in found(F.col("text")).items()))
    base = F.array_sort(F.concat(*(F.col(k) for k in BASE)))
    parts = F.concat(*(F.col(k) for k in PARTS))
    weak = F.concat(*(F.col(k) for k, (_, needs) in PARTS.items() if needs))
    # The first row of each document carries its base spans; its parts follow where there is something to link.
    marker = F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).alias("rank"), F.lit(-1).cast("long").alias("end"), F.lit("").alias("kind")))
    rows = rows.select("doc_id", "copy", base.alias("base"), F.when(F.size(weak) > 0, F.concat(marker, parts)).otherwise(marker).alias("parts"))
    rows = rows.select("doc_id", "copy", "base", F.posexplode("parts").alias("i", "part")).select("doc_id", "copy", F.when(F.col("i") == 0, F.col("base")).alias("base"), "part.*")
    own = Window.partitionBy("doc_id", "copy")
    up = own.orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    down = own.orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    of = F.create_map(*(F.lit(x) for k, (c, _) in PARTS.items() for x in (k, c)))
    rows = rows.withColumn("class", of[F.col("kind")])
    classes = ("secret", "identifier", "endpoint")
    rows = rows.withColumns({f"{c}_{w}": f(F.when(F.col("class") == c, F.col(v))).over(o) for c in classes for w, f, v, o in (("before", F.max, "end", up), ("after", F.min, "start", down))})
    near = {c: (F.coalesce(F.col("start") - F.col(f"{c}_before"), F.lit(scope + 1)) <= scope) | (F.coalesce(F.col(f"{c}_after") - F.col("end"), F.lit(scope + 1)) <= scope) for c in classes}
    linked = F.col("kind").isin([k for k, (_, needs) in PARTS.items() if needs]) & F.when(F.col("class") == "secret", near["identifier"] | near["endpoint"]).otherwise(near["secret"])
    span = F.struct("start", "rank", "end", "kind")
    per_doc = rows.groupBy("doc_id", "copy").agg(F.count("base").alias("copies"), F.first("base", ignorenulls=True).alias("base"), F.array_sort(F.collect_set(F.when(linked, span))).alias("linked"))
    per_doc = per_doc.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    # A weaker part that only repeats a base span is none.
    fresh = F.filter("linked", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return per_doc.select("doc_id", "copy", *(count(k) for k in BASE), "base", fresh.alias("linked"))


def redacted(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each reported span of text_col replaced by its kind in angle brackets; of spans that overlap, the earliest and longest."""
    to_cut = F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    hit = secrets(docs, scope, id_col, text_col).where("size(base) + size(linked) > 0").select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"), to_cut.alias("__cut")).dropDuplicates(["__id", "__copy"])
    hit = written(hit)
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("__copy"))
    new = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(let(F.col("__cut"), lambda v: cut(F.col(text_col), v)))
    return docs.join(hit, same, "left").withColumn(text_col, new).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    rows = secrets(read_table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "linked"))
    return rows.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
