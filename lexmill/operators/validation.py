"""Invariants of documents and postings. Each rule gives the rows that break it: none in a sound index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

KEY = ["segment_id", "doc_ord"]
TERM = r"\A[a-z0-9_]{1,256}\z"


def _small(keys: DataFrame) -> DataFrame:
    """Keys of documents that are kept before they are joined: Spark then knows their size, and the postings stay where they are if it is small."""
    keys = keys.distinct().persist()
    keys.count()
    return keys


def _marked(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """postings with __in: whether keys has theirs."""
    other = keys.select(*(F.col(k).alias(f"__{k}") for k in KEY), F.lit(True).alias("__found"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY))
    return postings.join(other, same, "left").withColumn("__in", F.coalesce("__found", F.lit(False))).drop("__found", *(f"__{k}" for k in KEY))


def _times(rows: DataFrame, n) -> DataFrame:
    """Each row n times, none where n is 0."""
    return rows.withColumn("__n", n.cast("int")).where("__n > 0").withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).drop("__n")


def ordinals(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Segments whose document numbers are not 0 to count - 1."""
    return docs.groupBy("segment_id").agg(F.max("doc_ord").alias("last"), F.count("*").alias("n"), F.countDistinct("doc_ord").alias("different")).where("last + 1 <> n or different <> n")


def tombstones(docs: DataFrame, postings: DataFrame) -> DataFrame:
    return docs.where("tombstone and (file_size <> 0 or mtime_ns <> 0 or token_count <> 0 or content_hash is not null)")


def paths(docs: DataFrame, postings: DataFrame) -> DataFrame:
    return docs.where((F.col("path") == "") | F.col("path").startswith("/") | F.col("path").rlike(r"(?s)(^|/)\.{1,2}(/|$)"))


def terms(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Terms that are no terms, and postings that are there twice."""
    # Rows are brought together first: hardly any are alike, so counting in the tasks before would save nothing.
    counted = postings.select("term", *KEY).repartition("term", *KEY).groupBy("term", *KEY).count()
    odd = F.when(F.col("term").rlike(TERM), 0).otherwise(F.col("count"))
    return _times(counted, odd + F.when(F.col("count") > 1, 1).otherwise(0)).select("term", *KEY)


def postings(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of no document, or without occurrences."""
    lost = _small(postings.select(*KEY).distinct().join(docs.select(*KEY), KEY, "left_anti"))
    found = _marked(postings.select("term", "tf", *KEY), lost)
    return _times(found, F.col("__in").cast("int") + F.coalesce(F.col("tf") <= 0, F.lit(False)).cast("int")).select("term", *KEY)


def positions(docs: DataFrame, postings: DataFrame) -> DataFrame:
    p = F.col("positions")
    return postings.where(p.isNotNull() & ((F.size(p) != F.col("tf")) | (p != F.array_sort(F.array_distinct(p)))))


def lengths(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents whose token count is not the sum of their postings' frequencies."""
    total = postings.groupBy(*KEY).agg(F.sum("tf").alias("total"))
    return docs.join(total, KEY, "left").where(F.coalesce("total", F.lit(0)) != F.col("token_count"))


def hidden(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of tombstones."""
    return _marked(postings, _small(docs.where("tombstone").select(*KEY))).where("__in").drop("__in")


RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {f.__name__: f for f in (ordinals, tombstones, paths, terms, postings, positions, lengths, hidden)}


def check(docs: DataFrame, post: DataFrame, seen: DataFrame) -> Row:
    """Holds an index against all rules. Gives how many terms, postings and positions the documents of seen have.

    What goes by document is found in one query, to which postings are shuffled once, without their positions.
    """
    p = post.select("term", *KEY, "tf", F.size("positions").alias("places")).repartition(*KEY)
    odd = F.when(F.col("term").rlike(TERM), 0).otherwise(1)
    by_term = p.groupBy(*KEY, "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.sum(F.when(F.col("tf") <= 0, 1).otherwise(0)).alias("bare"), F.sum("places").alias("places"))
    by_doc = by_term.groupBy(*KEY).agg(F.sum("tf").alias("tf"), F.sum("bare").alias("bare"), F.sum(odd + F.when(F.col("n") > 1, 1).otherwise(0)).alias("terms"), F.sum("places").alias("places"))
    d = docs.select(*KEY, "token_count", "tombstone", F.lit(True).alias("__doc")).join(by_doc.withColumn("__post", F.lit(True)), KEY, "full_outer")
    doc, has = F.col("__doc").isNotNull(), F.col("__post").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    faults = d.agg(
        count(F.col("terms") > 0).alias("terms"), (count(~doc) + count(F.col("bare") > 0)).alias("postings"), count(doc & (F.coalesce("tf", F.lit(0)) != F.col("token_count"))).alias("lengths"),
        count(doc & has & F.col("tombstone")).alias("hidden"), F.sum("places").alias("places"),
    )
    shown = p.join(seen.select(*KEY), KEY, "left_semi").groupBy("term").agg(F.count("*").alias("n"), F.sum("places").alias("places"), F.sum("tf").alias("tf"))
    counts = shown.agg(F.count("*").alias("terms"), F.sum("n").alias("postings"), F.sum("places").alias("positions"), F.sum("tf").alias("tf"))  # the sums that nobody reads keep both sides' shuffle one
    found = faults.select(F.struct("*").alias("faults"), F.lit(None).cast(counts.select(F.struct("*").alias("x")).schema[0].dataType).alias("counts"))
    rows = found.unionByName(counts.select(F.lit(None).cast(found.schema["faults"].dataType).alias("faults"), F.struct("*").alias("counts")))
    broken: dict[str, int] = {}
    whole = None
    for name, rule in RULES.items():
        if name in ("terms", "postings", "lengths", "hidden"):
            if whole is None:
                whole = rows.collect()  # two rows
                broken = next(r["faults"] for r in whole if r["faults"] is not None).asDict()
            wrong = broken[name] > 0
        else:
            wrong = not rule(docs, post).isEmpty()
        if wrong:
            raise RuntimeError(f"the index is corrupt: rule '{name}' is broken")
    counted = next(r["counts"] for r in whole if r["counts"] is not None).asDict()
    return Row(**{k: counted[k] or 0 for k in ("terms", "postings", "positions")})
