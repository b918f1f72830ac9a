"""Corpora: what a query runs on.

A DirectCorpus has the texts themselves; a query reads each text once and shuffles nothing but one row of counts.
An IndexedCorpus has documents and postings; a query reads the postings of its own terms (pushed to the scan),
and shuffles those by document. Both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexmill.functions import grouping
from lexmill.functions import text as tx
from lexmill.functions.deploy import ship

DOC_COLUMNS = ("path", "file_size", "mtime_ns", "token_count")
HIT = "map<string,struct<tf:int,positions:array<int>>>"


def _needs_tokens(df: DataFrame) -> DataFrame:
    return tx.once(df, tokens=tx.tokens(F.coalesce(F.col("text"), F.lit(""))))


@dataclass(frozen=True)
class DirectCorpus:
    """documents: path, text, file_size, mtime_ns. Documents with a token that is too long are left out, as in an index."""

    documents: DataFrame
    positions: bool = True

    def _tokenized(self) -> DataFrame:
        df = _needs_tokens(self.documents)
        return df.where(~F.exists("tokens", lambda t: F.length(t) > tx.MOST_TOKEN_BYTES))

    def rows(self) -> DataFrame:
        """path, file_size, mtime_ns, token_count."""
        return self._tokenized().withColumn("token_count", F.size("tokens")).select(*DOC_COLUMNS)

    def terms_with_prefix(self, prefix: str, most: int) -> list[str]:
        terms = self._tokenized().select(F.explode(F.filter("tokens", lambda t: t.startswith(prefix))).alias("term")).distinct().limit(most)
        return sorted(r["term"] for r in terms.collect())

    def matched(self, terms: list[str], with_positions: bool, keep_all: bool, prefixes: tuple[str, ...] = ()) -> DataFrame:
        """The documents' rows with `m`, a map from each of terms, and each term with one of prefixes, to its tf and positions."""
        df = self._tokenized().withColumn("token_count", F.size("tokens"))
        if not terms and not prefixes:
            return df.select(*DOC_COLUMNS, F.expr(f"cast(map() as {HIT})").alias("m"))
        hits = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: tx.one_of(x["t"], terms, prefixes))
        df = tx.once(df, hits=hits).select(*DOC_COLUMNS, "hits")
        if not keep_all:
            df = df.where(F.size("hits") > 0)
        wanted = F.array_distinct(F.transform("hits", lambda x: x["t"])) if prefixes else F.array(*map(F.lit, terms))
        each = F.transform(wanted, lambda t: F.struct(t.alias("term"), F.transform(F.filter("hits", lambda x: x["t"] == t), lambda x: x["i"]).alias("positions")))
        entries = F.transform(F.filter(each, lambda e: F.size(e["positions"]) > 0), lambda e: F.struct(e["term"], F.struct(F.size(e["positions"]).alias("tf"), e["positions"].alias("positions"))))
        return tx.once(df, m=F.map_from_entries(entries)).select(*DOC_COLUMNS, "m")

    def postings(self) -> DataFrame:
        return postings_of(self.documents, ["path"], self.positions, repeated(self.documents, ["path"]), tx.MOST_TOKEN_BYTES)

    def frequencies(self) -> DataFrame:
        """term, df, cf."""
        return frequencies_of(self.documents, ["path"], repeated(self.documents, ["path"]), tx.MOST_TOKEN_BYTES)


@dataclass(frozen=True)
class IndexedCorpus:
    """documents: segment_id, doc_ord and DOC_COLUMNS of visible documents; postings: term, segment_id, doc_ord, tf, positions."""

    documents: DataFrame
    stored: DataFrame
    positions: bool = True
    KEY = ("segment_id", "doc_ord")

    def rows(self) -> DataFrame:
        return self.documents.select(*DOC_COLUMNS)

    def visible_postings(self) -> DataFrame:
        return self.stored.join(self.documents.select(*self.KEY), list(self.KEY), "left_semi")

    def terms_with_prefix(self, prefix: str, most: int) -> list[str]:
        found = self.stored.where(F.col("term").startswith(prefix)).join(self.documents.select(*self.KEY), list(self.KEY), "left_semi")
        return sorted(r["term"] for r in found.select("term").distinct().limit(most).collect())

    def matched(self, terms: list[str], with_positions: bool, keep_all: bool, prefixes: tuple[str, ...] = ()) -> DataFrame:
        if not terms and not prefixes:
            return self.documents.select(*DOC_COLUMNS, F.expr(f"cast(map() as {HIT})").alias("m"))
        places = F.col("positions") if with_positions else F.expr("cast(null as array<int>)")
        p = self.stored.where(tx.one_of(F.col("term"), terms, prefixes)).select(*self.KEY, F.struct("term", F.struct("tf", places.alias("positions")).alias("hit")).alias("e"))
        p = p.groupBy(*self.KEY).agg(F.map_from_entries(F.collect_list("e")).alias("m"))
        joined = self.documents.join(p, list(self.KEY), "left" if keep_all else "inner")
        return tx.once(joined.select(*DOC_COLUMNS, "m"), m=F.coalesce("m", F.expr(f"cast(map() as {HIT})")))

    def postings(self) -> DataFrame:
        return self.visible_postings()


Corpus = DirectCorpus | IndexedCorpus


def repeated(docs: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys of more than one row of docs; None where there are none, as is usual. Reads and shuffles the keys alone."""
    again = docs.groupBy(*key).count().where("count > 1").select(*key)
    return None if again.isEmpty() else again


def _divided(docs: DataFrame, key: list[str], again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that have their key alone, and the others."""
    many = again.select(*(F.col(k).alias(f"__{k}") for k in key))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key))
    return docs.join(many, same, "left_anti"), docs.join(many, same, "left_semi")


def postings_of(docs: DataFrame, key: list[str], positions: bool = True, again: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """term, key, tf, positions of docs, which have key and text. A row's postings are made where the row is; only those of keys that
    several rows have, `again`, are brought together. Texts with a token of more than `most` bytes are left out."""
    ship(docs.sparkSession)
    docs = docs.select(*key, "text")
    schema = StructType([StructField("term", StringType()), *docs.schema.fields[:-1], StructField("tf", IntegerType()), StructField("positions", ArrayType(IntegerType()))])
    made = lambda rows: rows.mapInArrow(partial(grouping.postings_batches, positions=positions, most=most), schema)
    if again is None:
        return made(docs)
    alone, many = _divided(docs, key, again)
    places = F.sort_array(F.flatten(F.collect_list("positions"))) if positions else F.lit(None).cast("array<int>")
    met = made(many).groupBy("term", *key).agg(F.sum("tf").cast("int").alias("tf"), places.alias("positions"))
    return made(alone).unionByName(met)


def frequencies_of(docs: DataFrame, key: list[str], again: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """term, df (of how many keys), cf (how often) of docs, which have key and text; a task's terms are counted before the shuffle."""
    ship(docs.sparkSession)
    docs = docs.select(*key, "text")
    alone, many = (docs, None) if again is None else _divided(docs, key, again)
    counted = alone.select("text").mapInArrow(partial(grouping.frequency_batches, most=most), "term string, df long, cf long")
    if many is not None:
        met = postings_of(many, key, False, again, most)
        counted = counted.unionByName(met.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def documents_view(df: DataFrame, path, text, mtime_ns) -> DataFrame:
    """A corpus table of any table: its path, text and modification time as columns."""
    return df.select(path.alias("path"), text.alias("text"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("file_size"), mtime_ns.cast("long").alias("mtime_ns"))
