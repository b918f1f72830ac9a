"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `size` words (a shorter item is one window). The tokens that are joined are
shingles of up to three words. A window is found in a document only if all of its shingles are, so the prefix
that must be joined is one shingle: the window's rarest over all documents. Documents pass on, through a filter
of fixed size, the places where such a shingle may stand, with the words around; these join the windows on the
shingle, the shingle's place in the window bounds where the window must begin and end, and the words are
compared exactly.

Words: runs of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import bit_filter, in_filter, mix, read_table, shingle_hashes, slices, written

SHINGLE = 3
#: The windows are copied, and the places of a shingle spread, over so many keys: one shingle may stand in any share of the rows.
SALT = 16
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.array([bool(_WORD.match(bytes([b]))) for b in range(256)])
#: What a byte adds to its word's hash at each of 64 places; 0 for bytes outside words.
_ADDS = (np.random.default_rng(4093).integers(1, 1 << 64, (64, 256), dtype=np.uint64) * _IS_WORD).ravel()
#: Bytes that are hashed at once, and those of a word beyond which it is hashed by itself.
_AT_ONCE, _LONG = 1 << 20, 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class _Words:
    """The words of some texts: their hashes, their text's number, and their bytes on demand; counts has the words of each text."""

    def __init__(self, texts: list[str | bytes | None]):
        raws = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\0".join(raws).lower()
        buf = np.frombuffer(self.raw, np.uint8)
        inside = _IS_WORD[buf]
        self.begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]][:len(inside)])
        self.ends = np.flatnonzero(inside & ~np.r_[inside[1:], False][:len(inside)]) + 1
        self.counts = np.diff(np.searchsorted(self.begins, np.cumsum([0, *(len(r) + 1 for r in raws)])))
        self.text = np.repeat(np.arange(len(raws)), self.counts)
        self.hashes = self._hashes(buf)

    def _hashes(self, buf: np.ndarray) -> np.ndarray:
        begins, ends = self.begins, self.ends
        out = np.empty(len(begins), np.uint64)
        alone = np.flatnonzero(ends - begins > _LONG)
        for i in alone.tolist():
            out[i] = xxhash.xxh64_intdigest(self.raw[begins[i]:ends[i]])
        for i, stop in zip([0, *(alone + 1).tolist()], [*alone.tolist(), len(begins)]):
            while i < stop:
                j = min(int(np.searchsorted(begins, begins[i] + _AT_ONCE)), stop)
                at = begins[i:j] - begins[i]
                part = buf[begins[i]:ends[j - 1]]
                place = np.arange(len(part)) - np.repeat(at, np.diff(np.r_[at, len(part)]))
                adds = _ADDS[(place & 63) << 8 | part]
                far = np.flatnonzero((place >= 64) & (adds != 0))
                if len(far):
                    adds[far] = mix(adds[far] + (place[far] >> 6).astype(np.uint64))
                out[i:j] = mix(np.add.reduceat(adds, at))
                i = j
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each run of k words of one text."""
        if len(self.hashes) < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.text[:len(self.text) - k + 1] == self.text[k - 1:])
        return shingle_hashes(self.hashes, k)[at], at

    def joined(self, a: int, b: int) -> bytes:
        return b" ".join([self.raw[x:y] for x, y in zip(self.begins[a:b].tolist(), self.ends[a:b].tolist())])


def _windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(window, wid) of the distinct windows, and (wid, item_id) of the items that hold them; a null item_id counts as an item named ''."""

    def run(batches):
        for batch in slices(batches):
            out, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(t)
                for k in range(max(1, len(w) - size + 1) if w else 0):
                    out.append(b" ".join(w[k:k + size]))
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["item_id", "window"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string")).mapInArrow(run, "item_id string, window binary").distinct()
    windows = written(rows.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return windows, written(rows.join(windows, "window").select("wid", "item_id"))


def _shingles(windows: DataFrame) -> DataFrame:
    """(window, wid, n, shingle, at): every shingle of every window with its place; of SHINGLE words, or all of a shorter window."""

    def run(batches):
        for batch in slices(batches, 1024):
            words = _Words(batch.column(0).to_pylist())
            first = np.cumsum(words.counts) - words.counts
            found = [(*words.shingles(k), k) for k in range(1, SHINGLE + 1)]
            # Of a window of fewer words than SHINGLE, all of them are one.
            keep = [(words.counts[words.text[at]] == k) | (k == SHINGLE) for _, at, k in found]
            s, at = (np.concatenate([x[i][ok] for x, ok in zip(found, keep)]) for i in (0, 1))
            text = words.text[at]
            row = pa.array(text.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(words.counts[text].astype(np.int32)), pa.array(s.view(np.int64)), pa.array((at - first[text]).astype(np.int32))], names=["window", "wid", "n", "shingle", "at"])

    return windows.mapInArrow(run, "window binary, wid long, n int, shingle long, at int")


def _frequencies(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often each shingle that the filter lets through stands in all documents."""

    def run(batches):
        got: dict[int, int] = {}

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], names=["shingle", "n"])
            got.clear()
            return b

        for batch in slices(batches):
            words = _Words(batch.column(0).to_pylist())
            for k in sizes:
                s, _ = words.shingles(k)
                for x in s[in_filter(bits.value, s)].view(np.int64).tolist():
                    got[x] = got.get(x, 0) + 1
            if len(got) > 200_000:
                yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, bits, sizes: list[int], size: int) -> DataFrame:
    """A row for each document, with base true, and one for each place of a shingle that the filter lets through."""
    schema = "doc_id long, copy binary, n_words long, base boolean, shingle long, pos int, first int, around binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import hashlib

        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            words = _Words(texts)
            copies = [hashlib.md5(("\0" if t is None else t).encode("utf-8", "surrogatepass")).digest() for t in texts]
            docs = list(zip(batch.column(0).to_pylist(), copies, words.counts.tolist()))
            out: list[tuple] = [(*d, True, None, None, None, None) for d in docs]
            starts = (np.cumsum(words.counts) - words.counts).tolist()
            for k in sizes:
                s, at = words.shingles(k)
                hit = in_filter(bits.value, s)
                for x, p, i in zip(s[hit].view(np.int64).tolist(), at[hit].tolist(), words.text[at[hit]].tolist()):
                    p -= starts[i]
                    first = max(0, p - size + k)
                    out.append((*docs[i], False, x, p, first, words.joined(starts[i] + first, starts[i] + min(p + size, docs[i][2]))))
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _verified(rows: DataFrame) -> DataFrame:
    """Of each joined row, where its window begins in the document; null where its words differ."""

    def run(batches):
        for batch in slices(batches, 1024):
            start = []
            cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("window", "n", "at", "pos", "first", "around")]
            for window, n, at, pos, first, around in zip(*cols):
                if pos - at < first:
                    start.append(None)
                    continue
                w = around.split(b" ")[pos - at - first:pos - at - first + n]
                start.append(pos - at if b" ".join(w) == window else None)
            keep = [batch.column(batch.schema.names.index(c)) for c in ("doc_id", "copy", "n_words", "base", "n", "wid")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(start, pa.int32())], names=["doc_id", "copy", "n_words", "base", "n", "wid", "start"])

    return rows.mapInArrow(run, "doc_id long, copy binary, n_words long, base boolean, n int, wid long, start int").where("start is not null")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, copy (md5 of the text), n_words, spans (array of start and end word of merged hits), items (ids of items with occurring windows).

    Null or empty texts have no words and no hits; so have all documents if there are no items. Rows alike in
    doc_id and text each get their result; rows that share a doc_id, null too, but not the text get their own.
    Items that repeat count once by item_id; a null item_id counts as ''. Other columns are ignored. Texts may have
    any length: only places of rare shingles leave their task. An empty table gives an empty result.
    """
    named, holders = _windows(items, size)
    windows = written(_shingles(named))
    sizes = sorted({min(SHINGLE, r["n"]) for r in windows.select("n").distinct().collect()})  # at most `size` rows
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bit_filter(windows, "shingle"))
    often = _frequencies(docs, bits, sizes)
    ranked = windows.join(often.withColumnRenamed("n", "often"), "shingle", "left").select("wid", "window", "n", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "at").alias("rank"))
    rarest = written(ranked.groupBy("wid").agg(F.min("rank").alias("rank"), F.first("n").alias("n"), F.first("window").alias("window")).select("wid", "window", "n", F.col("rank.shingle").alias("shingle"), F.col("rank.at").alias("at")))
    # A shingle that stands in no document needs no place in the second filter either, but costs nothing there.
    bits2 = spark.sparkContext.broadcast(bit_filter(rarest, "shingle"))
    places = written(_places(docs, bits2, sizes, size))
    # Documents' own rows meet no window, so they stay out of the join.
    hits = places.where("not base").withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy", "pos"), F.lit(SALT)).cast("int"))
    hits = _verified(hits.join(rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["shingle", "salt"]))
    own = places.where("base").select("doc_id", "copy", "n_words", "base", F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("wid"), F.lit(None).cast("int").alias("start"))
    per_doc = written(own.unionByName(hits).groupBy("doc_id", "copy", "n_words").agg(
        F.sum(F.col("base").cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("n")).cast("int").alias("end"))))).alias("raw"),
        F.collect_set("wid").alias("wids"),
    ))
    key = ["doc_id", "copy", "n_words", "copies", "raw"]
    dirty = per_doc.where("size(wids) > 0").select(*key, F.explode("wids").alias("wid")).join(holders, "wid").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    every = per_doc.where("size(wids) = 0").select(*key, F.expr("cast(array() as array<string>)").alias("items")).unionByName(dirty)
    merged = every.select("doc_id", F.lower(F.hex("copy")).alias("copy"), "n_words", "copies", _merge("raw").alias("spans"), "items")
    return merged.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def _merge(spans: str):
    """Sorted (start, end) with those that overlap or touch made one; an array is only appended to where a gap is."""
    s = F.col(spans)
    # A span begins a merged one if no earlier span reaches it: all windows of an item may differ in length, so the largest end so far counts.
    empty = F.expr("named_struct('done', cast(array() as array<struct<start:int,end:int>>), 'start', cast(null as int), 'end', cast(null as int))")

    def step(acc, x):
        gap = acc["start"].isNotNull() & (x["start"] > acc["end"])
        return F.struct(
            F.when(gap, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"]).alias("done"),
            F.when(gap | acc["start"].isNull(), x["start"]).otherwise(acc["start"]).alias("start"),
            F.when(gap | acc["start"].isNull(), x["end"]).otherwise(F.greatest(acc["end"], x["end"])).alias("end"),
        )

    def end(acc):
        return F.when(acc["start"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))

    return F.aggregate(s, empty, step, end)


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs without those that hold any window of an item; all others stay, whatever is null or repeated in them."""
    hit = written(contamination(docs, items, size).where(F.size("spans") > 0).select(F.col("doc_id").alias("__doc"), F.col("copy").alias("__copy")).distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(hit["__doc"]) & (F.md5(docs["text"].cast("string").cast("binary")) == hit["__copy"])
    return docs.join(hit, same, "left_anti")


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; for null, empty, repeated and long texts see contamination()."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
with dw as (select doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x) w from documents),
iw as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') win from (select item_id, w, least(10, len(w)) n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from iw where len(w) > 0)),
sizes as (select distinct n from win),
spans as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
hit as (select s.doc_id, s.i, s.n, w.item_id from spans s join win w on s.win = w.win and s.n = w.n),
words as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from hit) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hit) group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw d left join words using (doc_id) left join items using (doc_id)
"""
