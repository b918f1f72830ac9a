"""Keeping an index: rebuild, update, remove, compact, and the relational operators these are made of."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexmill.functions import grouping
from lexmill.functions import text as tx
from lexmill.functions.deploy import ship
from lexmill.operators import storage as st
from lexmill.operators import validation
from lexmill.sources import directory
from lexmill.sources.corpus import postings_of

# --- relational operators ----------------------------------------------------------------------------------------


def visible(records: DataFrame) -> DataFrame:
    """The last record of each path, in order of segment and place; none where that is a tombstone.

    One aggregation, combined before the shuffle: the records of a path are never sorted or gathered.
    """
    rest = [c for c in records.columns if c not in ("segment_id", "doc_ord", "path")]
    last = records.groupBy("path").agg(F.max(F.struct("segment_id", "doc_ord", *rest)).alias("r"))
    return last.select(*(F.col("path") if c == "path" else F.col(f"r.{c}") for c in records.columns)).where(~F.col("tombstone"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, modified, removed, unchanged) between visible documents and a source, with the source's columns.

    A document without a content hash counts as modified.
    """
    o = old.select("path", *(F.col(c).alias(f"__{c}") for c in ("file_size", "mtime_ns", "content_hash")))
    rows = o.withColumn("__old", F.lit(True)).join(new.withColumn("__new", F.lit(True)), "path", "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f"__{c}") == F.col(c) for c in ("file_size", "mtime_ns", "content_hash")))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("modified")
    return rows.withColumn("change", change).drop("__old", "__new", "__file_size", "__mtime_ns", "__content_hash")


def removals(docs: DataFrame, globs: list[str]) -> DataFrame:
    return docs.where(reduce(lambda a, b: a | b, (tx.glob_matches(F.col("path"), g) for g in globs)))


# --- options and results -----------------------------------------------------------------------------------------

MIB = 1 << 20
PROFILES = {
    "minimal": {"memory_limit_bytes": 128 * MIB, "flush_bytes": 32 * MIB, "worker_threads": 1, "merge_fan_in": 4, "positions": False},
    "balanced": {"memory_limit_bytes": 256 * MIB, "flush_bytes": 128 * MIB, "worker_threads": 2, "merge_fan_in": 16, "positions": True},
    "performance": {"memory_limit_bytes": 1024 * MIB, "flush_bytes": 512 * MIB, "worker_threads": None, "merge_fan_in": 32, "positions": True},
}
MOST_SEGMENTS = 16
#: Diagnostics of documents that a result lists; it counts all of them.
MOST_DIAGNOSTICS = 1000
#: Logical bytes without which nothing can be indexed.
LEAST_MEMORY = 4096


@dataclass(frozen=True)
class IndexOptions:
    profile: str = "balanced"
    memory_limit_bytes: int | None = None
    temporary_space_limit_bytes: int | None = None
    temporary_directory: str | None = None
    worker_threads: int | None = None
    merge_fan_in: int | None = None

    def resolved(self) -> dict:
        if self.profile not in PROFILES:
            raise ValueError(f"there is no profile {self.profile}")
        out = dict(PROFILES[self.profile])
        for name, least in (("memory_limit_bytes", 1), ("temporary_space_limit_bytes", 1), ("worker_threads", 1), ("merge_fan_in", 2)):
            value = getattr(self, name)
            if value is not None:
                if value < least:
                    raise ValueError(f"{name} must be at least {least}")
                out[name] = value
        if self.temporary_directory is not None and not os.path.isdir(self.temporary_directory):
            raise ValueError(f"{self.temporary_directory} is not an existing folder")
        out["worker_threads"] = out["worker_threads"] or os.cpu_count() or 1
        return out


@dataclass(frozen=True)
class Diagnostic:
    stage: str  # scan, document, cleanup, maintenance
    path: str
    message: str


@dataclass(frozen=True)
class Changes:
    added: int = 0
    modified: int = 0
    removed: int = 0
    unchanged: int = 0
    matched: int = 0
    discarded_records: int = 0


@dataclass(frozen=True)
class Metrics:
    scanned_files: int = 0
    indexed_files: int = 0
    failed_files: int = 0
    indexed_bytes: int = 0
    token_count: int = 0
    peak_memory_bytes: int = 0
    peak_temporary_bytes: int = 0
    temporary_segments: int = 0
    merge_passes: int = 0
    worker_threads: int = 0
    positions_enabled: bool = True


@dataclass(frozen=True)
class IndexResult:
    outcome: str  # unchanged, published, compacted
    revision: int
    active_segments: int
    changes: Changes = Changes()
    metrics: Metrics = Metrics()
    diagnostics: list[Diagnostic] = field(default_factory=list)


@dataclass(frozen=True)
class IndexStats:
    documents: int
    segments: int
    tombstones: int
    terms: int
    postings: int
    positions: int
    bytes: int


# --- the writer --------------------------------------------------------------------------------------------------


def measured(df: DataFrame, keep: bool = True) -> DataFrame:
    """df, which has text and error, with token_count, and an error where a token is too long; without `keep`, the text is left out."""
    ship(df.sparkSession)
    df = df.select(*(c for c in df.columns if c != "text"), "text")
    kept = df.schema.fields if keep else df.schema.fields[:-1]
    df = df.mapInArrow(partial(grouping.measured_batches, keep=keep), StructType([*kept, StructField("token_count", IntegerType()), StructField("longest", IntegerType())]))
    too_long = F.when(F.col("longest") > tx.MOST_TOKEN_BYTES, F.lit(f"a token is longer than {tx.MOST_TOKEN_BYTES} bytes"))
    return df.withColumn("error", F.coalesce("error", too_long)).drop("longest")


class IndexWriter:
    """Maintains one index; until a method commits, the former generation stays as it is."""

    def __init__(self, spark: SparkSession, index_dir: str, options: IndexOptions = IndexOptions(), invalid: str = "replace"):
        self.spark, self.folder, self.invalid = spark, Path(index_dir), invalid
        self.options, self.limits = options, options.resolved()

    # Sources: a folder, or a table with path, text and mtime_ns.
    def _source(self, source, options: directory.ScanOptions) -> tuple[DataFrame, list[Diagnostic]]:
        if isinstance(source, DataFrame):
            size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
            mtime = F.col("mtime_ns").cast("long") if "mtime_ns" in source.columns else F.lit(0).cast("long")
            return source.select("path", size.alias("file_size"), mtime.alias("mtime_ns"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content_hash"), F.lit(None).cast("string").alias("error")), []
        found = directory.scan(str(source), options)
        return directory.read(self.spark, found, self.invalid).drop("n_invalid"), [Diagnostic("scan", p, m) for p, m in found.errors]

    def _staged(self, t: st.Transaction, rows: DataFrame) -> DataFrame:
        """rows in ranges of path, written with their place: a partition's number and the number within it. Rows with a text are measured;
        texts are shuffled once, and never with their tokens. A partition's rows with errors come before its others."""
        ranged = rows.repartitionByRange("path")
        ranged = measured(ranged) if "text" in rows.columns else ranged.withColumn("error", F.lit(None).cast("string"))
        # The tie of rows that share a path doesn't depend on the run.
        ties = [F.col(c) for c in ("mtime_ns", "content_hash") if c in rows.columns]
        ordered = ranged.sortWithinPartitions(F.col("error").isNull(), "path", *ties)
        return t.staged(ordered.withColumn("__place", F.monotonically_increasing_id()))

    def _numbered(self, staged: DataFrame, segment: int) -> tuple[DataFrame, int]:
        """The rows without an error, with segment_id and doc_ord from 0 in order of path, and how many these are. Only counts of partitions come to the driver."""
        part, place = F.shiftright("__place", 33).cast("int"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
        counts = {r["part"]: r for r in staged.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count("error").alias("bad")).collect()}
        total, shift = 0, []
        for p in range(max(counts, default=-1) + 1):
            n, bad = (counts[p]["n"], counts[p]["bad"]) if p in counts else (0, 0)
            shift.append(total - bad)
            total += n - bad
        before = F.element_at(F.array(*map(F.lit, shift)), part + 1) if shift else F.lit(0)
        return staged.where("error is null").withColumns({"segment_id": F.lit(segment).cast("long"), "doc_ord": (before + place).cast("long")}).drop("__place"), total

    def _records(self, numbered: DataFrame, positions: bool) -> tuple[DataFrame, DataFrame]:
        docs = numbered.select("segment_id", "doc_ord", "path", "file_size", "mtime_ns", "token_count", "tombstone", "content_hash")
        return docs, postings_of(numbered.where(~F.col("tombstone")), ["segment_id", "doc_ord"], positions)

    def _space(self, candidate: Path) -> int:
        used = sum(p.stat().st_size for p in candidate.rglob("*") if p.is_file())
        limit = self.limits.get("temporary_space_limit_bytes")
        if limit is not None and used > limit:
            raise RuntimeError(f"the new segment takes {used} bytes of temporary space; the limit is {limit}")
        return used

    def _check_memory(self) -> None:
        if self.limits["memory_limit_bytes"] < LEAST_MEMORY:
            raise RuntimeError(f"a memory limit of {self.limits['memory_limit_bytes']} bytes holds no document")

    def _metrics(self, rows: DataFrame, positions: bool, used: int) -> tuple[Metrics, list[Diagnostic]]:
        ok = F.col("error").isNull()
        m = rows.agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("ok"), F.sum(F.when(ok, F.col("file_size"))).alias("bytes"), F.sum(F.when(ok, F.col("token_count"))).alias("tokens"), F.sum(F.when(ok, F.octet_length("text"))).alias("text")).first()
        bad = [Diagnostic("document", r["path"], r["error"]) for r in rows.where(~ok).select("path", "error").orderBy("path").limit(MOST_DIAGNOSTICS).collect()]
        if (left := m["n"] - m["ok"] - len(bad)) > 0:
            bad.append(Diagnostic("document", "", f"and {left} more documents"))
        return Metrics(m["n"], m["ok"], m["n"] - m["ok"], m["bytes"] or 0, m["tokens"] or 0, (m["text"] or 0) + LEAST_MEMORY, used, 1, 0, self.limits["worker_threads"], positions), bad

    def rebuild(self, source, scan: directory.ScanOptions = directory.ScanOptions()) -> IndexResult:
        """A new index of all of source. Documents that fail become diagnostics; an empty source gives an empty index."""
        self._check_memory()
        if not isinstance(source, DataFrame) and not os.path.isdir(source):
            raise FileNotFoundError(f"{source} is not a folder")
        positions = self.limits["positions"]
        with st.Transaction(self.folder, create=True) as t:
            if t.old:
                st.check_files(self.folder, t.old)
            rows, notes = self._source(source, scan)
            staged = self._staged(t, rows.withColumn("tombstone", F.lit(False)))
            numbered, _ = self._numbered(staged, t.next_segment)
            candidate = t.write(*self._records(numbered, positions))
            metrics, bad = self._metrics(staged, positions, self._space(candidate))
            new, warnings = t.commit(candidate, (), positions)
            return IndexResult("published", new.generation, len(new.active), metrics=metrics, diagnostics=[*notes, *bad, *(Diagnostic("cleanup", "", w) for w in warnings)])

    def _delta(self, t: st.Transaction, rows: DataFrame) -> tuple[Path, DataFrame, int]:
        """A segment of the rows without an error, live ones with a text, and tombstones; the rows as staged; how many the segment has."""
        staged = self._staged(t, rows)
        numbered, n = self._numbered(staged, t.next_segment)
        return t.write(*self._records(numbered, t.old.positions)), staged, n

    def _publish(self, t: st.Transaction, candidate: Path, replace_all: bool = False) -> tuple[st.Manifest, bool, list[Diagnostic]]:
        """Appends candidate, and where that makes too many segments, compacts; if that fails, the candidate is published all the same."""
        notes: list[Diagnostic] = []
        if not replace_all and len(t.old.active) + 1 > MOST_SEGMENTS:
            try:
                # The candidate takes part under the number that it would have had.
                docs, post = self._all(t, candidate)
                whole = self._compacted(t, docs, post)
                new, warnings = t.commit(whole, (), t.old.positions)
                return new, True, [*notes, *(Diagnostic("cleanup", "", w) for w in warnings)]
            except Exception as e:  # noqa: BLE001
                notes.append(Diagnostic("maintenance", "", f"compaction failed: {e}"))
        new, warnings = t.commit(candidate, () if replace_all else t.old.active, t.old.positions)
        return new, False, [*notes, *(Diagnostic("cleanup", "", w) for w in warnings)]

    def _all(self, t: st.Transaction, candidate: Path | None = None) -> tuple[DataFrame, DataFrame]:
        docs, post = st.open_segments(self.spark, self.folder, t.old)
        if candidate is not None:
            uri = candidate.absolute().as_uri()
            docs = docs.unionByName(self.spark.read.schema(st.DOCUMENTS).parquet(f"{uri}/documents"))
            post = post.unionByName(self.spark.read.schema(st.POSTINGS).parquet(f"{uri}/postings"))
        return docs, post

    def _compacted(self, t: st.Transaction, docs: DataFrame, post: DataFrame) -> Path:
        """One segment of the visible records; postings keep their terms and change their key."""
        seen, _ = self._numbered(self._staged(t, visible(docs).withColumnsRenamed({"segment_id": "__segment", "doc_ord": "__ord"})), t.next_segment)
        keys = seen.select(F.col("__segment").alias("segment_id"), F.col("__ord").alias("doc_ord"), F.col("segment_id").alias("__new"), F.col("doc_ord").alias("__new_ord"))
        moved = post.join(keys, ["segment_id", "doc_ord"]).select("term", F.col("__new").alias("segment_id"), F.col("__new_ord").alias("doc_ord"), "tf", "positions")
        return t.write(seen.select("segment_id", "doc_ord", "path", "file_size", "mtime_ns", "token_count", "tombstone", "content_hash"), moved)

    def update(self, source, scan: directory.ScanOptions = directory.ScanOptions()) -> IndexResult:
        """Brings the index up to a source. All contents are read and compared; an error of the scan or of a document ends it."""
        self._check_memory()
        if not isinstance(source, DataFrame) and not os.path.isdir(source):
            raise FileNotFoundError(f"{source} is not a folder")
        with st.Transaction(self.folder, create=False) as t:
            self._ready(t)
            docs, _ = self._all(t)
            rows, notes = self._source(source, scan)
            if notes:
                raise RuntimeError(f"{notes[0].path}: {notes[0].message}")
            # What is compared is one small row a document; texts are shuffled after, where they are to be indexed.
            now = measured(rows, keep=False).persist()
            todo = changes(visible(docs), now).persist()
            try:
                failed = now.where("error is not null").select("path", "error").first()
                if failed:
                    raise RuntimeError(f"{failed['path']}: {failed['error']}")
                n = {r["change"]: r["count"] for r in todo.groupBy("change").count().collect()}
                found = Changes(n.get("added", 0), n.get("modified", 0), n.get("removed", 0), n.get("unchanged", 0))
                scanned = found.added + found.modified + found.unchanged
                metrics = Metrics(scanned, found.added + found.modified, worker_threads=self.limits["worker_threads"], positions_enabled=t.old.positions)
                if not found.added + found.modified + found.removed:
                    return IndexResult("unchanged", t.old.generation, len(t.old.active), found, metrics)
                what = ["path", "file_size", "mtime_ns", "content_hash"]
                zero, none = F.lit(0).cast("long"), F.lit(None)
                fresh = rows.join(todo.where("change in ('added', 'modified')").select(*what).distinct(), what, "left_semi").select(*what, "text", "error", F.lit(False).alias("tombstone"))
                gone = todo.where("change = 'removed'").select("path", zero.alias("file_size"), zero.alias("mtime_ns"), none.cast("long").alias("content_hash"), none.cast("string").alias("text"), none.cast("string").alias("error"), F.lit(True).alias("tombstone"))
                candidate, staged, written = self._delta(t, fresh.unionByName(gone))
                if written != found.added + found.modified + found.removed:
                    raise RuntimeError("the source changed while it was read")
                used = self._space(candidate)
                m = staged.where("not tombstone").agg(F.sum("file_size").alias("b"), F.sum("token_count").alias("k")).first()
            finally:
                todo.unpersist()
                now.unpersist()
            new, compacted, notes = self._publish(t, candidate)
            metrics = replace(metrics, indexed_bytes=m["b"] or 0, token_count=m["k"] or 0, peak_temporary_bytes=used, peak_memory_bytes=(m["b"] or 0) + LEAST_MEMORY, temporary_segments=1)
            return IndexResult("compacted" if compacted else "published", new.generation, len(new.active), found, metrics, notes)

    def remove(self, globs: list[str]) -> IndexResult:
        """Hides the visible documents whose whole path matches any of globs."""
        globs = [globs] if isinstance(globs, str) else list(globs)
        if not globs or not all(globs):
            raise ValueError("remove needs patterns that are not empty")
        with st.Transaction(self.folder, create=False) as t:
            self._ready(t)
            docs, _ = self._all(t)
            hit = removals(visible(docs), globs).select("path").persist()
            try:
                n = hit.count()
                if not n:
                    return IndexResult("unchanged", t.old.generation, len(t.old.active))
                zero = F.lit(0).cast("long")
                delta = hit.select("path", zero.alias("file_size"), zero.alias("mtime_ns"), F.lit(None).cast("long").alias("content_hash"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("tombstone"))
                candidate, _, _ = self._delta(t, delta)
                used = self._space(candidate)
            finally:
                hit.unpersist()
            new, compacted, notes = self._publish(t, candidate)
            return IndexResult("compacted" if compacted else "published", new.generation, len(new.active), Changes(removed=n, matched=n), Metrics(peak_temporary_bytes=used, positions_enabled=t.old.positions), notes)

    def compact(self) -> IndexResult:
        """All visible records in one segment; nothing happens if they are already."""
        with st.Transaction(self.folder, create=False) as t:
            self._ready(t)
            docs, post = self._all(t)
            discarded = docs.count() - visible(docs).count()
            if len(t.old.active) == 1 and not discarded:
                return IndexResult("unchanged", t.old.generation, 1)
            candidate = self._compacted(t, docs, post)
            used = self._space(candidate)
            new, warnings = t.commit(candidate, (), t.old.positions)
            return IndexResult("compacted", new.generation, 1, Changes(discarded_records=discarded), Metrics(peak_temporary_bytes=used, positions_enabled=t.old.positions), [Diagnostic("cleanup", "", w) for w in warnings])

    def _ready(self, t: st.Transaction) -> None:
        if not t.old:
            raise st.IndexFailure(f"{self.folder} holds no manifest: rebuild the index")
        st.check_files(self.folder, t.old)


def validate_index(spark: SparkSession, index_dir: str) -> IndexStats:
    """Holds files, records and postings against all rules, and counts what is visible."""
    folder = Path(index_dir)
    m, docs, post = st.read_index(spark, folder)
    st.check_files(folder, m, spark)
    seen = visible(docs)
    p = validation.check(docs, post, seen)
    d = docs.agg(F.sum(F.col("tombstone").cast("long")).alias("t")).first()
    return IndexStats(seen.count(), len(m.active), d["t"] or 0, p["terms"], p["postings"], max(0, p["positions"] or 0) if m.positions else 0, st.segment_bytes(folder, m))
