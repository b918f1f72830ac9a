"""The index on disk: immutable segments of Parquet, and a manifest whose replacement is the sole point of commit.

    <index>/MANIFEST                   generation, next segment, active segments, positions, checksum
    <index>/segment-<16 digits>/       documents/, postings/ (sorted by term) and _segment.json with the size and digest of each file

A writer holds a lock on the folder. It writes a segment under a temporary name, renames it, then replaces the
manifest; what an interrupted writer left behind is removed by the next one. Segments that a new generation no
longer names stay for one more generation, for readers that still use them.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
import shutil
import uuid
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "segment_id long, doc_ord long, path string, file_size long, mtime_ns long, token_count int, tombstone boolean, content_hash long"
POSTINGS = "term string, segment_id long, doc_ord long, tf int, positions array<int>"
_SEGMENT = re.compile(r"segment-(\d{16})")
_TEMPORARY = re.compile(r"\.(?:segment|manifest)-[0-9a-f]{32}")


class IndexFailure(RuntimeError):
    """An index that can't be read or written as asked."""


@dataclass(frozen=True)
class Manifest:
    generation: int
    next_segment: int
    active: tuple[int, ...]
    positions: bool = True
    retired: tuple[int, ...] = field(default=())

    def check(self) -> Manifest:
        if self.generation < 1 or not self.active or list(self.active) != sorted(set(self.active)) or self.active[0] < 1 or self.active[-1] >= self.next_segment:
            raise IndexFailure("the manifest is not valid")
        return self


def segment_name(n: int) -> str:
    return f"segment-{n:016d}"


def _body(m: Manifest) -> dict:
    return {"generation": m.generation, "next_segment": m.next_segment, "active": list(m.active), "positions": m.positions, "retired": list(m.retired)}


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def read_manifest(folder: Path) -> Manifest:
    try:
        raw = json.loads((folder / "MANIFEST").read_text())
        body = raw["body"]
        if raw["sha256"] != _digest(body):
            raise IndexFailure("the manifest's checksum differs")
        return Manifest(body["generation"], body["next_segment"], tuple(body["active"]), body["positions"], tuple(body["retired"])).check()
    except FileNotFoundError:
        raise IndexFailure(f"{folder} holds no manifest: rebuild the index") from None
    except (ValueError, KeyError, TypeError) as e:
        raise IndexFailure(f"the manifest can't be read: {e}") from e


def sync(path: Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


class Transaction:
    """Holds the writer's lock from the start to commit() or close()."""

    def __init__(self, folder: Path, create: bool):
        if create:
            folder.mkdir(parents=True, exist_ok=True)
        if not folder.is_dir():
            raise IndexFailure(f"there is no index in {folder}")
        self.folder, self.temporary = folder, []
        self.lock = os.open(folder, os.O_RDONLY)
        try:
            fcntl.flock(self.lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            os.close(self.lock)
            raise IndexFailure(f"another writer holds {folder}") from None
        try:
            self.old = read_manifest(folder) if (folder / "MANIFEST").exists() else None
            self.recover()
            seen = [int(m[1]) for p in folder.iterdir() if (m := _SEGMENT.fullmatch(p.name))]
            self.next_segment = max([0, *seen, self.old.next_segment - 1 if self.old else 0]) + 1
        except BaseException:
            self.close()
            raise

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        for path in self.temporary:
            shutil.rmtree(path, ignore_errors=True)
        self.temporary = []
        if self.lock is not None:
            os.close(self.lock)
            self.lock = None

    def recover(self) -> None:
        """Removes what interrupted writers left; files of other names stay."""
        named = {*self.old.active, *self.old.retired} if self.old else set()
        for p in self.folder.iterdir():
            m = _SEGMENT.fullmatch(p.name)
            if _TEMPORARY.fullmatch(p.name) or (m and int(m[1]) not in named and self.old):
                shutil.rmtree(p) if p.is_dir() else p.unlink()

    def staged(self, rows: DataFrame) -> DataFrame:
        """rows as they are now, in a folder of their own until the transaction ends: read again and again, they stay the same."""
        path = self.folder / f".segment-{uuid.uuid4().hex}"
        self.temporary.append(path)
        rows.write.parquet(path.absolute().as_uri())
        return rows.sparkSession.read.schema(rows.schema).parquet(path.absolute().as_uri())

    def write(self, documents: DataFrame, postings: DataFrame) -> Path:
        """A segment under a temporary name. Postings are sorted by term across files, so a query's terms meet few row groups."""
        path = self.folder / f".segment-{uuid.uuid4().hex}"
        self.temporary.append(path)
        uri = path.absolute().as_uri()
        documents.write.parquet(f"{uri}/documents")
        postings.repartitionByRange("term", "doc_ord").sortWithinPartitions("term", "doc_ord").write.parquet(f"{uri}/postings")
        files = sorted(p for p in path.rglob("*.parquet"))
        (path / "_segment.json").write_text(json.dumps(file_digests(documents.sparkSession, path, files)))
        for p in [path / "_segment.json", path]:
            sync(p)
        return path

    def commit(self, candidate: Path | None, keep: tuple[int, ...], positions: bool) -> tuple[Manifest, list[str]]:
        """Publishes candidate after the segments of keep; the rest are retired. Gives warnings of the cleaning up."""
        number, active = self.next_segment, keep
        if candidate is not None:
            os.rename(candidate, self.folder / segment_name(number))
            self.temporary.remove(candidate)
            sync(self.folder)
            active = (*keep, number)
        gone = tuple(s for s in (self.old.active if self.old else ()) if s not in active)
        new = Manifest((self.old.generation if self.old else 0) + 1, number + 1, active, positions, gone).check()
        temp = self.folder / f".manifest-{uuid.uuid4().hex}"
        body = _body(new)
        temp.write_text(json.dumps({"body": body, "sha256": _digest(body)}))
        sync(temp)
        os.replace(temp, self.folder / "MANIFEST")
        sync(self.folder)
        warnings = []
        for s in self.old.retired if self.old else ():
            try:
                if s not in active:
                    shutil.rmtree(self.folder / segment_name(s))
            except OSError as e:
                warnings.append(f"{segment_name(s)}: {e}")
        return new, warnings


def file_digests(spark: SparkSession, folder: Path, files: list[Path]) -> dict[str, list]:
    """Of each file its size and SHA-256, by its name below folder: read, and synced to disk, by the executors."""

    def run(batches):
        for batch in batches:
            paths, sizes, digests = batch.column(0).to_pylist(), [], []
            for p in map(Path, paths):
                with p.open("rb") as f:
                    digests.append(hashlib.file_digest(f, "sha256").hexdigest())
                    os.fsync(f.fileno())
                    sizes.append(os.fstat(f.fileno()).st_size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["path", "size", "sha256"])

    if not files:
        return {}
    table = spark.createDataFrame([(str(p.absolute()),) for p in files], "path string").repartition(min(len(files), 4096))
    rows = table.mapInArrow(run, "path string, size long, sha256 string").collect()  # a row for each file
    return {str(Path(r["path"]).relative_to(folder.absolute())): [r["size"], r["sha256"]] for r in rows}


def segment_bytes(folder: Path, m: Manifest) -> int:
    return sum(p.stat().st_size for s in m.active for p in (folder / segment_name(s)).rglob("*.parquet"))


def check_files(folder: Path, m: Manifest, spark: SparkSession | None = None) -> None:
    """Holds the files of active segments against what was written: names and sizes, which a writer needs, and with spark all contents, on the executors."""
    for s in m.active:
        path = folder / segment_name(s)
        try:
            wanted = json.loads((path / "_segment.json").read_text())
        except (OSError, ValueError) as e:
            raise IndexFailure(f"{path.name} can't be read: {e}") from e
        files = list(path.rglob("*.parquet"))
        sizes = {str(p.relative_to(path)): p.stat().st_size for p in files}
        if sizes != {name: size for name, (size, _) in wanted.items()} or (spark and file_digests(spark, path, files) != wanted):
            raise IndexFailure(f"{path.name}: files are missing, added or changed")


def open_segments(spark: SparkSession, folder: Path, m: Manifest) -> tuple[DataFrame, DataFrame]:
    """The records of all active segments. segment_id is stored, so no list of files grows with the data."""
    paths = [(folder / segment_name(s)).absolute().as_uri() for s in m.active]
    docs = spark.read.schema(DOCUMENTS).parquet(*(f"{p}/documents" for p in paths))
    return docs, spark.read.schema(POSTINGS).parquet(*(f"{p}/postings" for p in paths))


def read_index(spark: SparkSession, folder: Path, attempts: int = 3) -> tuple[Manifest, DataFrame, DataFrame]:
    """A generation; tried again if a writer replaced it meanwhile."""
    for left in reversed(range(attempts)):
        m = read_manifest(folder)
        try:
            for s in m.active:
                if not (folder / segment_name(s) / "_segment.json").exists():
                    raise IndexFailure(f"{segment_name(s)} is missing")
            return m, *open_segments(spark, folder, m)
        except Exception:
            if not left or read_manifest(folder).generation == m.generation:
                raise
    raise AssertionError
