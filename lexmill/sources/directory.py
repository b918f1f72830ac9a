"""Folders of text files: the scan on the driver, the reading on the executors."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.deploy import ship
from lexmill.functions.text import glob_match

MOST_FILE_BYTES = 16 << 20


@dataclass(frozen=True)
class ScanOptions:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    most_bytes: int = MOST_FILE_BYTES
    follow_links: bool = False


@dataclass
class Scan:
    root: str
    files: list[tuple[str, int, int]] = field(default_factory=list)  # path, size, mtime_ns
    errors: list[tuple[str, str]] = field(default_factory=list)


def _fits(path: str, patterns: tuple[str, ...]) -> bool:
    """A pattern with a slash is held against the path, one without against the file name."""
    return any(glob_match(path if "/" in p else path.rpartition("/")[2], p) for p in patterns)


def scan(root: str, options: ScanOptions = ScanOptions()) -> Scan:
    """Regular files below root, sorted by path. Hidden and empty files count; larger ones than most_bytes are passed over.

    Links are passed over, or followed, each folder once. What can't be read is among the errors; the rest goes on.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(f"there is no {root}")
    if not os.path.isdir(root):
        raise NotADirectoryError(f"{root} is not a folder")
    out, seen, todo = Scan(root), {os.path.realpath(root)}, [""]
    while todo:
        below = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, below)))
        except OSError as e:
            out.errors.append((below, str(e)))
            continue
        for e in entries:
            path = f"{below}/{e.name}" if below else e.name
            try:
                if e.is_symlink() and not options.follow_links:
                    continue
                if e.is_dir():
                    if options.follow_links:
                        if (real := os.path.realpath(e.path)) in seen:
                            continue
                        seen.add(real)
                    todo.append(path)
                elif e.is_file():
                    st = e.stat()
                    path.encode("utf-8")
                    if st.st_size <= options.most_bytes and (not options.include or _fits(path, options.include)) and not _fits(path, options.exclude):
                        out.files.append((path, st.st_size, st.st_mtime_ns))
            except (OSError, UnicodeEncodeError) as err:
                out.errors.append((path.encode("utf-8", "replace").decode(), str(err)))
    order = lambda x: x[0].encode()
    out.files.sort(key=order)
    out.errors.sort(key=order)
    return out


def read(spark: SparkSession, found: Scan, invalid: str = "replace") -> DataFrame:
    """path, file_size, mtime_ns, text, content_hash, n_invalid, error of each file.

    A file that changes or fails while it is read has an error and no text. Invalid UTF-8 becomes U+FFFD, one for
    each maximal subsequence, or with invalid="reject" an error that names the offset.
    """
    ship(spark)
    root, schema = found.root, "path string, file_size long, mtime_ns long, content binary, text string, n_invalid long, error string"

    def one(path: str, size: int, mtime_ns: int):
        full = os.path.join(root, path)
        try:
            before = os.stat(full)
            with open(full, "rb") as f:
                raw = f.read()
            after = os.stat(full)
            if len(raw) != size or (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns) or after.st_mtime_ns != mtime_ns:
                return None, None, 0, "the file changed while it was read"
        except OSError as e:
            return None, None, 0, str(e)
        try:
            return raw, raw.decode("utf-8"), 0, None
        except UnicodeDecodeError as e:
            if invalid == "reject":
                return raw, None, 0, f"invalid UTF-8 at byte {e.start}"
            text = raw.decode("utf-8", "replace")
            return raw, text, text.count("�") - raw.count("�".encode()), None

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                rows = [one(*r) for r in zip(*(part.column(k).to_pylist() for k in range(3)))]
                raw, text, bad, error = zip(*rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary()), pa.array(text, pa.string()), pa.array(bad, pa.int64()), pa.array(error, pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    table = spark.createDataFrame(found.files, "path string, file_size long, mtime_ns long")
    # Files of like number, not of like size, go to a task; none is larger than most_bytes.
    parts = max(1, min(len(found.files) // 8 + 1, 4 * spark.sparkContext.defaultParallelism))
    return table.repartition(parts).mapInArrow(run, schema).withColumn("content_hash", F.xxhash64("content")).drop("content")
