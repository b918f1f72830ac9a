"""Shared pieces of the training-data operators: hashing, written tables, bit filters, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows handled at once inside a Python worker; bounds the word lists that are alive together.
SLICE = 128


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder; a temporary one only where none is set and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lexmill-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The mount point of a shared folder, for operators that write files of their own format."""
    for prefix in ("file://", "file:"):
        if uri.startswith(prefix):
            return uri[len(prefix):]
    if "://" in uri:
        raise ValueError(f"a folder mounted on all executors is needed here, not {uri}")
    return uri


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def text_of(docs: DataFrame, col: str = "text"):
    return F.coalesce(docs[col].cast("string"), F.lit(""))


@functools.cache
def _libc():
    """The C library, told to map blocks of 4 MB and more by themselves, so that their memory goes back as they are freed; None where it is not glibc."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim") or not hasattr(libc, "mallopt"):
        return None
    libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD; unless it is set it rises to 32 MB
    return libc


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on with all that its largest task took."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        batch = None
        give_back()


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """(key, rows) of each run of rows alike in the first `keys` columns, whole numbers without nulls, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    give_back()

    def whole():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield last, whole()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, whole()


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all words once it holds `most`."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of a text whose word hashes are h; none if it has fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = h[:n] + np.uint64(k)
    for i in range(1, k):
        x = mix(x) * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return mix(x)


FILTER_BITS = 27
#: Up to how many more bits a filter may have for many entries.
MORE_BITS = 2


def bit_filter(df: DataFrame, col: str, entries: int = 0) -> np.ndarray:
    """A filter of 2**27 bits (16 MB) that is set at the top bits of each 64-bit hash; for so many entries of up to 2**29 bits (64 MB), whatever their number.

    The executors build 64 KB pages; the driver only puts at most 1,024 of them side by side.
    More hashes make more false positives, which the later exact steps discard; it has no false negatives.
    """
    page_bits = 19

    def arrow_pages(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            page = bit >> page_bits
            for p in np.unique(page):
                a = acc.setdefault(int(p), np.zeros(1 << (page_bits - 3), np.uint8))
                at = np.unique(bit[page == p] & ((1 << page_bits) - 1))
                np.bitwise_or.at(a, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if acc:
            yield pa.RecordBatch.from_pydict({"page": pa.array(list(acc), pa.int64()), "bits": pa.array([a.tobytes() for a in acc.values()], pa.binary())})

    # Eight bits an entry, if there may be so many.
    n = FILTER_BITS + min(max((entries * 8 - 1).bit_length() - FILTER_BITS, 0), MORE_BITS)
    bits = df.select(F.shiftrightunsigned(F.col(col), 64 - n).alias("bit")).distinct()
    bits = bits.repartition(16, F.shiftright("bit", page_bits))
    out = np.zeros(1 << (n - 3), np.uint8)
    for row in bits.mapInArrow(arrow_pages, "page long, bits binary").collect():
        at = row["page"] << (page_bits - 3)
        out[at:at + (1 << (page_bits - 3))] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(65 - (len(bits) * 8).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of edges (a, b long).

    Each round, every node points at its smallest neighbour, pointers are followed four steps, and
    the edges are contracted; what is left shrinks by a constant factor at least. Rounds are written
    to the shared folder, and nothing but the number of edges left comes to the driver.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = ends.select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        to = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        for _ in range(2):
            up = to.select(F.col("v").alias("p"), F.col("p").alias("q"))
            to = to.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        to = written(to)
        labels = written(labels.join(to, labels.label == to.v, "left").select("node", F.coalesce("p", "label").alias("label")))
        a, b = to.select(F.col("v").alias("a"), F.col("p").alias("pa")), to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        new = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        edges = written(new.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
