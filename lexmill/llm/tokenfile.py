"""Token ids in files of patched frame-of-reference blocks.

A file: blocks of 128 ids, then an index. A block subtracts its minimum and packs the differences at the width
that its 90th percentile needs; larger ones are in the block's list of exceptions, by place and value.
    block: minimum u32, width u8, exceptions u8, packed ceil(count * width / 8) bytes (lowest bits first), places u8 each, values u32 each
    index: a u64 for the start of each block and the end of the last, then for each document doc_id i64, is-null u8, end u64
    trailer: blocks u64, documents u64, ids u64, b"PFOR0002"
The index gives any range of ids without reading the rest. Files of a table are in ascending order of doc_id.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import local_path, read_table, shared_dir, slices, tokenizer_path
from lexmill.llm.encoding import encoder

BLOCK, PERCENTILE = 128, 90
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("end", "<u8")])
_BITS = np.array([int(x).bit_length() for x in range(1 << 16)], np.uint8)


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> 16
    return np.where(high > 0, _BITS[high] + np.uint8(16), _BITS[x & 0xFFFF])


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of whole multiples of BLOCK ids (or one shorter block), and their lengths in bytes."""
    full = len(ids) // BLOCK
    if full == 0:
        return _encode(ids.reshape(1, -1)) if len(ids) else ([], np.empty(0, np.int64))
    assert full * BLOCK == len(ids)
    return _encode(ids.reshape(full, BLOCK))


def _packed(x: np.ndarray, width: int) -> np.ndarray:
    """Each row's values below 2**width, the lowest bit first, as bytes: eight values make `width` bytes."""
    rows, n = x.shape
    groups = -(-n // 8)
    v = np.zeros((rows, groups * 8), np.uint64)
    v[:, :n] = x
    v = v.reshape(rows, groups, 8)
    out = np.zeros((rows, groups, width + 8), np.uint8)
    for k in range(8):
        at, shift = divmod(k * width, 8)
        part = v[:, :, k] << np.uint64(shift)
        for i in range(-(-(shift + width) // 8)):
            out[:, :, at + i] |= (part >> np.uint64(8 * i)).astype(np.uint8)
    return out[:, :, :width].reshape(rows, -1)[:, : -(-n * width // 8)]


def _unpacked(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n values of each row of bytes."""
    kind = np.uint32 if width <= 24 else np.uint64
    at, shift = np.divmod(np.arange(n) * width, 8)
    out = np.zeros((len(raw), n), kind)
    for i in range(-(-(7 + width) // 8)):
        # A value's last byte may be that before the row's end; what is read beyond it is masked.
        out |= raw[:, np.minimum(at + i, raw.shape[1] - 1)].astype(kind) << kind(8 * i)
    return (out >> shift.astype(kind)) & kind((1 << width) - 1)


def _encode(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    n = x.shape[1]
    low = x.min(1)
    d = x - low[:, None]
    need = np.partition(d, (k := min(n - 1, n * PERCENTILE // 100)), axis=1)[:, k]
    width = _bit_length(need)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        part = d[rows]
        bad = part >> w > 0 if w < 32 else np.zeros(part.shape, bool)
        size = -(-n * w // 8)
        body = _packed(np.where(bad, 0, part), w).tobytes() if w else b""
        count = bad.sum(1)
        head = np.zeros((len(rows), 6), np.uint8)
        head[:, :4] = low[rows].astype("<u4").reshape(-1, 1).view(np.uint8)
        head[:, 4], head[:, 5] = w, count
        heads, places, values = head.tobytes(), np.nonzero(bad)[1].astype(np.uint8).tobytes(), part[bad].astype("<u4").tobytes()
        ends = np.cumsum(count).tolist()
        for i, (r, e, c) in enumerate(zip(rows.tolist(), ends, count.tolist())):
            out[r] = heads[6 * i:6 * i + 6] + body[size * i:size * i + size] + places[e - c:e] + values[4 * (e - c):4 * e]
    return out, np.array([len(b) for b in out], np.int64)


def decode_blocks(raw: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at starts in raw and hold counts ids."""
    buf = np.frombuffer(raw, np.uint8)
    head = buf[starts[:, None] + np.arange(6)]
    low = head[:, :4].copy().view("<u4").reshape(-1)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w, n in {(int(w), int(n)) for w, n in zip(head[:, 4], counts)}:
        rows = np.flatnonzero((head[:, 4] == w) & (counts == n))
        if w:
            out[rows, :n] = _unpacked(buf[starts[rows][:, None] + 6 + np.arange(-(-n * w // 8))], n, w)
    for r in np.flatnonzero(head[:, 5]).tolist():
        w, n, e = int(head[r, 4]), int(counts[r]), int(head[r, 5])
        at = int(starts[r]) + 6 + -(-n * w // 8)
        out[r, buf[at:at + e]] = np.frombuffer(raw, "<u4", e, at + e)
    out += low[:, None]
    return out.reshape(-1)[: int(counts.sum())] if (counts[:-1] == BLOCK).all() else np.concatenate([o[:c] for o, c in zip(out, counts)])


class Writer:
    def __init__(self, path: str):
        self.path, self.temp = path, f"{path}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.f = open(self.temp, "wb")
        self.rest, self.lengths, self.docs, self.n = np.empty(0, np.uint32), [], [], 0

    def add(self, docs: list[tuple[int | None, int]], ids: np.ndarray) -> None:
        """docs: id and number of ids of each, in order; ids: all of theirs."""
        for doc_id, n in docs:
            self.n += n
            self.docs.append((doc_id or 0, doc_id is None, self.n))
        ids = np.concatenate([self.rest, ids])
        cut = len(ids) // BLOCK * BLOCK
        self.rest = ids[cut:]
        self._put(ids[:cut])

    def _put(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), 512 * BLOCK):
            blocks, lengths = encode_blocks(ids[i:i + 512 * BLOCK])
            self.f.write(b"".join(blocks))
            self.lengths.append(lengths)

    def close(self) -> tuple[int, int]:
        """Ends the file and puts it in its place at once; returns its numbers of documents and ids."""
        self._put(self.rest)
        lengths = np.concatenate([np.zeros(1, np.int64), *self.lengths])
        self.f.write(np.cumsum(lengths).astype("<u8").tobytes())
        self.f.write(np.array(self.docs, _DOC).tobytes())
        self.f.write(np.array([len(lengths) - 1, len(self.docs), self.n], "<u8").tobytes() + b"PFOR0002")
        self.f.flush()
        os.fsync(self.f.fileno())
        self.f.close()
        os.replace(self.temp, self.path)
        return len(self.docs), self.n


class Reader:
    def __init__(self, path: str):
        self.f = open(path, "rb")
        size = os.fstat(self.f.fileno()).st_size
        tail = self._at(size - 32, 32)
        if tail[24:] != b"PFOR0002":
            raise ValueError(f"{path} is no file of token ids")
        self.blocks, n_docs, self.n = np.frombuffer(tail, "<u8", 3).astype(np.int64).tolist()
        at = size - 32 - n_docs * _DOC.itemsize
        self.docs = np.frombuffer(self._at(at, n_docs * _DOC.itemsize), _DOC)
        self.starts = np.frombuffer(self._at(at - 8 * (self.blocks + 1), 8 * (self.blocks + 1)), "<u8").astype(np.int64)

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, reading only their blocks."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        raw = self._at(int(self.starts[a]), int(self.starts[b] - self.starts[a]))
        counts = np.minimum(BLOCK, self.n - np.arange(a, b) * BLOCK)
        return decode_blocks(raw, self.starts[a:b] - self.starts[a], counts)[start - a * BLOCK:stop - a * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document's id, its ids before it in the file, and its ids; about `most` ids are decoded at once."""
        ends, d = self.docs["end"].astype(np.int64), 0
        while d < len(ends):
            start = int(ends[d - 1]) if d else 0
            to = max(d + 1, int(np.searchsorted(ends, start + most, "right")))
            ids = self.ids(start, int(ends[to - 1]))
            for k in range(d, to):
                a = (int(ends[k - 1]) if k else 0) - start
                yield (None if self.docs["null"][k] else int(self.docs["id"][k])), start + a, ids[a:int(ends[k]) - start]
            d = to


def write_ids(docs: DataFrame, path: str, end_id: int, out: str) -> DataFrame:
    """Writes the ids of all texts, each followed by end_id, below the shared folder `out`; a manifest row per file.

    Files follow one another in ascending order of doc_id (nulls first, rows that repeat a doc_id by the hash
    of their text). A null or empty text has the end id alone. A task that is run again writes the same file.
    """
    folder = local_path(out)

    def run(batches):
        from pyspark import TaskContext

        enc, writer, end = encoder(path), None, np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in slices(batches):
            writer = writer or Writer(f"{folder}/part-{part:06d}.pfor")
            raw = [r + end for r in enc.encode([t or "" for t in batch.column(1).to_pylist()])]
            writer.add([(d, len(r) // 4) for d, r in zip(batch.column(0).to_pylist(), raw)], np.frombuffer(b"".join(raw), "<u4"))
        if writer:
            n_docs, n = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([writer.path], pa.string()), pa.array([n_docs], pa.int64()), pa.array([n], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long")


def read_ids(spark: SparkSession, files: list[tuple[str, int]], with_ids: bool = False) -> DataFrame:
    """Per document of the files, given with the number of ids before each: doc_id, start, n_tokens, ids_crc32, and ids on demand."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, start, ids in Reader(path).documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int64) if with_ids else None))
                    if len(rows) >= 1024:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    def pack(rows):
        c = list(zip(*rows))
        arrays = [pa.array(x, pa.int64()) for x in c[:4]] + ([pa.array(c[4], pa.list_(pa.int64()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    table = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, path: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Writes the ids of docs to files in the shared folder and reads those files back."""
    spark = docs.sparkSession
    # A row for each file: their number is that of the shuffle's partitions.
    files = write_ids(docs, path, end_id, shared_dir(spark)).collect()
    base, found = 0, []
    for f in sorted(files, key=lambda f: f["part"]):
        found.append((f["path"], base))
        base += f["n_ids"]
    return read_ids(spark, found, with_ids)


def op8(spark, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
