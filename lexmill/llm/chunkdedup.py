"""Substring dedup by content-defined chunks.

A gear rolling hash over 16 bytes of the lower-cased text cuts it wherever five of the hash's bits are zero, 32
bytes apart on average; there is no least or greatest length, so whether a place is a cut depends on the bytes
before it alone, and an insertion changes only the chunks that it touches. Chunks are deduplicated by a
128-bit digest over the whole corpus: of each digest one place is the first, by doc_id and place. Runs of
chunks that are not the first of theirs are compared with the texts around their first places, byte by byte to
both sides; what then holds at least `least_words` words is a repeat.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.llm.common import bit_filter, in_filter, read_table, slices, written

CUT_BITS = 5
#: Bytes that a cut depends on.
WINDOW = 16
#: Words beside a chunk of which hashes tell whether its surroundings can be alike, and the number of them with which a side counts as alike.
LEVELS = np.array([1, 2, 3, 5, 7, 10, 14, 20])
NEAR = 5
#: What a place's key in the filter is changed with if the bytes beside it are asked for.
_BESIDE = 0x5DEECE66D1CE4E5B
_GEAR = np.random.default_rng(8191).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: bytes) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes up to it: h = (h << 1) + G[byte], as sums of doubling spans."""
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    span = 1
    while span < 32:
        h = h.copy()
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cuts(raw: bytes) -> np.ndarray:
    """Where chunks end; the first chunk's cut needs no WINDOW bytes before it."""
    at = np.flatnonzero(gear(raw) << np.uint32(32 - WINDOW) >> np.uint32(32 - CUT_BITS) == 0) + 1
    return at if len(at) and at[-1] == len(raw) else np.append(at, len(raw))


def _chunks(text: str | None) -> tuple[bytes, list[int]]:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    return raw, cuts(raw).tolist() if raw else []


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(d1, n): of each half digest, how often it occurs in all documents."""

    def run(batches):
        for batch in slices(batches):
            d: list[int] = []
            for t in batch.column(0).to_pylist():
                raw, ends = _chunks(t)
                d += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip([0, *ends], ends)]
            x, n = np.unique(np.array(d, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int32))], names=["d1", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "d1 long, n int").groupBy("d1").agg(F.sum("n").alias("n"))


class _Text:
    """Positions in raw: the words' begins and ends, and counts of words and code points begun before a byte."""

    def __init__(self, raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        space = _space(buf)
        self.begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
        self.ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        self.raw, self.buf = raw, buf

    def words(self, at):
        return np.searchsorted(self.begins, at)

    def points(self, at: list[int]) -> np.ndarray:
        return np.r_[0, np.cumsum((self.buf & 0xC0) != 0x80)][at]

    def back(self, at, n: int):
        """Where the last n words that begin before at begin; 0 if there are fewer."""
        k = self.words(at) - n
        return np.where(k >= 0, np.r_[self.begins, 0][np.maximum(k, 0)], 0)

    def ahead(self, at, n: int):
        """Where the first n words that begin from at on end; the text's end if there are fewer."""
        k = self.words(at) + n - 1
        return np.where(k < len(self.ends), np.r_[self.ends, 0][np.minimum(k, len(self.ends))], len(self.raw))

    def beside(self, a, b) -> np.ndarray:
        """For the chunks from a to b, 4 bits each of hashes of the LEVELS words before (upper half) and after, the nearest lowest."""
        # Sums over runs of four bytes: of bytes alike they are alike, wherever these stand.
        h = _GEAR[self.buf]
        h[1:] += h[:-1] << np.uint32(1)
        h[2:] += h[:-2] << np.uint32(2)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        h = np.r_[np.uint32(0), np.cumsum(h ^ h >> np.uint32(13), dtype=np.uint32)]
        n = LEVELS[:, None]

        def bits(lo, hi):
            x = h[hi] - h[np.minimum(lo + 3, hi)] + (hi - lo).astype(np.uint32) * np.uint32(0x9E3779B1)
            x = (x ^ x >> np.uint32(16)) * np.uint32(0xC2B2AE35)
            return ((x >> np.uint32(28)).astype(np.uint64) << (np.arange(len(LEVELS), dtype=np.uint64) * np.uint64(4))[:, None]).sum(0, dtype=np.uint64)

        return bits(self.back(a, n), a) << np.uint64(32) | bits(b, self.ahead(b, n))


def _space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def _occurrences(docs: DataFrame, bits, text_col: str, id_col: str) -> DataFrame:
    """A row for each chunk that the filter lets through: digest (two longs), place, `w`, which holds the words begun
    before it and in it, and `sig`, which tells what is beside it."""
    names = ["d1", "d2", "doc_id", "copy", "idx", "w", "sig"]

    def run(batches):
        for batch in slices(batches):
            cols: list[list[np.ndarray]] = [[] for _ in names]
            null = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, ends = _chunks(t)
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                d = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts, ends)], np.uint64)
                at = np.flatnonzero(in_filter(bits.value, d))
                if not len(at):
                    continue
                text = _Text(raw)
                a, b = np.array(starts)[at], np.array(ends)[at]
                copy = xxhash.xxh3_64_intdigest(raw)
                d2 = [xxhash.xxh3_64_intdigest(raw[x:y], 77) for x, y in zip(a.tolist(), b.tolist())]
                before = text.words(a)
                w = before << 32 | text.words(b) - before
                null += [doc_id is None] * len(at)
                for c, v in zip(cols, (d[at].view(np.int64), np.array(d2, np.uint64).view(np.int64), np.full(len(at), doc_id or 0), np.full(len(at), copy, np.uint64).view(np.int64), at, w, text.beside(a, b).view(np.int64))):
                    c.append(v)
            flat = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in cols]
            arrays = [pa.array(v) if n != "doc_id" else pa.array(v, mask=np.array(null, bool)) for n, v in zip(names, flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _whole(batches, keys: int):
    """The rows of sorted batches, parted only where one of the first `keys` columns changes."""
    held: list[pa.RecordBatch] = []

    def row(batch, i: int) -> list:
        return [batch.column(k)[i].as_py() for k in range(keys)]

    def one():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and row(held[-1], held[-1].num_rows - 1) != row(batch, 0):
            yield one()
            held = []
        other = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            other |= _changed(batch.column(k))
        cut = int(np.flatnonzero(other)[-1]) if other.any() else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield one()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield one()


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, nulls) of whole numbers; a null is 0."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _changed(*columns) -> np.ndarray:
    """Where a row differs from the one before in a column; the first row does not."""
    out = None
    for c in columns:
        for x in _values(c) if isinstance(c, pa.Array) else (c,):
            new = np.r_[False, x[1:] != x[:-1]][:len(x)]
            out = new if out is None else out | new
    return out


_PIECE = ["doc_id", "copy", "n", "p", "q", "own", "first_doc_id", "first_copy", "first_p", "first_q"]


def _pieces(again: DataFrame, least_words: int) -> DataFrame:
    """Runs of chunks p to q that may be repeats, each with where it stands first; first_p and first_q are null on a side that is not to be extended.

    A run is cut where its first places are not in a row; each such segment is extended if the words beside it may
    make up what it lacks. A side adds no more words than the fewest of LEVELS that differ, and no more bytes than
    _places() compares: nothing, if the run has them anyway. Of what is left, those stay that may hold least_words
    words together with the others that they may touch.
    """
    most = np.r_[LEVELS, 1 << 32]
    full = 1 + int(np.flatnonzero(LEVELS == NEAR)[0])

    def run(batches):
        for batch in _whole(batches, 2):
            # Rows alike in doc_id and text are one document.
            new_doc = _changed(batch.column(0), batch.column(1))
            batch = batch.filter(pa.array(np.r_[True, (new_doc | _changed(batch.column(2)))[1:]]))
            (doc, none), (first, first_none) = _values(batch.column(0)), _values(batch.column(5))
            copy, idx, w, alike, first_copy, first_idx = (batch.column(k).to_numpy() for k in (1, 2, 3, 4, 6, 7))
            word, words, left_alike, right_alike = w >> 32, w & 0xFFFFFFFF, alike >> 4, alike & 15
            new_doc = _changed(batch.column(0), batch.column(1))
            # A run repeats other documents or its own: short chunks that stand everywhere don't join the two.
            own = (doc == first) & (none == first_none) & (copy == first_copy)
            new_run = new_doc | _changed(own, idx - np.arange(len(idx)))
            new_run[0] = True
            begins = np.flatnonzero(new_run | _changed(first, first_none, first_copy, first_idx - idx))
            runs = np.flatnonzero(new_run)
            ends, run_ends = np.r_[begins[1:], len(idx)], np.r_[runs[1:], len(idx)]
            of = np.searchsorted(runs, begins, "right") - 1
            total = np.r_[0, np.cumsum(words)]
            own_words, run_words, passed = total[ends] - total[begins], (total[run_ends] - total[runs])[of], total[begins] - total[runs][of]
            has = np.where((begins == runs[of]) | (ends == run_ends[of]), run_words, own_words)
            more_left, more_right = left_alike[begins] >= full, right_alike[ends - 1] >= full
            left, right = most[left_alike[begins]] >= passed, most[right_alike[ends - 1]] >= run_words - passed - own_words
            # What is compared ends at the last chunk that begins least_words words before, or the first that ends as many after, and WINDOW + 1 bytes beyond.
            base = (np.cumsum(new_run) - 1) << 34
            back = np.searchsorted(base + word, base[begins] + word[begins] - least_words, "right") - 1
            left &= (back < runs[of]) | (word[np.maximum(back, runs[of])] - word[runs[of]] <= WINDOW // 2)
            ahead = np.searchsorted(base + word + words, base[begins] + (word + words)[ends - 1] + least_words + 1)
            right &= ahead >= run_ends[of] - 1
            found = (left | right) & (more_left | more_right | (has + 2 * NEAR >= least_words))
            some = np.bincount(of[found], minlength=len(runs)) > 0
            many = (np.bincount(of, minlength=len(runs)) > 1) & (some | (total[run_ends] - total[runs] >= least_words))
            # The largest chunk of a run, the first of several.
            of_chunk = np.cumsum(new_run) - 1
            largest = np.flatnonzero(words == np.maximum.reduceat(words, runs)[of_chunk])
            largest = largest[np.unique(of_chunk[largest], return_index=True)[1]]
            a, b = np.r_[begins[found], runs[many]], np.r_[ends[found], run_ends[many]] - 1
            from_ = np.r_[begins[found], largest[many]]
            left, right = np.r_[left[found], np.zeros(many.sum(), bool)], np.r_[right[found], np.zeros(many.sum(), bool)]
            lo = np.maximum(word[a] - np.where(left, most[left_alike[a]], 0), 0)
            hi = np.minimum(word[b] + words[b] + np.where(right, most[right_alike[b]], 0), 1 << 33)
            group = (np.cumsum(new_doc)[a] * 2 + own[a]) << 34
            order = np.argsort(group + lo, kind="stable")
            reach = np.maximum.accumulate((group + hi)[order])
            opens = np.flatnonzero(np.r_[True, (group + lo)[order][1:] > reach[:-1]][:len(order)])
            closes = np.r_[opens[1:], len(order)][:len(opens)]
            enough = reach[closes - 1] - (group + lo)[order][opens] >= least_words
            keep = order[np.repeat(enough, closes - opens)]
            a, b, from_, left, right = a[keep], b[keep], from_[keep], left[keep], right[keep]
            arrays = [
                pa.array(doc[a], mask=none[a]), pa.array(copy[a]), pa.array(np.arange(len(a))), pa.array(idx[a]), pa.array(idx[b]), pa.array(own[a].astype(np.int64)),
                pa.array(first[from_], mask=first_none[from_]), pa.array(first_copy[from_]), pa.array(first_idx[a], mask=~left), pa.array(first_idx[b], mask=~right),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=_PIECE)

    rows = again.select("doc_id", "copy", "idx", "w", "alike", "fd", "fc", "fi").repartition("doc_id", "copy").sortWithinPartitions("doc_id", "copy", "idx")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in _PIECE))


def _places(docs: DataFrame, bits, least_words: int, text_col: str, id_col: str) -> DataFrame:
    """A row for each start (place 2 * idx) and end (2 * idx + 1) of a chunk that the filter lets through: its byte, the
    code points and words begun before it, and, where the filter lets that through too, the bytes beside it.

    `near` reaches over least_words words at least and on to a cut: to the left to the start of a chunk before and over
    the window of its cut, to the right to a cut that any common text shares; one byte more lets words be counted.
    """
    names = ["doc_id", "copy", "place", "at", "point", "word", "near"]

    def run(batches):
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, ends = _chunks(t)
                if not ends:
                    continue
                copy = xxhash.xxh3_64_intdigest(raw)
                keys = np.uint64(copy) ^ (np.arange(2 * len(ends), dtype=np.uint64) << np.uint64(37))
                hit = np.flatnonzero(in_filter(bits.value, keys))
                if not len(hit):
                    continue
                beside = in_filter(bits.value, keys[hit] ^ np.uint64(_BESIDE)).tolist()
                text, starts = _Text(raw), [0, *ends[:-1]]
                signed = int(np.uint64(copy).astype(np.int64))
                at = [ends[h >> 1] if h & 1 else starts[h >> 1] for h in hit.tolist()]
                back, ahead = text.back(np.array(at), least_words).tolist(), text.ahead(np.array(at), least_words).tolist()
                for h, x, point, word, lo, hi, asked in zip(hit.tolist(), at, text.points(at).tolist(), text.words(at).tolist(), back, ahead, beside):
                    i = h >> 1
                    if not asked:
                        near = None
                    elif h & 1:
                        cut = bisect.bisect_left(ends, max(x + 1, starts[i] + WINDOW, hi))
                        near = raw[x - 1:(ends[cut] if cut < len(ends) else len(raw)) + 1]
                    else:
                        before = bisect.bisect_right(starts, min(lo, starts[max(i - 1, 0)])) - 1
                        near = raw[max(starts[before] - WINDOW - 1, 0):x]
                    out.append((doc_id, signed, h, x, point, word, near))
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "near" else pa.int64()) for n, c in zip(names, cols)], names=names)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'near' else 'long'}" for n in names))


def _alike(a: bytes, b: bytes, order: str) -> int:
    """How many bytes a and b begin ("little") or end ("big") with alike."""
    n = min(len(a), len(b))
    if not n:
        return 0
    cut = slice(n) if order == "little" else slice(-n, None)
    x = int.from_bytes(a[cut], order) ^ int.from_bytes(b[cut], order)
    return (x & -x).bit_length() - 1 >> 3 if x else n


def _begun(near: bytes, a: int, b: int) -> tuple[int, int]:
    """(code points, words) that begin in near[a:b]; before near there is none, or a byte that ends a word."""
    part = near[a:b]
    points = b - a if part.isascii() else len(part) - sum(x & 0xC0 == 0x80 for x in part)
    return points, len(part.split()) - (a > 0 and not near[a - 1:a].isspace() and not part[:1].isspace() and a < b)


def _left(here: tuple, there: tuple | None) -> tuple[int, int, int]:
    """(byte, code point, word) at which the text alike before two places begins."""
    at, point, word, near = here
    if there is None:
        return at, point, word
    # The byte before is there to tell whether a word begins, unless the text does.
    n = _alike(*(x[3] if len(x[3]) == x[0] else x[3][1:] for x in (here, there)), "big")
    points, words = _begun(near, len(near) - n, len(near))
    return at - n, point - points, word - words


def _right(here: tuple, there: tuple | None) -> tuple[int, int, int]:
    """(byte, code point, word) at which the text alike after two places ends."""
    at, point, word, near = here
    if there is None:
        return at, point, word
    n = _alike(near[1:], there[3][1:], "little")
    while 0 < n < len(near) - 1 and near[n + 1] & 0xC0 == 0x80:
        n -= 1
    points, words = _begun(near, 1, n + 1)
    return at + n, point + points, word + words


def _joined_pieces(sides: DataFrame, least_words: int) -> DataFrame:
    """The repeats of the pieces, of which sides has up to four rows each: begin and end here (0, 1) and, on a side to be extended, there (2, 3)."""
    names = ["doc_id", "span_start", "span_end", "n_words", "first_doc_id", "copy", "first_copy"]

    def joined(doc_id, copy, found: list[tuple], out: list[tuple]) -> None:
        found.sort(key=lambda x: (x[0], x[1], x[2]))
        i = 0
        while i < len(found):
            j, end, most = i, found[i][2], found[i]
            while j < len(found) and found[j][0] == found[i][0] and found[j][1] <= end:
                end, most = max(end, found[j][2]), max(most, found[j], key=lambda x: x[3])
                j += 1
            words = end[2] - found[i][1][2]
            if words >= least_words:
                out.append((doc_id, found[i][1][1], end[1], words, most[4], copy, most[5]))
            i = j

    def run(batches):
        for batch in _whole(batches, 2):
            out: list[tuple] = []
            begins = np.flatnonzero(np.r_[True, _changed(batch.column(0), batch.column(1))[1:]]).tolist()
            for a, b in zip(begins, [*begins[1:], batch.num_rows]):
                rows, found, i = batch.slice(a, b - a), [], 0
                n, side, own, first, first_copy = (rows.column(k).to_pylist() for k in range(2, 7))
                places = list(zip(*(rows.column(k).to_pylist() for k in range(7, 11))))
                while i < len(n):
                    j, s = i, {}
                    while j < len(n) and n[j] == n[i]:
                        s[side[j]] = places[j]
                        j += 1
                    x, y = _left(s[0], s.get(2)), _right(s[1], s.get(3))
                    found.append((own[i], x, y, y[2] - x[2], first[i], first_copy[i]))
                    i = j
                joined(rows.column(0)[0].as_py(), rows.column(1)[0].as_py(), found, out)
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    rows = sides.repartition("doc_id", "copy").sortWithinPartitions("doc_id", "copy", "n", "side")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeats(docs: DataFrame, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each repeat: doc_id, span_start, span_end (code points), n_words, first_doc_id (where its largest part stands first), copy, first_copy.

    A-Z count as a-z. Null and empty texts have no chunks. Rows alike in doc_id and text are one document, so they
    are no repeats of each other; `copy` tells rows apart that share a doc_id but not the text, and first_copy does
    so for first_doc_id. A null doc_id comes before all others. Other columns are ignored. A repeat is found by a
    chunk that lies wholly in it. An empty table gives an empty result; a text may have any length, as its chunks do.
    """
    spark = docs.sparkSession
    twice = _counted(docs, text_col).where("n > 1")
    bits = spark.sparkContext.broadcast(bit_filter(twice, "d1"))
    occ = written(_occurrences(docs, bits, text_col, id_col))
    place = F.struct("doc_id", "copy", "idx")
    first = occ.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "copy", "idx", "sig")).alias("first"), F.max(place).alias("last")).where("struct(first.doc_id, first.copy, first.idx) <> last")
    again = occ.join(first.select("d1", "d2", "first"), ["d1", "d2"]).where("struct(doc_id, copy, idx) <> struct(first.doc_id, first.copy, first.idx)")
    differ = F.col("sig").bitwiseXOR(F.col("first.sig"))

    def alike(shift: int) -> Column:
        """How many of LEVELS are alike, from the nearest on."""
        out = F.lit(len(LEVELS))
        for k in reversed(range(len(LEVELS))):
            out = F.when(F.shiftright(differ, shift + 4 * k).bitwiseAND(15) != 0, k).otherwise(out)
        return out

    again = again.select("doc_id", "copy", "idx", "w", (alike(32) * 16 + alike(0)).cast("long").alias("alike"), F.col("first.doc_id").alias("fd"), F.col("first.copy").alias("fc"), F.col("first.idx").alias("fi"))
    pieces = written(_pieces(again, least_words))

    def end(side: int, doc: str, copy: str, at: str, there: str) -> Column:
        return F.struct(F.lit(side).cast("long").alias("side"), F.col(doc).alias("d"), F.col(copy).alias("c"), F.expr(at).alias("place"), F.col(there).isNotNull().alias("extend"))

    there = ("first_doc_id", "first_copy")
    ends = F.array(end(0, "doc_id", "copy", "2 * p", "first_p"), end(1, "doc_id", "copy", "2 * q + 1", "first_q"), end(2, *there, "2 * first_p", "first_p"), end(3, *there, "2 * first_q + 1", "first_q"))
    asked = pieces.select("doc_id", "copy", "n", "own", *there, F.explode(ends).alias("e")).where("e.place is not null")
    asked = asked.select("doc_id", "copy", "n", "own", *there, "e.*")
    key = F.col("c").bitwiseXOR(F.shiftleft("place", 37))
    keys = F.array(key, F.when(F.col("extend"), key.bitwiseXOR(F.lit(_BESIDE))).otherwise(key))
    bits3 = spark.sparkContext.broadcast(bit_filter(asked.select(F.explode(keys).alias("h")), "h", 8 * pieces.count()))
    at = _places(docs, bits3, least_words, text_col, id_col).select(F.col("doc_id").alias("pd"), F.col("copy").alias("pc"), F.col("place").alias("pp"), "at", "point", "word", "near")
    met = asked.join(at, F.col("d").eqNullSafe(F.col("pd")) & (F.col("c") == F.col("pc")) & (F.col("place") == F.col("pp")))
    sides = met.select("doc_id", "copy", "n", "side", "own", *there, "at", "point", "word", F.when(F.col("extend"), F.col("near")).alias("near"))
    return _joined_pieces(sides, least_words)


def without_repeats(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """docs with all repeats cut out of text; a null text stays null. Rows that share a null doc_id keep their text; other columns stay as they are, whatever their names."""
    spans = repeats(docs, least_words).where("doc_id is not null").groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("spans"))

    def cut(t: str | None, spans: list | None) -> str | None:
        if t is None or spans is None:
            return t
        at, kept = 0, []
        for x in spans:
            kept.append(t[at:x["span_start"]])
            at = max(at, x["span_end"])
        return "".join([*kept, t[at:]])

    def marked(batches):
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            copy = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass").lower()) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copy.view(np.int64))], names=["row", "id", "text", "copy"])

    def run(batches):
        for batch in slices(batches):
            text = pa.array(list(map(cut, batch.column(1).to_pylist(), batch.column(2).to_pylist())), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["row", "text"])

    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names if c != "text"))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType
    rows = rows.mapInArrow(marked, StructType([*rows.schema.fields]).add("copy", "long"))
    rows = rows.join(spans.withColumnsRenamed({"doc_id": "span_id", "copy": "span_copy"}), (F.col("id") == F.col("span_id")) & (F.col("copy") == F.col("span_copy")), "left")
    rows = rows.select("row", "text", "spans").mapInArrow(run, StructType().add("row", kind).add("text", "string"))
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names))


def op7(spark, sf_dir: str) -> DataFrame:
    """All repeats; `own` is true where a document repeats itself, false where it repeats another."""
    found = repeats(read_table(spark, sf_dir, "documents"))
    return found.withColumn("own", F.expr("first_doc_id <=> doc_id and first_copy = copy")).drop("copy", "first_copy")
