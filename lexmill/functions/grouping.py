"""A document's tokens and postings, worked out by columns within its own task: nothing is shuffled to bring a document's words together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexmill.functions.text import LOWER, UPPER

#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20

_LOWERED = np.zeros(256, np.uint8)  # a byte of a token as it counts, 0 for all others
_LOWERED[list((LOWER + "0123456789_").encode())] = list((LOWER + "0123456789_").encode())
_LOWERED[list(UPPER.encode())] = list(LOWER.encode())


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE_BYTES of the last column, a text."""
    for batch in batches:
        ends = _bytes(batch.column(batch.num_columns - 1))[1][1:]
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the end of the last."""
    text = text.cast(pa.large_string()).fill_null("") if text.null_count else text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def tokens(text: pa.Array, most: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of the texts in order, the place of the text that each is of, and how many each text has: as text.tokens() gives them.
    A text with a token of more than `most` bytes has none."""
    raw, at = _bytes(text)
    low = _LOWERED[raw]
    inside = low != 0
    after = np.empty(len(raw), bool)  # whether the byte before belongs to the same token
    after[:1] = False
    after[1:] = inside[:-1]
    after[at[:-1][at[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~after)
    kept = low[inside]
    # Where each token begins among the bytes that are kept.
    begins = np.cumsum(inside, dtype=np.int64)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    ends = np.append(begins, len(kept))
    values = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
    counts = np.diff(np.searchsorted(starts, at))
    parents = np.repeat(np.arange(len(counts)), counts)
    if most is not None and len(long := np.flatnonzero(np.diff(ends) > most)):
        counts[parents[long]] = 0
        left = counts[parents] > 0
        values, parents = values.filter(pa.array(left)), parents[left]
    return values, parents, counts


def postings(text: pa.Array, positions: bool, most: int | None = None) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """The postings of the texts: the place of each one's text, its term, its frequency and its positions in order."""
    values, parents, counts = tokens(text, most)
    words = values.dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    order = np.argsort(parents * max(1, len(words.dictionary)) + codes, kind="stable")
    parents, codes = parents[order], codes[order]
    first = np.ones(len(order), bool)
    first[1:] = (parents[1:] != parents[:-1]) | (codes[1:] != codes[:-1])
    heads = np.flatnonzero(first)
    ends = np.append(heads, len(order)).astype(np.int32)
    tf = pa.array(np.diff(ends).astype(np.int32))
    if positions:
        own = (order - (np.cumsum(counts) - counts)[parents]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(ends), pa.array(own))
    else:
        places = pa.nulls(len(heads), pa.list_(pa.int32()))
    return parents[heads], words.dictionary.take(pa.array(codes[heads])).cast(pa.string()), tf, places


def postings_batches(batches: Iterator[pa.RecordBatch], positions: bool, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """For rows of keys and a text, the last column: term, the keys, tf, positions."""
    for part in slices(batches):
        rows, terms, tf, places = postings(part.column(part.num_columns - 1), positions, most)
        if len(terms):
            at = pa.array(rows)
            keys = part.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([terms, *(part.column(i).take(at) for i in range(len(keys))), tf, places], names=["term", *keys, "tf", "positions"])


def frequency_batches(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """For rows of a text: the terms of a few texts, with how many of these have each, and how often."""
    for part in slices(batches):
        values, parents, _ = tokens(part.column(part.num_columns - 1), most)
        if len(values):
            words = values.dictionary_encode()
            codes, n = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            cf = np.bincount(codes, minlength=n)
            pairs = np.sort(parents * n + codes)
            df = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] % n, minlength=n)
            yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(df), pa.array(cf)], names=["term", "df", "cf"])


def measured_batches(batches: Iterator[pa.RecordBatch], keep: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows with the number of tokens of the text in the last column, and the bytes of the longest one; without `keep`, the text is left out."""
    for part in slices(batches):
        values, parents, counts = tokens(part.column(part.num_columns - 1))
        longest = np.zeros(len(counts), np.int32)
        np.maximum.at(longest, parents, np.diff(np.frombuffer(values.buffers()[1], np.int64)[:len(values) + 1]).astype(np.int32))
        n = part.num_columns - (not keep)
        yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(counts.astype(np.int32)), pa.array(longest)], names=[*part.schema.names[:n], "token_count", "longest"])
