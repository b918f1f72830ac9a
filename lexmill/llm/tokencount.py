"""Token counts with a whole-token shortcut.

A text's pre-tokens (the pieces within which merges happen) are counted directly as one token where the
vocabulary string is proved to encode alone as one token; the proof encodes every vocabulary string once.
Only the other pre-tokens are merged, by the library, and their counts kept.
"""

from __future__ import annotations

import os
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import read_table, slices, tokenizer_path

#: Characters of which the splitting pattern's classes are the same in every version of Unicode that the libraries may use.
STABLE = r"[^\x00-\x1b\x20-\x84\x86-ȠЀ-џ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_strings(vocab: dict[str, int]) -> dict[str, int]:
    """The vocabulary's strings as text, without those that are no whole UTF-8."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = {}
    for s, i in vocab.items():
        try:
            out[bytes(back[c] for c in s).decode()] = i
        except (KeyError, UnicodeDecodeError):
            pass
    return out


class Counter:
    """Counts by a byte-level tokenizers file."""

    def __init__(self, path: str, most: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.split = regex.compile(PATTERN).findall
        self.odd = regex.compile(STABLE + r"|<\|").search
        self.most, self.counts = most, {}
        self.whole = proved(self.tok)

    def of(self, texts: list[str]) -> list[int]:
        odd = [i for i, t in enumerate(texts) if self.odd(t)]
        odd_set, whole, counts = set(odd), self.whole, self.counts
        rest = []
        n = []
        for i, t in enumerate(texts):
            pre = [] if i in odd_set else self.split(t)
            other = [p for p in pre if p not in whole]
            rest.append(other)
            n.append(len(pre) - len(other))
        need = set(chain.from_iterable(rest))
        new = [p for p in need if p not in counts]
        if len(counts) + len(new) > self.most:
            counts.clear()
            new = list(need)
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            counts.update(zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False))))
        get = counts.__getitem__
        out = [a + sum(map(get, r)) for a, r in zip(n, rest)]
        for p in new:
            if len(p) > 40:
                del counts[p]
        for i in odd:
            out[i] = len(self.tok.encode(texts[i], add_special_tokens=False).ids)
        return out


def proved(tok) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and encode alone as their own token."""
    import regex

    split = regex.compile(PATTERN).findall
    vocab = byte_strings(tok.get_vocab(with_added_tokens=False))
    strings = list(vocab)
    ids = (e.ids for e in tok.encode_batch_fast(strings, add_special_tokens=False))
    return frozenset(s for s, e in zip(strings, ids) if e == [vocab[s]] and split(s) == [s])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); a null text counts as empty.

    Every row has its own result, whether doc_id is null or repeated; other columns are ignored.
    """

    def run(batches):
        count = counter(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = count.of(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
