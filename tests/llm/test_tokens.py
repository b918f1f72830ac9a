import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import encoding, packing, tokencount, tokenfile
from lexmill.llm.common import tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
BITS = [
    "a", " ", "  ", "\n", "\t", "é", "É", "İ", "ß", "'s", "'S", "can't", "123", "²", "½", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "😀", "中文", "ΣΑΣ", "_", "--", "http://", "\x01", "\x00", "“q”", "…", "ſ",
    "qzxj", "the", "THE ", "  \n x", "ª", "×", "thstbleoron", "éèéauxouan", "ǆ",
]


def texts(n, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.choice([0, 1, 2, 6, 40]))) for _ in range(n)]


def ids(path, t):
    return np.array(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts(300)), (300, None), (301, "word " * 9000), (302, "x" * 50_000), (304, "a" + " " * 1_100_000 + "b"), (7, "again"), (7, "again"), (None, "no id"), (303, "")]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder(path):
    some = texts(4000, 9)
    library = Tokenizer.from_file(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]
    assert encoding.Encoder(path).encode(some) == want


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_of_long_runs(path):
    """Runs over which an expression that goes back would need a stack of millions."""
    e = encoding.Encoder(path)
    for t in ("x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "a\t" + "\t" * 1_100_000, "a" * 300_000, "-" * 100_000, "don't " * 100_000):
        assert (e.one(t) == np.array(e.library.encode(t, add_special_tokens=False).ids, "<u4")).all()


def test_unproved_tokens_are_left_out():
    chars = {"a": 97, "b": 98, "c": 99}
    # abc is made of a + bc, but bc can't form where ab forms first.
    spec = {"model": {"end_of_word_suffix": None, "vocab": {**{c: i for i, c in enumerate(chars)}, "ab": 3, "bc": 4, "abc": 5}, "merges": ["a b", "b c", "a bc"]}}
    tokens, _ = encoding.proved_merges(spec)
    assert tokens == [b"ab", b"bc"]


def test_counts(spark, docs_of, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(docs_of(rows), BYTES).collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), len(ids(BYTES, t)), len(ids(BYTES, t)) > 1024) for i, t in rows)
    assert got == want


def test_files(spark, docs_of, rows, tmp_path):
    found = tokenfile.round_trip(docs_of(rows), WORDS, 2, with_ids=True).collect()
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append([*ids(WORDS, t).tolist(), 2])
    for r in by_start:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        left[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    assert not any(left.values())
    assert tokenfile.round_trip(docs_of([]), WORDS, 2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
@pytest.mark.parametrize("top", [1, 2, 300, 1 << 16, 1 << 32])
def test_blocks(tmp_path, n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    x[::40] = (1 << 32) - 1
    w = tokenfile.Writer(str(tmp_path / "f"))
    w.add([(1, n // 3), (None, n - n // 3)], x)
    w.close()
    r = tokenfile.Reader(str(tmp_path / "f"))
    assert (r.ids(0, n) == x).all() and (r.ids(n // 4, n // 2) == x[n // 4:n // 2]).all()
    assert [(d, s, len(i)) for d, s, i in r.documents(most=50)] == [(1, 0, n // 3), (None, n // 3, n - n // 3)]


def test_packing(spark, docs_of, rows):
    got = packing.pack_documents(docs_of(rows), BYTES, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, t in rows:
        if i not in (7,):
            want, parts = [*ids(BYTES, t).tolist(), 0], sorted(by_doc[i], key=lambda r: r["piece"])
            assert [x for r in parts for x in r["ids"]] == want
            assert [r["start"] for r in parts] == list(np.cumsum([0, *(r["length"] for r in parts)])[:-1]) and all(r["length"] == 2048 for r in parts[1:])
    assert len(by_doc[7]) == 3
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0, *(r["length"] for r in s)])[:-1]) and sum(r["length"] for r in s) <= 2048
    assert len(by_seq) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack_documents(docs_of([]), BYTES).count() == 0


def test_levels(spark, monkeypatch):
    """Many small shards, pooled over several levels, still put each row once and fill nearly all sequences."""
    monkeypatch.setattr(packing, "SHARD", 20)
    monkeypatch.setattr(packing, "POOL", 4)
    monkeypatch.setattr(packing, "POOLED", 4)
    r = random.Random(1)
    rows = [(i, r.choice([r.randrange(1, 2048), r.randrange(1, 400)]), "x") for i in range(600)] + [(700, 2048, "full")]
    mine = ("shard", "id", "row", "best", "a.b")
    table = spark.createDataFrame(rows, "doc_id long, length long, sequence string").withColumns({c: F.lit(77) for c in (*mine, "sequence_id", "offset")})
    found = packing.pack(table)
    assert found.columns == ["doc_id", "length", "sequence", *mine, "sequence_id", "offset"]
    got = found.collect()
    assert sorted((x["doc_id"], x["length"]) for x in got) == sorted(x[:2] for x in rows) and all(x[c] == 77 for x in got for c in mine)
    fill = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == fill.get(x["sequence_id"], 0)
        fill[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(fill.values()) <= 2048


def test_rows_that_are_all_the_same(spark, monkeypatch):
    """They go to all shards alike."""
    monkeypatch.setattr(packing, "SHARD", 100)
    sizes, solved = [], packing._solved
    monkeypatch.setattr(packing, "_solved", lambda rows, capacity: sizes.append([r["count"] for r in rows.groupBy("shard").count().collect()]) or solved(rows, capacity))
    same = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("length"))
    assert packing.pack(same).groupBy("sequence_id").count().count() <= 2
    assert len(sizes[0]) == 10 and max(sizes[0]) < 200


@pytest.mark.parametrize("low, high, gain", [(400, 800, 5), (300, 520, 5)])
def test_genetic_algorithm_beats_best_fit(low, high, gain):
    """On lengths that best-fit decreasing can't pack to the bound."""
    r = random.Random(1)
    lengths = [r.randrange(low, high) for _ in range(4096)]
    plain = packing.best_fit(lengths, sorted(range(4096), key=lambda i: -lengths[i]), [], 2048)
    best = packing.evolve(lengths, [], 2048, 1)[0]
    assert -(-sum(lengths) // 2048) <= len(best) <= len(plain) - gain
    assert sorted(i for b in best for i in b) == list(range(4096)) and max(sum(lengths[i] for i in b) for b in best) <= 2048


def test_genetic_operators():
    r = random.Random(3)
    lengths = [r.randrange(1, 2048) for _ in range(200)]
    down = sorted(range(200), key=lambda i: -lengths[i])
    a, b = packing.best_fit(lengths, down, [], 2048), packing.best_fit(lengths, down[::-1], [], 2048)
    for child in (packing.crossover(lengths, a, b, 2048, r), packing.mutate(lengths, a, 2048, r)):
        assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(lengths[i] for i in x) <= 2048 for x in child)
    best = packing.evolve(lengths, [], 2048, 1)[0]
    assert len(best) <= len(a)
