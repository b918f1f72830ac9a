import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chunkdedup, common, decontam, minhash


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(n=240, seed=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([1, 2, 6, 40, 120, 300]))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs_of, k):
    rows = corpus()
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Solo"), (904, "sOLO"), (905, "x " * 30_000), (906, "X\t" * 29_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(rows), k=k).collect()}
    assert got == brute(rows, k, 80)


def test_blocks_and_chains(spark, docs_of, monkeypatch):
    """A chain whose ends are far apart, in buckets larger than a block."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "GROUP", 3)
    r = random.Random(2)
    w = [f"a{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(w)
        for _ in range(4):
            w[r.randrange(150)] = f"b{i}{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(rows), k=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}


def test_deduplicated(spark, docs_of):
    rows = [(5, "one two three four five six"), (3, "ONE two three four five six"), (8, "other words stand here today now"), (8, "other words stand here today now"), (9, None), (10, ""), (None, "one two three four five six"), (None, None)]
    # Rows that share a doc_id, or have none, are near-duplicates of each other all the same.
    rows += [(20, "a first text of seven words here"), (20, "A first text of seven words here"), (None, "nobody names the row of this text"), (None, "nobody NAMES the row of this text")]
    docs = docs_of(rows).withColumns({c: F.lit("mine") for c in ("kept", "component_id", "node", "copy", "h", "a")})
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or -1, (r["text"] or "").lower()) for r in out.collect())
    assert got == [(-1, ""), (-1, rows[10][1]), (3, rows[0][1]), (8, rows[2][1]), (9, ""), (10, ""), (20, rows[8][1])]
    assert minhash.near_duplicates(docs_of([])).count() == 0 and minhash.deduplicated(docs_of([])).count() == 0


def test_bayes():
    least = dict(minhash.fewest_matches(0.8, 1e-6))
    assert least[200] < 150 and all(0 < m / n < 0.8 for n, m in least.items())
    a = np.zeros((4, 200), np.uint8)
    a[1, ::10] = 1
    a[2, ::2] = 1
    i, j, m = minhash.survivors(a, np.ones((4, 4), bool), list(least.items()))
    assert list(zip(i.tolist(), j.tolist(), m.tolist())) == [(0, 1, 180), (0, 3, 200), (1, 3, 180)]
    # The dense way, for more rows, gives what the sparse one gives.
    r = np.random.default_rng(1)
    base = r.integers(0, 256, 200, dtype=np.uint8)
    many = np.where(r.random((150, 200)) < r.random((150, 1)) * 0.4, r.integers(0, 256, (150, 200), dtype=np.uint8), base)
    got = list(zip(*(x.tolist() for x in minhash.survivors(many, np.ones((150, 150), bool), list(least.items())))))
    match = (many[:, None] == many[None]).cumsum(2)
    assert got == [(x, y, int(match[x, y, -1])) for x in range(150) for y in range(x + 1, 150) if all(match[x, y, n - 1] >= need for n, need in least.items())]


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (7, 3)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x["node"]: x["label"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    assert got == {v: find(v) for v in top}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def contaminated(rows, items, size=10):
    out = {}
    for i, t in rows:
        w = decontam.words_of(t)
        hit, ids = set(), set()
        for item, it in items:
            x = decontam.words_of(it)
            n = min(size, len(x))
            for s in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[s:s + n]:
                        hit |= set(range(p, p + n))
                        ids.add("" if item is None else str(item))
        out.setdefault(i, []).append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs_of, tmp_path):
    r = random.Random(4)
    vocab = ["a", "b", "c", "dé", "E", "f9", "中"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 9, 10, 14])))) for i in range(12)]
    items += [(50, None), (51, "..."), (2, "the same id twice here"), (None, "no id of its own at all in this item here")]
    rows = [(i, r.choice(["-", " ", "\n"]).join([*(r.choice(vocab) for _ in range(r.randrange(25))), *r.choice(items)[1:]][:-1] + [str(r.choice(items)[1])])) for i in range(120)]
    rows += [(200, None), (201, ""), (3, "repeat"), (3, "repeat"), (None, items[0][1]), (202, "a b " * 20_000), (203, "z" * 100_000), (204, "x NO id of its own at all in this ITEM here y")]
    docs_of(rows).withColumns({c: F.lit(1) for c in ("n", "window", "pos", "salt", "copy", "items")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9)).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {}
    for x in decontam.op3(spark, str(tmp_path)).collect():
        got.setdefault(x["doc_id"], []).append(tuple(x[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))
    want = contaminated(rows, items)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = decontam.clean(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert kept.columns == docs.columns and kept.count() == sum(not x[4] for v in want.values() for x in v)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).where("size(spans) > 0").count() == 0 and decontam.clean(docs, none).count() == len(rows)
    assert decontam.contamination(docs_of([]), none).count() == 0


def test_words_at_once(monkeypatch):
    """Words, counts and shingles of many texts at once are those of each text alone, wherever they are parted."""
    monkeypatch.setattr(decontam, "_AT_ONCE", 50)
    monkeypatch.setattr(decontam, "_LONG", 200)
    texts = [None, "", "Ab cd", "  ", "ab, CD ef\0gh", "é" * 90 + " x " + "y" * 300, "z" * 70 + "-" * 99 + "Z" * 70, "ab cd ef gh", "a" * 64 + "b", "b" + "a" * 64, "\ud800a b"]
    words = decontam._Words(texts)
    want = [decontam.words_of(t) for t in texts]
    flat = [w for ws in want for w in ws]
    assert words.counts.tolist() == [len(w) for w in want] and [words.joined(i, i + 1) for i in range(len(flat))] == flat
    assert len({(w, int(h)) for w, h in zip(flat, words.hashes)}) == len(set(flat)) == len(set(words.hashes.tolist()))
    for k in (1, 2, 3):
        got = [words.joined(i, i + k) for i in words.shingles(k)[1].tolist()]
        assert got == [b" ".join(w[i:i + k]) for w in want for i in range(len(w) - k + 1)]
    assert not len(decontam._Words([]).hashes) and not len(decontam._Words([None]).shingles(1)[0])


def test_gear():
    raw = bytes(random.Random(1).randrange(256) for _ in range(500))
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(chunkdedup._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunkdedup.gear(raw).tolist() == want
    # An insertion moves the later cuts and changes none of them.
    more = raw[:50] + b"inserted" + raw[50:]
    assert {x + 8 for x in chunkdedup.cuts(raw).tolist() if x > 90} == {x for x in chunkdedup.cuts(more).tolist() if x > 98}


def test_repeats(spark, docs_of):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    shared, short = words(120), words(8)
    rows = [(i, words(60) + " " + shared + " " + words(40)) for i in (4, 9, 30)] + [(i, words(150) + " " + short) for i in range(100, 130)]
    rows += [(200, None), (201, ""), (202, "a" * 60_000), (9, rows[1][1]), (None, shared.upper())]
    found = chunkdedup.repeats(docs_of(rows).withColumns({c: F.lit(1) for c in ("idx", "d1", "first", "copy")})).where("first_doc_id is null or first_doc_id <> doc_id").collect()
    assert {x["doc_id"] for x in found} == {4, 9, 30}
    text = dict(rows[:3])
    for x in found:
        part = text[x["doc_id"]][x["span_start"]:x["span_end"]]
        assert part in shared and x["first_doc_id"] is None and x["n_words"] > 90
    mine = ("cut", "__copy", "__doc", "copy", "row", "id", "spans", "a.b")
    out = chunkdedup.without_repeats(docs_of(rows[:3]).withColumns({c: F.lit(7) for c in mine}))
    assert out.columns == [*docs_of(rows[:3]).columns, *mine] and all(x[c] == 7 for x in out.collect() for c in mine)
    kept = {x["doc_id"]: len(x["text"]) for x in out.collect()}
    assert kept[4] == len(text[4]) and kept[9] < len(text[9]) - 0.7 * len(shared)
    assert chunkdedup.repeats(docs_of([])).count() == 0 and chunkdedup.without_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("n", [30, 51])
def test_planted_passages(spark, docs_of, n):
    """Passages of n words in two documents each are found whole, whatever the chunks; the parts beside them are not."""
    r = random.Random(n)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnopé") for _ in range(r.randrange(2, 9))) for _ in range(n))
    rows, planted = [], {}
    for i in range(300):
        passage = words(n)
        planted[2 * i + 1] = passage
        rows += [(2 * i + k, f"{words(40)} {passage} {words(40)}") for k in (0, 1)]
    text = dict(rows)
    found = {x["doc_id"]: x for x in chunkdedup.repeats(docs_of(rows)).collect()}
    assert set(found) <= set(planted) and len(found) >= {30: 285, 51: 299}[n]
    for i, x in found.items():
        assert planted[i] in text[i][x["span_start"]:x["span_end"]] and x["span_end"] - x["span_start"] <= len(planted[i]) + 8
        assert n <= x["n_words"] <= n + 1 and x["first_doc_id"] == i - 1


def test_repeats_against_all_pairs_of_positions(spark, docs_of):
    """What is found stands elsewhere word for word, and whatever stands elsewhere for 50 words or more is found."""
    r = random.Random(77)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    pool = [[word() for _ in range(90)] for _ in range(12)]
    docs = []
    for _ in range(60):
        w = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(pool)
            a = r.randrange(60)
            w += [word() for _ in range(r.randrange(30))] + p[a:a + r.randrange(5, 91)]
        docs.append(w)
    # Of each word the longest run through it that stands elsewhere, in an earlier document or at any other place of its own.
    begins: dict[str, list[tuple[int, int]]] = {}
    for d, w in enumerate(docs):
        for i, x in enumerate(w):
            begins.setdefault(x, []).append((d, i))
    longest = [[0] * len(w) for w in docs]
    for at in begins.values():
        for d, i in at:
            for e, j in at:
                if (e, j) != (d, i) and e <= d and (i == 0 or j == 0 or docs[d][i - 1] != docs[e][j - 1]):
                    n = 0
                    while i + n < len(docs[d]) and j + n < len(docs[e]) and docs[d][i + n] == docs[e][j + n]:
                        n += 1
                    for k in range(i, i + n):
                        longest[d][k] = max(longest[d][k], n)
    hit = [[False] * len(w) for w in docs]
    for x in chunkdedup.repeats(docs_of([(i, " ".join(w)) for i, w in enumerate(docs)])).collect():
        ends, at = [], 0
        for w in docs[x["doc_id"]]:
            ends.append((at, at + len(w)))
            at += len(w) + 1
        inside = [k for k, (a, b) in enumerate(ends) if x["span_start"] <= a and b <= x["span_end"]]
        for k in inside:
            hit[x["doc_id"]][k] = True
    rows = [(found, n) for h, ns in zip(hit, longest) for found, n in zip(h, ns)]
    # Parts that follow one another may come from different places, each of them short.
    assert all(n > 0 for found, n in rows if found)
    want = [found for found, n in rows if n >= 50]
    assert len(want) > 1000 and sum(want) >= 0.95 * len(want)


def test_op7(spark, docs_of, tmp_path):
    """Repeats of rows with a null doc_id, and of rows that share a doc_id but not the text, are repeats of others."""
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    p, q = words(80), words(80)
    rows = [(None, f"{words(30)} {p} {words(30)}"), (None, f"{words(20)} {p}"), (7, f"{p} {words(30)}"), (8, f"{words(10)} {p}")]
    rows += [(5, f"{q} {words(30)}"), *[(5, f"{words(30)} {q} {words(9)}")] * 2]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = chunkdedup.op7(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"] or 0, x["first_doc_id"] or 0) for x in found) == [(0, 0), (5, 5), (7, 0), (8, 0)]
    assert all(80 <= x["n_words"] <= 81 for x in found)


def test_op7_own_repeats(spark, docs_of, tmp_path):
    r = random.Random(22)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    p, q = words(80), words(80)
    rows = [(i, f"{words(30)} {p} {words(30)} {p} {words(9)}") for i in (None, 4)] + [(i, f"{words(9)} {q} {words(9)}") for i in (5, 6)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = chunkdedup.op7(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"] or 0, x["first_doc_id"] or 0, x["own"]) for x in found) == [(0, 0, True), (4, 0, False), (4, 0, False), (6, 5, False)]


def test_bytes_are_asked_for_only_beside_a_run(spark, docs_of, monkeypatch):
    """Of a text put together from many others all of it is one repeat, for which only what is near its ends is compared."""
    r = random.Random(31)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    w = words(2400).split()
    rows = [(i, " ".join(w[60 * i:60 * i + 120])) for i in range(39)] + [(100, f"{words(9)} {' '.join(w)} {words(9)}")]
    kept = []
    monkeypatch.setattr(chunkdedup, "written", lambda df: kept.append(common.written(df)) or kept[-1])
    found = [x for x in chunkdedup.repeats(docs_of(rows)).collect() if x["doc_id"] == 100]
    assert len(found) == 1 and 2400 <= found[0]["n_words"] <= 2402
    pieces = [x for x in kept[-1].collect() if x["doc_id"] == 100]
    assert len(pieces) < 10 and sum(x["first_p"] is not None for x in pieces) < 5 and sum(x["first_q"] is not None for x in pieces) < 5


def test_memory_goes_back():
    """What batches took before is not kept by the process; each block freed here lies below one that stays."""
    code = """
import pyarrow as pa
from lexmill.llm.common import slices

def used():
    return int(open("/proc/self/statm").read().split()[1]) * 4 // 1024

pins = []

def batches():
    for _ in range(3):
        blocks = [b"x" * 100_000 for _ in range(1500)]
        pins.append(b"y" * 100_000)
        del blocks
        yield pa.RecordBatch.from_pydict({"a": [1, 2, 3]})

before = used()
assert sum(b.num_rows for b in slices(batches(), 2)) == 9
assert used() - before < 60, used() - before
"""
    root = Path(common.__file__).resolve().parents[2]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_filter_grows(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 20)
    df = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    inside = df.toPandas()["h"].to_numpy().view(np.uint64)
    outside = spark.range(500_000, 600_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy().view(np.uint64)
    for entries, bits in ((0, 20), (1 << 17, 20), (400_000, 22), (1 << 40, 22)):
        got = common.bit_filter(df, "h", entries)
        assert len(got) * 8 == 1 << bits and common.in_filter(got, inside).all()
        assert common.in_filter(got, outside).mean() < (0.35 if bits == 20 else 0.1)


def test_beside():
    """The hashes of what is beside a chunk differ at no level that what is alike reaches over."""
    r = random.Random(32)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    for _ in range(20):
        w = [word() for _ in range(60)]
        raw = " ".join(w).encode()
        text = chunkdedup._Text(raw)
        ends = chunkdedup.cuts(raw)
        starts = np.r_[0, ends[:-1]]
        sig = text.beside(starts, ends)
        k = r.randrange(60)
        other = " ".join([*w[:k], "z" + w[k], *w[k + 1:]]).encode()
        ends2 = chunkdedup.cuts(other)
        sig2 = chunkdedup._Text(other).beside(np.r_[0, ends2[:-1]], ends2)
        at = {(a, b): s for a, b, s in zip(starts.tolist(), ends.tolist(), sig.tolist())}
        shift = len(" ".join(w[:k])) + (k > 0)
        for a, b, s in zip([0, *ends2[:-1].tolist()], ends2.tolist(), sig2.tolist()):
            moved = int(shift < a)
            if (old := at.get((a - moved, b - moved))) is None or a <= shift < b:
                continue
            # Words between the chunk and the change are alike at every level that they reach over.
            left, right = (old ^ s) >> 32, (old ^ s) & 0xFFFFFFFF
            n = len(other[shift:a].split()) - 1 if shift < a else len(other[b:shift].split()) - 1
            x = left if shift < a else right
            assert all(x >> 4 * i & 15 == 0 for i, level in enumerate(chunkdedup.LEVELS) if level <= n - 1)
            assert (right if shift < a else left) == 0


def test_large_buckets(spark, docs_of, monkeypatch):
    """Many documents that are alike but not all linked, in buckets of many blocks and groups of many parts."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "GROUP", 5)
    r = random.Random(12)
    base = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for p in r.sample(range(200), 3 if i % 3 else 14):
            w[p] = f"b{i}x{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(rows), k=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}
