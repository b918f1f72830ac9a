"""The pipeline's stages against brute force over a small corpus, each by what its predecessor kept."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import decontam
from lexmill.llm.common import tokenizer_path, written
from tests.llm.test_duplicates import brute, contaminated, corpus
from tests.llm.test_quality_and_language import sample
from tests.llm.test_spans import base_secrets

ITEMS = [(1, "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"), (2, "short item")]


@pytest.fixture(scope="module")
def rows():
    said = sample(60)
    out = [(i, t, lang, "s") for i, t, lang in said]
    out += [(1000 + i, t, "en", "s") for i, t in corpus(120)]
    out += [(2000, None, "en", "s"), (2001, "12 34", "en", "s"), (2002, said[1][1] + " eins zwei drei vier fünf sechs sieben acht neun zehn", "fr", "s"), (2003, "the garden a SHORT, item was", "en", "s")]
    out += [(2004, 'they were with the people token = "0123456789abcdef0123" in this house', "en", "s"), (2005, said[0][1], "en", "s"), (2006, "the house " * 4000, "en", "s"), (2007, said[0][1].upper(), "en", None)]
    return out


def test_stages(spark, docs_of, rows, tmp_path):
    d = str(tmp_path)
    docs_of(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), docs_of(rows).columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, d))
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    lang, near, clean, safe = kept
    texts = {r[0]: r[1] for r in rows}
    assert {2000, 2001}.isdisjoint(lang) and {i for i, t, *_ in rows if i < 1000 and len(t.split()) > 20} <= set(lang)
    assert all(texts[i] == t for i, t in lang.items())
    want = brute(list(lang.items()), 5, 80)
    assert set(near) == {i for i, (_, c) in want.items() if c == i}
    hit = contaminated(list(near.items()), ITEMS)
    assert set(clean) == {i for i, v in hit.items() if not v[0][4]} and {2002, 2003}.isdisjoint(clean)
    assert set(safe) == set(clean)
    for i, t in clean.items():
        if not base_secrets(t):
            assert safe[i] == t
    assert "0123456789abcdef" not in safe[2004] and "<assign>" in safe[2004]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    tok, ids = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        whole = ids.setdefault(r["doc_id"], [*tok.encode(safe[r["doc_id"]], add_special_tokens=False).ids, 0])
        assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert {i: sum(r["length"] for r in out if r["doc_id"] == i) for i in ids} == {i: len(x) for i, x in ids.items()} and set(ids) == set(safe)
    whole = corpus_pipeline.run(spark, d).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, out))


def test_empty_and_odd_tables(spark, docs_of, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for table in (docs_of([]), docs_of([(None, None, None, None), (1, None, "en", "s"), (1, None, "en", "s"), (None, "", None, None)])):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, d))
        assert "sequence_id" in docs.columns


def test_entry():
    import __spark_entry__ as e

    names = e.queries()
    assert [n for k in range(1, 11) for n in names if re.match(rf"op{k}_", n)] and "pipeline" in names and set(e.oracle_sql()) <= set(names)
    assert decontam.ORACLE == e.oracle_sql()["op3_decontamination"]
