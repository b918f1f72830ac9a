"""Every query of the engine that has SQL gives the rows of DuckDB, over tables made here; the direct and the indexed corpus agree."""

import random
import sys
from pathlib import Path

import duckdb
import pytest

from lexmill.operators.maintenance import IndexWriter
from lexmill.operators.search import Searcher
from lexmill.plans import catalog
from lexmill.plans import compile as cp
from lexmill.plans import query as q
from lexmill.sources.corpus import DirectCorpus

WORDS = ["the", "of", "and", "that", "thion", "la", "les", "der", "et", "erthen", "erthing", "zz", "div", "blue", "The", "OF"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, r = tmp_path_factory.mktemp("tables"), random.Random(1)
    text = lambda: r.choice([" ", "\n", ", "]).join(r.choice(WORDS) for _ in range(r.choice([0, 1, 5, 40, 700])))
    docs = [(i, text(), r.choice(["en", "es"]), f"src{r.randrange(20)}", 0) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", f"<div>{text()}</div>") for i in range(20)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i // 3, i % 3, "u", text()) for i in range(30)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, text()) for i in range(9)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, "blue " * i) for i in range(9)], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    con = duckdb.connect()
    for p in Path(d).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}/*.parquet'")
    return str(d), con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_against_duckdb(spark, tables, name):
    d, con = tables
    df = catalog.QUERIES[name](spark, d)
    columns = sorted(df.columns)
    sql = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[sql.columns.index(c)] for c in columns) for r in sql.fetchall())


def evaluate(node, tokens, path, size):
    """A document's answer, the plain way."""
    match node:
        case q.Term(v):
            return v in tokens
        case q.Prefix(v):
            return any(t.startswith(v) for t in tokens)
        case q.Phrase(terms, near):
            def go(start, at, i):
                return i == len(terms) or any(go(start, j, i + 1) for j in range(at + 1, len(tokens)) if tokens[j] == terms[i] and j - start - i <= near)

            return any(go(start, start, 1) for start in range(len(tokens)) if tokens[start] == terms[0])
        case q.Not(c):
            return not evaluate(c, tokens, path, size)
        case q.And(a, b):
            return evaluate(a, tokens, path, size) and evaluate(b, tokens, path, size)
        case q.Or(a, b):
            return evaluate(a, tokens, path, size) or evaluate(b, tokens, path, size)
        case q.Extension(v):
            return path.endswith("." + v)
        case q.Size(_, n):
            return size >= n


def random_query(r, depth=0):
    x = r.random()
    if depth < 3 and x < 0.5:
        a = random_query(r, depth + 1)
        return f"NOT ({a})" if x < 0.15 else f"({a}) {r.choice(['AND', 'OR', ''])} ({random_query(r, depth + 1)})"
    return r.choice(["the", "of", "erth*", "zz*", "nope", '"the of"', '"the the"~3', '"of that la"~5', "extension:md", "size:>=60", '"and"'])


def test_corpora_agree(spark, tables, tmp_path):
    from lexmill.functions.text import tokenize

    d, _ = tables
    view = catalog.view(spark, d).where("length(text) < 400").persist()
    rows = [(x["path"], tokenize(x["text"]), x["file_size"]) for x in view.collect()]
    IndexWriter(spark, str(tmp_path / "idx")).rebuild(view)
    searcher, direct, r = Searcher(spark, str(tmp_path / "idx")), DirectCorpus(view), random.Random(7)
    for _ in range(12):
        e = random_query(r)
        want = {p for p, t, s in rows if evaluate(q.parse_query(e), t, p, s)}
        got = [{x["path"]: round(x["score"], 9) for x in df.collect()} for df in (cp.search(direct, e, None), searcher.search_df(e, None))]
        assert set(got[0]) == want and got[0] == got[1], e
    searcher.close()


def test_prefix_limit(spark):
    def corpus(n):
        return DirectCorpus(spark.createDataFrame([("p", " ".join(f"prefix{i}" for i in range(n)), 1, 1)], "path string, text string, file_size long, mtime_ns long"))

    assert cp.search(corpus(256), "prefix*", None).count() == 1
    with pytest.raises(ValueError):
        cp.search(corpus(257), "NOT prefix*", None)


@pytest.fixture(scope="module")
def many_terms(spark, tmp_path_factory):
    """Tables whose documents have 300 terms with the catalog's prefix."""
    d, r = tmp_path_factory.mktemp("many"), random.Random(3)
    docs = [(i, " ".join([*(f"Tionth{r.randrange(300)}" for _ in range(i % 4 * 9)), *r.choices(WORDS, k=12), "tion"][i % 3:]), "en", f"src{i % 7}", 0) for i in range(200)]
    docs += [(200, " ".join(f"tionth{i}" for i in range(300)), "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["bm25_or", "match_prefix"])
def test_prefix_of_many_terms(spark, many_terms, name):
    """The catalog's queries have no limit, since their SQL has none."""
    test_against_duckdb(spark, many_terms, name)


def test_rows_that_share_a_path(spark, tmp_path):
    """Documents given twice count as one, as SQL's groups do; postings otherwise stay in their task, whatever the text."""
    texts = ["the of The", None, "", "of zz é of", "zz", "x" * 300]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(texts)] + [(0, "of the", "en", "src1", 0), (4, "zz zz", "en", "src1", 0), (4, "zz", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("postings", "visible_df"):
        test_against_duckdb(spark, (str(tmp_path), con), name)
    frequencies = {r["term"]: (r["df"], r["cf"]) for r in catalog.QUERIES["term_df"](spark, str(tmp_path)).collect()}
    assert frequencies == {"the": (1, 3), "of": (2, 4), "zz": (2, 5)}  # not the token of 300 letters


def test_postings_stay_in_their_task(spark, tables):
    d, _ = tables
    plan = lambda name: catalog.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("postings")
    for name in ("term_df", "visible_df", "validate_positions"):  # no shuffle of postings
        assert "collect_list" not in plan(name) and "posexplode" not in plan(name), name


def test_plans(spark, tables):
    """Only the needed columns are read; top-k keeps k rows a task; one match needs no shuffle."""
    d, _ = tables
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = plan(cp.search(catalog.corpus(spark, d), "the of", 5))
    assert "TakeOrderedAndProject" in top and "n_chars" not in top
    assert "Exchange" not in plan(catalog.matches("the OR of")(spark, d)) and "Python" not in top


def test_bm25(spark):
    from pyspark.sql import functions as F

    from lexmill.functions.ranking import bm25

    def score(*x):
        return spark.range(1).select(bm25(*map(F.lit, x)).alias("s")).first()["s"]

    assert score(2, 1, 10, 3, 8.0) == pytest.approx(1.260043420, abs=1e-6)
    assert score(0, 1, 10, 3, 8.0) == score(2, 0, 10, 3, 8.0) == score(2, 1, 10, 0, 8.0) == score(2, 1, 10, 3, 0.0) == 0
    assert score(3, 1, 10, 3, 8.0) > score(2, 1, 10, 3, 8.0)


def test_without_training_operators():
    """Nothing outside of the subpackage imports it."""
    root = Path(__file__).resolve().parent.parent / "lexmill"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lexmill.llm" not in p.read_text(), p
    assert "lexmill.plans.catalog" in sys.modules
