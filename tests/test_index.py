import io
import json
import os
import shutil

import pytest

from lexmill import cli
from lexmill.operators import storage as st
from lexmill.operators.maintenance import IndexOptions, IndexWriter, validate_index
from lexmill.operators.search import Searcher, SearchOptions
from lexmill.sources import directory


def put(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
        os.utime(p, ns=(10**18, 10**18))


def found(spark, index, *expressions):
    s = Searcher(spark, str(index))
    out = [[h.path for h in s.search(e)] for e in expressions]
    s.close()
    return out if len(out) > 1 else out[0]


def test_language(spark, tmp_path):
    src, idx = tmp_path / "src", tmp_path / "idx"
    put(src, {"a.txt": "alpha beta alpha alphabet", "b.md": "alpha gamma beta alpine", "sub/c.TXT": "delta alpha beta", "sub/repeat.txt": "echo echo"})
    r = IndexWriter(spark, str(idx)).rebuild(str(src))
    assert (r.outcome, r.revision, r.active_segments, r.metrics.indexed_files, r.metrics.token_count) == ("published", 1, 1, 4, 13)
    s = Searcher(spark, str(idx))
    n = {
        '"alpha beta"': 2, '"alpha alpha"': 0, '"echo echo"': 1, '"alpha beta"~1': 3, "alpha beta": 3, "alpha AND (beta OR delta) AND NOT extension:md": 2, "path:sub/*": 2,
        "NOT alpha": 1, "size:<10": 1, "mtime:2001-09-09": 4, "mtime:>2001-09-09": 0, "missing": 0, "missing OR echo": 1,
    }
    assert {e: len(s.search(e)) for e in n} == n
    assert [h.path for h in s.search("extension:.mD")] == ["b.md"]
    hit = {h.path: h for h in s.search("alp*", SearchOptions(explain=True))}
    assert [e.term for e in hit["a.txt"].explanation] == ["alpha", "alphabet"]
    assert hit["a.txt"].score == pytest.approx(sum(e.score for e in hit["a.txt"].explanation))
    assert [(h.path, h.score) for h in s.search("extension:txt")] == [("a.txt", 0.0), ("sub/c.TXT", 0.0), ("sub/repeat.txt", 0.0)]
    assert s.search("alpha", SearchOptions(top_k=0)) == []
    with pytest.raises(ValueError):
        s.search("alpha", SearchOptions(top_k=1001))
    with pytest.raises(ValueError):
        s.search("alpha AND", SearchOptions(top_k=0))
    assert validate_index(spark, str(idx)).terms == 7


def test_lifecycle(spark, tmp_path):
    src, idx = tmp_path / "src", tmp_path / "idx"
    put(src, {"a.txt": "alpha beta shared", "b.txt": "stale shared"})
    w = IndexWriter(spark, str(idx))
    w.rebuild(str(src))
    stats = lambda: (lambda s: (s.documents, s.segments, s.tombstones))(validate_index(spark, str(idx)))
    assert stats() == (2, 1, 0)
    assert w.update(str(src)).outcome == "unchanged"
    put(src, {"b.txt": "alpha beta replacement", "c.txt": "gamma shared"})
    r = w.update(str(src))
    assert (r.changes.added, r.changes.modified, r.changes.removed, r.changes.unchanged) == (1, 1, 0, 1)
    assert stats() == (3, 2, 0)
    old = Searcher(spark, str(idx))
    r = w.remove(["a.*"])
    assert (r.outcome, r.changes.matched) == ("published", 1)
    assert w.remove(["zzz"]).outcome == "unchanged"
    assert stats() == (2, 3, 1)
    assert found(spark, idx, "shared", "alpha", "stale") == [["c.txt"], ["b.txt"], []]
    assert sorted(h.path for h in old.search("shared")) == ["a.txt", "c.txt"]  # a reader keeps its generation
    old.close()
    s = Searcher(spark, str(idx))
    before = [(h.path, h.score) for h in s.search("alpha OR shared OR gamma")]
    s.close()
    assert w.compact().changes.discarded_records == 3
    assert w.compact().outcome == "unchanged"
    assert stats() == (2, 1, 0)
    s = Searcher(spark, str(idx))
    assert [(h.path, h.score) for h in s.search("alpha OR shared OR gamma")] == before
    s.close()
    r = w.update(str(src))
    assert (r.changes.added, r.changes.unchanged) == (1, 2)
    (src / "b.txt").unlink()
    assert w.update(str(src)).changes.removed == 1
    assert found(spark, idx, "beta") == ["a.txt"]


def test_compacts_by_itself(spark, tmp_path):
    table = lambda i: spark.createDataFrame([("a", f"word{i}", i)], "path string, text string, mtime_ns long")
    w = IndexWriter(spark, str(tmp_path / "idx"))
    w.rebuild(table(0))
    m = st.read_manifest(tmp_path / "idx")
    # Sixteen segments are there; the seventeenth makes one of all.
    for i in range(1, 16):
        with st.Transaction(tmp_path / "idx", create=False) as t:
            name = st.segment_name(t.next_segment)
            shutil.copytree(tmp_path / "idx" / st.segment_name(m.active[0]), tmp_path / "idx" / f".segment-{i:032x}")
            t.temporary.append(tmp_path / "idx" / f".segment-{i:032x}")
            new, _ = t.commit(t.temporary[-1], t.old.active, True)
            assert (tmp_path / "idx" / name).exists()
    assert len(new.active) == 16
    r = w.update(table(1))
    assert (r.outcome, r.active_segments) == ("compacted", 1)
    assert found(spark, tmp_path / "idx", "word1", "word0") == [["a"], []]


def test_failures_and_profiles(spark, tmp_path):
    src, idx = tmp_path / "src", tmp_path / "idx"
    put(src, {"a-valid.txt": "safe", "b-long.txt": "x" * 300, "c.txt": b"A\xe2(\xa1B", "empty.txt": "", ".hidden": "safe"})
    w = IndexWriter(spark, str(idx), IndexOptions(profile="minimal"))
    r = w.rebuild(str(src))
    assert (r.metrics.indexed_files, r.metrics.failed_files, [d.path for d in r.diagnostics]) == (4, 1, ["b-long.txt"])
    assert found(spark, idx, "safe") == [".hidden", "a-valid.txt"]
    with pytest.raises(ValueError):
        found(spark, idx, '"safe"')
    with pytest.raises(RuntimeError):
        w.update(str(src))
    r = IndexWriter(spark, str(tmp_path / "strict"), invalid="reject").rebuild(str(src))
    assert sorted(d.path for d in r.diagnostics) == ["b-long.txt", "c.txt"] and "byte 1" in [d for d in r.diagnostics if d.path == "c.txt"][0].message
    with pytest.raises(RuntimeError):
        IndexWriter(spark, str(idx), IndexOptions(memory_limit_bytes=1)).rebuild(str(src))
    with pytest.raises(RuntimeError):
        IndexWriter(spark, str(idx), IndexOptions(temporary_space_limit_bytes=1)).rebuild(str(src))
    assert st.read_manifest(idx).generation == 1
    for bad in ({"profile": "x"}, {"merge_fan_in": 1}, {"worker_threads": 0}, {"temporary_directory": str(tmp_path / "none")}):
        with pytest.raises(ValueError):
            IndexWriter(spark, str(idx), IndexOptions(**bad))


def test_publication(spark, tmp_path):
    idx = tmp_path / "idx"
    empty = spark.createDataFrame([], "path string, text string, mtime_ns long")
    with pytest.raises(RuntimeError, match="rebuild"):
        Searcher(spark, str(tmp_path))
    w = IndexWriter(spark, str(idx))
    w.rebuild(empty)
    assert found(spark, idx, "NOT a") == []
    with st.Transaction(idx, create=False):
        with pytest.raises(RuntimeError, match="another writer"):
            w.compact()
    # What an interrupted writer left goes; other files stay.
    for name in (".segment-" + "0" * 32, "segment-0000000000000077"):
        (idx / name).mkdir()
    (idx / "notes.txt").write_text("mine")
    w.update(spark.createDataFrame([("p", "one two", 5)], "path string, text string, mtime_ns long"))
    assert (idx / "notes.txt").exists() and not (idx / (".segment-" + "0" * 32)).exists() and not (idx / "segment-0000000000000077").exists()
    assert found(spark, idx, "one") == ["p"]
    part = next((idx / st.segment_name(st.read_manifest(idx).active[-1])).rglob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    with pytest.raises(RuntimeError, match="changed"):
        validate_index(spark, str(idx))
    m = json.loads((idx / "MANIFEST").read_text())
    m["body"]["generation"] += 1
    (idx / "MANIFEST").write_text(json.dumps(m))
    with pytest.raises(RuntimeError, match="checksum"):
        Searcher(spark, str(idx))


def test_scan(tmp_path):
    put(tmp_path, {"a.cpp": "1", "b.hpp": "22", "generated/c.cpp": "3", "d/e.txt": "55555", "d/.f.cpp": ""})
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "link.cpp").symlink_to(tmp_path / "a.cpp")
    paths = lambda **k: [f[0] for f in directory.scan(str(tmp_path), directory.ScanOptions(**k)).files]
    assert paths() == ["a.cpp", "b.hpp", "d/.f.cpp", "d/e.txt", "generated/c.cpp"]
    assert paths(include=("*.cpp", "*.hpp"), exclude=("generated/*",)) == ["a.cpp", "b.hpp", "d/.f.cpp"]
    assert paths(most_bytes=2) == ["a.cpp", "b.hpp", "d/.f.cpp", "generated/c.cpp"]
    assert "link.cpp" in paths(follow_links=True) and not any(p.startswith("loop") for p in paths(follow_links=True))
    with pytest.raises(FileNotFoundError):
        directory.scan(str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        directory.scan(str(tmp_path / "a.cpp"))


def test_read_counts_invalid(spark, tmp_path):
    put(tmp_path, {"a": b"A\xe2(\xa1B", "b": b"A\xf0\x9f", "c": "�ok"})
    rows = {r["path"]: (r["text"], r["n_invalid"]) for r in directory.read(spark, directory.scan(str(tmp_path))).collect()}
    assert rows == {"a": ("A�(�B", 2), "b": ("A�", 1), "c": ("�ok", 0)}


def call(spark, *args):
    out, err = io.StringIO(), io.StringIO()
    return cli.run(list(map(str, args)), spark, out, err), out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path):
    src, idx = tmp_path / "src", tmp_path / "idx"
    put(src, {"a.txt": 'first\nsecond "é" unique term\n', "b.txt": "unique"})
    code, out, _ = call(spark, "index", src, "--index", idx)
    assert code == 0 and [x.split("=")[0] for x in out.split()] == ["outcome", "revision", "segments", "indexed", "failed", "memory_peak_bytes", "temporary_peak_bytes", "warning_count"]
    code, out, _ = call(spark, "query", idx, "unique term", "--source", src, "--jsonl", "--explain")
    row = json.loads(out)
    assert list(row) == ["path", "line", "score", "snippet", "explanation"] and row["line"] == 2 and row["snippet"] == 'second "é" unique term'
    assert list(row["explanation"][0]) == ["term", "tf", "df", "score"]
    assert call(spark, "query", idx, "unique", "--paths-only")[1] == "b.txt\na.txt\n"
    assert call(spark, "query", idx, "nothing") == (0, "", "")
    assert call(spark, "query", idx, "unique")[1].startswith("b.txt score=0.")
    put(src, {"c.txt": "x"})
    assert "added=1\nmodified=0\nremoved=0\nunchanged=2\n" in call(spark, "update", src, "--index", idx)[1]
    assert "matched=1\n" in call(spark, "remove", idx, "--path", "c.*", "--path", "zz")[1]
    assert "discarded_records=2\n" in call(spark, "compact", idx)[1]
    assert [x.split("=")[0] for x in call(spark, "stats", idx)[1].split()] == ["documents", "segments", "tombstones", "terms", "postings", "positions", "bytes"]
    assert call(spark, "verify", idx)[1] == "index verified\n"
    put(src, {"bad.txt": "y" * 300})
    code, _, err = call(spark, "index", src, "--index", tmp_path / "idx2")
    assert code == 2 and err.startswith("document warning: bad.txt: ")
    for bad in (["query", idx, "a", "--jsonl", "--paths-only"], ["query", idx, "a", "--paths-only", "--explain"], ["query", idx, "a", "--top-k", "1001"], ["query", idx, "a AND"], ["index", src], ["nope"],
                ["compact", idx, "--threads", "0"], ["compact", idx, "--threads", "1", "--threads", "1"], ["remove", idx], ["stats", tmp_path / "none"], ["compact", idx, "--memory-limit", "1KB"]):
        code, out, err = call(spark, *bad)
        assert code == 1 and not out and err.startswith("lexmill: "), bad
    assert call(spark, "--version")[0] == call(spark, "--help")[0] == 0


def test_stream(spark, tmp_path):
    from lexmill.streaming.follow import follow

    w = IndexWriter(spark, str(tmp_path / "idx"))
    w.rebuild(spark.createDataFrame([("a", "one", 1)], "path string, text string, mtime_ns long"))
    inbox = tmp_path / "in"

    def send(rows):
        spark.createDataFrame(rows, "path string, text string, mtime_ns long").write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema("path string, text string, mtime_ns long").parquet(str(inbox))
        q = follow(w, stream, str(tmp_path / "chk"))
        q.awaitTermination(60)
        assert q.exception() is None

    send([("b", "two", 1), ("b", "three", 2)])
    assert found(spark, tmp_path / "idx", "one", "two", "three") == [["a"], [], ["b"]]
    send([("a", None, 9)])
    assert found(spark, tmp_path / "idx", "one", "three") == [[], ["b"]]


def test_numbers_and_staging(spark, tmp_path):
    """Documents are numbered on in order of path over partitions, with failed ones and shared paths among them; staged rows and tokens don't stay."""
    idx = tmp_path / "idx"
    rows = [(f"p{i:04}", "x" * 300 if i % 7 == 3 else f"word{i} all ALL") for i in range(300)] + [("p0005", "again")]
    r = IndexWriter(spark, str(idx)).rebuild(spark.createDataFrame(rows, "path string, text string").repartition(5))
    assert (r.metrics.indexed_files, r.metrics.failed_files) == (258, 43) and len(r.diagnostics) == 43
    assert [p.name for p in idx.iterdir() if p.name.startswith(".")] == []
    _, docs, post = st.read_index(spark, idx)
    assert "text" not in docs.columns
    got = docs.orderBy("doc_ord").collect()
    assert [x["doc_ord"] for x in got] == list(range(258)) and [x["path"] for x in got] == sorted(p for p, t in rows if len(t) < 300)
    assert [(x["tf"], x["positions"]) for x in post.where("term = 'all'").collect()] == [(2, [1, 2])] * 257


def test_rules_by_row_and_at_once(spark):
    """Each rule gives a row for each fault, also for two faults of one posting, and check() names the rule that one query finds broken."""
    from lexmill.operators import validation as vd
    from lexmill.operators.maintenance import visible

    docs = [(1, 0, "a", 1, 1, 3, False, 1), (1, 1, "b", 1, 1, 1, False, 1), (1, 2, "c", 0, 0, 0, True, None)]
    good = [("x", 1, 0, 2, [0, 2]), ("y", 1, 0, 1, [1]), ("x", 1, 1, 1, [0])]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = frame(docs, st.DOCUMENTS)
    assert vd.check(d, frame(good, st.POSTINGS), visible(d)).asDict() == {"terms": 2, "postings": 3, "positions": 4}
    assert vd.check(d.where("false"), frame([], st.POSTINGS), visible(d.where("false"))).asDict() == {"terms": 0, "postings": 0, "positions": 0}
    for rule, more, n in (
        ("terms", [("X", 1, 0, 1, [5])] * 2, 3), ("postings", [("x", 1, 9, 0, [])], 2), ("postings", [("z", 1, 1, 0, [])], 1),
        ("lengths", [("z", 1, 1, 1, [1])], 1), ("hidden", [("x", 1, 2, 1, [0])], 1), ("terms", [("y", 1, 0, 1, [1])], 1),
    ):
        p = frame(good + more, st.POSTINGS)
        assert vd.RULES[rule](d, p).count() == n, (rule, more)
        first = next(name for name in vd.RULES if not vd.RULES[name](d, p).isEmpty())
        with pytest.raises(RuntimeError, match=f"'{first}'"):
            vd.check(d, p, visible(d))
