"""The command line: index, update, remove, compact, query, stats, verify."""

from __future__ import annotations

import json
import sys

from lexmill import __version__
from lexmill.functions.text import byte_size
from lexmill.operators.maintenance import IndexOptions, IndexResult, IndexWriter, validate_index
from lexmill.operators.search import MOST_HITS, SearchHit, Searcher, SearchOptions

HELP = f"""lexmill {__version__}: full-text retrieval on Spark

  index SOURCE --index DIR     a new index of a folder
  update SOURCE --index DIR    bring an index up to a folder
  remove DIR --path GLOB ...   hide documents by path
  compact DIR                  one segment of what is visible
  query DIR EXPRESSION         ranked matches
  stats DIR | verify DIR       counts | a full check

Writers take --profile minimal|balanced|performance, --memory-limit SIZE, --temporary-directory DIR,
--temporary-space-limit SIZE, --threads N and --merge-fan-in N; a SIZE may end in B, KiB, MiB, GiB or TiB.
query takes --top-k N, --source DIR (shows lines), --explain, and --jsonl or --paths-only.
"""


class UsageError(ValueError):
    pass


def _integer(text: str, least: int, option: str) -> int:
    if not (text.isascii() and text.isdigit()) or int(text) < least:
        raise UsageError(f"{option} takes an integer of {least} or more")
    return int(text)


_WRITER = {
    "--profile": ("profile", str),
    "--memory-limit": ("memory_limit_bytes", lambda v: byte_size(v, True, "--memory-limit")),
    "--temporary-space-limit": ("temporary_space_limit_bytes", lambda v: byte_size(v, True, "--temporary-space-limit")),
    "--temporary-directory": ("temporary_directory", str),
    "--threads": ("worker_threads", lambda v: _integer(v, 1, "--threads")),
    "--merge-fan-in": ("merge_fan_in", lambda v: _integer(v, 2, "--merge-fan-in")),
}


def writer_options(args: list[str], more: dict[str, bool]) -> tuple[IndexOptions, dict[str, list[str]]]:
    """Options of a writer and, of those in `more` (option: whether it may repeat), the values."""
    values: dict[str, object] = {}
    others: dict[str, list[str]] = {}
    i = 0
    while i < len(args):
        name = args[i]
        if name not in _WRITER and name not in more:
            raise UsageError(f"unknown option {name}")
        if i + 1 >= len(args):
            raise UsageError(f"{name} needs a value")
        if name in _WRITER:
            key, read = _WRITER[name]
            if key in values:
                raise UsageError(f"{name} may be given once")
            values[key] = read(args[i + 1])
        else:
            if name in others and not more[name]:
                raise UsageError(f"{name} may be given once")
            others.setdefault(name, []).append(args[i + 1])
        i += 2
    options = IndexOptions(**values)
    options.resolved()
    return options, others


def score_text(x: float) -> str:
    return f"{x:.6f}"


def json_text(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def render(hit: SearchHit, form: str, explain: bool) -> str:
    """The lines of one hit, each with its end."""
    if form == "paths":
        return hit.path + "\n"
    if form == "jsonl":
        line, shown = (hit.snippet.line, hit.snippet.text) if hit.snippet else (0, "")
        out = f'{{"path":{json_text(hit.path)},"line":{line},"score":{score_text(hit.score)},"snippet":{json_text(shown)}'
        if explain:
            parts = (f'{{"term":{json_text(e.term)},"tf":{e.tf},"df":{e.df},"score":{score_text(e.score)}}}' for e in hit.explanation)
            out += f',"explanation":[{",".join(parts)}]'
        return out + "}\n"
    place = f":{hit.snippet.line}" if hit.snippet else ""
    shown = f" {hit.snippet.text}" if hit.snippet and hit.snippet.text else ""
    rows = [f"{hit.path}{place} score={score_text(hit.score)}{shown}"]
    rows += [f"  {e.term} tf={e.tf} df={e.df} score={score_text(e.score)}" for e in hit.explanation]
    return "".join(r + "\n" for r in rows)


def report(result: IndexResult, command: str, out, err) -> int:
    for d in result.diagnostics:
        print(f"{d.stage} warning: {d.path}: {d.message}", file=err)
    c, m = result.changes, result.metrics
    pairs = [("outcome", result.outcome), ("revision", result.revision), ("segments", result.active_segments)]
    pairs += {
        "index": [("indexed", m.indexed_files), ("failed", m.failed_files)],
        "update": [("added", c.added), ("modified", c.modified), ("removed", c.removed), ("unchanged", c.unchanged), ("failed", m.failed_files)],
        "remove": [("matched", c.matched)],
        "compact": [("discarded_records", c.discarded_records)],
    }[command]
    pairs += [("memory_peak_bytes", m.peak_memory_bytes), ("temporary_peak_bytes", m.peak_temporary_bytes), ("warning_count", len(result.diagnostics))]
    for k, v in pairs:
        print(f"{k}={v}", file=out)
    return 2 if result.diagnostics else 0


def query_options(args: list[str]) -> tuple[SearchOptions, str]:
    values: dict[str, object] = {}
    form, i = "rich", 0
    while i < len(args):
        name = args[i]
        if name in ("--source", "--top-k"):
            key = "source_root" if name == "--source" else "top_k"
            if key in values or i + 1 >= len(args):
                raise UsageError(f"{name} takes one value, once")
            values[key] = args[i + 1] if key == "source_root" else _integer(args[i + 1], 0, name)
            if key == "top_k" and values[key] > MOST_HITS:
                raise UsageError(f"--top-k is at most {MOST_HITS}")
            i += 1
        elif name in ("--jsonl", "--paths-only"):
            if form != "rich":
                raise UsageError("one of --jsonl and --paths-only can be given")
            form = "jsonl" if name == "--jsonl" else "paths"
        elif name == "--explain":
            values["explain"] = True
        else:
            raise UsageError(f"unknown option {name}")
        i += 1
    if form == "paths" and values.get("explain"):
        raise UsageError("--paths-only shows no explanations")
    return SearchOptions(**values), form


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lexmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(args: list[str], spark=None, out=None, err=None) -> int:
    """The exit status: 0, 1 for an error, 2 where something was published with warnings."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        if not args or args[0] in ("--help", "-h"):
            print(HELP, file=out)
            return 0
        if args[0] == "--version":
            print(__version__, file=out)
            return 0
        command, rest = args[0], args[1:]
        if command in ("index", "update") and rest:
            options, others = writer_options(rest[1:], {"--index": False})
            if "--index" not in others:
                raise UsageError(f"{command} needs --index")
            writer = IndexWriter(spark or _session(), others["--index"][0], options)
            return report(writer.rebuild(rest[0]) if command == "index" else writer.update(rest[0]), command, out, err)
        if command == "remove" and rest:
            options, others = writer_options(rest[1:], {"--path": True})
            if not others.get("--path"):
                raise UsageError("remove needs --path")
            return report(IndexWriter(spark or _session(), rest[0], options).remove(others["--path"]), command, out, err)
        if command == "compact" and rest:
            options, _ = writer_options(rest[1:], {})
            return report(IndexWriter(spark or _session(), rest[0], options).compact(), command, out, err)
        if command == "query" and len(rest) >= 2:
            options, form = query_options(rest[2:])
            searcher = Searcher(spark or _session(), rest[0])
            try:
                for hit in searcher.search(rest[1], options):
                    out.write(render(hit, form, options.explain))
            finally:
                searcher.close()
            return 0
        if command in ("stats", "verify") and len(rest) == 1:
            stats = validate_index(spark or _session(), rest[0])
            if command == "verify":
                print("index verified", file=out)
            else:
                for k in ("documents", "segments", "tombstones", "terms", "postings", "positions", "bytes"):
                    print(f"{k}={getattr(stats, k)}", file=out)
            return 0
        raise UsageError("no such command; see --help")
    except Exception as e:  # noqa: BLE001
        print(f"lexmill: {e}", file=err)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
