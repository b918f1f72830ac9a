"""Searching an index: hits with scores, explanations and source lines."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lexmill.functions.text import snippet_of
from lexmill.operators import storage as st
from lexmill.operators.maintenance import visible
from lexmill.plans import compile as cp
from lexmill.plans import query as q
from lexmill.sources.corpus import Corpus, IndexedCorpus
from lexmill.sources.directory import MOST_FILE_BYTES

MOST_HITS = 1000


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 20
    source_root: str | None = None
    explain: bool = False


@dataclass(frozen=True)
class ScoreDetail:
    term: str
    tf: int
    df: int
    score: float


@dataclass(frozen=True)
class Snippet:
    line: int
    text: str


@dataclass(frozen=True)
class SearchHit:
    path: str
    score: float
    snippet: Snippet | None = None
    explanation: list[ScoreDetail] = field(default_factory=list)


def safe(path: str) -> bool:
    return bool(path) and not path.startswith("/") and not re.search(r"(?:^|/)\.{1,2}(?:/|$)", path)


def snippet(root: str, path: str, terms: set[str]) -> Snippet | None:
    """The line to show of a source file, or None if there is none or it can't be read."""
    if not safe(path):
        return None
    try:
        full = os.path.join(root, path)
        if os.path.getsize(full) > MOST_FILE_BYTES:
            return None
        with open(full, "rb") as f:
            found = snippet_of(f.read().decode("utf-8", "replace"), terms)
        return Snippet(*found) if found else None
    except (OSError, ValueError):
        return None


class Searcher:
    """One generation of an index. The visible documents are worked out once, when it is opened, and kept until close()."""

    def __init__(self, spark: SparkSession, index_dir: str):
        self.manifest, docs, postings = st.read_index(spark, Path(index_dir))
        self._documents = visible(docs).persist()
        self.corpus: Corpus | None = IndexedCorpus(self._documents, postings, self.manifest.positions)

    def close(self) -> None:
        self._documents.unpersist()
        self.corpus = None

    def _corpus(self) -> Corpus:
        if self.corpus is None:
            raise RuntimeError("the searcher is closed")
        return self.corpus

    def search_df(self, expression: str, top_k: int | None = 20) -> DataFrame:
        """path, score, explanation, best first; without top_k all matches, unsorted."""
        return cp.search(self._corpus(), expression, top_k)

    def search(self, expression: str, options: SearchOptions = SearchOptions()) -> list[SearchHit]:
        return search(self._corpus(), expression, options)


def search(corpus: Corpus, expression: str, options: SearchOptions = SearchOptions()) -> list[SearchHit]:
    if not 0 <= options.top_k <= MOST_HITS:
        raise ValueError(f"top_k must be from 0 to {MOST_HITS}")
    if options.source_root and not os.path.isdir(options.source_root):
        raise ValueError(f"{options.source_root} is not a folder")
    node = q.parse_query(expression)
    if options.top_k == 0:
        return []
    p = cp.plan(node, corpus)
    stats = cp.statistics(corpus, p.positive) if p.positive else cp.Statistics(0, 0.0, {})
    rows = cp.best(cp.scored(cp.matching(corpus, p), stats, p.positive), options.top_k).collect()
    out = []
    for r in rows:
        details = [ScoreDetail(e["term"], e["tf"], e["df"], e["score"]) for e in r["explanation"]] if options.explain else []
        out.append(SearchHit(r["path"], r["score"], snippet(options.source_root, r["path"], set(p.positive)) if options.source_root else None, details))
    return out
