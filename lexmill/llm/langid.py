"""Language ID by a linear-chain conditional random field over words.

A word is a run of letters (with marks and apostrophes inside). Its features: affixes and inner n-grams of one to
four characters with the word's boundaries as characters, and the word itself, which the lexicon of training words
knows. Features are hashed to a table of weights per language. Transitions between neighbouring words' languages
are learned with the emissions, by gradient ascent of the likelihood on chains that are spliced from documents of
one or two languages, so that switches occur in training. A text's words are labelled by forward-backward in chains
of CHAIN words, each with CONTEXT words of the text on both sides, over which the values from the neighbours are
carried; the text's language is that with the largest mean posterior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from lexmill.llm.common import mix, read_table, slices

HASH_BITS, NGRAMS, CHAIN, CONTEXT = 17, (1, 2, 3, 4), 48, 12
#: The bounds of the training sample: documents of each language and in all, and pieces of half a chain from all over each.
DOCS_PER_LANG, MOST_DOCS, PIECES_PER_DOC = 300, 4096, 16
_WORD = None


def words_of(text: str) -> list[str]:
    global _WORD
    if _WORD is None:
        import regex

        _WORD = regex.compile(r"\p{L}(?:[\p{L}\p{M}]|['’](?=\p{L}))*").findall
    return _WORD(text.lower() if text.isascii() or "İ" not in text else text.replace("İ", "i").lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first of each word's features): the hashed features of all words, one after another."""
    flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(flat == 2) - 1
    h = np.zeros(len(flat), np.uint64)
    out, of = [], []
    for n in NGRAMS:
        h = h[:len(flat) - n + 1] if n > 1 else h
        h = mix(h * np.uint64(31) + flat[n - 1:] + np.uint64(n))
        ok = word[:len(h)] == word[n - 1:]
        if n == 1:
            ok &= flat > 3
        out.append(h[ok])
        of.append(word[:len(h)][ok])
    # The lexicon's feature: a hash of all characters with their places.
    starts = np.flatnonzero(flat == 2)
    place = np.arange(len(flat)) - starts[word]
    whole = np.add.reduceat(mix(flat * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), starts)
    out.append(mix(whole))
    of.append(np.arange(len(words)))
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    f = (np.concatenate(out)[order] >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return f, np.searchsorted(of_all[order], np.arange(len(words)))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # from x to, in logs

    def emissions(self, words: list[str]) -> np.ndarray:
        f, at = features(words)
        return np.add.reduceat(self.weights[f], at, axis=0)


def _forward_backward(e: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains e (chains x CHAIN x languages, in logs), the posteriors of labels, and of moves summed over all places.

    Forward and backward values are scaled to sum to 1 at each place; masked places carry the values through.
    """
    n, t, k = e.shape
    p = np.exp(e - e.max(2, keepdims=True)).astype(np.float32)
    m = np.exp(moves - moves.max()).astype(np.float32)
    a = np.empty((t, n, k), np.float32)
    b = np.ones((t, n, k), np.float32) / k
    a[0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (a[i - 1] @ m) * p[:, i]
        x /= x.sum(1, keepdims=True)
        a[i] = np.where(mask[:, i, None], x, a[i - 1])
    for i in range(t - 2, -1, -1):
        x = (p[:, i + 1] * b[i + 1]) @ m.T
        x /= x.sum(1, keepdims=True)
        b[i] = np.where(mask[:, i + 1, None], x, b[i + 1])
    post = a * b
    post /= post.sum(2, keepdims=True)
    pair = np.zeros((k, k))
    for i in range(1, t):
        q = a[i - 1][:, :, None] * m[None] * (p[:, i] * b[i])[:, None, :]
        q /= q.sum((1, 2), keepdims=True)
        pair += q[mask[:, i]].sum(0)
    return post.transpose(1, 0, 2), pair


def pieces_of(text: str, most: int = PIECES_PER_DOC) -> list[list[str]]:
    """Runs of half a chain of words: all of a text's, or `most` of them, evenly spread over the whole text."""
    w = words_of(text)
    starts = range(0, len(w), CHAIN // 2)
    if len(starts) > most:
        starts = [starts[k * len(starts) // most] for k in range(most)]
    return [w[i:i + CHAIN // 2] for i in starts]


def train(texts: list[tuple[str, str]], epochs: int = 4, rate: float = 0.4, seed: int = 3) -> Model:
    """A model of (text, language) rows; of none, one without languages."""
    return train_pieces([(p, lang) for text, lang in texts for p in pieces_of(text)], sorted({lang for _, lang in texts}), epochs, rate, seed)


def train_pieces(found: list[tuple[list[str], str]], langs: list[str], epochs: int = 4, rate: float = 0.4, seed: int = 3) -> Model:
    if not langs:
        return Model([], np.zeros((1 << HASH_BITS, 0), np.float32), np.zeros((0, 0), np.float32))
    rng, k = np.random.default_rng(seed), len(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    pieces = [(w, number[lang]) for w, lang in found]
    if not pieces:
        return Model(langs, np.zeros((1 << HASH_BITS, k), np.float32), np.zeros((k, k), np.float32))
    weights, moves = np.zeros((1 << HASH_BITS, k)), np.zeros((k, k))
    gw, gm = np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2)
    for _ in range(epochs):
        # Two pieces to a chain, at random: some chains switch language, the others stay.
        order = rng.permutation(len(pieces))
        for i in range(0, len(order), 128):
            part = order[i:i + 128]
            chains = [[pieces[j] for j in part[c:c + 2]] for c in range(0, len(part), 2)]
            # Half of the chains take both pieces from one language.
            for c in chains[::2]:
                same = [p for p in (pieces[j] for j in part) if p[1] == c[0][1]]
                c[1:] = [same[rng.integers(len(same))]]
            words = [w for c in chains for p in c for w in p[0]]
            gold = np.array([p[1] for c in chains for p in c for _ in p[0]])
            lengths = np.array([sum(len(p[0]) for p in c) for c in chains])
            f, at = features(words)
            e = np.add.reduceat(weights[f], at, axis=0)
            mask = np.arange(CHAIN) < lengths[:, None]
            x = np.zeros((*mask.shape, k))
            x[mask] = e
            post, pair = _forward_backward(x, mask, moves)
            d = -post[mask].astype(np.float64)
            d[np.arange(len(gold)), gold] += 1
            y = np.zeros(mask.shape, np.int64)
            y[mask] = gold
            both = mask[:, 1:]
            want = np.zeros((k, k))
            np.add.at(want, (y[:, :-1][both], y[:, 1:][both]), 1)
            per = np.repeat(d, np.diff(np.append(at, len(f))), axis=0)
            used, back = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(back, per[:, j], len(used)) for j in range(k)], 1) - 1e-3 * weights[used]
            gw[used] += g * g
            weights[used] += rate * g / np.sqrt(gw[used])
            g = want - pair
            gm += g * g
            moves += rate * g / np.sqrt(gm)
    return Model(langs, weights.astype(np.float32), moves.astype(np.float32))


def word_posteriors(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the posteriors of all words (words x languages), one text after another."""
    words = [words_of(t) if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    total, k = int(n.sum()), len(model.langs)
    if not total or not k:
        return n, np.zeros((total, k), np.float32)
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64, total)
    e = model.emissions(list(index))
    chains = -(-n // CHAIN)
    doc = np.repeat(np.arange(len(texts)), chains)
    first = np.cumsum(n) - n
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(chains) - chains, chains)) * CHAIN
    low, high = np.maximum(begin - CONTEXT, 0), np.minimum(begin + CHAIN + CONTEXT, n[doc])
    out = np.empty((total, k), np.float32)
    length = high - low
    edges = (0, 12, 24, CHAIN, CHAIN + CONTEXT, CHAIN + 2 * CONTEXT)
    for least, most in zip(edges, edges[1:]):
        rows = np.flatnonzero((length > least) & (length <= most))
        place = np.arange(most)
        for i in range(0, len(rows), 2048):
            r = rows[i:i + 2048]
            mask = place < length[r, None]
            at = (first[doc[r]] + low[r])[:, None] + np.where(mask, place, 0)
            post = _smooth(e[ids[at]], mask, model.moves)
            own = (place >= (begin - low)[r, None]) & (place < np.minimum(begin + CHAIN, high)[r, None] - low[r, None])
            out[at[own]] = post[own]
    return n, out


def label(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The language and the score of each text; `und` and 0 for one without letters. Of languages that tie, the first by name."""
    n, post = word_posteriors(texts, model)
    if not len(post) or not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(model.langs)))
    some = np.flatnonzero(n)
    sums[some] = np.add.reduceat(post, (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
    mean = sums / np.maximum(n, 1)[:, None]
    best = mean.argmax(1)
    return [model.langs[b] if k else "und" for b, k in zip(best, n)], [float(min(1.0, mean[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, n))]


def spans(texts: list[str | None], model: Model) -> list[list[tuple[str, int, int]]]:
    """Of each text, its runs of words of one language: (language, first word, words)."""
    n, post = word_posteriors(texts, model)
    if not model.langs:
        return [[] for _ in texts]
    best, out = post.argmax(1), []
    for a, m in zip((np.cumsum(n) - n).tolist(), n.tolist()):
        x = best[a:a + m]
        at = [*np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist(), m] if m else [0]
        out.append([(model.langs[x[i]], i, j - i) for i, j in zip(at, at[1:])])
    return out


def _smooth(e, mask, moves):
    t = e.shape[1]
    p = np.exp(e - e.max(2, keepdims=True)).transpose(1, 0, 2).copy()
    # A masked place has equal emissions, and nothing beyond it; its backward values stay equal.
    p[~mask.T] = 1.0
    m = np.exp(moves - moves.max()).astype(np.float32)
    a, b = np.empty_like(p), np.empty_like(p)
    a[0] = p[0] / p[0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (a[i - 1] @ m) * p[i]
        a[i] = x / x.sum(1, keepdims=True)
    b[t - 1] = 1.0
    live = mask.T[:, :, None]
    for i in range(t - 2, -1, -1):
        x = (p[i + 1] * b[i + 1]) @ m.T
        b[i] = np.where(live[i + 1], x / x.sum(1, keepdims=True), 1.0)
    post = a * b
    return (post / post.sum(2, keepdims=True)).transpose(1, 0, 2)


def held_out(doc_id):
    """Documents that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, most_docs: int = MOST_DOCS) -> Model:
    """A model of a sample of docs (doc_id, text, lang): those with a text and a language that are not held out.

    The sample is bounded by docs_per_lang for each language (drawn by a hash of doc_id, so that is the mean), by
    most_docs in all, but at least one document a language is drawn for, and by PIECES_PER_DOC pieces from all over
    each text. All languages take part; the model takes half a megabyte for each. An empty table, or one without
    languages, gives a model without languages; rows that repeat count as often as they are there.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(True)))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language, as the model has
    if not counts:
        return train([])
    each = max(1, min(docs_per_lang, most_docs // len(counts)))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    most = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))))
    rows = usable.withColumn("share", share / most[F.col("lang")]).where("share < 1").orderBy("share", F.xxhash64("text")).limit(2 * each * len(counts)).select("text", "lang")

    def run(batches):
        for batch in slices(batches):
            found = [(" ".join(p), lang) for t, lang in zip(*(c.to_pylist() for c in batch.columns)) for p in pieces_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["piece", "lang"])

    pieces = sorted((r["lang"], r["piece"]) for r in rows.mapInArrow(run, "piece string, lang string").collect())
    return train_pieces([(p.split(" "), lang) for lang, p in pieces], sorted(counts))


def languages(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1) of their whole texts, on demand with lang_spans: the runs of words of one language (lang, word, words).

    `und` and 0 where the text is null, empty or without letters, or where nothing could be learned. Rows are
    labelled one by one, whatever is null or repeated, however long; columns of docs of these names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            lang, score = label(texts, shared.value)
            new = {"lang_pred": pa.array(lang, pa.string()), "lang_score": pa.array(score, pa.float64())}
            if with_spans:
                found = [[{"lang": a, "word": b, "words": c} for a, b, c in x] for x in spans(texts, shared.value)]
                new["lang_spans"] = pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("word", pa.int64()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*names, *new])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType())
    if with_spans:
        schema = schema.add("lang_spans", "array<struct<lang:string,word:bigint,words:bigint>>")
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least_score: float = 0.4) -> DataFrame:
    """docs without those of no known language: `und`, or a mean posterior below least_score. The columns stay as they are.

    Where nothing could be learned there is no language to tell from others: all documents with letters stay.
    """
    names = docs.columns
    if not model.langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    odd = [n for n in ("lang_pred", "lang_score", "lang_spans") if n in names]
    aside = docs.withColumnsRenamed({n: f"__{n}" for n in odd})
    out = languages(aside, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= least_score)).drop("lang_pred", "lang_score")
    return out.withColumnsRenamed({f"__{n}": n for n in odd}).select(*names)


def op2(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; for null, empty, repeated and long texts see languages()."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    found = languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
