"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set are one node from the start. Nodes get 200 minima, of which one byte each is kept
as the signature; 40 bands of 5 whole minima propose candidates (two sets at similarity 0.8 share no band with
probability 1.3e-7). Candidates are compared by batches of 40 bytes; a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below `miss` (Beta(1, 1) prior, a byte agreeing by chance
once in 256). Survivors are confirmed on their full shingle sets.

Not every surviving pair is confirmed, or leaves its task:
1. In each bucket a node chooses one other: of its likely neighbours the one with the most likely neighbours, else the
   likeliest survivor. Buckets with the same members count once. Nodes that choose the same other form groups of up to
   GROUP, to which each set is sent once; there all surviving pairs are confirmed, likeliest first, but those that
   links already join. What is linked is merged.
2. In buckets that still hold several components, the surviving pairs of different components that met in no group
   are listed, each in the bucket of its smallest key alone. They are confirmed in blocks of nodes, each set sent once
   to a block, likeliest first, until a component is joined.
A bucket of more than BLOCK nodes is compared in blocks: in step 1 each block by itself and with PIVOTS nodes that all
share, in step 2 all pairs of blocks but those between two blocks of the bucket's largest component. So a group of
copies, however large, costs about a comparison with a block a copy, and nothing bounds the pairs that are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WordHashes, bit_filter, components, in_filter, mix, read_table, runs, shingle_hashes, slices, written

PERMS, BAND, BATCH = 200, 5, 40
BANDS = PERMS // BAND
#: Nodes of a bucket that are compared at once, those that all blocks of a larger bucket share, and nodes and bytes of sets that are confirmed at once.
BLOCK, PIVOTS, GROUP, GROUP_BYTES = 1024, 32, 256, 32 << 20


def _perms() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240917)
    return r.integers(1, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def agreement(similarity):
    """The probability that one byte of two signatures agrees."""
    return similarity + (1 - similarity) / 256


def fewest_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(bytes compared, fewest matches with which a candidate stays), by the posterior of the similarity."""
    x = (np.arange(20_000) + 0.5) / 20_000
    same = agreement(x)
    out = []
    for n in range(BATCH, PERMS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(same) + (n - m) * np.log1p(-same)
            p = np.exp(log - log.max())
            if p[x >= threshold].sum() / p.sum() >= miss:
                out.append((n, m))
                break
    return out


def survivors(sig: np.ndarray, allowed: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, matches) of the pairs i < j of rows of sig that are allowed (a square matrix, which is used up) and stay after all batches."""
    n, done = len(sig), 0
    allowed &= np.tri(n, n, -1, dtype=bool).T
    if n > 64:
        (done, need), least = least[0], least[1:]
        got = np.zeros((n, n), np.uint8)
        for c in np.ascontiguousarray(sig[:, :done].T):
            got += c[:, None] == c
        allowed &= got >= need
        i, j = np.nonzero(allowed)
        m = got[i, j].astype(np.int16)
    else:
        i, j = np.nonzero(allowed)
        m = np.zeros(len(i), np.int16)
    for to, need in least:
        for k in range(0, len(i), 1 << 15):
            part = slice(k, k + (1 << 15))
            m[part] += np.count_nonzero(sig[i[part], done:to] == sig[j[part], done:to], axis=1).astype(np.int16)
        keep = m >= need
        i, j, m, done = i[keep], j[keep], m[keep], to
    return i, j, m


def shingle_set(text: str | None, words: WordHashes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of a shorter text, one of all its words; none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = words.of(w)
    return np.unique(shingle_hashes(h, k if len(w) >= k else len(w)))


def _node(s: np.ndarray) -> int:
    """A 64-bit digest of a shingle set."""
    with np.errstate(over="ignore"):
        x = mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))
        y = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        return int(mix(np.array([x * np.uint64(0x9E3779B97F4A7C15) + y], np.uint64)).view(np.int64)[0])


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 256):
        h = ((s[None, i:i + 256] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, h.min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """The 64-bit key of each band of minima (rows x PERMS)."""
    x = np.zeros((len(low), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        x = mix(x + low[:, i::BAND].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x).view(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, copy): copy is a hash of the text, and tells rows apart that share a doc_id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("copy"))


def shingled(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, n_shingles, sig, keys, copy) of every document; node is null where it has no words, sig and keys also where a task gave them before."""
    names = ["doc_id", "node", "n_shingles", "sig", "keys", "copy"]

    def run(batches):
        words, (a, b), seen = WordHashes(), _perms(), set()
        for batch in slices(batches):
            node, n, sig, at, lows = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, words, k)
                n.append(len(s))
                node.append(x := _node(s) if len(s) else None)
                sig.append(None)
                if x is not None and x not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(x)
                    at.append(len(sig) - 1)
                    lows.append(minima(s, a, b))
            keys: list[bytes | None] = [None] * len(sig)
            if lows:
                for i, low, key in zip(at, lows, band_keys(np.stack(lows))):
                    sig[i], keys[i] = low.astype(np.uint8).tobytes(), key.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.binary()), batch.column(2)], names=names)

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, node long, n_shingles long, sig binary, keys binary, copy long")


def _bands(table: DataFrame, bits=None) -> DataFrame:
    """(key, node): each node in its buckets, a key for each band; with bits, only the keys that pass the filter."""

    def run(batches):
        for batch in slices(batches, 4096):
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            node = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), BANDS)
            if bits is not None:
                ok = in_filter(bits.value, key.view(np.uint64))
                key, node = key[ok], node[ok]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    return table.where("keys is not null").select("keys", "node").mapInArrow(run, "key long, node long")


def _buckets(table: DataFrame) -> DataFrame:
    """(key, node, n) of the buckets with n > 1 nodes; of buckets with the same members, that of the smallest key.

    Keys are counted with map-side combining, so a bucket may hold any share of the nodes.
    """
    spark = table.sparkSession
    shared = written(_bands(table).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    bits = spark.sparkContext.broadcast(bit_filter(shared, "key"))
    rows = written(_bands(table, bits).join(shared, "key", "left_semi").dropDuplicates(["key", "node"]))
    per = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    kept = per.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key", "n")
    return written(rows.join(kept, "key").select("key", "node", "n"))


def _signatures(table: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, n_shingles, sig, tags) of the nodes of buckets; tags: the upper half of each band's key."""
    wanted = buckets.select("node").distinct()
    bits = table.sparkSession.sparkContext.broadcast(bit_filter(wanted, "node"))

    def run(batches):
        for batch in slices(batches, 4096):
            batch = batch.filter(pa.array(in_filter(bits.value, batch.column(0).to_numpy().view(np.uint64))))
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").reshape(-1, BANDS, 2)[:, :, 1]
            tags = [x.tobytes() for x in np.ascontiguousarray(keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(tags, pa.binary())], names=["node", "n_shingles", "sig", "tags"])

    rows = table.where("keys is not null").select("node", "n_shingles", "sig", "keys").mapInArrow(run, "node long, n_shingles long, sig binary, tags binary")
    return written(rows.join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _of_like_size(n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)


def _chosen(buckets: DataFrame, state: DataFrame, least, percent: int) -> DataFrame:
    """(key, n, node, to, score) of each node that has a surviving neighbour in its block of a bucket: whom it chooses, itself perhaps."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
    pivot = (F.col("n") > BLOCK) & (F.pmod(F.xxhash64("key", "node", F.lit(7)), F.col("n")) < PIVOTS)
    rows = buckets.select("key", F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("block"), "n", "node")
    rows = rows.join(state.select("node", "n_shingles", "sig"), "node").select("key", "block", "n", "node", "n_shingles", "sig")
    likely = int(np.ceil(PERMS * agreement(percent / 100)))

    def run(batches):
        out: list[np.ndarray] = []
        for (key, _), rows in runs(batches, 2):
            n, node = rows.column(2)[0].as_py(), rows.column(3).to_numpy()
            i, j, m = survivors(_matrix(rows.column(5), np.uint8, PERMS), _of_like_size(rows.column(4).to_numpy(), percent), least)
            if not len(i):
                continue
            sure = m >= likely
            degree = np.bincount(np.concatenate([i[sure], j[sure]]), minlength=len(node))
            me, to, m = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([m, m]).astype(np.int64)
            score = np.where(m >= likely, (1 << 32) + degree[to], m)
            hubs = np.flatnonzero(degree)
            me, to, score = np.concatenate([me, hubs]), np.concatenate([to, hubs]), np.concatenate([score, (1 << 32) + degree[hubs]])
            order = np.lexsort((node[to], score, me))
            last = order[np.r_[me[order][1:] != me[order][:-1], True]]
            out.append(np.stack([np.full(len(last), key), np.full(len(last), n), node[me[last]], node[to[last]], score[last]]))
            if len(out) >= 1000:
                yield _batch(out, ["key", "n", "node", "to", "score"])
                out = []
        yield _batch(out, ["key", "n", "node", "to", "score"])

    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return written(rows.mapInArrow(run, "key long, n long, node long, to long, score long"))


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    whole = np.concatenate(columns, axis=1) if columns else np.empty((len(names), 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in whole.astype(np.int64)], names=names)


def _parts(count, shingles):
    """Into how many groups so many nodes with so many shingles go."""
    return F.greatest(F.lit(1), F.ceil(count / GROUP), F.ceil(shingles * 8 / GROUP_BYTES)).cast("int")


def _sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, raw): the shingle sets of the wanted nodes, made again from one document of each, and now and then of others."""
    sources = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("h")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(sources, "h"))

    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            passed = in_filter(bits.value, batch.column(1).to_numpy().view(np.uint64))
            sets = [shingle_set(t, words, k) for t in batch.column(0).filter(pa.array(passed)).to_pylist()]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "raw"])

    return _source(docs, id_col, text_col).select("text", F.xxhash64("doc_id", "copy").alias("h")).mapInArrow(run, "node long, raw binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links_in_groups(placed: DataFrame, state: DataFrame, sets: DataFrame, least, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) that join what is linked within each group: a hub and a part of the nodes that chose it."""
    rows = placed.select("hub", "chunk", "node").union(placed.select("hub", "chunk", F.col("hub").alias("node")).distinct()).distinct()
    rows = rows.join(state.select("node", "sig"), "node").join(sets, "node").select("hub", "chunk", "node", "sig", "raw")

    def run(batches):
        for _, rows in runs(batches, 2):
            node, first = np.unique(rows.column(2).to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            raw = rows.column(4)
            sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in first.tolist()]
            sig = _matrix(rows.column(3), np.uint8, PERMS)[first]
            i, j, m = survivors(sig, _of_like_size(np.array(list(map(len, sets))), percent), least)
            top, left, a, b = list(range(len(node))), len(node), [], []
            for k in np.argsort(-m, kind="stable").tolist():
                x, y = _top(top, int(i[k])), _top(top, int(j[k]))
                if x != y and linked(sets[i[k]], sets[j[k]], percent):
                    top[y] = x
                    left -= 1
                    a.append(node[i[k]])
                    b.append(node[j[k]])
                    if left == 1:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk").mapInArrow(run, "a long, b long"))


def _top(top: list[int], x: int) -> int:
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def _apart(buckets: DataFrame, chosen: DataFrame, placed: DataFrame, state: DataFrame, least, percent: int) -> DataFrame:
    """(a, b, m, la, lb, na, nb): surviving pairs of different components that met in no group; placed has the labels of components."""
    # In a bucket that is one block, nodes without a surviving neighbour need no second look.
    small = chosen.where(F.col("n") <= BLOCK).select("key", "node").join(placed, "node")
    mixed = small.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    zero = F.lit(0)
    small = small.join(mixed, "key").select("key", zero.alias("t"), zero.alias("i"), zero.alias("j"), zero.alias("own"), "node", "label", "hub", "chunk")
    large = buckets.where(F.col("n") > BLOCK).join(placed, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("hub", "node").alias("hub"), F.coalesce("chunk", F.lit(-1)).alias("chunk"))
    most = large.groupBy("key", "label").agg(F.count("*").alias("c"), F.first("n").alias("n")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.first("n").alias("n"))
    most = most.select("key", F.col("most.label").alias("main"), F.ceil(F.col("most.c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most.c")) / BLOCK).cast("int").alias("others")).where("others > 0")
    large = large.join(most, "key").withColumn("is_main", F.col("label") == F.col("main"))
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda t, i, j: F.struct(F.lit(t).alias("t"), i.alias("i"), j.alias("j"))
    own = F.col("own")
    places = F.when(F.col("is_main"), F.transform(each("others"), lambda x: place(1, x, own))).otherwise(
        F.concat(F.transform(each("others"), lambda x: place(0, F.least(x, own), F.greatest(x, own))), F.transform(each("mains"), lambda x: place(1, own, x)))
    )
    # Within blocks of type 1, `own` tells the main component's nodes from the others.
    large = large.select("key", F.explode(places).alias("p"), "own", "is_main", "node", "label", "hub", "chunk")
    large = large.select("key", "p.*", F.when(F.col("p.t") == 1, F.col("is_main").cast("int")).otherwise(F.col("own")).alias("own"), "node", "label", "hub", "chunk")
    rows = small.unionByName(large).join(state, "node").select("key", "t", "i", "j", "own", "node", "label", "hub", "chunk", "n_shingles", "sig", "tags")
    names = ["a", "b", "m", "la", "lb", "na", "nb"]

    def run(batches):
        out: list[np.ndarray] = []
        for (key, t, bi, bj), rows in runs(batches, 4):
            own, node, label, hub, chunk, n = (rows.column(c).to_numpy() for c in range(4, 10))
            allowed = _of_like_size(n, percent) & (label[:, None] != label) & ~((hub[:, None] == hub) & (chunk[:, None] == chunk)) & (hub[:, None] != node) & (node[:, None] != hub)
            if t or bi != bj:
                allowed &= own[:, None] != own
            if not allowed.any():
                continue
            i, j, m = survivors(_matrix(rows.column(10), np.uint8, PERMS), allowed, least)
            tags = _matrix(rows.column(11), "<i4", BANDS)
            for k in range(0, len(i), 1 << 15):
                x, y, mm = i[k:k + (1 << 15)], j[k:k + (1 << 15)], m[k:k + (1 << 15)]
                # Of all buckets that the pair shares, that of the smallest key has it.
                here = np.where(tags[x] == tags[y], tags[x], np.iinfo(np.int32).max).min(1) == key >> 32
                x, y, mm = x[here], y[here], mm[here]
                if len(x):
                    out.append(np.stack([node[x], node[y], mm.astype(np.int64), label[x], label[y], n[x], n[y]]))
            if sum(c.shape[1] for c in out) >= 50_000:
                yield _batch(out, names)
                out = []
        yield _batch(out, names)

    rows = rows.repartition("key", "t", "i", "j").sortWithinPartitions("key", "t", "i", "j")
    return written(rows.mapInArrow(run, ", ".join(f"{n} long" for n in names)))


def _links_apart(pairs: DataFrame, placed: DataFrame, state: DataFrame, sets_of, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) of pairs that join different components; each set goes once to a block of pairs."""
    sizes = placed.join(state.select("node", "n_shingles"), "node").groupBy("label").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    size = lambda x: sizes.select(F.col("label").alias("l" + x), F.col("c").alias("c" + x), F.col("s").alias("s" + x))
    one = lambda c: F.coalesce(c, F.lit(1))
    rows = pairs.join(size("a"), "la", "left").join(size("b"), "lb", "left")
    swap = F.struct(one("ca"), F.col("la")) > F.struct(one("cb"), F.col("lb"))
    either = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    # y is of the larger component.
    rows = written(rows.select(
        either("la", "lb").alias("big"), either("lb", "la").alias("lx"), either("b", "a").alias("x"), either("a", "b").alias("y"), either("nb", "na").alias("nx"), "m",
        _parts(one(either("ca", "cb")), F.coalesce(either("sa", "sb"), either("na", "nb"))).alias("parts_y"),
    ).distinct())
    per = rows.select("big", "x", "nx").distinct().groupBy("big").agg(_parts(F.count("*"), F.sum("nx")).alias("parts_x"))
    rows = rows.join(per, "big").select("big", F.pmod(F.xxhash64("x"), "parts_x").cast("int").alias("cx"), F.pmod(F.xxhash64("y"), "parts_y").cast("int").alias("cy"), "x", "y", "lx", "m")
    rows = written(rows)
    place = ["big", "cx", "cy"]
    members = rows.select(*place, F.col("x").alias("node")).union(rows.select(*place, F.col("y").alias("node"))).distinct()
    none = F.lit(None)
    both = members.join(sets_of(members), "node").select(*place, F.lit(0).alias("kind"), "node", F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("lx"), F.lit(0).cast("long").alias("m"), "raw")
    both = both.union(rows.select(*place, F.lit(1).alias("kind"), "x", "y", "lx", "m", none.cast("binary").alias("raw")))

    def run(batches):
        for _, rows in runs(batches, 3):
            kind, x, y, lx, m = (rows.column(c).to_numpy() for c in range(3, 8))
            raw = rows.column(8)
            sets = {int(x[i]): np.frombuffer(raw[i].as_buffer(), np.uint64) for i in np.flatnonzero(kind == 0).tolist()}
            at, joined, a, b = np.flatnonzero(kind == 1), set(), [], []
            for k in at[np.argsort(-m[at], kind="stable")].tolist():
                if int(lx[k]) not in joined and linked(sets[int(x[k])], sets[int(y[k])], percent):
                    joined.add(int(lx[k]))
                    a.append(x[k])
                    b.append(y[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(both.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long"))


def _nodes_linked(docs: DataFrame, table: DataFrame, nodes: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """(node, label) of the nodes that are linked with others: the smallest node reachable."""
    least = fewest_matches(percent / 100, miss)
    sets_of = lambda wanted: _sets(docs, wanted, nodes, k, id_col, text_col)
    buckets = _buckets(table)
    state = _signatures(table, buckets)
    chosen = _chosen(buckets, state, least, percent)
    to = written(chosen.groupBy("node").agg(F.max(F.struct("score", "to")).alias("x")).select("node", F.col("x.to").alias("hub")))
    per = to.join(state.select("node", "n_shingles"), "node").groupBy("hub").agg(_parts(F.count("*"), F.sum("n_shingles")).alias("parts"))
    placed = written(to.join(per, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("chunk")))
    links = _links_in_groups(placed, state, sets_of(placed), least, percent)
    labels = components(links)
    placed = written(placed.join(labels, "node", "left").select("node", "hub", "chunk", F.coalesce("label", "node").alias("label")))
    apart = _apart(buckets, chosen, placed, state, least, percent)
    if apart.isEmpty():
        return labels
    return components(links.union(_links_apart(apart, placed, state, sets_of, percent)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", with_group: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and on demand copy (xxhash64 of the text) and label (long, the same for a whole component).

    Words are runs without ASCII white space, A-Z lower-cased. A document's set: its distinct k-word shingles;
    with fewer words, the whole sequence. Two documents are linked if 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable, and the document that bears it is kept.
    A null or empty text has no set, a null label, and is linked with nothing. Rows with a null doc_id are linked as
    others; where a component has no other doc_id, component_id is null and its rows are kept. Rows that repeat a
    doc_id are each returned. Texts may have any length: sets are confirmed in groups bounded in bytes, so that one
    text's set and signature must fit a task. Other columns of docs are ignored; an empty table gives an empty result.
    """
    table = written(shingled(docs, k, id_col, text_col))
    usable = table.where("node is not null")
    nodes = written(usable.groupBy("node").agg(F.min("doc_id").alias("least_doc"), F.min(F.struct("doc_id", "copy")).alias("r")).select("node", "least_doc", F.xxhash64("r.doc_id", "r.copy").alias("h")))
    labels = _nodes_linked(docs, table, nodes, k, percent, miss, id_col, text_col)
    # Only the labels of linked nodes need grouping.
    groups = labels.join(nodes.select("node", "least_doc"), "node").groupBy("label").agg(F.min("least_doc").alias("component_id"))
    named = nodes.select("node", "least_doc").join(labels.join(groups, "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.when(F.col("label").isNull(), F.col("least_doc")).otherwise(F.col("component_id")).alias("component_id"))
    out = usable.select("doc_id", "n_shingles", "copy", "node").join(named, "node").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "copy", "label")
    bare = table.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "copy", F.lit(None).cast("long").alias("label"))
    out = out.unionByName(bare)
    return out if with_group else out.drop("copy", "label")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null the largest), and of the smallest hash of the text where rows share it.

    Documents without words all stay. The columns stay as they are.
    """
    names = docs.columns
    found = written(near_duplicates(docs, k, percent, miss, id_col, text_col, with_group=True).where("label is not null").select("label", "doc_id", "copy"))
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    best = found.groupBy("label").agg(F.count("*").alias("n"), F.min(me).alias("best")).where("n > 1").select("label", "best")
    rows = found.join(best, "label").groupBy("doc_id", "copy").agg(F.count("*").alias("n"), F.max((~me.eqNullSafe(F.col("best"))).cast("int")).alias("lost"))
    rows = written(rows.where("lost = 1 or n > 1").select(F.col("doc_id").alias("__doc"), F.col("copy").alias("__copy"), F.col("lost").alias("__lost"), F.xxhash64("doc_id", "copy").alias("__hash")))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(rows, "__hash"))
    marked = docs.withColumns({"__doc": docs[id_col].cast("long"), "__copy": F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))})
    marked = marked.withColumn("__hash", F.xxhash64("__doc", "__copy"))

    def passed(want: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_filter(bits.value, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)) == want))

        return run

    # Most rows meet nothing in the filter and need no shuffle; the others are looked up by a join at every size.
    clean = marked.mapInArrow(passed(False), marked.schema).select(*names)
    same = F.col("m.__doc").eqNullSafe(F.col("r.__doc")) & (F.col("m.__copy") == F.col("r.__copy"))
    met = marked.mapInArrow(passed(True), marked.schema).alias("m").join(rows.hint("merge").alias("r"), same, "left")
    met = met.select("m.*", F.col("r.__lost").alias("__lost")).where("__lost is null or __lost = 0")
    once = met.where("__lost = 0").dropDuplicates(["__doc", "__copy"])
    return clean.unionByName(met.where("__lost is null").select(*names)).unionByName(once.select(*names))


def op9(spark, sf_dir: str) -> DataFrame:
    """Links of 0.8 on two-word shingles over all documents; for null, empty, repeated and odd rows see near_duplicates()."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=2, percent=80)


#: All pairs that share a shingle, which the tables of the SQL check still allow.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) g from w),
n as materialized (select doc_id, count(*) n from s group by 1),
t as (select s.doc_id, g, n from s join n using (doc_id)),
link as materialized (select a.doc_id a, b.doc_id b from t a join t b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge as materialized (select a, b from link union all select b, a from link),
reach as (select doc_id a, doc_id b from documents union select r.a, e.b from reach r join edge e on r.b = e.a),
c as (select a doc_id, min(b) component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, d.doc_id = component_id kept from documents d join c using (doc_id) left join n using (doc_id)
"""
