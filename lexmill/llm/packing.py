"""Best-fit packing by a grouping genetic algorithm.

A document's token ids and an end id are cut into pieces of at most `capacity`; only the first piece of a
document may be shorter. Pieces go by number to shards of about 4,096. A shard's lengths are packed on several
islands: a population starts from best-fit decreasing and randomised best fits; a crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold duplicates, and best-fits the
displaced pieces; a mutation empties some of the least filled bins. Between rounds each island's elite moves
on to the next island. An island stops where its best reaches the lower bound, sum of lengths / capacity.
The least filled bins of the shards are then pooled, 64 shards to a group, and packed again, until one group
is left, so the rounding up of shards adds no more than a sequence in all.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.llm.common import read_table, slices, tokenizer_path, written
from lexmill.llm.encoding import encoder

SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4096, 2, 2, 6, 4
#: Pieces of a shard's least filled bins that are packed again with those of 63 other shards.
POOLED, POOL = 128, 64

Bins = list[list[int]]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start (its document's ids before it), length, ids_crc32, and ids (array) on demand.

    A null or empty text has the end id alone. Rows that repeat are cut each by itself.
    """
    extra = ", ids array<int>" if with_ids else ""

    def run(batches):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                n = len(raw) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    stop = n - capacity * ((n - at - 1) // capacity)
                    part = raw[4 * at:4 * stop]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    at = stop
            cols = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + extra)


def best_fit(lengths: list[int], items: list[int], bins: Bins, capacity: int) -> Bins:
    """bins with items put, in their order, each where it leaves the least room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, members in enumerate(bins):
        free = capacity - sum(lengths[i] for i in members)
        room[free].append(b)
        mask |= 1 << free
    for i in items:
        n = lengths[i]
        fits = mask >> n
        if fits:
            free = (fits & -fits).bit_length() - 1 + n
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            b, free = len(bins), capacity
            bins.append([i])
        free -= n
        room[free].append(b)
        mask |= 1 << free
    return bins


def fitness(lengths: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(lengths: list[int], a: Bins, b: Bins, capacity: int, rng: random.Random) -> Bins:
    """Some of b's well-filled bins injected whole into a; a's bins that share a piece with them are dissolved, the rest best-fitted."""
    filled = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    chosen = [x for x in filled[: max(1, len(filled) * 3 // 4)] if rng.random() < 0.4] or filled[:1]
    taken = {i for x in chosen for i in x}
    kept, loose = [list(x) for x in chosen], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    return best_fit(lengths, sorted(loose, key=lambda i: -lengths[i]), kept, capacity)


def mutate(lengths: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """The least filled bins, and some at random, emptied and best-fitted anew in a perturbed order."""
    order = sorted(range(len(bins)), key=lambda b: sum(lengths[i] for i in bins[b]))
    out = set(order[: max(2, len(order) // 50)]) | set(rng.sample(range(len(bins)), min(len(bins), 4)))
    loose = [i for b in out for i in bins[b]]
    loose.sort(key=lambda i: -lengths[i] * rng.uniform(0.8, 1.2))
    return best_fit(lengths, loose, [list(x) for b, x in enumerate(bins) if b not in out], capacity)


def evolve(lengths: list[int], population: list[Bins], capacity: int, seed: int) -> list[Bins]:
    """The population after GENERATIONS; the best comes first."""
    rng, least = random.Random(seed), -(-sum(lengths) // capacity)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    if not population:
        population = [best_fit(lengths, down, [], capacity)]
    while len(population[0]) > least and len(population) < POPULATION:
        order = sorted(down, key=lambda i: -lengths[i] * rng.uniform(0.7, 1.3))
        population.append(best_fit(lengths, order, [], capacity))
    score: Callable[[Bins], tuple[int, float]] = lambda x: fitness(lengths, x, capacity)
    population.sort(key=score, reverse=True)
    for _ in range(GENERATIONS):
        if len(population[0]) <= least:
            break
        children = [crossover(lengths, *rng.sample(population, 2), capacity, rng) for _ in range(POPULATION // 2)]
        children.append(mutate(lengths, population[0], capacity, rng))
        population = sorted(population + children, key=score, reverse=True)[:POPULATION]
    return population


def _flat(bins: Bins, n: int) -> bytes:
    out = np.empty(n, np.int32)
    for b, members in enumerate(bins):
        out[members] = b
    return out.tobytes()


def _bins(flat: bytes) -> Bins:
    of = np.frombuffer(flat, np.int32)
    out: Bins = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, b in enumerate(of.tolist()):
        out[b].append(i)
    return out


def _solved(rows: DataFrame, capacity: int) -> DataFrame:
    """(shard, best): of each shard of rows (shard, length), its bins by the place of a piece in the order of lengths."""
    state = "shard long, island int, lengths array<int>, population array<binary>, n int"
    problems = rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.col("length").cast("int"))).alias("lengths"))
    islands = problems.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.expr("cast(array() as array<binary>)").alias("population"), F.lit(0).alias("n"))

    def round_of(r: int):
        def run(batches):
            for batch in slices(batches, 8):
                out, n = [], []
                for shard, island, lengths, population in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    found = evolve(lengths, [_bins(p) for p in population], capacity, seed=(shard * ISLANDS + island) * ROUNDS + r)
                    out.append([_flat(b, len(lengths)) for b in found])
                    n.append(len(found[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.binary())), pa.array(n, pa.int32())], names=["shard", "island", "lengths", "population", "n"])

        return run

    for r in range(ROUNDS):
        islands = written(islands.repartition("shard", "island").mapInArrow(round_of(r), state))
        if r + 1 < ROUNDS:
            elite = islands.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("population", 1, 1).alias("elite"))
            islands = islands.join(elite, ["shard", "island"]).select("shard", "island", "lengths", F.concat("elite", F.slice("population", 1, POPULATION - 1)).alias("population"), "n")
    return islands.groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct("n", "island")).alias("best"))


def _place(level: int, last: bool, capacity: int):
    """The function that gives a shard's rows their sequences; at all levels but the last, -1 for those to be pooled."""

    def place(key, rows: pa.Table, sol: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("length", "ascending"), ("id", "ascending")]))
        of = np.frombuffer(sol.column("best")[0].as_py(), np.int32).astype(np.int64)
        length = rows.column("length").to_numpy()
        by = np.argsort(of, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        begins = np.r_[True, of[by][1:] != of[by][:-1]]
        offset = np.empty(len(of), np.int64)
        offset[by] = before - np.maximum.accumulate(np.where(begins, before, 0))
        seq = (np.int64(level) << np.int64(58)) | (np.int64(key[0].as_py()) << np.int64(20)) | of
        if not last:  # the least filled bins go on to the next level
            fill, count = np.bincount(of, length), np.bincount(of)
            least = np.argsort(fill, kind="stable")
            again = least[(np.cumsum(count[least]) - count[least] < POOLED) & (fill[least] < capacity)]
            seq = np.where(np.isin(of, again), -1, seq)
        return rows.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return place


def pack(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """rows, which have a length from 1 to capacity, with sequence_id and offset (gapless from 0).

    Other columns stay as they are, whatever their names; columns of rows named sequence_id or offset are replaced.
    Each row is put once, repeated ones too: shards are drawn by a number that every row gets as it is written, so
    they are alike in size even where all rows are the same. An empty table gives an empty result.
    """
    rows = rows.drop("sequence_id", "offset")
    rows = written(rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("id")))
    n = rows.where(F.col("length") < capacity).count()
    shards = max(1, -(-n // SHARD))
    # A piece that fills a sequence is one by itself.
    full = rows.where(F.col("length") >= capacity).select("row", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = rows.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long"))
    done, level = [full], 0
    while True:
        level += 1
        best, last = _solved(todo, capacity), shards == 1
        schema = StructType([*todo.schema.fields]).add("sequence_id", "long").add("offset", "long")
        placed = written(todo.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_place(level, last, capacity), schema))
        done.append(placed.where("sequence_id >= 0").select("row", "sequence_id", "offset"))
        if last:
            break
        shards = -(-shards // POOL)
        todo = placed.where("sequence_id < 0").drop("sequence_id", "offset").withColumn("shard", F.floor(F.col("shard") / POOL).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and on demand its ids (array).

    Null and empty texts have the end id alone; null and repeated doc_ids are packed as any other row; other
    columns of docs are ignored; of pieces of one length, any may take the place of any other. Texts may have any length.
    """
    return pack(pieces(docs, path, capacity, end_id, with_ids), capacity)


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens; for null, empty, repeated and long texts see pack_documents()."""
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
