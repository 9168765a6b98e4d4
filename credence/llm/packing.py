"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents are cut into pieces of the sequence length (only the last may be shorter); full pieces are sequences of their
own. The rest is dealt into shards of about ``SHARD_PIECES`` pieces, each evolved on several islands, every island a task
of its own:

* a chromosome is a list of bins (a bin is a list of piece lengths: pieces of one length are interchangeable); the first
  ones are pieces best-fitted in random order;
* crossover injects whole well-filled bins of one parent into another, removes the bins that now hold pieces twice, and
  best-fits the displaced pieces;
* after each epoch an island sends its elite to the next one.

An island whose best chromosome reaches ceil(tokens / capacity) bins, which no packing can beat, stops early. What the
shards leave in badly filled bins is dealt again to fewer shards and packed once more, until one shard is left, so the
waste does not grow with the number of shards.

Edge cases: null and empty texts are one piece holding the end id; an empty table gives no rows; rows that repeat a
doc_id are packed as documents of their own; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, short_batches, staged

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 4_096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 3, 6, 6
MOST_TASKS = 10_000  # of an epoch; beyond it, tasks hold several islands
GOOD = 0.998  # filling from which a bin is not packed again

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, with the checksum of their ids."""
    short_batches(docs.sparkSession)

    def cut(batches):
        from .vocab import word_tokenizer

        tok = word_tokenizer(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            texts = [x or "" for x in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), tok.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(doc, k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


# --- one shard: a chromosome is a list of bins, a bin a list of lengths -------------------------------------------------


def best_fit(lengths, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Add ``lengths`` in their order to the bins where they leave least room, opening bins where none has room."""
    room = sorted((capacity - sum(b), i) for i, b in enumerate(bins))
    bins = [list(b) for b in bins]
    for x in lengths:
        k = bisect.bisect_left(room, (x, -1))
        if k == len(room):
            bins.append([x])
            bisect.insort(room, (capacity - x, len(bins) - 1))
        else:
            left, i = room.pop(k)
            bins[i].append(x)
            if left > x:
                bisect.insort(room, (left - x, i))
    return bins


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more unequal filling, which leaves room in one place."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], lengths: np.ndarray, capacity: int, rng: random.Random) -> list[list[int]]:
    """Well-filled bins of ``a`` are injected whole; of ``b`` those bins follow, the fullest first, that hold no piece twice;
    the pieces of the others are displaced and best-fitted, long ones first."""
    filled = sorted(a, key=sum, reverse=True)
    top = filled[: max(1, len(filled) * 2 // 3)]
    inject = [x for x in top if rng.random() < 0.7] or top[:1]
    left = np.bincount(lengths, minlength=capacity + 1).tolist()
    for x in inject:
        for v in x:
            left[v] -= 1
    kept = list(inject)
    for x in sorted(b, key=sum, reverse=True):
        for k, v in enumerate(x):
            left[v] -= 1
            if left[v] < 0:  # the bin holds a piece twice: it goes, and its pieces are displaced
                for w in x[: k + 1]:
                    left[w] += 1
                break
        else:
            kept.append(x)
    return best_fit(_down(left), kept, capacity)


def _down(left: list[int]) -> list[int]:
    return [v for v in range(len(left) - 1, 0, -1) if left[v] for _ in range(left[v])]


def mutate(bins: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empty the worst filled bin and a few others, and best-fit their pieces, long ones first or in any order."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    gone = {order[0], *rng.sample(range(len(bins)), min(len(bins), 1 + len(bins) // 20))}
    displaced = sorted((v for i in gone for v in bins[i]), reverse=True)
    if rng.random() < 0.5:
        rng.shuffle(displaced)
    return best_fit(displaced, [x for i, x in enumerate(bins) if i not in gone], capacity)


def start_population(lengths: np.ndarray, capacity: int, size: int, rng: random.Random) -> list[list[list[int]]]:
    """Chromosomes of pieces that were best-fitted in random order."""
    out = []
    for _ in range(size):
        order = lengths.tolist()
        rng.shuffle(order)
        out.append(best_fit(order, [], capacity))
    return out


def evolve(population: list, lengths: np.ndarray, capacity: int, generations: int, rng: random.Random) -> list:
    """Each generation: as many children as the population has, of random parents, of which the better half is likelier;
    some are mutated; the best of old and new live on."""
    bound = -(-int(lengths.sum()) // capacity)
    size = len(population)
    rank = lambda c: fitness(c, capacity)
    population = sorted(population, key=rank, reverse=True)
    for _ in range(generations):
        if len(population[0]) <= bound or size < 2:
            break
        children = []
        for _ in range(size):
            i, j = min(rng.randrange(size), rng.randrange(size)), rng.randrange(size - 1)
            child = crossover(population[i], population[j + (j >= i)], lengths, capacity, rng)
            if len(child) > bound and rng.random() < 0.5:
                child = min(child, mutate(child, capacity, rng), key=len)
            children.append(child)
            if len(child) <= bound:
                break
        best: dict[tuple, list] = {}
        for c in population + children:
            best.setdefault(rank(c), c)  # no two of the same worth
        ranked = [best[f] for f in sorted(best, reverse=True)]
        population = (ranked + population)[:size]
    return population


def to_genes(bins: list[list[int]]) -> bytes:
    return np.array([v for b in bins for v in (*b, 0)], "<i4").tobytes()


def from_genes(genes: bytes) -> list[list[int]]:
    v = np.frombuffer(genes, "<i4")
    ends = np.flatnonzero(v == 0)
    return [x.tolist() for x in np.split(v, ends + 1)[:-1] for x in [x[:-1]]]


def _islands(items: DataFrame, shards: int, capacity: int, seed: int) -> DataFrame:
    """(shard, genes): the best chromosome of each shard. items: shard int, length long. The rows are few and short but the
    work on them is not, so they are dealt to a task for each island rather than by their bytes."""
    counts = items.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    per_shard = counts.groupBy("shard").agg(F.collect_list(F.struct("length", "n")).alias("hist"))  # at most ``capacity`` entries
    state = per_shard.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.to_json("hist").alias("hist"), F.lit(None).cast("binary").alias("genes"))
    schema = "shard int, island int, hist string, genes binary"

    def epoch(key, pdf: pd.DataFrame, number: int) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        hist = json.loads(pdf["hist"].iloc[0])
        lengths = np.sort(np.repeat(np.array([x["length"] for x in hist], np.int64), [x["n"] for x in hist]))
        rng = random.Random((seed * 1_000_003 + shard) * 64 + island * 8 + number)
        given = [from_genes(g) for g in pdf["genes"] if g is not None]
        given.sort(key=lambda c: (fitness(c, capacity), to_genes(c)), reverse=True)
        population = given[:POPULATION] or start_population(lengths, capacity, POPULATION, rng)
        population = evolve(population, lengths, capacity, GENERATIONS, rng)
        rows = [(shard, island, pdf["hist"].iloc[0], to_genes(c)) for c in population]
        if number + 1 < EPOCHS and ISLANDS > 1:
            rows.append((shard, (island + 1) % ISLANDS, pdf["hist"].iloc[0], to_genes(population[0])))  # the elite migrates
        return pd.DataFrame(rows, columns=["shard", "island", "hist", "genes"])

    def numbered(number: int):
        return lambda key, pdf: epoch(key, pdf, number)

    for number in range(EPOCHS):
        state = state.repartition(min(shards * ISLANDS, MOST_TASKS), "shard", "island").groupBy("shard", "island").applyInPandas(numbered(number), schema)
    bins = F.expr("length(genes)")  # fewer bins mean fewer separators: the pieces are the same
    return state.groupBy("shard").agg(F.min_by("genes", F.struct(bins, "island", "genes")).alias("genes"))


ASSIGNED = PIECES + ", row long, shard int, bin int, offset long, fill long"


def _assign(items: DataFrame, best: DataFrame) -> DataFrame:
    """Deal the pieces of a shard to the bins of its best chromosome."""

    def deal(key, rows: pd.DataFrame, genes: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*rows.columns, "bin", "offset", "fill"])
        bins = from_genes(genes["genes"].iloc[0])
        size = np.array([len(b) for b in bins])
        flat = np.array([v for b in bins for v in b], np.int64)
        of = np.repeat(np.arange(len(bins)), size)
        total = np.cumsum(flat)
        first = np.repeat(np.cumsum(size) - size, size)
        offset = total - flat - (total - flat)[first]
        fill = np.bincount(of, flat, len(bins)).astype(np.int64)
        by_length = np.argsort(flat, kind="stable")
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        return rows.assign(bin=of[by_length], offset=offset[by_length], fill=fill[of[by_length]])

    return items.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(deal, ASSIGNED)


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, seed: int = 7) -> DataFrame:
    """items: the columns of PIECES; result: those, sequence_id and offset. ``items`` is read several times: stage it.

    Shards are dealt by a number of each row, so copies of one row spread over all of them."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = items.where(F.col("length") >= capacity).select(*cols, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = staged(items.where(F.col("length") < capacity).select(*cols, F.monotonically_increasing_id().alias("row")), "pieces")
    n, level, out = rest.count(), 0, full
    while n:
        shards = -(-n // shard_pieces)
        rest = rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).cast("int"))
        placed = staged(_assign(rest, _islands(rest, shards, capacity, seed + level)), f"packed{level}")
        sequence = -(F.lit(1 + level).cast("long") * (1 << 56) + F.col("shard").cast("long") * (1 << 28) + F.col("bin"))
        good = F.col("fill") >= int(capacity * GOOD)
        before, n = n, 0
        if shards > 1:
            n = placed.where(~good).count()
        last = 2 * n > before or not n  # nothing is left to pack better, or it does not get less
        out = out.unionByName((placed if last else placed.where(good)).select(*cols, sequence.alias("sequence_id"), "offset"))
        rest, level, n = placed.where(~good).select(*cols, "row"), level + 1, 0 if last else n
    return out


def op2_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents as packed pieces."""
    import public_tokenizers

    docs = documents(spark, sf_dir)
    cut = staged(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(cut)
