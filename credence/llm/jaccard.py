"""Self-join of documents on the Jaccard similarity of their word 5-gram sets, by chosen paths.

Paths. Under each of ``FIRST_ROOTS`` hash functions a set goes to the bucket of its least shingle, which two sets share with
probability J. A bucket of more than ``SPLIT_ROWS`` sets is split again, by the least shingles under ``CHILDREN`` other hash
functions, as long as the largest part is at most half of it; a bucket that does not shrink is a group of copies or of
texts that are mostly one passage, and is compared by brute force, block against block. Buckets up to that size are
compared by brute force as they are.

Runs. Every pair of a bucket is first compared by 64 one-byte min-hashes (``CUT`` of them equal: a pair of similarity 0.8
falls below it once in some millions). From the similarities of all pairs found, the chance of each to have been missed
gives an estimate of the missing ones; runs of ``RUN_ROOTS`` further paths are added until the recall so estimated reaches
``TARGET`` or the ``MOST_ROOTS`` functions are used up, at which a pair at 0.8 is lost once in 10 ** 11.

Verification. Only texts with a candidate travel, once for each group of candidates that are connected within a bucket (or
within two blocks of one); there whole shingle sets are intersected and links counted exactly. A pair that meets in several
buckets counts in the first, which each side can tell from its list of buckets, so no pairs leave the tasks: only link
counts and one edge a member to its local group. Blocks hold at most ``BLOCK_ROWS`` sets and about ``BLOCK_SHINGLES``
shingles (or one longer set). In buckets of more than ``PLAIN_BLOCKS`` blocks, sets are also told apart by size: sets of
similarity 0.8 differ in size by a factor of at most 1.25, so only neighbouring bands of sizes meet.

Exact copies (equal shingle sets) are one class from the start, of which one text walks.

Words are runs of letters, marks and numbers in lower case. Texts with one to four words have one shingle, all their
words. Edge cases: texts without words (and null texts) link with nothing and are classes of their own; rows with null
doc_id come back with null class_id and no links; rows that repeat a doc_id are rows of their own, copies if their sets are
equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, runs_of, short_batches, staged
from .components import connected_components
from .langid import lower_table
from .textvec import Scan, mix

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5  # the threshold, 0.8
FIRST_ROOTS, RUN_ROOTS, MOST_ROOTS = 8, 4, 16
TARGET = 0.99999
SKETCH = 64  # one-byte min-hashes
CUT = 35
SPLIT_ROWS = 8_192
CHILDREN = 4
BLOCK_ROWS = 1_024
BLOCK_SHINGLES = 1_000_000
PLAIN_BLOCKS = 3
BAND = 1.26  # ratio of sizes of a band: above DENOMINATOR / NUMERATOR, with room for rounding
MANY = 1 << 20  # blocks of a band
RUN_CHARS = 1_000_000
PAIRS = 400_000  # pairs handled at a time

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = [np.uint64(x) for x in (np.random.default_rng(5).integers(1, 1 << 62, MOST_ROOTS + SKETCH) * 2 + 1)]


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and 64-bit hash of each distinct shingle, in order of texts."""
    s = Scan(texts)
    a, b = s.words()
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = s.hashes(a, b, lower_table()[s.cp])
    bounds = s.of_text(a)
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(texts)), n)
    g, go = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= words:
        m = len(h) - words + 1
        g = np.zeros(m, np.uint64)
        for k in range(words):
            g = mix(g * _STEP + h[k : k + m])
        whole = of[words - 1 :] == of[:m]
        g, go = g[whole], of[:m][whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        extra = []
        for i in short:
            x = np.zeros(1, np.uint64)
            for y in h[bounds[i] : bounds[i + 1]]:
                x = mix(x * _STEP + y + np.uint64(1))
            extra.append(x[0])
        g, go = np.concatenate([g, np.array(extra, np.uint64)]), np.concatenate([go, short])
        order = np.argsort(go, kind="stable")
        g, go = g[order], go[order]
    first = ~pd.Series(mix(g ^ (go.astype(np.uint64) * _STEP))).duplicated().to_numpy()
    return go[first], g[first]


SIGNED = "doc_id long, mark long, key1 long, key2 long, n_sh int, sig array<int>, sketch binary"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), key1, key2 (128 bits of the shingle set), n_sh, sig (a coordinate for each root) and
    sketch (a byte for each further hash function)."""
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = len(texts)
            key1, key2, size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)
            sig, sketch = np.zeros((n, MOST_ROOTS), np.int32), np.zeros((n, SKETCH), np.uint8)
            for i, j in runs_of(texts, RUN_CHARS):
                of, g = shingle_sets(texts[i:j])
                if not len(g):
                    continue
                count = np.bincount(of, minlength=j - i)
                there = np.flatnonzero(count)
                start = np.flatnonzero(np.append(True, np.diff(of) != 0))
                size[i:j] = count
                key1[i + there] = np.add.reduceat(mix(g ^ np.uint64(0xA5A5)), start)
                key2[i + there] = np.add.reduceat(mix(g ^ np.uint64(0x5A5A5A)), start)
                for c, f in enumerate(_FACTORS):
                    least = mix(np.minimum.reduceat(g * f, start))
                    if c < MOST_ROOTS:
                        sig[i + there, c] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    else:
                        sketch[i + there, c - MOST_ROOTS] = (least >> np.uint64(56)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * MOST_ROOTS, pa.int32()), pa.array(sig.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(size), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "mark", "key1", "key2", "n_sh", "sig", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, SIGNED)


# --- buckets: where sets meet --------------------------------------------------------------------------------------------


def blocks_of(n: Column | str, load: Column | str, rows: int, shingles: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / rows), F.ceil(F.col(load) / shingles)).cast("int")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_sh").alias("load")).where(F.col("n") > 1)


def _parted(rows: DataFrame, depth: int) -> DataFrame:
    """rows: bucket, node, n_sh, k, sketch -> rows of the buckets they part into; their bytes differ by depth and root."""
    at = lambda j: j * (SKETCH // CHILDREN) + F.pmod(5 * F.col("k") + depth, F.lit(SKETCH // CHILDREN)) + 1
    run = F.shiftright("bucket", 56)
    child = lambda j: F.shiftleft(run, 56) + F.pmod(F.xxhash64("bucket", F.lit(j), F.substring(F.col("sketch"), at(j), F.lit(1))), F.lit(1 << 56))
    return rows.select(F.col("bucket").alias("parent"), F.explode(F.array(*[F.struct(F.lit(j).alias("j"), child(j).alias("bucket")) for j in range(CHILDREN)])).alias("c"), "node", "n_sh", "k", "sketch").select("parent", "c.bucket", "node", "n_sh", "k", "sketch")


def leaf_buckets(reps: DataFrame, run: int, split_rows: int) -> DataFrame:
    """reps: node, n_sh, sig, sketch -> (bucket, node, n_sh, n, load, depth) of the buckets with two or more members that are
    to be compared. Buckets of later runs have larger numbers."""
    first, count = (0, FIRST_ROOTS) if run == 0 else (FIRST_ROOTS + (run - 1) * RUN_ROOTS, RUN_ROOTS)
    bucket = F.lit(run).cast("long") * (1 << 56) + F.pmod(F.xxhash64("k", "token"), F.lit(1 << 56))
    token = F.posexplode(F.slice("sig", first + 1, count)).alias("at", "token")
    rows = reps.select("node", "n_sh", "sketch", token).withColumn("k", F.col("at") + first).select(bucket.alias("bucket"), "node", "n_sh", "k", "sketch")
    leaves, depth = None, 0
    while True:
        sizes = staged(_sizes(rows), "sizes")
        large = sizes.where(F.col("n") > split_rows)
        splits = None
        if not large.isEmpty():
            parts = _parted(rows.join(large.select("bucket"), "bucket"), depth)
            widest = parts.groupBy("parent", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.max("n").alias("most"))
            splits = staged(large.join(widest, large["bucket"] == widest["parent"]).where(2 * F.col("most") <= F.col("n")).select("parent"), "splits")
            sizes = sizes.join(splits.withColumnRenamed("parent", "bucket"), "bucket", "left_anti")
        own = rows.join(sizes, "bucket").select("bucket", "node", "n_sh", "n", "load", F.lit(depth).alias("depth"))
        leaves = own if leaves is None else leaves.union(own)
        if splits is None or splits.isEmpty():
            return leaves
        rows = staged(_parted(rows.join(splits.withColumnRenamed("parent", "bucket"), "bucket"), depth).drop("parent"), "parts")
        depth += 1


def dealt_to_blocks(leaves: DataFrame, rows: int, shingles: int) -> DataFrame:
    """(bucket, depth, node, block, others); others: the blocks whose members can be similar to it, its own among them."""
    n_blocks = blocks_of("n", "load", rows, shingles)
    leaves = leaves.withColumn("n_blocks", n_blocks)
    band = F.when(F.col("n_blocks") > PLAIN_BLOCKS, F.floor(F.log("n_sh") / math.log(BAND)).cast("int")).otherwise(0)
    placed = leaves.withColumn("band", band)
    wide = placed.where(F.col("n_blocks") > PLAIN_BLOCKS).groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_sh").alias("load"))
    layout = wide.select("bucket", F.struct("band", blocks_of("n", "load", rows, shingles).alias("n")).alias("b")).groupBy("bucket").agg(F.map_from_entries(F.collect_list("b")).alias("layout"))  # some dozens of bands at most
    placed = placed.join(layout, "bucket", "left").withColumn("layout", F.coalesce("layout", F.create_map(F.lit(0), F.col("n_blocks"))))
    own = F.col("band").cast("long") * MANY + F.pmod(F.xxhash64("node", "bucket"), F.try_element_at("layout", F.col("band")))
    near = F.filter(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.map_contains_key("layout", b))
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.try_element_at("layout", b) - 1), lambda x: b.cast("long") * MANY + x)))
    return placed.select("bucket", "depth", "node", own.alias("block"), others.alias("others"))


# --- pairs of a sorted run of groups -------------------------------------------------------------------------------------


def pairs_of(starts: np.ndarray, n: int):
    """Chunks (a, b) of all pairs a < b within groups of consecutive rows."""
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    more = ends - np.arange(n) - 1
    total = np.cumsum(more)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        m = more[lo:hi]
        a = np.repeat(np.arange(lo, hi), m)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        lo = hi


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of a and b; ``label`` points to the least member of each row's group."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            low = label[label]
            if (low == label).all():
                break
            label[:] = low


class Lists:
    """The buckets of each row, to tell whether two rows have met in an earlier one."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, alone: bool = True):
        """``alone``: the lists are only compared with each other, so buckets of a single row can be left out."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        if alone:
            codes, names = pd.factorize(flat)
            common = np.bincount(codes, minlength=len(names))[codes] > 1
            row, flat = row[common], flat[common]
        self.names, code = np.unique(flat, return_inverse=True)
        self.width = max(1, len(self.names))
        self.row, self.id, self.code = row, flat, code.astype(np.int64)
        self.first = np.searchsorted(row, np.arange(len(sizes) + 1))
        self.has = np.sort(row * self.width + self.code)

    def met_before(self, a: np.ndarray, b: np.ndarray, bucket: np.ndarray, other: Lists | None = None) -> np.ndarray:
        """Whether the list of row a and that of row b (in ``other``, if given) share a bucket below ``bucket`` (one value for
        each pair)."""
        other = other or self
        out = np.zeros(len(a), bool)
        if not len(other.has):
            return out
        for lo in range(0, len(a), PAIRS):
            x, y, limit = a[lo : lo + PAIRS], b[lo : lo + PAIRS], bucket[lo : lo + PAIRS]
            size = self.first[x + 1] - self.first[x]
            pair = np.repeat(np.arange(len(x)), size)
            at = np.repeat(self.first[x] - np.cumsum(size) + size, size) + np.arange(len(pair))
            fine = self.id[at] < limit[pair]
            pair, at = pair[fine], at[fine]
            if other is self:
                code = self.code[at]
            else:
                place = np.minimum(np.searchsorted(other.names, self.id[at]), len(other.names) - 1)
                code = np.where(other.names[place] == self.id[at], place, -1)
                pair, at, code = pair[code >= 0], at[code >= 0], code[code >= 0]
            key = y[pair] * other.width + code
            where = np.minimum(np.searchsorted(other.has, key), len(other.has) - 1)
            out[lo + pair[other.has[where] == key]] = True
        return out


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys], 1)
        change = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held and (np.array([held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in keys]) != k[0]).any():
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if not len(change):
            held.append(b)
            continue
        last = int(change[-1])
        yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(t: pa.Table) -> Lists:
    lists = t.column("buckets").combine_chunks()
    return Lists(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    k = np.stack([t.column(c).to_numpy() for c in keys], 1)
    return np.append(0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1)


PROPOSED = "bucket long, i long, j long, comp long, node long, block long"


def propose(batches):
    """Members with a candidate, of groups (bucket, i, j), and the smallest member they are connected with there. Rows without
    a node count pairs: bucket -1, i: equal bytes, j: depth of the bucket, comp: pairs."""
    seen: dict[tuple[int, int], int] = {}
    for t in whole_groups(batches, ["bucket", "i", "j"]):
        n = t.num_rows
        col = {c: t.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "node", "n_sh", "depth")}
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
        lists = _lists(t)
        label, hit = np.arange(n), np.zeros(n, bool)
        for a, b in pairs_of(_starts(t, ["bucket", "i", "j"]), n):
            sa, sb = col["n_sh"][a].astype(np.int64), col["n_sh"][b].astype(np.int64)
            fine = DENOMINATOR * np.minimum(sa, sb) >= NUMERATOR * np.maximum(sa, sb)
            fine &= (col["i"][a] == col["j"][a]) | (col["block"][a] != col["block"][b])
            a, b = a[fine], b[fine]
            same = (sketch[a] == sketch[b]).sum(1)
            fine = same >= CUT
            a, b, same = a[fine], b[fine], same[fine]
            fine = ~lists.met_before(a, b, col["bucket"][a])
            a, b, same = a[fine], b[fine], same[fine]
            hit[a] = hit[b] = True
            join_labels(label, a, b)
            near = same * DENOMINATOR >= NUMERATOR * SKETCH
            count = np.bincount(col["depth"][a[near]].astype(np.int64) * (SKETCH + 1) + same[near])
            for x in np.flatnonzero(count).tolist():
                seen[x] = seen.get(x, 0) + int(count[x])
        at = np.flatnonzero(hit)
        if len(at):
            yield pa.RecordBatch.from_arrays([*(pa.array(col[c][at]) for c in ("bucket", "i", "j")), pa.array(col["node"][label[at]]), pa.array(col["node"][at]), pa.array(col["block"][at])], ["bucket", "i", "j", "comp", "node", "block"])
    for x, count in seen.items():
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1]), "i": pa.array([x % (SKETCH + 1)], pa.int64()), "j": pa.array([x // (SKETCH + 1)], pa.int64()), "comp": pa.array([count], pa.int64()), "node": pa.array([None], pa.int64()), "block": pa.array([None], pa.int64())})


def estimated_recall(pairs: list[tuple[int, int, int]], roots: int) -> float:
    """pairs: (equal bytes, depth, number) of the pairs found -> share of the similar pairs that they are, each standing for
    those of its similarity and depth that no path has brought together."""
    found = missing = 0.0
    for same, depth, count in pairs:
        j = max(same / SKETCH, NUMERATOR / DENOMINATOR)
        lost = (1 - j * (1 - (1 - j) ** CHILDREN) ** depth) ** roots
        found, missing = found + count, missing + count * lost / (1 - lost)
    return found / (found + missing) if found else 1.0


# --- verification on whole sets ------------------------------------------------------------------------------------------


def intersections(of: np.ndarray, g: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Common shingles of each left row with each right row. of, g: row and hash of each distinct shingle of n rows. Shingles
    that many rows share are multiplied out as a matrix, the others listed pair by pair."""
    codes, names = pd.factorize(g)
    count = np.bincount(codes, minlength=len(names))
    keep = count[codes] > 1
    of, codes = of[keep], codes[keep]
    order = np.lexsort((of, codes))
    of, codes = of[order], codes[order]
    column = np.cumsum(np.append(0, np.diff(codes) != 0)) if len(codes) else codes
    size = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    heavy = size >= max(8, n // 32)
    inter = np.zeros((len(left), len(right)), np.float32)
    many = heavy[column] if len(column) else np.zeros(0, bool)
    wide, rank = int(heavy.sum()), np.cumsum(heavy) - 1
    width = max(1, 4_000_000 // max(n, 1))
    if wide:
        r, c = of[many], rank[column[many]]  # c ascends
        for at in range(0, wide, width):
            lo, hi = np.searchsorted(c, [at, at + width])
            a = np.zeros((n, min(width, wide - at)), np.float32)
            a[r[lo:hi], c[lo:hi] - at] = 1
            inter += a[left] @ a[right].T
    few = of[~many]
    if len(few):
        starts = np.append(0, np.flatnonzero(np.diff(column[~many])) + 1)
        in_left, in_right = np.full(n, -1), np.full(n, -1)
        in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
        for a, b in pairs_of(starts, len(few)):
            a, b = few[a], few[b]
            for x, y in ((a, b), (b, a)):
                fine = (in_left[x] >= 0) & (in_right[y] >= 0)
                if fine.any():
                    inter += np.bincount(in_left[x[fine]] * len(right) + in_right[y[fine]], minlength=inter.size).reshape(inter.shape)
    return inter


LINKS = "node long, links long, root long"


def compare(t: pa.Table, of: np.ndarray, g: np.ndarray, lists: Lists, at: np.ndarray):
    """Links of one group, whose rows of ``t`` are ``at``; of, g: row (within ``at``) and hash of each distinct shingle."""
    n = len(at)
    cross = t.column("cross")[int(at[0])].as_py()
    block, bucket = t.column("block").to_numpy()[at], t.column("bucket").to_numpy()[at]
    weight, node = t.column("n_copies").to_numpy()[at], t.column("node").to_numpy()[at]
    size = np.bincount(of, minlength=n)
    left = np.flatnonzero(block == block.min()) if cross else np.arange(n)
    right = np.flatnonzero(block != block.min()) if cross else left
    inter = intersections(of, g, left, right, n)
    label, links = np.arange(n), np.zeros(n, np.int64)
    for lo in range(0, len(left), 256):
        part = inter[lo : lo + 256].astype(np.float64)
        both = size[left[lo : lo + 256], None] + size[right][None, :]
        a, b = np.nonzero((part * (NUMERATOR + DENOMINATOR) >= NUMERATOR * both) & (part > 0))
        a, b = left[lo + a], right[b]
        if not cross:
            a, b = a[a < b], b[a < b]
        fine = ~lists.met_before(at[a], at[b], bucket[a])
        a, b = a[fine], b[fine]
        links += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
        join_labels(label, a, b)
    some = np.flatnonzero(links)
    return node[some], links[some], node[label[some]]


def verify(batches):
    """Links of all groups of a partition sorted by (gid, node)."""
    for t in whole_groups(batches, ["gid"]):
        gid, node = t.column("gid").to_numpy(), t.column("node").to_numpy()
        once = np.append(True, (gid[1:] != gid[:-1]) | (node[1:] != node[:-1]))  # rows that repeat doc_id and text
        t = t.filter(pa.array(once))
        texts = [x or "" for x in t.column("text").to_pylist()]
        parts = []
        for a, b in runs_of(texts, RUN_CHARS):
            of, g = shingle_sets(texts[a:b])
            parts.append((of + a, g))
        of, g = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        lists = _lists(t)
        starts = _starts(t, ["gid"])
        found = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            lo, hi = np.searchsorted(of, [a, b])
            found.append(compare(t, of[lo:hi] - a, g[lo:hi], lists, np.arange(a, b)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["node", "links", "root"])


def near_duplicates(docs: DataFrame, block: int = BLOCK_SHINGLES, split_rows: int = SPLIT_ROWS, block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), class_id (smallest doc_id reachable by links), n_links (other rows at similarity 0.8
    or more), n_copies (rows with the same shingle set), kept (the row stays: of each class those of the smallest doc_id, and
    of several texts under it those of the smallest mark). docs: doc_id, text; read twice. ``report`` receives the recall."""
    spark = docs.sparkSession
    sigs = staged(signatures(docs), "signatures")
    has = F.col("doc_id").isNotNull() & (F.col("n_sh") > 0)
    first = F.min(F.struct("doc_id", "mark")).alias("rep")
    classes = sigs.where(has).groupBy("key1", "key2").agg(first, F.count(F.lit(1)).alias("n_copies"), F.first("n_sh").alias("n_sh"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    reps = staged(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    members, proposed, run = None, None, 0
    keys = ("bucket", "i", "j")
    while True:
        new = staged(dealt_to_blocks(leaf_buckets(reps.select("node", "n_sh", "sig", "sketch"), run, split_rows), block_rows, block), "leaves")
        members = new if members is None else members.union(new)
        lists = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # one for each root, or some for a split one
        sides = new.withColumn("other", F.explode("others")).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "depth", "node")
        groups = sides.join(lists.join(reps.select("node", "n_sh", "sketch"), "node"), "node")
        short_batches(spark, 4096)
        found = groups.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "block", "depth", "node", "n_sh", "sketch", "buckets").mapInArrow(propose, PROPOSED)
        found = staged(found, "proposed")
        proposed = found if proposed is None else proposed.union(found)
        counts = proposed.where(F.col("node").isNull()).groupBy("i", "j").agg(F.sum("comp").alias("n")).collect()  # by equal bytes and depth
        roots = FIRST_ROOTS + run * RUN_ROOTS
        recall = estimated_recall([(r["i"], r["j"], r["n"]) for r in counts], roots)
        if report is not None:
            report.update(recall=recall, roots=roots, pairs=sum(r["n"] for r in counts))
        if recall >= TARGET or roots >= MOST_ROOTS:
            break
        run += 1
    lists = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    named = lists.join(reps.select("node", "n_copies", F.col("rep.doc_id").alias("doc_id"), F.col("rep.mark").alias("mark")), "node")
    asked = proposed.where(F.col("node").isNotNull()).select(F.xxhash64(*keys, "comp").alias("gid"), "bucket", (F.col("i") != F.col("j")).alias("cross"), "block", "node").join(named, "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").join(asked, ["doc_id", "mark"])
    short_batches(spark)
    groups = texts.select("gid", "bucket", "cross", "block", "node", "n_copies", "buckets", "text").repartition("gid").sortWithinPartitions("gid", "node")
    found = staged(groups.mapInArrow(verify, LINKS), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = reps.select("key1", "key2", "node", "rep", "n_copies").join(component, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    decided = placed.join(least, "component").select("key1", "key2", "n_copies", "links", "least")
    out = sigs.select("doc_id", "mark", F.when(has, F.col("key1")).alias("key1"), F.when(has, F.col("key2")).alias("key2")).join(decided, ["key1", "key2"], "left")
    n_copies = F.coalesce("n_copies", F.lit(1)).cast("long")
    kept = F.col("least").isNull() | ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark")))
    return out.select("doc_id", "mark", F.coalesce("least.doc_id", "doc_id").alias("class_id"), (n_copies - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), n_copies.alias("n_copies"), kept.alias("kept"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
