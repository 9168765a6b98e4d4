"""Token-id files: independent zstandard frames, a trailing seek table and one checksum per frame.

Layout of a shard file (all integers little-endian):

* data frames: one zstandard frame for each group of whole documents, holding their ids as unsigned 32-bit integers;
* an index frame: zstandard over ``n`` doc_ids (int64), ``n`` presence bytes (0 where doc_id is null) and ``n`` id counts
  (int64);
* a seek table in the public seekable zstandard form: a skippable frame (magic 0x184D2A5E) with, for each frame,
  compressed size, decompressed size and the low 32 bits of XXH64 over the decompressed bytes, then the number of frames,
  a descriptor byte 0x80 (checksums present) and the magic 0x8F92EAB1. The index frame is its last entry.

Any zstandard reader can decompress the file; a reader that wants a few documents fetches the tail, the index frame and
the frames that hold them. Shards are ranges of doc_id, so the shard order is the document order.

Edge cases: null text encodes as the end id alone; empty tables write no shard and read back as no rows; rows that repeat
a doc_id are kept, in the order of their text's hash; null doc_ids come first; other columns of the input are ignored.
A task writes its shard under a name of its own and only the names of tasks that ended are listed, so a task that is run
again leaves at most an unlisted file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, short_batches, staged

SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids in a frame, before compression, after which it is closed; a longer document has a frame to itself.
FRAME_BYTES = 1 << 20
#: Text bytes (Parquet file bytes, about half of the text) that a shard is meant to hold.
SHARD_BYTES = 16 << 20  # of text, about
MOST_READERS = 10_000  # tasks that read shards
MOST_BROADCAST = 1_000_000  # shards whose starts are broadcast
END_ID = 1

MANIFEST = "path string, shard int, n_docs long, n_tokens long"


class ShardWriter:
    """Frames of whole documents; the file is streamed to the sink frame by frame."""

    def __init__(self, sink, level: int = 3, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype("<u4").tobytes()
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        self.held.append(data)
        self.size += len(data)
        self.docs.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> None:
        self._flush()
        ids = np.array([x or 0 for x in self.docs], "<i8")
        there = np.array([x is not None for x in self.docs], "u1")
        self._frame(ids.tobytes() + there.tobytes() + np.array(self.counts, "<i8").tobytes())
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(rows) + len(foot)) + rows + foot)


class ShardReader:
    """Reads through ``fetch(offset, size)``, so that only the frames asked for are moved and decompressed."""

    def __init__(self, fetch, size: int):
        self.fetch = fetch
        n, flags, magic = struct.unpack("<IBI", fetch(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKED:
            raise ValueError("no seek table with checksums at the end of the file")
        table = fetch(size - 9 - 12 * n - 8, 8 + 12 * n)
        if struct.unpack("<I", table[:4])[0] != SKIPPABLE:
            raise ValueError("the seek table has no skippable frame header")
        self.table = np.frombuffer(table[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(n - 1)
        m = len(index) // 17
        ids, there, counts = np.frombuffer(index[: 8 * m], "<i8"), np.frombuffer(index[8 * m : 9 * m], "u1"), np.frombuffer(index[9 * m :], "<i8")
        self.docs = [int(a) if b else None for a, b in zip(ids, there)]
        self.counts = counts.astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])  # in ids, within the shard
        self.frame_begin = np.concatenate([[0], np.cumsum(self.table[: n - 1, 1])]) // 4

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, size, check = self.table[k]
        data = zstandard.ZstdDecompressor().decompress(self.fetch(int(self.at[k]), int(packed)), max_output_size=int(size))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return data

    def documents(self, wanted=None):
        """Yield (position, doc_id, ids) of all documents, or of those whose doc_id is in ``wanted``."""
        last, ids = -1, np.zeros(0, "<u4")
        for i, doc in enumerate(self.docs):
            if wanted is not None and doc not in wanted:
                continue
            if not self.counts[i]:
                yield i, doc, ids[:0]
                continue
            k = int(np.searchsorted(self.frame_begin, self.begin[i], "right")) - 1
            if k != last:
                last, ids = k, np.frombuffer(self.frame(k), "<u4")
            a = int(self.begin[i] - self.frame_begin[k])
            yield i, doc, ids[a : a + int(self.counts[i])]


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id under ``folder``; return the manifest."""
    spark = docs.sparkSession
    short_batches(spark)
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))

    def write(batches):
        from pyspark import TaskContext

        from .vocab import word_tokenizer

        tok, writer, sink, path = word_tokenizer(tokenizer), None, None, ""
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), tok.encode(texts)):
                if writer is None:
                    part = TaskContext.get().partitionId()
                    path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.zst"
                    store, inner = fs.FileSystem.from_uri(folder)
                    store.create_dir(inner, recursive=True)
                    sink = store.open_output_stream(f"{inner}/{path.rpartition('/')[2]}", compression=None)
                    writer = ShardWriter(sink)
                writer.add(doc, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "shard": pa.array([part], pa.int32()), "n_docs": [len(writer.docs)], "n_tokens": [int(sum(writer.counts))]})

    # the row's number only parts rows that are equal, so that many copies of one spread over shards
    keys = ["doc_id", "_tie", "_row"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
    return staged(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def _open(path: str) -> ShardReader:
    store, inner = fs.FileSystem.from_uri(path)
    f = store.open_input_file(inner)

    def fetch(offset: int, size: int) -> bytes:
        f.seek(offset)
        return f.read(size)

    return ShardReader(fetch, f.size())


def read_store(manifest: DataFrame, wanted: set[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of the store, read from its files: doc_id, shard, start (within the shard), n_tokens, ids_crc32 and, if
    asked for, the ids. ``wanted`` limits what is decompressed to the frames that hold those doc_ids."""
    schema = "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        for b in batches:
            for path, shard in zip(b.column("path").to_pylist(), b.column("shard").to_pylist()):
                r = _open(path)
                rows: dict[str, list] = {k: [] for k in ("doc_id", "start_in_shard", "n_tokens", "ids_crc32")}
                ids_of = []
                for i, doc, ids in r.documents(wanted):
                    rows["doc_id"].append(doc)
                    rows["start_in_shard"].append(int(r.begin[i]))
                    rows["n_tokens"].append(len(ids))
                    rows["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        ids_of.append(ids.astype(np.int64).tolist())
                n = len(rows["doc_id"])
                cols = {"doc_id": pa.array(rows["doc_id"], pa.int64()), "shard": pa.array([shard] * n, pa.int32())} | {k: pa.array(rows[k], pa.int64()) for k in ("start_in_shard", "n_tokens", "ids_crc32")}
                if with_ids:
                    cols["ids"] = pa.array(ids_of, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)

    paths = manifest.select("path", "shard")
    return paths.repartition(max(1, min(paths.count(), MOST_READERS))).mapInArrow(read, schema)  # in turn, a shard or some a task


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each shard: a running sum over blocks of shards, then within each block (no single-task window)."""
    block = F.floor(F.col("shard") / 1024)
    sums = manifest.withColumn("block", block).groupBy("block").agg(F.sum("n_tokens").alias("block_tokens"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b.block") < F.col("a.block"), "left").groupBy(F.col("a.block").alias("block")).agg(F.coalesce(F.sum("b.block_tokens"), F.lit(0)).alias("block_start"))
    from pyspark.sql import Window

    inner = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("block", block).withColumn("_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, "block").select("shard", (F.col("block_start") + F.col("_in")).alias("shard_start"))


def op9_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Write all documents to a store and report each document from the files.

    The starts of shards (24 bytes each) are broadcast up to ``MOST_BROADCAST`` shards and joined beyond; the documents never
    are broadcast."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    manifest = write_store(documents(spark, sf_dir).select("doc_id", "text"), fresh_path(spark, "store"), tokenizer)
    starts = shard_starts(manifest)
    starts = F.broadcast(starts) if manifest.count() <= MOST_BROADCAST else starts
    return read_store(manifest).join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
