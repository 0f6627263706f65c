"""Operator 5: raw token-id shards with a minimal perfect hash index.

A shard is one file: the ids of its documents one after the other (unsigned little-endian integers of 2 or 4 bytes, by vocabulary
size), each document closed by the end id, then a table (number of ids of each document) and a fixed footer. Shards hold ascending
ranges of doc_id. Index files hold the keys by hash bucket: a minimal perfect hash (cascaded bit arrays with ranks) gives a key's slot,
the slot a 32-bit fingerprint and the place of the key's rows, so a lookup costs a few probes whatever the number of documents.

Documents are dealt by range of doc_id and hash of text, so that rows that share a doc_id, or have none, may span any number of shards, and
sorted inside their partition; the number of shards follows the bytes of text. Only places, not ids, are shuffled for the index. A file
appears whole under its final name, so a task that runs again replaces it by the same bytes. A lookup deals keys by index file and
places by shard, so each file is loaded by one task.

Cases: null or empty text is the end id alone; null doc_ids come first in order and are one key, kept outside the hash; rows with one
doc_id stand side by side (by hash of text) and one lookup returns all of them; an unknown key returns nothing, but for a chance of 2^-32;
an empty table makes an empty store; other columns play no part.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .storage import drop, file_system, materialise, read_range, write_file
from .text import mix
from .tokens import encoder, tokenizer_path, with_end

_FOOT = struct.Struct("<8sQQQ")
_MAGIC = b"GWIDS001"


def keys_of(doc_id: pa.Array) -> np.ndarray:
    """64-bit key hashes: two ids never share one."""
    return mix(doc_id.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


# --- shards -------------------------------------------------------------------------------------------------------------------


def shard_parts(runs: Iterator[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[bytes]:
    """The bytes of a shard: runs are (ids of some documents, number of ids of each)."""
    sizes, total = [np.zeros(0, np.int64)], 0
    for ids, size in runs:
        sizes.append(size)
        total += len(ids)
        yield ids.astype(f"<u{width}").tobytes()
    size = np.concatenate(sizes)
    yield size.astype("<u8").tobytes()
    yield _FOOT.pack(_MAGIC, width, len(size), total)


class Shard:
    """Reads documents of a shard by row, sequentially in blocks."""

    def __init__(self, uri: str, block: int = 1 << 22):
        system, path = file_system(uri)
        self.file, self.block, self.at, self.held = system.open_input_file(path), block, 0, b""
        end = self.file.size()
        self.file.seek(end - _FOOT.size)
        magic, self.width, n, self.total = _FOOT.unpack(self.file.read(_FOOT.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.file.seek(end - _FOOT.size - 8 * n)
        self.sizes = np.frombuffer(self.file.read(8 * n), "<u8").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def _bytes(self, lo: int, hi: int) -> bytes:
        if not (self.at <= lo and hi <= self.at + len(self.held)):
            self.file.seek(lo)
            self.at, self.held = lo, self.file.read(min(max(self.block, hi - lo), self.total * self.width - lo))
        return self.held[lo - self.at : hi - self.at]

    def ids(self, row: int) -> np.ndarray:
        """The ids of a document, as they are in the file."""
        return np.frombuffer(self._bytes(int(self.first[row]) * self.width, int(self.first[row + 1]) * self.width), f"<u{self.width}")

    def crc32(self, row: int) -> int:
        """crc32 of a document's ids as unsigned little-endian 32-bit integers, a block at a time."""
        lo, hi, out = int(self.first[row]), int(self.first[row + 1]), 0
        while lo < hi:
            to = min(hi, lo + self.block // self.width)
            out = zlib.crc32(np.frombuffer(self._bytes(lo * self.width, to * self.width), f"<u{self.width}").astype("<u4").tobytes(), out)
            lo = to
        return out


# --- minimal perfect hash -----------------------------------------------------------------------------------------------------


class PerfectHash:
    """Keys to 0..n-1 without gaps: in every level a key alone at its bit gets it, the others go on to the next level."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        """levels: number of bits, and the bits in little-endian 64-bit words. The rank of a bit is that of its word and a count inside."""
        self.sizes, self.words = [n for n, _ in levels], [w for _, w in levels]
        self.ranks, base = [], 0
        for w in self.words:
            ends = base + np.cumsum(np.bitwise_count(w), dtype=np.int64)
            self.ranks.append(np.concatenate([[base], ends[:-1]]).astype(np.uint32))
            base = int(ends[-1])

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) > 200:
                raise ValueError("equal keys")
            size = max(64, int(spread * len(keys)))
            at = cls._bit(keys, len(levels), size)
            count = np.bincount(at, minlength=size)
            bits = np.zeros(-(-size // 64) * 64, bool)
            bits[:size] = count == 1
            levels.append((size, np.packbits(bits, bitorder="little").view("<u8")))
            keys = keys[count[at] > 1]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some that aren't in the set; others of those get a slot by chance."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (size, words) in enumerate(zip(self.sizes, self.words, strict=True)):
            at = self._bit(keys[left], n, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[n][at[hit] >> 6].astype(np.int64) + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out


def index_parts(keys: np.ndarray, shard: np.ndarray, row: np.ndarray, rows: np.ndarray) -> Iterator[bytes]:
    """The bytes of an index file: a JSON line, the levels' bits, then by slot fingerprint, shard, first row, number of rows."""
    mph = PerfectHash.build(keys)
    slot = mph(keys)
    yield json.dumps({"keys": len(keys), "levels": mph.sizes}).encode() + b"\n"
    yield from (w.astype("<u8").tobytes() for w in mph.words)
    for values, kind in ((mix(~keys) >> np.uint64(32), "<u4"), (shard, "<u4"), (row, "<u8"), (rows, "<u8")):
        out = np.zeros(len(keys), kind)
        out[slot] = values
        yield out.tobytes()


class Index:
    def __init__(self, uri: str):
        data = read_range(uri)
        head, _, _ = data.partition(b"\n")
        head, at = json.loads(head), len(head) + 1
        levels = []
        for size in head["levels"]:
            levels.append((size, np.frombuffer(data, "<u8", -(-size // 64), at)))
            at += 8 * -(-size // 64)
        self.mph, columns = PerfectHash(levels), []
        for kind in ("<u4", "<u4", "<u8", "<u8"):
            columns.append(np.frombuffer(data, kind, head["keys"], at))
            at += columns[-1].nbytes
        self.prints, self.shard, self.row, self.rows = columns

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which keys are here, their shard, first row and number of rows)."""
        slot = self.mph(keys)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.prints[slot[hit]] == (mix(~keys[hit]) >> np.uint64(32))] if len(hit) else hit
        slot = slot[hit]
        return hit, self.shard[slot].astype(np.int64), self.row[slot].astype(np.int64), self.rows[slot].astype(np.int64)


# --- the store ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Store:
    """path/shard-N.ids, path/index-B.mph for B under buckets; bases: (ids, rows) in all shards before N; rows in all; null: the
    (shard, first row, number of rows) of documents without doc_id."""

    path: str
    buckets: int
    bases: dict[int, tuple[int, int]]
    rows: int
    null: tuple[int, int, int] | None


def write_store(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, keys_per_index: int = 100_000, shard_bytes: int = 32_000_000) -> Store:
    """Encode all documents (doc_id, text) into a store at a URI that driver and executors share."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    given = given.withColumn("mark", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, out = encoder(tokenizer_path(tokenizer)), TaskContext.get().partitionId(), []
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        row = 0

        def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal row
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    ids, bounds = with_end(*coder.encode(part.column(1).to_pylist()), end_id)
                    size = np.diff(bounds)
                    n = part.num_rows
                    # a copy: a slice would hold the batch's texts in memory
                    out.append((pa.array(part.column(0).to_pylist(), pa.int64()), np.arange(row, row + n), size))
                    row += n
                    yield ids, size

        first = next(it := runs(), None)
        if first is None:
            return
        write_file(f"{path}/shard-{shard}.ids", shard_parts((x for y in ([first], it) for x in y), width))
        for ids, rows, size in out:
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), shard)), pa.array(rows), pa.array(size)], ["doc_id", "shard", "row", "n"])

    places = materialise(map_arrow(given, write, "doc_id long, shard long, row long, n long"), "places")
    bases, base, rows = {}, 0, 0
    for r in places.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy("shard").collect():
        bases[r["shard"]] = base, rows
        base, rows = base + r["n"], rows + r["rows"]
    # shards lie in the order of ids, so a key's rows follow its first one
    first = F.min(F.struct("shard", "row"))
    keyed = places.groupBy("doc_id").agg(first.alias("first"), F.count("*").alias("rows")).select("doc_id", "first.shard", "first.row", "rows")
    keyed = materialise(keyed, "keys")
    null = keyed.where("doc_id is null").first()
    keyed = keyed.where("doc_id is not null")
    buckets = max(1, -(-keyed.count() // keys_per_index))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(bucket: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            values = [table.column(i).to_numpy() for i in (2, 3, 4)]
            write_file(f"{path}/index-{bucket}.mph", index_parts(keys_of(table.column(1).combine_chunks()), *values))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([table.num_rows], pa.int64())], ["bucket", "keys"])

        now = None
        for batch in batches:
            column = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(column)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if hi > lo:
                    if now is not None and column[lo] != now:
                        yield flush(now)
                    now = int(column[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush(now)

    spread = keyed.transform(lambda d: _bucketed(d, buckets)).select("bucket", "doc_id", "shard", "row", "rows")
    spread = spread.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    map_arrow(spread, index, "bucket long, keys long").agg(F.sum("keys")).collect()
    drop(keyed)
    drop(places)
    return Store(path, buckets, bases, rows, None if null is None else (null["shard"], null["row"], null["rows"]))


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))


PLACES = "doc_id long, shard long, row long, rows long"


def _spans(doc_id: pa.Array, shard: np.ndarray, row: np.ndarray, rows: np.ndarray, shards: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """PLACES, cut where they run over a shard's end. shards: all shards; edges: rows before each, and in all."""
    first = edges[np.searchsorted(shards, shard)] + row
    lo, hi = np.searchsorted(edges, first, "right") - 1, np.searchsorted(edges, first + rows, "left") - 1
    take = np.repeat(np.arange(len(row)), hi - lo + 1)
    own = np.arange(len(take)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[take]
    begin, end = np.maximum(first[take], edges[own]), np.minimum((first + rows)[take], edges[own + 1])
    return pa.RecordBatch.from_arrays([doc_id.take(pa.array(take)), pa.array(shards[own]), pa.array(begin - edges[own]), pa.array(end - begin)], [x.split()[0] for x in PLACES.split(", ")])


def find(store: Store, keys: DataFrame) -> DataFrame:
    """PLACES of the distinct keys (doc_id) that the index knows, one row for each shard that a key's documents lie in."""
    shards = np.array(sorted(store.bases), np.int64)
    edges = np.array([store.bases[s][1] for s in shards.tolist()] + [store.rows], np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            bucket = batch.column(0)
            if bucket.null_count and store.null:
                yield _spans(pa.nulls(1, pa.int64()), *(np.array([x], np.int64) for x in store.null), shards, edges)
            bucket = bucket.fill_null(-1).to_numpy(zero_copy_only=False)
            for b in np.unique(bucket[bucket >= 0]):
                if b != now:
                    index, now = Index(f"{store.path}/index-{b}.mph"), b
                some = batch.column(1).filter(pa.array(bucket == b))
                hit, *place = index.find(keys_of(some))
                if len(hit):
                    yield _spans(some.take(pa.array(hit)), *place, shards, edges)

    named = keys.select(F.col("doc_id").cast("long").alias("doc_id"))
    if not store.bases:
        return named.limit(0).selectExpr("doc_id", "0L as shard", "0L as row", "0L as rows")
    named = _bucketed(named, store.buckets).withColumn("bucket", F.when(F.col("doc_id").isNotNull(), F.col("bucket"))).select("bucket", "doc_id")
    # a bucket's keys meet its index file in one task
    return map_arrow(named.repartition(store.buckets, "bucket").sortWithinPartitions("bucket"), probe, PLACES)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"


def lookup(store: Store, keys: DataFrame, with_ids: bool = True) -> DataFrame:
    """READ: every document of the store whose doc_id is among the distinct keys, from the shards' bytes."""
    spark: SparkSession = keys.sparkSession
    bases = spark.sparkContext.broadcast(store.bases)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for batch in batches:
            doc, start, n, crc, ids = [], [], [], [], []
            for d, s, r, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != now:
                    shard, now = Shard(f"{store.path}/shard-{s}.ids"), s
                for row in range(r, r + k):
                    doc.append(d)
                    start.append(bases.value[s][0] + int(shard.first[row]))
                    n.append(int(shard.sizes[row]))
                    crc.append(shard.crc32(row))
                    ids.append(shard.ids(row).astype(np.int64) if with_ids else None)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], [x.split()[0] for x in READ.split(", ")])

    places = find(store, keys.select("doc_id").distinct())
    # a shard is read by one task, in order
    places = places.repartition(max(1, min(4 * len(store.bases), 10_000)), "shard").sortWithinPartitions("shard", "row")
    return map_arrow(places, read, READ)
