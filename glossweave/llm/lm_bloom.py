"""Operator 9: language-model scoring with a log-frequency Bloom filter (after Talbot and Osborne, 2007).

Tokens and token pairs of all training documents are counted exactly, in buckets of their hashes. A count c is put into the bucket's
Bloom filter once for each level 1..1 + floor(log2 c); a lookup probes the levels upward until one is missing, so counts come back
quantised, and no smaller than put in but for the quantising. With q(.) for these counts and p(w) = (q(w) + 1) / (N + 1 * (V + 1)),

    log10 p(w | v) = log10( (min(q(v, w), q(v)) + s * p(w)) / (q(v) + s) )

summed over a text's tokens is its score; a text's first token follows a start mark. Tokens are A-Z-lower-cased runs of bytes that
aren't ASCII white space, and one end token; they are told apart by 64-bit hashes, pairs by their bucket and 40 bits of their hash.

The filter grows with the corpus. Where all of it has at most `most_bytes`, it is broadcast and texts are scored in one pass where they
are read. A larger one is not: texts are dealt to chunks of `chunk_bytes`, the distinct keys of a chunk go to the buckets that hold
them, are probed there, and their levels come back to the chunk. Both ways probe the same filter with the same keys, so they give the
same scores, and both read the corpus twice (counting, scoring) whatever its size.

The exact counts of the base score are a table: those of the most frequent tokens, at most `hot` of them, are broadcast and cover most
of every text; a document's other tokens are counted in the document and joined by hash.

Cases: a null or blank text is the end token alone; a row with null doc_id is trained on and not held out; repeated rows are counted
and scored each; with no training text N = V = 0 and every token is unknown; an empty table gives an empty result; other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .storage import drop, materialise
from .text import Words, gathered, mix, words

START, END = np.uint64(0x5DEECE66D1234567), np.uint64(0x27D4EB2F165667C5)
_PAIR, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEY = np.uint64((1 << 40) - 1)
#: Bytes of text whose tokens a worker holds at once, and those after which an Arrow batch ends.
_PIECE, _BATCH = 1 << 21, 1 << 22


@dataclass(frozen=True)
class Params:
    #: Bits and probes of one filter entry: about 0.4 % of absent entries are met by chance.
    bits: int = 12
    probes: int = 6
    smoothing: float = 2.0
    hot: int = 1 << 18
    #: Bytes of text to a bucket and to a chunk, and the most bytes of filter that are broadcast.
    bucket_bytes: int = 16_000_000
    chunk_bytes: int = 8_000_000
    most_bytes: int = 256_000_000
    #: Tokens that a task counts before it passes counts on.
    buffer: int = 1 << 21


def held_out(doc_id: Column, n: int = 7) -> Column:
    """Whether crc32 of the id as text leaves 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n == 2, F.lit(False))


def sequence(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with end tokens, the token before each, bounds of the texts)."""
    texts = len(w.bounds) - 1
    bounds = w.bounds + np.arange(texts + 1)
    tokens = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    tokens[inside] = w.hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    return tokens, before, bounds


def pair(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + tokens)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]


def value_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 0, 1, then the middle of 2..3, 4..7 and so on."""
    return np.where(levels < 2, levels, 1.5 * np.exp2(np.maximum(levels, 1) - 1.0) - 0.5)


def _places(keys: np.ndarray, bucket: np.ndarray, level: int, size: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    one = mix((keys & _KEY) + (bucket.astype(np.uint64) * np.uint64(131) + np.uint64(level)) * _STEP)
    two = mix(one + _STEP) | np.uint64(1)
    for i in range(probes):
        yield ((one + np.uint64(i) * two) % size).astype(np.int64)


def build(keys: np.ndarray, counts: np.ndarray, bucket: int, p: Params) -> bytes:
    """A bucket's filter of keys (40 bits) and counts."""
    levels = levels_of(counts)
    bits = np.zeros(8 * (-(-max(64, p.bits * int(levels.sum())) // 8)), bool)
    size, where = np.uint64(len(bits)), np.full(len(keys), bucket)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = levels >= level
        for at in _places(keys[some], where[some], level, size, p.probes):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def probe(data: np.ndarray, keys: np.ndarray, bucket: np.ndarray, size: np.ndarray, base: np.ndarray, p: Params) -> np.ndarray:
    """The highest level that is reached from 1 without a gap, for each key; size and base: the bits of its bucket in data (0: none)."""
    out, left, level = np.zeros(len(keys), np.int64), np.flatnonzero(size > 0), 0
    while len(left) and level < 60:
        level += 1
        hit = np.ones(len(left), bool)
        for at in _places(keys[left], bucket[left], level, size[left], p.probes):
            at += base[left]
            hit &= (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        left = left[hit]
        out[left] = level
    return out


class Filter:
    """Some buckets' filters; other buckets hold nothing."""

    def __init__(self, sizes: dict[int, int], data: bytes, buckets: int, p: Params):
        """sizes: bytes of each bucket, one after the other in data."""
        self.buckets, self.p = buckets, p
        self.size, self.base, at = np.zeros(buckets, np.uint64), np.zeros(buckets, np.int64), 0
        for b, n in sizes.items():
            self.size[b], self.base[b] = 8 * n, 8 * at
            at += n
        self.data = np.frombuffer(data, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        bucket = bucket_of(h, self.buckets)
        return probe(self.data, h, bucket, self.size[bucket], self.base[bucket], self.p)


def _counts(docs: DataFrame, buckets: int, p: Params) -> DataFrame:
    """Packed counts of what a task has gathered, by bucket. ones: hashes, then counts of tokens; pairs: keys with counts under 256;
    common: keys, then counts of the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        pairs: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            cut = []
            for held in (tokens, pairs):
                h, n = np.unique(np.concatenate(held), return_counts=True)
                bucket = bucket_of(h, buckets)
                order = np.argsort(bucket, kind="stable")
                h, n = h[order], n[order]
                cut.append((h, n, np.searchsorted(bucket[order], np.arange(buckets + 1))))
                held.clear()
            (one, one_n, one_at), (two, two_n, two_at) = cut
            rows = []
            for b in np.flatnonzero((np.diff(one_at) > 0) | (np.diff(two_at) > 0)):
                i, j = one_at[b : b + 2]
                k, m = two_at[b : b + 2]
                key, n = two[k:m] & _KEY, two_n[k:m]
                rare = n < 256  # key and count in six bytes; others take twelve
                six = (key[rare] | n[rare].astype(np.uint64) << np.uint64(40)).view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((b, one[i:j].tobytes() + one_n[i:j].astype("<u4").tobytes(), six.tobytes(), key[~rare].tobytes() + n[~rare].astype("<u4").tobytes()))
            b, x, y, z = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(z, pa.binary())], ["bucket", "ones", "pairs", "common"])

        held = 0
        for batch in batches:
            for _, _, w in gathered(words(batch.column(0)), _PIECE):
                one, before, _ = sequence(w)
                tokens.append(one)
                pairs.append(pair(before, one))
                held += len(one)
                if held >= p.buffer:
                    yield packed()
                    held = 0
        if held:
            yield packed()

    return map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "bucket long, ones binary, pairs binary, common binary")


def _bucketed(packed: DataFrame, buckets: int, p: Params) -> DataFrame:
    """bucket, bits (its filter), h and c (its exact token counts): one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            return h[first], np.add.reduceat(n, first) if len(h) else n

        def flush(bucket: int) -> pa.RecordBatch:
            one_h, one_n, two_h, two_n = [], [], [], []
            for ones, pairs, common in held:
                for raw, to_h, to_n in ((ones, one_h, one_n), (common, two_h, two_n)):
                    k = len(raw) // 12
                    to_h.append(np.frombuffer(raw, "<u8", k))
                    to_n.append(np.frombuffer(raw, "<u4", k, 8 * k).astype(np.int64))
                wide = np.zeros((len(pairs) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(pairs, np.uint8).reshape(-1, 6)
                word = wide.view(np.uint64).ravel()
                two_h.append(word & _KEY)
                two_n.append((word >> np.uint64(40)).astype(np.int64))
            held.clear()
            h, c = merged(np.concatenate(one_h), np.concatenate(one_n))
            pair_h, pair_c = merged(np.concatenate(two_h), np.concatenate(two_n))
            bits = build(np.concatenate([h & _KEY, pair_h]), np.concatenate([c, pair_c]), bucket, p)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([bits], pa.binary()), pa.array([h.view(np.int64)], pa.list_(pa.int64())), pa.array([c], pa.list_(pa.int64()))], ["bucket", "bits", "h", "c"])

        now = None
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is not None and b != now:
                    yield flush(now)
                now = b
                held.append(tuple(row))
        if held:
            yield flush(now)

    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, "bucket long, bits binary, h array<long>, c array<long>")


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, hot_sum double, hot_known long, score double, rare array<long>, times array<long>"


@dataclass
class _Known:
    """What scoring needs besides levels: the hashes and counts of hot tokens, training tokens, their distinct number, texts."""

    hot: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    texts: float


def _scored(rids: np.ndarray, part: pa.RecordBatch, w: Words, levels, known: _Known, p: Params) -> pa.RecordBatch:
    """_SCORED of some texts (part: doc_id, held_out, ...); levels: the levels of an array of distinct hashes."""
    tokens, before, bounds = sequence(w)
    one, back = np.unique(tokens, return_inverse=True)
    two, again = np.unique(pair(before, tokens), return_inverse=True)
    mine, both = value_of(levels(one))[back], value_of(levels(two))[again]
    texts, n = len(bounds) - 1, np.diff(bounds)
    history = np.empty(len(tokens))
    history[1:] = mine[:-1]
    history[bounds[:-1]] = known.texts
    chance = (mine + 1) / (known.total + known.distinct + 1)
    log = np.log10((np.minimum(both, history) + p.smoothing * chance) / (history + p.smoothing))
    doc = np.repeat(np.arange(texts), n)
    at = np.minimum(np.searchsorted(known.hot, one), max(0, len(known.hot) - 1))
    is_hot = known.hot[at] == one if len(known.hot) else np.zeros(len(one), bool)
    weight = np.where(is_hot, np.log10(known.counts[at] + 1.0), 0.0) if len(known.hot) else np.zeros(len(one))
    left = np.flatnonzero(~is_hot[back])
    key, times = np.unique(doc[left] * len(one) + back[left], return_counts=True)
    edge = pa.array(np.searchsorted(key, np.arange(texts + 1) * len(one)).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(edge, pa.array(values.astype(np.int64)))
    columns = [
        pa.array(rids),
        part.column(0),
        part.column(1),
        pa.array(n.astype(np.int64)),
        pa.array(np.bincount(doc, weight[back], texts)),
        pa.array(np.bincount(doc, is_hot[back], texts).astype(np.int64)),
        pa.array(np.bincount(doc, log, texts)),
        lists(one.view(np.int64)[key % len(one)]),
        lists(times),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORED.split(", ")])


def _score_broadcast(given: DataFrame, model: DataFrame, known, buckets: int, p: Params) -> DataFrame:
    """_SCORED of all texts, in one pass with the whole filter at every worker."""
    # as Arrow: rows of Python objects would hold the filter several times at the driver
    table = model.select("bucket", "bits").toArrow()
    bits = [x.as_buffer() for x in table.column("bits")]
    shared = given.sparkSession.sparkContext.broadcast((dict(zip(table.column("bucket").to_pylist(), map(len, bits), strict=True)), b"".join(bits)))
    del table, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Filter(*shared.value, buckets, p)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, w in gathered(words(batch.column(2)), _PIECE):
                yield _scored(np.arange(rid, rid + hi - lo), batch.slice(lo, hi - lo), w, table.levels, known.value, p)
                rid += hi - lo

    out = materialise(map_arrow(given, run, _SCORED), "scored")
    shared.destroy()
    return out


_CHUNK = "chunk long, at long, doc_id long, held_out boolean, text string"
_KEYS = "bucket long, kind int, chunk long, part long, data binary"


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of rows in which the first columns are equal and the last one counts up."""
    *same, last = columns
    breaks = np.diff(last) != 1
    for c in same:
        breaks |= np.diff(c) != 0
    yield from pairwise([0, *(np.flatnonzero(breaks) + 1).tolist(), len(last)])


def _score_dealt(given: DataFrame, model: DataFrame, known, buckets: int, tasks: int, p: Params) -> DataFrame:
    """_SCORED of all texts, with the keys of each chunk probed at the buckets that hold them."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, at, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            chunks, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i, n in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
                chunks[i], places[i] = chunk, at
                at, size = at + 1, size + 64 + (n or 0)
                if size >= p.chunk_bytes:
                    chunk, at, size = chunk + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(places), *batch.columns], [x.split()[0] for x in _CHUNK.split(", ")])

    chunks = materialise(map_arrow(given, chunked, _CHUNK), "chunks")

    def some_keys(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, w in gathered(words(texts), _PIECE):
            tokens, before, _ = sequence(w)
            yield np.unique(np.concatenate([tokens, pair(before, tokens)]))

    def by_bucket(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ones by bucket, and their buckets."""
        one = np.unique(np.concatenate(keys))
        bucket = bucket_of(one, buckets)
        order = np.argsort(bucket, kind="stable")
        return one[order], bucket[order]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where a file is read in splits, a chunk can lie in two tasks: a part is what one of them has, named by its first row."""
        held: list[np.ndarray] = []
        chunk = part = end = -1

        def closed() -> Iterator[pa.RecordBatch]:
            keys, bucket = by_bucket(held)
            held.clear()
            own, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(keys))
            low = (keys & _KEY).view(np.uint8).reshape(-1, 8)[:, :5]
            for at in range(0, len(own), 4096):
                data = [low[i:j].tobytes() for i, j in zip(first[at : at + 4096], ends[at : at + 4096], strict=True)]
                n = len(data)
                columns = [pa.array(own[at : at + n]), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, chunk)), pa.array(np.full(n, part)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "chunk", "part", "data"])

        for batch in batches:
            c, at = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, hi in _runs(c, at) if len(c) else ():
                if held and (c[lo], at[lo]) != (chunk, end):
                    yield from closed()
                if not held:
                    chunk, part = int(c[lo]), int(at[lo])
                held += some_keys(batch.column(2).slice(lo, hi - lo))
                end = at[hi - 1] + 1
        if held:
            yield from closed()

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(0, np.uint8)
        for batch in batches:
            out = []
            for bucket, kind, chunk, part, data in zip(*batch.columns, strict=True):
                bucket, data = bucket.as_py(), np.frombuffer(data.as_buffer(), np.uint8)
                if kind.as_py() == 0:  # a bucket's filter comes before the keys to probe
                    now, bits = bucket, data.copy()
                    continue
                n = len(data) // 5
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = data.reshape(-1, 5)
                size = np.full(n, 8 * len(bits) if bucket == now else 0, np.uint64)
                found = probe(bits, wide.view(np.uint64).ravel(), np.full(n, bucket), size, np.zeros(n, np.int64), p)
                out.append((chunk.as_py(), part.as_py(), bucket, found.astype(np.uint8).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "at", "bucket", "levels"])

    filters = model.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("part"), F.col("bits").alias("data"))
    dealt = filters.unionByName(map_arrow(chunks.select("chunk", "at", "text"), keyed, _KEYS)).repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket", "kind")
    levels = map_arrow(dealt, probed, "chunk long, at long, bucket long, levels binary")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[pa.RecordBatch] = []
        levels: dict[int, list[bytes]] = {}
        now = None
        rid = TaskContext.get().partitionId() << 33

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal rid
            rows = pa.Table.from_batches(texts).combine_chunks().to_batches()[0]
            texts.clear()
            for first, end in pairwise([*levels, rows.num_rows]):
                part = rows.slice(first, end - first)
                keys, _ = by_bucket(list(some_keys(part.column(2))))
                order = np.argsort(keys)
                keys, found = keys[order], np.frombuffer(b"".join(levels[first]), np.uint8)[order]
                for lo, hi, w in gathered(words(part.column(2)), _PIECE):
                    yield _scored(np.arange(rid, rid + hi - lo), part.slice(lo, hi - lo), w, lambda some: found[np.searchsorted(keys, some)].astype(np.int64), known.value, p)  # noqa: B023
                    rid += hi - lo
            levels.clear()

        for batch in batches:
            c, kind = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, hi in _runs(c, kind, np.arange(len(c))) if len(c) else ():
                if c[lo] != now:
                    if texts:
                        yield from closed()
                    now = c[lo]
                if kind[lo] == 0:
                    texts.append(batch.select(["doc_id", "held_out", "text"]).slice(lo, hi - lo))
                else:
                    for i in range(lo, hi):
                        levels.setdefault(batch.column(2)[i].as_py(), []).append(batch.column(4)[i].as_buffer().to_pybytes())
        if texts:
            yield from closed()

    back = levels.select("chunk", F.lit(1).alias("kind"), "at", "bucket", "levels", *[F.lit(None).cast(k).alias(n) for n, k in (("doc_id", "long"), ("held_out", "boolean"), ("text", "string"))])
    own = chunks.select("chunk", F.lit(0).alias("kind"), "at", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("levels"), "doc_id", "held_out", "text")
    # a chunk's texts come first, then the levels of its parts by bucket
    met = own.unionByName(back).repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "at", "bucket")
    out = materialise(map_arrow(met, scored, _SCORED), "scored")
    drop(chunks)
    return out


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of _BATCH bytes at most, or of one row: their buffers lie outside the JVM's heap, several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, _BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, trained_on: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out (as given), n_tokens, n_known, train_tokens, base_score, score of all docs (doc_id, text, held_out).

    trained_on: rows with text, all of which are learned from."""
    with _small_batches(docs.sparkSession):  # the result is lazy, but has no Python in it
        return _score(docs, trained_on, p)


def _score(docs: DataFrame, trained_on: DataFrame, p: Params) -> DataFrame:
    spark = docs.sparkSession
    size = trained_on.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-size // p.bucket_bytes))
    model = materialise(_bucketed(_counts(trained_on, buckets, p), buckets, p), "model")
    vocabulary = model.select(F.explode(F.arrays_zip("h", "c")).alias("x")).select("x.h", "x.c")
    total, distinct, held = model.agg(F.sum(F.expr("aggregate(c, 0L, (a, x) -> a + x)")), F.sum(F.size("h")), F.sum(F.length("bits"))).first()
    total, distinct, held = total or 0, distinct or 0, held or 0
    ends = vocabulary.where(F.col("h") == int(END.astype(np.int64))).first()
    # the least count that at most p.hot tokens reach
    by_level = sorted(((r["k"], r["n"]) for r in vocabulary.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    reached, level = 0, None
    for k, n in by_level:
        if reached + n > p.hot:
            break
        reached, level = reached + n, k
    hot_h, hot_c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if level is not None:
        hot = vocabulary.where(F.floor(F.log2("c") * 8) >= level).toArrow()
        hot_h, hot_c = hot.column("h").to_numpy().view(np.uint64), hot.column("c").to_numpy()
        order = np.argsort(hot_h)
        hot_h, hot_c = hot_h[order], hot_c[order]
    known = spark.sparkContext.broadcast(_Known(hot_h, hot_c, total, distinct, float(ends["c"]) if ends else 0.0))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out").cast("boolean").alias("held_out"), F.col("text").cast("string").alias("text"))
    given = _score_broadcast(given, model, known, buckets, p) if held <= p.most_bytes else _score_dealt(given, model, known, buckets, max(tasks, -(-size // (4 * p.chunk_bytes))), p)
    known.destroy()
    rare = given.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    found = rare.join(vocabulary, "h").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("sum"), F.sum("n").alias("known"))
    none = F.lit(float(np.log10(total + distinct + 1)))
    return given.drop("rare", "times").join(found, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * none).alias("base_score"),
        "score",
    )
