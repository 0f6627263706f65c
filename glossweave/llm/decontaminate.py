"""Operator 1: benchmark decontamination by the q-gram lemma.

Texts are compared as lower-cased runs of letters and digits with single spaces, in UTF-8 bytes. Every benchmark item is cut into
windows (a whole item if it is shorter): long ones for passages with many edits, and short ones, so close that every passage of
`passage` bytes of an item holds a whole one. So each verbatim passage of that length is a leak wherever it lies in its item, and so
is one with few enough edits inside such a window; of shorter passages those are found that hold a window. Windows begin where a hash of
the next q-gram is the least of `stride` neighbours, so that items that share a passage share its windows: equal windows are one, with
many owners.

A window with k edits allowed and w bytes shares at least w + 1 - q(k + 1) of its q-grams with a passage that matches it, and all of them
lie on k + 1 neighbouring diagonals. So q-gram hits are counted in bands of `band` diagonals that overlap by k; bands that reach the bound
are aligned with the window by banded dynamic programming, those of most hits first, until one is within k edits: that is a leak of every
item that has the window. Hits are taken in lots of at most `hits`, whatever is shared by how many.

A task reads documents, looks q-grams up in a bitmap and a sorted array of the benchmark's and keeps nothing: no row is moved.
The benchmark goes to the tasks in blocks of bounded size; one more block means one more pass over the documents.

Cases: null and blank texts leak nothing; items of fewer than `least` bytes after normalising are found where they are a whole normalised
document, and nowhere else, since so short a text says nothing inside another; items without letters and digits match nothing; a null doc_id
or item_id stays null in the result; repeated documents are each judged, equal items each matched; empty tables give no leaks; other
columns play no part, and decontaminate() keeps all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .text import mix, powers

LEAKS = "doc_id long, item_id long, windows long, item_windows long, edits long, first_at long"
_END = b"\xff" * 16
_FOLD = np.array([ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)] + list(range(128, 256)), np.uint8)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 22


@dataclass(frozen=True)
class Params:
    q: int = 10
    window: int = 100
    stride: int = 50
    #: Bytes of the shortest passage that is always found, and the stride of the windows cut for it.
    passage: int = 75
    passage_stride: int = 20
    #: Edits a window may have, as a share of its bytes.
    error: float = 0.08
    band: int = 16
    least: int = 25
    #: Bytes of benchmark text in one broadcast, and q-gram hits held at once.
    block: int = 4_000_000
    hits: int = 1 << 21

    def cuts(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(begin, bytes) of the windows of an item's bytes; every run of `passage` bytes of a longer item holds a whole one."""
        out = {}
        code = mix(_grams(text, self.q))
        for window, stride in ((self.window, self.stride), (self.passage - self.passage_stride + 1, self.passage_stride)):
            if len(text) <= window:
                out[0, len(text)] = None
                continue
            least = code[: len(text) - window + 1]
            for lo in range(0, max(1, len(least) - stride + 1), 1 << 14):
                some = least[lo : lo + (1 << 14) + stride - 1]
                runs = np.lib.stride_tricks.sliding_window_view(some, min(stride, len(some)))
                out |= dict.fromkeys((int(at), window) for at in np.unique(runs.argmin(axis=1) + np.arange(len(runs)) + lo))
        return list(out)


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [t.lower().encode() if t else b"" for t in texts]


def _normal(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised texts, each after sixteen bytes that no text has; where each begins."""
    data = np.frombuffer(_END + _END.join(raw) + _END, np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1]])) + 16 * np.arange(1, len(raw) + 1) if len(raw) else np.zeros(0, np.int64)
    data = _FOLD[data]
    gap = data == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1] & (data[:-1] != 255)
    at = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], at[starts]


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q bytes (8 <= q <= 16)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    head = np.ndarray((n,), "<u8", data, 0, (1,))
    tail = np.ndarray((n,), "<u8", data, q - 8, (1,))
    return head * _K1 ^ (tail ^ tail >> np.uint64(29)) * _K2


def _firsts(mark: np.ndarray, count: np.ndarray, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The rows of largest count, and then first, for each mark."""
    order = np.lexsort((np.arange(len(mark)), -count, mark))
    first = order[np.concatenate([[True], mark[order][1:] != mark[order][:-1]])] if len(mark) else order
    return tuple(c[first] for c in columns)


class Index:
    """The q-grams of the distinct windows of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], p: Params):
        self.p, self.item_ids = p, [i for i, _ in items]
        self.whole: dict[bytes, list[int]] = {}
        numbers: dict[bytes, int] = {}
        window, owner = [], []
        for n, raw in enumerate(_bytes([t for _, t in items])):
            text = _normal([raw])[0][16:-16].tobytes().strip()
            if len(text) < max(p.least, p.q):
                if text:
                    self.whole.setdefault(text, []).append(n)
                continue
            for at, size in p.cuts(np.frombuffer(text, np.uint8)):
                window.append(numbers.setdefault(text[at : at + size], len(numbers)))
                owner.append(n)
        pairs = np.unique(np.stack([np.array(window, np.int64), np.array(owner, np.int64)], axis=1), axis=0) if window else np.zeros((0, 2), np.int64)
        # window w is in the items owner[first[w]:first[w + 1]]
        self.owner, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(numbers) + 1))
        self.counts = np.bincount(self.owner, minlength=len(items))
        self.size = np.array([len(w) for w in numbers], np.int64)
        self.k = np.minimum((p.error * self.size).astype(np.int64), np.maximum(0, (self.size - p.q) // p.q))
        self.need = self.size + 1 - p.q * (self.k + 1)
        flat = np.frombuffer(b"".join(numbers), np.uint8)
        begin = np.cumsum(self.size) - self.size
        self.text = np.zeros((len(numbers), p.window), np.uint8)
        self.text[np.repeat(np.arange(len(numbers)), self.size), np.arange(len(flat)) - np.repeat(begin, self.size)] = flat
        grams = self.size - p.q + 1
        self.window = np.repeat(np.arange(len(numbers)), grams)
        self.place = np.arange(len(self.window)) - np.repeat(np.cumsum(grams) - grams, grams)
        codes = _grams(flat, p.q)[begin[self.window] + self.place] if len(flat) else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.window, self.place = codes[order], self.window[order], self.place[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.codes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.most = int(self.k.max(initial=0))

    def search(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, windows that match, fewest edits and least place of their matches) for normalised texts."""
        out = [(t, n, 0, 0, 0) for t, n in self._whole_texts(data, starts)]
        text, window, low = self._candidates(data, starts)
        if not len(text):
            return out
        # candidates of one text and window stand side by side, the likeliest first; each round tries twice as many of those left
        ends = np.append(starts[1:], len(data)) - 16
        head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (window[1:] != window[:-1])]))
        size, tried = np.diff(np.append(head, len(text))), 0
        edits, place = np.full(len(head), -1), np.zeros(len(head), np.int64)
        while len(left := np.flatnonzero((edits < 0) & (size > tried))):
            many = np.minimum(tried + 1, size[left] - tried)
            group = np.repeat(left, many)
            at = head[group] + tried + np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
            for i in range(0, len(at), 2048):
                some, own = at[i : i + 2048], group[i : i + 2048]
                found = self._aligned(data, window[some], low[some], starts[text[some]], ends[text[some]])
                good = np.flatnonzero(found <= self.k[window[some]])[::-1]
                edits[own[good]], place[own[good]] = found[good], np.maximum(0, low[some[good]] - starts[text[some[good]]])
            tried += tried + 1
        hit = np.flatnonzero(edits >= 0)
        many = self.first[window[head[hit]] + 1] - self.first[window[head[hit]]]
        group = np.repeat(hit, many)
        item = self.owner[self.first[window[head[group]]] + np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)]
        order = np.lexsort((item, text[head[group]]))
        group, item = group[order], item[order]
        text = text[head[group]]
        begins = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])) if len(group) else np.zeros(0, np.int64)
        if not len(begins):
            return out
        columns = (text[begins], item[begins], np.diff(np.append(begins, len(group))), np.minimum.reduceat(edits[group], begins), np.minimum.reduceat(place[group], begins))
        return out + list(zip(*(c.tolist() for c in columns), strict=True))

    def _whole_texts(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) of texts that are a short item."""
        if not self.whole:
            return []
        ends = np.append(starts[1:] - 16, len(data) - 16)
        short = np.flatnonzero(ends - starts <= max(map(len, self.whole)) + 2)
        return [(int(t), n) for t in short for n in self.whole.get(data[starts[t] : ends[t]].tobytes().strip(), ())]

    def _candidates(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, lowest diagonal) of the bands that reach the bound, by text and window, those of most hits first."""
        codes = _grams(data, self.p.q)
        at = np.flatnonzero(self.bitmap[(codes >> np.uint64(64 - _BITS)).view(np.int64)])
        lo = np.searchsorted(self.codes, codes[at], "left")
        n = np.searchsorted(self.codes, codes[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        total, width = np.cumsum(n), self.p.band
        reach = self.p.window + width + self.most  # hits of one band and window lie within so many bytes
        power, back = powers(len(data))
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=run[1:])
        found: list[tuple[np.ndarray, ...]] = []
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + self.p.hits, "right")))
            j = max(j, min(len(at), int(np.searchsorted(at, at[i] + 2 * reach))))  # at least so far, or lots that overlap would never end
            many = n[i:j]
            hit = np.repeat(lo[i:j] - np.cumsum(many) + many, many) + np.arange(many.sum())
            window = self.window[hit]
            diagonal = np.repeat(at[i:j], many) - self.place[hit] + self.p.window  # never negative: texts begin after sixteen bytes
            band = diagonal // width
            both = diagonal % width < self.k[window]  # also in the band below, which overlaps by k
            lowest = int(band.min()) - 1
            span = int(band.max()) - lowest + 1
            cell = window * span + (band - lowest)
            cell = np.concatenate([cell, cell[both] - 1])
            if len(self.size) * span <= 4 * len(cell) + (1 << 16):  # counted in place where hits are dense, by sorting where they are sparse
                count = np.bincount(cell, minlength=1)
                cell = np.flatnonzero(count)
                count = count[cell]
            else:
                cell, count = np.unique(cell, return_counts=True)
            enough = count >= self.need[cell // span]
            cell, count = cell[enough], count[enough]
            window, low = cell // span, (cell % span + lowest) * width - self.p.window
            text = np.maximum(0, np.searchsorted(starts, np.maximum(0, low + width + self.most), "right") - 1)
            # bands that hold the same bytes of a text align alike: one of them stands for all, the first of most hits
            begin, end = np.clip(low - self.most, 0, len(data)), np.clip(low + width + 2 * self.most + 1 + self.size[window], 0, len(data))
            mark = mix((run[end] - run[begin]) * back[begin] + (window << 24).view(np.uint64) + (end - begin).view(np.uint64)) + mix(text.view(np.uint64))
            found.append(_firsts(mark, count, (text, window, low, count, mark)))
            if j == len(at):
                break
            i = max(i + 1, int(np.searchsorted(at, at[j] - reach)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        text, window, low, count, mark = (np.concatenate(x) for x in zip(*found, strict=True))
        text, window, low, count, _ = _firsts(mark, count, (text, window, low, count, mark))
        order = np.lexsort((low, -count, window, text))
        return text[order], window[order], low[order]

    def _aligned(self, data: np.ndarray, window: np.ndarray, lowest: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fewest edits that turn a window into some run near these diagonals of the text between begin and end."""
        k, columns = self.most, self.p.band + 3 * self.most + 1
        step = np.arange(columns, dtype=np.int16)
        cost = np.zeros((len(window), columns), np.int16)
        best = np.full(len(window), 32_000, np.int16)
        size, text, live = self.size[window], self.text[window], np.arange(len(window))
        first = lowest - k
        # runs of another text (sixteen bytes away) don't count
        cost[(first[:, None] + step < begin[:, None]) | (first[:, None] + step > (end - size + self.k[window])[:, None])] = 16_000
        for r in range(int(size.max(initial=0))):
            place = first[:, None] + r + step
            other = np.where((place >= 0) & (place < len(data)), data[np.clip(place, 0, len(data) - 1)], 255)
            new = cost + (other != text[:, r, None])
            np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
            cost = np.minimum.accumulate(new - step, axis=1) + step
            done = size == r + 1
            if done.any():
                best[live[done]] = cost[done].min(axis=1)
            if r % 8 == 7:  # most that fail do so early
                keep = ~done & (size > r + 1) & (cost.min(axis=1) <= self.k[window])
                if not keep.all():
                    cost, window, size, text, first, live = (x[keep] for x in (cost, window, size, text, first, live))
                    if not len(live):
                        break
        return best


def _blocks(benchmark: DataFrame, p: Params) -> Iterator[list]:
    """The items in lists of about p.block bytes; only one is at the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // p.block)
    for b in range(n):
        some = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r.item_id, r.text) for r in some.collect()]


def _slices(texts: list[str | None], size: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    raw, first, held = [], 0, 0
    for i, r in enumerate(_bytes(texts)):
        raw.append(r)
        held += len(r)
        if held >= size:
            yield first, raw
            raw, first, held = [], i + 1, 0
    if raw:
        yield first, raw


def _search_all(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    for first, raw in _slices(texts):
        for t, *rest in index.search(*_normal(raw)):
            yield first + t, *rest


def leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """A row a document and item of which it holds a passage: LEAKS. first_at is a byte of the normalised text."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in LEAKS.split(", ")]
    out: DataFrame | None = None
    for block in _blocks(benchmark, p):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, p)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [[ids[t], index.item_ids[n], w, int(index.counts[n]), e, at] for t, n, w, e, at in _search_all(index, batch.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        part = map_arrow(given, run, LEAKS)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block in _blocks(benchmark, p):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, p)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in _search_all(index, batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        docs = map_arrow(docs, run, docs.schema)
    return docs
