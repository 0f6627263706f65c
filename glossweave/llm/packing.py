"""Operator 2: vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Every partition packs what it reads and moves no rows: a bounded window of examples is kept, one sequence is filled at a time by the
example whose demand has the largest dot product with the room that is left, and what stays free takes a cut piece of another
example, the longest that the room and the limit on loss allow. Examples longer than a sequence are cut first, while there are prompts
to go with them. What a window leaves goes on to the next one, and a sequence that the window can't fill waits for more examples;
one that nothing fills in the end falls into sequences whose lengths are powers of two, which need no padding.

The front ids of an example, its prompt, bear no loss. With fewer loss-bearing than other ids in a sequence allowed (`loss` under
`tokens`), a sequence is full only if prompts make up the difference, so both limits steer the choice.

Cases: a null or empty text is one piece, the end id; a null doc_id stays null; repeated rows are packed each by itself, as they come;
an empty table gives no pieces; other columns of the input play no part. A text of any length is cut into whole sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .tokens import encoder, tokenizer_path, with_end

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence. A segment is one piece of one example; the ids of an example's prompt bear no loss."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


class Packer:
    """Packs examples (row number, start, length, loss) of one partition; piece order in a sequence is the order of placing."""

    def __init__(self, limits: Limits, window: int = 1 << 19, most: int = 2048):
        self.limits, self.window, self.most = limits, window, most
        self.items: list[tuple[object, int, int, int]] = []  # example, start, length, ids at the front that bear no loss
        self.held, self.due = 0, window

    def add(self, example, length: int, prompt: int = 0) -> Iterator[list[tuple[object, int, int, int]]]:
        """Yield the sequences that are filled meanwhile: lists of (example, start, length, loss)."""
        start, full = 0, self.limits.tokens
        while length - start >= full and self._fits(start, full, prompt, self.limits.loss) == full:
            yield [(example, start, full, self._loss(start, full, prompt))]
            start += full
        if start < length:
            self.items.append((example, start, length - start, prompt))
            self.held += length - start
        if self.held >= self.due or len(self.items) >= self.most:
            yield from self._pack(self.held // 2)

    def finish(self) -> Iterator[list[tuple[object, int, int, int]]]:
        yield from self._pack(0)

    @staticmethod
    def _loss(start: int, size: int, prompt: int) -> int:
        return max(0, start + size - max(start, prompt))

    def _fits(self, start: int, size: int, prompt: int, loss: int) -> int:
        """The longest piece from start that bears at most `loss`."""
        return min(size, max(0, prompt - start) + loss)

    def _pack(self, leave: int) -> Iterator[list[tuple[object, int, int, int]]]:
        lim = self.limits
        items = self.items
        size = np.array([x[2] for x in items], np.int64)
        loss = np.array([self._loss(x[1], x[2], x[3]) for x in items], np.int64)
        front = np.array([max(0, x[3] - x[1]) for x in items], np.int64)  # ids at the front that bear no loss
        alive = np.ones(len(items), bool)
        count = len(items)
        self.due = self.window
        while count and self.held > leave:
            room, segments, free = lim.tokens, lim.segments, lim.loss
            pieces, before = [], {}
            while room and segments and count:
                # the constant third demand (one segment) ranks nothing; a dot product over the scaled limits ranks the rest
                score = np.where(alive & (size <= room) & (loss <= free), size * (room / lim.tokens**2) + loss * (free / lim.loss**2), -1.0)
                at = int(score.argmax())
                over = np.where(alive & (size > lim.tokens), size, 0) if not pieces else None
                if score[at] < 0 or over is not None and over.any():
                    # no example fits whole, or one is longer than any sequence: the longest piece that one can give
                    longest = np.where(alive if score[at] < 0 else over > 0, np.minimum(np.minimum(size, room), front + free), 0)
                    cut = int(longest.max())
                    if cut <= 0:
                        break
                    at = int(np.where(longest == cut, size, -1).argmax())
                    before.setdefault(at, items[at])
                    example, start, length, prompt = items[at]
                    pieces.append((example, start, cut, self._loss(start, cut, prompt)))
                    items[at] = (example, start + cut, length - cut, prompt)
                    size[at], loss[at], front[at] = length - cut, self._loss(start + cut, length - cut, prompt), max(0, front[at] - cut)
                    if length == cut:
                        alive[at] = False
                        count -= 1
                else:
                    before.setdefault(at, items[at])
                    example, start, cut, prompt = items[at]
                    pieces.append((example, start, cut, int(loss[at])))
                    alive[at] = False
                    count -= 1
                room, segments, free = room - cut, segments - 1, free - pieces[-1][3]
                self.held -= cut
            if not pieces:
                raise ValueError("limits that no id fits")
            if room and segments and leave and self.held < 3 * self.window and count < self.most // 2:
                # what is missing may come yet: take the pieces back and wait
                for at, item in before.items():
                    items[at], alive[at] = item, True
                self.held += sum(x[2] for x in pieces)
                self.due = self.held + self.window // 2
                break
            yield from self._closed(pieces)
        self.items = [x for x, a in zip(items, alive, strict=True) if a]

    def _closed(self, pieces):
        """A full sequence as it is; any other as sequences whose lengths are powers of two."""
        total = sum(x[2] for x in pieces)
        if total == self.limits.tokens:
            yield pieces
            return
        queue = list(reversed(pieces))
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            need, out = 1 << bit, []
            while need:
                example, start, size, loss = queue.pop()
                cut = min(size, need)
                first = max(0, min(loss, cut - (size - loss)))  # loss-bearing ids stand at the end of a piece
                out.append((example, start, cut, first))
                if cut < size:
                    queue.append((example, start + cut, size - cut, loss - first))
                need -= cut
            yield out


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, limits: Limits = Limits(), prompt_tokens: str | int = 0, chunks: int = 800_000) -> DataFrame:
    """Pieces of all documents (doc_id, text), with their ids as unsigned little-endian 32-bit integers. Columns: PIECES.

    prompt_tokens: so many ids at the front of a document bear no loss, or the integer column that says how many (null: 0).
    chunks: of words that a worker's encoder keeps; fewer take less memory and more time."""
    prompt: Column = F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0).cast("long")) if isinstance(prompt_tokens, str) else F.lit(prompt_tokens).cast("long")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.alias("prompt"))
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer_path(tokenizer), chunks), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        serial = 0

        def rows(sequences) -> list[list]:
            nonlocal serial
            out: list[list] = []
            for pieces in sequences:
                offset = 0
                for (doc, ids), start, length, loss in pieces:
                    out.append([doc, start, length, ids[start : start + length].tobytes(), len(ids), base + serial, offset, loss])
                    offset += length
                serial += 1
            return out

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                flat, bounds = with_end(*coder.encode(part.column(1).to_pylist()), end_id)
                out: list[list] = []
                for i, (doc, front) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    ids = flat[bounds[i] : bounds[i + 1]].copy()
                    out += rows(packer.add((doc, ids), len(ids), max(0, front)))
                if out:
                    yield batch_of(out)
        out = rows(packer.finish())
        if out:
            yield batch_of(out)

    return map_arrow(given, run, PIECES)
