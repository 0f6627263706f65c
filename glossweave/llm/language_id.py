"""Operator 7: language identification by unigram piece models whose word scores sum over all segmentations.

The vocabulary is that of a public SentencePiece file, its byte pieces included, so that every text can be segmented. Each learned
language has a probability for each piece, fitted by expectation-maximisation on a bounded sample of labelled documents. A word's
probability is the sum over all its segmentations (forward algorithm), a text's the product over its words, and the prediction is the
language with the largest posterior under equal priors; that posterior is the score.

Words are runs of bytes that aren't ASCII white space, A-Z lower-cased, and may have any length: the forward sums of a word are carried
over all of it, rescaled as they go, so a text without spaces is one word and all its segmentations count. Texts are scored whole where
they are read: no row is moved.

Every language of the labelled rows is learned, each in a task of its own, from about `sample` documents of at most `longest` bytes, or
fewer if they hold more than `most` bytes; a language that has longer documents only is learned from its shortest one. The model is
one column of 4-byte probabilities for each language (128 KB with the vocabulary used), whatever the number of documents.

Cases: a null text or one without any letter is `und` with score 0; so is every text if nothing could be learned; a null doc_id is
neither learned from nor held out; rows without lang aren't learned from but predicted; repeated rows are judged alike; ties between
languages go to the first by name; an empty table gives an empty result; identify() keeps all columns and adds lang_pred and score,
replacing columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..runtime import map_arrow
from .storage import materialise
from .text import Words, gathered, mix, powers, words
from .tokens import tokenizer_path

_LETTER = re.compile(r"[^\W\d_]")
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_CACHE = 1 << 20
#: Bytes of words whose arcs are held at once; a longer word is swept in sections of this size.
SECTION = 1 << 16
#: Steps after which forward sums are rescaled, and numbers (states times languages) held at once.
_SCALE, _HELD = 16, 1 << 22


@dataclass(frozen=True)
class Params:
    vocabulary: str = "piece_bpe_32k.model"
    #: The sample that is learned from: so many documents of each language (about), none over so many bytes, so many bytes in all.
    sample: int = 400
    longest: int = 1 << 16
    most: int = 1 << 23
    rounds: int = 5
    smoothing: float = 0.1


class Vocabulary:
    """Pieces by code; a word-initial piece starts with a space. Numbers 0..255 are the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        flat, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(x) for x in pieces])
        code = _codes(flat, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(code)
        self.code, self.longest, self.size = code[order], max(map(len, pieces)), len(pieces) + 256
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(code >> np.uint64(44)).view(np.int64)] = True

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, pieces) of the codes that are pieces."""
        rows = np.flatnonzero(self.maybe[(code >> np.uint64(44)).view(np.int64)])
        code = code[rows]
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        same = self.code[at] == code
        return rows[same], at[same] + 256


def _codes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the runs of bytes low[begin:end]."""
    power, back = powers(len(low))
    run = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[: len(low)], out=run[1:])
    return (run[end] - run[begin]) * back[begin]


class Arcs:
    """Everything that segments some words, in the order of its end: arcs from state to state, a state before and after each byte.

    low: the words' bytes one after the other; sizes: their lengths; head: arcs that end at one of a word's first `head` bytes are
    left out."""

    def __init__(self, vocabulary: Vocabulary, low: np.ndarray, sizes: np.ndarray, head: int = 0):
        n, words_ = len(low), len(sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if words_ else np.zeros(0, np.int64)
        self.last, self.states, self.steps, self.head = self.first + sizes, n + words_, int(sizes.max(initial=0)), head
        word = np.repeat(np.arange(words_), sizes)
        offset = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - offset
        power, back = powers(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * power[:n], out=run[1:])
        begin, size, piece = [np.arange(n)], [np.ones(n, np.int64)], [low.astype(np.int64)]
        for k in range(1, vocabulary.longest + 1):
            at = np.flatnonzero(left >= k)
            rows, found = vocabulary.find((run[at + k] - run[at]) * back[at])
            begin.append(at[rows])
            size.append(np.full(len(rows), k))
            piece.append(found)
        begin, size, piece = (np.concatenate(x) for x in (begin, size, piece))
        step = offset[begin] + size
        keep = np.flatnonzero(step > head)
        order = keep[np.lexsort((begin[keep], word[begin[keep]], step[keep]))]
        self.word = word[begin[order]].astype(np.int32)
        self.source = (begin[order] + self.word).astype(np.int32)
        self.target = (self.source + size[order]).astype(np.int32)
        self.piece = piece[order].astype(np.int32)
        self.bounds = np.searchsorted(step[order], np.arange(self.steps + 2))

    def forward(self, chances: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sums, logarithms of their scales) of every state, a column a language; start: the sums of one word's first states."""
        f, scale = np.zeros((self.states, chances.shape[1])), np.zeros((self.states, chances.shape[1]) if self.steps > _SCALE + self.head else (1, 1))
        if start is None:
            f[self.first] = 1
        else:
            f[: len(start)] = start
        now = np.zeros((len(self.first), chances.shape[1]))
        for s in range(self.head + 1, self.steps + 1):
            lo, hi = self.bounds[s], self.bounds[s + 1]
            source, target, word = self.source[lo:hi], self.target[lo:hi], self.word[lo:hi]
            part = f[source] * chances[self.piece[lo:hi]]
            if s > _SCALE + self.head:
                part *= np.exp(scale[source] - now[word])
            begins = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            to, who = target[begins], word[begins]
            f[to] = np.add.reduceat(part, begins)
            if len(scale) > 1:
                scale[to] = now[who]
                if (s - self.head) % _SCALE == 0:
                    now[who] += np.log(f[to])
        return f, scale

    def backward(self, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, logarithms of their scales) of every state, from the words' ends, for one language."""
        b, scale = np.zeros(self.states), np.zeros(self.states)
        b[self.last] = 1
        order = np.lexsort((self.source, self.first[self.word] - self.source))  # a state's arcs side by side, a word's last state first
        source, target, piece = self.source[order], self.target[order], self.piece[order]
        offset = source - self.first[self.word[order]]
        # all arcs of states with this many bytes before them; their targets lie behind
        bounds = np.searchsorted(-offset, -np.arange(self.steps, -2, -1))
        sizes = self.last - self.first
        now = np.zeros(len(self.first))
        word = self.word[order]
        for n, s in enumerate(range(self.steps, -1, -1)):
            lo, hi = bounds[n], bounds[n + 1]
            if lo == hi:
                continue
            begins = np.flatnonzero(np.concatenate([[True], source[lo + 1 : hi] != source[lo : hi - 1]]))
            to, who = source[lo:hi][begins], word[lo:hi][begins]
            part = b[target[lo:hi]] * chances[piece[lo:hi]] * np.exp(scale[target[lo:hi]] - now[word[lo:hi]])
            b[to] = np.add.reduceat(part, begins)
            scale[to] = now[who]
            again = (sizes[who] - s) % _SCALE == 0
            now[who[again]] += np.log(b[to[again]])
        return b, scale


def _lots(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of words, the short ones first, in lots of at most `most` bytes (or one word)."""
    order = np.argsort(sizes, kind="stable")
    total, at = np.cumsum(sizes[order]), 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield order[at:to]
        at = to


def _spaced(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some words' bytes one after the other, each with a space before it, and their lengths."""
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(starts - 1 - begin, sizes) + np.arange(sizes.sum())
    out = low[np.maximum(at, 0)]
    out[begin] = 32
    return out, sizes


def forward(vocabulary: Vocabulary, chances: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log probability of each word in each language (columns of chances), summed over segmentations."""
    out = np.zeros((len(starts), chances.shape[1]))
    for who in _lots(ends - starts + 1, SECTION):
        flat, sizes = _spaced(low, starts[who], ends[who])
        if len(flat) <= SECTION:
            out[who] = _sweep(Arcs(vocabulary, flat, sizes), chances, None)[0]
            continue
        carry = None  # one long word goes section by section, each with the last states of the one before
        for at in range(0, len(flat), SECTION):
            head = min(at, vocabulary.longest)
            part = flat[at - head : at + SECTION]
            log, carry = _sweep(Arcs(vocabulary, part, np.array([len(part)]), head), chances, carry, vocabulary.longest + 1)
            out[who] += log
    return out


def _sweep(arcs: Arcs, chances: np.ndarray, start: np.ndarray | None, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(logarithms of the words' last sums, last `tail` sums over the very last one), a few languages at a time."""
    step = max(1, _HELD // arcs.states)
    log, ends = [], []
    for k in range(0, chances.shape[1], step):
        f, scale = arcs.forward(chances[:, k : k + step], None if start is None else start[:, k : k + step])
        scale = np.broadcast_to(scale, f.shape)
        log.append(np.log(f[arcs.last]) + scale[arcs.last])
        ends.append(f[arcs.states - tail :] / f[-1] * np.exp(scale[arcs.states - tail :] - scale[-1]))
    return np.concatenate(log, axis=1), np.concatenate(ends, axis=1)


def _fit_one(vocabulary: Vocabulary, texts: list[str], p: Params) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over the distinct words of the texts."""
    counts: dict[bytes, int] = {}
    for w in (w for t in texts for w in t.encode().lower().split()):
        counts[w] = counts.get(w, 0) + 1
    times = np.array(list(counts.values()), float)
    low = np.frombuffer(b" ".join(counts) or b" ", np.uint8)
    sizes = np.array([len(w) for w in counts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    chances = np.full(vocabulary.size, 1 / vocabulary.size)
    lots = [(who, Arcs(vocabulary, *_spaced(low, starts[who], starts[who] + sizes[who]))) for who in _lots(sizes + 1, SECTION)]
    for _ in range(p.rounds):
        expected = np.full(vocabulary.size, p.smoothing)
        for who, arcs in lots:
            f, up = arcs.forward(chances[:, None])
            f, up = f[:, 0], np.broadcast_to(up[:, 0], arcs.states)
            b, down = arcs.backward(chances)
            whole = np.log(f[arcs.last]) + up[arcs.last]
            share = f[arcs.source] * chances[arcs.piece] * b[arcs.target] * np.exp(up[arcs.source] + down[arcs.target] - whole[arcs.word])
            expected += np.bincount(arcs.piece, times[who][arcs.word] * share, vocabulary.size)
        chances = expected / expected.sum()
    return chances


def held_out(doc_id: Column, n: int = 4) -> Column:
    """Whether crc32 of the id as text leaves 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray
    vocabulary: str


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Learn from rows with text, lang and doc_id that aren't held out: a sample drawn by a hash of doc_id."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    size = F.octet_length("text").cast("long")
    short = F.when(size <= p.longest, size)
    counts = rows.groupBy("lang").agg(F.count(short).alias("n"), F.sum(short).alias("bytes"), F.min(F.struct(size.alias("size"), "doc_id")).alias("least"))
    counts = materialise(counts.select("lang", F.least(F.lit(p.sample) / F.greatest("n", F.lit(1)), F.lit(p.most) / F.greatest("bytes", F.lit(1))).alias("share"), F.col("least.doc_id").alias("least")), "languages")
    drawn = rows.join(counts, "lang").where((F.col("doc_id") == F.col("least")) | ((size <= p.longest) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1e6 < F.col("share"))))
    drawn = drawn.select("lang", "doc_id", "text").repartition("lang").sortWithinPartitions("lang", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary | None = None
        now, texts, held = None, [], 0

        def learned() -> pa.RecordBatch:
            nonlocal vocabulary
            vocabulary = vocabulary or Vocabulary(tokenizer_path(p.vocabulary))
            chances = _fit_one(vocabulary, texts, p).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([chances.tobytes()], pa.binary())], ["lang", "chances"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if lang != now:
                    if texts:
                        yield learned()
                    now, texts, held = lang, [], 0
                # the draw is about so large; ids that repeat could make it larger
                if not texts or (len(texts) < 2 * p.sample and held < 2 * p.most):
                    texts.append(text)
                    held += len(text)
        if texts:
            yield learned()

    found = map_arrow(drawn, run, "lang string, chances binary").toArrow().sort_by("lang")
    columns = [np.frombuffer(x.as_buffer(), np.float32) for x in found.column("chances")]
    return Model(found.column("lang").to_pylist(), np.stack(columns, axis=1) if columns else np.zeros((0, 0), np.float32), p.vocabulary)


class _Scorer:
    """log probabilities of words with a direct-mapped cache by hash."""

    def __init__(self, model: Model):
        self.vocabulary, self.chances = Vocabulary(tokenizer_path(model.vocabulary)), model.chances.astype(float)
        self.slots = max(1 << 12, min(_CACHE, (1 << 23) // len(model.languages)))
        self.keys = np.zeros(self.slots, np.uint64)
        self.values = np.zeros((self.slots, len(model.languages)), np.float32)

    def texts(self, w: Words) -> np.ndarray:
        hashes, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        slot = (hashes % np.uint64(self.slots)).astype(np.int64)
        value = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != hashes)
        for at in range(0, len(miss), 100_000):
            some = miss[at : at + 100_000]
            value[some] = forward(self.vocabulary, self.chances, w.low, w.starts[first[some]], w.ends[first[some]])
        self.keys[slot[miss]], self.values[slot[miss]] = hashes[miss], value[miss]
        # of several new words in one slot the last one stays
        text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
        return np.stack([np.bincount(text, column[inverse], len(w.bounds) - 1) for column in value.T.astype(float)], axis=1)


def _lettered(w: Words, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter; only those without ASCII letters are decoded."""
    ascii_letter = np.concatenate([[0], np.cumsum((w.low >= 97) & (w.low <= 122))])
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts.cast(pa.large_binary())], np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    out = ascii_letter[edge[1:]] > ascii_letter[edge[:-1]]
    for i in np.flatnonzero(~out & (sizes > 0)):
        out[i] = bool(_LETTER.search(texts[int(i)].as_py()))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    given = docs.drop("lang_pred", "score")
    at = given.columns.index("text")
    schema = StructType([*given.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _Scorer(model) if model.languages else None
        for batch in batches:
            for lo, hi, w in gathered(words(batch.column(at)), max(1 << 18, min(1 << 21, (1 << 24) // max(1, len(model.languages))))):
                part = batch.slice(lo, hi - lo)
                pred, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if scorer:
                    log = scorer.texts(w)
                    best = log.argmax(axis=1)
                    sure = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                    for i in np.flatnonzero(_lettered(w, part.column(at))):
                        pred[i], score[i] = model.languages[best[i]], sure[i]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return map_arrow(given, run, schema)
