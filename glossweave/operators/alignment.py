"""Word alignment: numerical kernels over a similarity matrix, and the operator that runs them with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written
from ..runtime import ship

# Languages written without spaces, stemmer languages, models and their least link scores.
UNSPACED = ("ja", "zh", "th")
STEMMERS = {
    "cs": "czech", "sk": "czech", "de": "german", "el": "greek", "es": "spanish", "et": "estonian", "fi": "finnish", "fr": "french", "hu": "hungarian",
    "it": "italian", "nl": "dutch", "pl": "polish", "pt": "portuguese", "ro": "romanian", "ru": "russian", "sr": "serbian", "tr": "turkish",
}
LEAST_SCORE = {"bert-base-multilingual-cased": 0.55, "xlm-roberta-base": 0.75}
DEFAULT_MODEL, MODEL_FOR = "bert-base-multilingual-cased", {"th": "xlm-roberta-base"}
ALGORITHM = "3"

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+(?:['’-][\p{L}\p{N}\p{M}]+)*")


class Encoder(Protocol):
    """Gives each unit of each text a vector; `units` cuts a text into (start, end) spans."""

    def units(self, text: str, unspaced: bool) -> list[tuple[int, int]]: ...

    def encode(self, texts: list[str], spans: list[list[tuple[int, int]]]) -> list[np.ndarray]: ...


class HashEncoder:
    """A stand-in without a model: the vector of a unit is that of its character trigrams, so like-spelt words are similar."""

    def __init__(self, dimensions: int = 128):
        self.dimensions = dimensions

    def units(self, text: str, unspaced: bool) -> list[tuple[int, int]]:
        if unspaced:
            return [(i, i + 1) for i, c in enumerate(text) if regex.match(r"[\p{L}\p{N}\p{M}]", c)]
        return [m.span() for m in _WORD.finditer(text)]

    def encode(self, texts: list[str], spans: list[list[tuple[int, int]]]) -> list[np.ndarray]:
        import zlib

        out = []
        for text, own in zip(texts, spans, strict=True):
            vectors = np.zeros((len(own), self.dimensions), np.float32)
            for n, (a, b) in enumerate(own):
                padded = f" {text[a:b].lower()} "
                for i in range(max(1, len(padded) - 2)):
                    vectors[n, zlib.crc32(padded[i : i + 3].encode()) % self.dimensions] += 1
            out.append(unit_rows(vectors))
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def pooled(subwords: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    """Word vectors: the mean of a word's normalised subword vectors, normalised again."""
    out = np.zeros((words, subwords.shape[1]), np.float32)
    np.add.at(out, owner, unit_rows(subwords))
    return unit_rows(out / np.maximum(np.bincount(owner, minlength=words), 1)[:, None])


def mutual_argmax(sim: np.ndarray) -> np.ndarray:
    """Mask of the cells that are the first maximum of their row and of their column."""
    mask = np.zeros(sim.shape, bool)
    if sim.size:
        rows = np.arange(len(sim))
        best = sim.argmax(axis=1)
        hit = sim.argmax(axis=0)[best] == rows
        mask[rows[hit], best[hit]] = True
    return mask


def itermax(sim: np.ndarray, rounds: int = 2, alpha: float = 0.9) -> np.ndarray:
    """Mutual maxima of similarities that count in full where row and column are both free, `alpha` of them where one is, and not at all
    where none is; what each round finds is taken in the next. Before the first round all is free, so it gives mutual_argmax.

    Two rows or columns have no second round, and none comes once all rows or all columns are taken."""
    gain = np.minimum(alpha * np.arange(3), 1.0)
    links = np.zeros(sim.shape, bool)
    for _ in range(rounds if min(sim.shape, default=0) > 2 else 1):
        sides = np.add.outer(~links.any(axis=1), ~links.any(axis=0), dtype=int)
        if sides.max(initial=0) == 2:
            links |= mutual_argmax(sim * gain[sides]) & (sides > 0)
    return links


def _run(flags: np.ndarray, most: int) -> int:
    """Length of the run of true flags at the front, `most` at most."""
    stop = np.flatnonzero(~flags[:most])
    return int(stop[0]) if len(stop) else min(most, len(flags))


def grow_spans(sim: np.ndarray, links: np.ndarray, most: int) -> list[tuple[int, int] | None]:
    """Target span of each source word: what its links cover, and on both sides up to `most` units that no word is linked to and
    that are most similar to this one."""
    loose = np.where(links.any(axis=0), -1, sim.argmax(axis=0) if len(sim) else -1)  # the word that a unit may be taken by
    spans: list[tuple[int, int] | None] = [None] * len(links)
    for i in np.flatnonzero(links.any(axis=1)):
        own = np.flatnonzero(links[i])
        mine = loose == i
        spans[i] = int(own[0]) - _run(mine[: own[0]][::-1], most), int(own[-1]) + _run(mine[own[-1] + 1 :], most)
    return spans


def scores(sim: np.ndarray, links: np.ndarray) -> list[float | None]:
    """The best similarity of each source word over its links, three digits."""
    return [round(float(s[m].max()), 3) if m.any() else None for s, m in zip(sim, links, strict=True)]


def stem(word: str, lang: str) -> str:
    """Lower case; languages without spaces as they are; by snowballstemmer where it is installed, else five characters."""
    w = word.lower()
    if lang in UNSPACED:
        return w
    if lang in STEMMERS:
        try:
            import snowballstemmer
        except ImportError:
            return w[:5]
        return snowballstemmer.stemmer(STEMMERS[lang]).stemWord(w)
    return w[:5]


@dataclass(frozen=True)
class Routing:
    """Which model a language is aligned by."""

    default: str = DEFAULT_MODEL
    by_language: tuple[tuple[str, str], ...] = tuple(MODEL_FOR.items())

    def of(self, lang: str) -> str:
        return dict(self.by_language).get(lang, self.default)

    def column(self, lang: Column) -> Column:
        out = F.lit(self.default)
        for code, model in self.by_language:
            out = F.when(lang == code, model).otherwise(out)
        return out


RESULT = (
    "id long, src_words array<string>, tgt_units array<string>, tgt_stems array<string>, joiner string, "
    "links array<struct<i:int,j:int>>, spans array<struct<lo:int,hi:int>>, scores array<double>"
)


def align_pair(src: str, tgt: str, lang: str, encoder: Encoder, method: str = "itermax", known: dict | None = None) -> dict:
    """One row of RESULT without its id. known: spans and vectors of sources that were encoded before, kept for the next pairs."""
    unspaced = lang in UNSPACED
    known = {} if known is None else known
    if src not in known:
        known.clear()
        own = encoder.units(src, False)
        known[src] = own, encoder.encode([src], [own])[0] if own else None
    (own, x), theirs = known[src], encoder.units(tgt, unspaced)
    source, target = [src[a:b] for a, b in own], [tgt[a:b] for a, b in theirs]
    out = {"src_words": source, "tgt_units": target, "tgt_stems": [stem(w, lang) for w in target], "joiner": "" if unspaced else " "}
    if not source or not target:
        return out | {"links": [], "spans": [None] * len(source), "scores": [None] * len(source)}
    sim = x @ encoder.encode([tgt], [theirs])[0].T
    links = itermax(sim) if method == "itermax" else mutual_argmax(sim)
    grown = grow_spans(sim, links, 8 if unspaced else 2)
    return out | {
        "links": [{"i": int(i), "j": int(j)} for i, j in zip(*np.nonzero(links), strict=True)],
        "spans": [None if s is None else {"lo": s[0], "hi": s[1]} for s in grown],
        "scores": scores(sim, links),
    }


def align(requests: DataFrame, encoder: Callable[[str], Encoder] | None = None, routing: Routing = Routing(), method: str = "itermax") -> DataFrame:
    """RESULT for requests (id, lang, src, tgt). encoder(model) is made once a task and model.

    Pairs are dealt by source, so that a source is encoded once a model, however many languages it has."""
    make = encoder or (lambda _: HashEncoder())
    ship(requests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Encoder] = {}
        known: dict[str, dict] = {}
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                model = routing.of(r.lang)
                if model not in made:
                    made[model] = make(model)
                rows.append({"id": r.id} | align_pair(r.src, r.tgt, r.lang, made[model], method, known.setdefault(model, {})))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.replace("struct<i:int,j:int>", "s").replace("struct<lo:int,hi:int>", "s").split(", ")])

    return requests.select("id", "lang", "src", "tgt").repartition("src").sortWithinPartitions("src").mapInPandas(run, RESULT)


def request_keys(requests: DataFrame, routing: Routing = Routing(), layer: int = 8, method: str = "itermax") -> DataFrame:
    """requests with k, the content address of each in an alignment cache."""
    return requests.withColumn("k", T.cache_key(F.lit(ALGORITHM), routing.column(F.col("lang")), F.lit(str(layer)), F.lit(method), F.col("lang"), F.col("src"), F.col("tgt")))


# --- the same kernels over a long table of similarities (pair, i, j, s) --------------------------------------------------------


def cosine_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, i, j, s: cosine of all units of a pair. left: pair, i, v (array of double); right: pair, j, w."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    unit = lambda name: dot(F.col(name), F.col(name))
    return left.join(right, "pair").select("pair", "i", "j", (dot(F.col("v"), F.col("w")) / F.sqrt(unit("v") * unit("w"))).alias("s"))


def mutual_argmax_table(sim: DataFrame) -> DataFrame:
    """The cells of sim (pair, i, j, s, ...) that are first maxima of row and column."""
    row = F.row_number().over(Window.partitionBy("pair", "i").orderBy(F.desc("s"), "j"))
    column = F.row_number().over(Window.partitionBy("pair", "j").orderBy(F.desc("s"), "i"))
    best = sim.withColumn("row_rank", row).withColumn("column_rank", column).where("row_rank = 1 and column_rank = 1")
    return best.select("pair", "i", "j", "s", *[c for c in sim.columns if c not in ("pair", "i", "j", "s")])


def itermax_table(sim: DataFrame, alpha: float = 0.9) -> DataFrame:
    """pair, i, j, s of the cells that itermax links in two rounds."""
    first = written(mutual_argmax_table(sim), "links")
    taken = sim.join(first.select("pair", "i").withColumn("r", F.lit(1)), ["pair", "i"], "left").join(first.select("pair", "j").withColumn("c", F.lit(1)), ["pair", "j"], "left")
    sides = 2 - F.coalesce("r", F.lit(0)) - F.coalesce("c", F.lit(0))
    weighed = taken.withColumn("sides", sides).withColumn("s0", F.col("s")).withColumn("s", F.col("s") * F.least(F.lit(alpha) * F.col("sides"), F.lit(1.0)))
    # pairs of over two rows and columns in which some row and some column are free
    sizes = weighed.groupBy("pair").agg(F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("columns"), F.max("sides").alias("most"))
    again = weighed.join(sizes.where("least(rows, columns) > 2 and most = 2").select("pair"), "pair", "left_semi")
    more = mutual_argmax_table(again).where("sides > 0").select("pair", "i", "j", F.col("s0").alias("s"))
    return first.select("pair", "i", "j", "s").unionByName(more)


def spans_table(sim: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """pair, i, lo, hi: the span of every linked row over the columns, which count from 0 in the order of j; by grow_spans, a pair a call."""
    ship(sim.sparkSession)
    marked = sim.join(links.select("pair", "i", "j", F.lit(True).alias("linked")), ["pair", "i", "j"], "left").select("pair", "i", "j", "s", F.coalesce("linked", F.lit(False)).alias("linked"))

    def spans(cells: pd.DataFrame) -> pd.DataFrame:
        wide = cells.pivot(index="i", columns="j", values="s"), cells.pivot(index="i", columns="j", values="linked")
        grown = grow_spans(wide[0].to_numpy(), wide[1].to_numpy().astype(bool), most)
        return pd.DataFrame([(cells["pair"].iloc[0], i, *s) for i, s in zip(wide[0].index, grown, strict=True) if s is not None], columns=["pair", "i", "lo", "hi"])

    # a pair is two sentences: its cells are one call's
    return marked.groupBy("pair").applyInPandas(spans, "pair long, i long, lo long, hi long")
