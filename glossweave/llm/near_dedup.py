"""Operator 10: near-duplicate documents by MinHash, banding, signature verification and connected components.

1. Every text becomes its set of word shingles (64-bit hashes), a 128-bit digest of that set, `bands` hashes of `rows` universal-hash
   minima each, and one byte of every minimum. Texts with equal sets form a class, which its least row represents from here on.
2. Two classes that share a band are candidates. A bucket isn't expanded into pairs: its members are compared with one pivot, the
   member that meets most others over all its bands. A pivot's set goes to one place, or to `_SPREAD` if it has a large
   share of all pairs, and members to it. Links found so far
   give components. Where a bucket still holds several, its members are dealt to blocks of bounded size, and the blocks of that
   bucket are compared in pairs inside tasks that emit links alone; of buckets with the same members one is enough. No bucket is capped.
3. Candidates whose signatures agree too little are dropped (six standard deviations below the threshold); the others are confirmed
   on the full shingle sets, made again from the texts of candidates only.
4. Large-star and small-star steps give the components. Least ids are combined by class, then by component, and come back in joins
   that don't move the rows of large classes and components.

With 56 bands of 5 rows two sets of similarity 0.75 share no band with a chance of 3e-7, more similar ones with less.
Cases: a null or blank text has an empty set, is linked with nothing and kept; a row without doc_id has a null component, links
nothing and is kept; repeated rows with one doc_id and text share a component, and drop_near_duplicates() keeps one row of each component,
of its least doc_id; an empty table gives an empty result; other columns of the input are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow, ship
from .components import components
from .skew import join_counted
from .storage import drop, materialise
from .text import mix, words

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    #: Links need least_num * union <= least_den * intersection.
    least_num: int = 75
    least_den: int = 100
    #: At most 64.
    bands: int = 56
    rows: int = 5
    seed: int = 7

    @property
    def floor(self) -> float:
        """The least share of equal signature bytes: six standard deviations below the threshold."""
        t = self.least_num / self.least_den
        t += (1 - t) / 256
        return t - 6 * (t * (1 - t) / (self.bands * self.rows)) ** 0.5


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text with fewer words has one, all its words."""
    n = len(hashes)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        whole = whole * _STEP + hashes[j : n - size + 1 + j] if len(whole) else whole
    whole = mix(whole)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(whole[lo : hi - size + 1]))
        elif hi > lo:
            one = np.zeros(1, np.uint64)
            for h in hashes[lo:hi]:
                one = one * _STEP + h
            out.append(mix(one + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b""


def signatures(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """Minima of bands * rows universal hashes over each (non-empty) set: one row a set."""
    rng = np.random.default_rng(p.seed)
    k = p.bands * p.rows
    a, b = rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, spare = np.empty((k, len(sets)), np.uint32), np.empty_like(x)
    for i in range(k):
        np.multiply(x, a[i], out=spare)
        np.add(spare, b[i], out=spare)
        np.minimum.reduceat(spare, at, out=out[i])
    return out.T


def _profiles(docs: DataFrame, p: Params) -> DataFrame:
    """A row a document: rid (unique), doc_id, n_shingles, key (digest of the set), bands, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, w in words(batch.column(1)):
                sets = shingle_sets(w.hashes, w.bounds, p.shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                sig: list = [None] * len(sets)
                for at in range(0, len(full), 4096):
                    some = full[at : at + 4096]
                    minima = signatures([sets[i] for i in some], p)
                    low = minima.astype(np.uint8)
                    grouped = np.zeros((len(some), p.bands), np.uint64)
                    for j in range(p.rows):
                        grouped = grouped * _STEP + minima[:, j :: p.rows].astype(np.uint64) + np.uint64(1)
                    column = np.arange(p.bands, dtype=np.uint64)
                    # a band's low bits are its column
                    grouped = (mix(grouped + column * _STEP) & ~np.uint64(63) | column).view(np.int64)
                    for n, i in enumerate(some):
                        bands[i], sig[i] = grouped[n], low[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + hi - lo)),
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sig, pa.binary()),
                    ],
                    ["rid", "doc_id", "n_shingles", "key", "bands", "sig"],
                )
                rid += hi - lo

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(given, run, "rid long, doc_id long, n_shingles long, key binary, bands array<long>, sig binary")


#: Places of a membership bitmap: its size doesn't depend on the number of ids.
_PLACES = 1 << 23


def _perhaps(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of ids (doc_id, a long) by a bitmap of their hashes: never false for one of them, seldom true for others.

    It keeps rows that a join would drop anyway out of the join's shuffle, texts above all."""
    ship(ids.sparkSession)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_PLACES))
    bits = np.zeros(_PLACES, bool)
    bits[ids.select(place(F.col("doc_id")).alias("place")).distinct().toArrow().column("place").to_numpy()] = True
    shared = ids.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        table, n = np.frombuffer(shared.value, np.uint8), at.to_numpy()
        return pd.Series((table[n >> 3] >> (7 - (n & 7)).astype(np.uint8) & 1).astype(bool))

    return lambda c: held(place(c))


def _only(classes: DataFrame, rids: DataFrame) -> DataFrame:
    """classes without most of those that aren't in rids (rid): they needn't be shuffled."""
    return classes.where(_perhaps(rids.select(F.col("rid").alias("doc_id")))(F.col("rid")))


def _agreeing(pairs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Pairs (pivot, rid) of classes whose signatures agree in enough bytes."""
    need = p.floor * p.bands * p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select(["pivot", "rid"]).filter(pa.array((left == right).sum(1) >= need))

    sig = materialise(_only(classes, pairs.select(F.explode(F.array("pivot", "rid")).alias("rid"))).select("rid", "sig"), "signatures")
    joined = pairs.join(sig.toDF("pivot", "sig_p"), "pivot").join(sig.toDF("rid", "sig_r"), "rid").select("pivot", "rid", "sig_p", "sig_r")
    return map_arrow(joined, run, "pivot long, rid long")


def _sets(rids: DataFrame, docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """(rid, shingles) of the classes in rids (distinct), made again from the texts of those alone."""
    wanted = classes.join(rids, "rid", "left_semi").select("rid", "key", F.col("doc_id").alias("wanted_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in words(batch.column(2)):
                found = shingle_sets(w.hashes, w.bounds, p.shingle)
                keep = [i for i, (s, k) in enumerate(zip(found, batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True)) if digest(s) == k]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["rid", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = texts.where(_perhaps(wanted.select(F.col("wanted_id").alias("doc_id")))(F.col("doc_id")))
    # a doc_id of several rows brings texts of other sets too (dropped by the digest); equal rows are dropped after
    # merged, never broadcast: the test of texts and the sets in one stage would take two Python workers a core
    own = wanted.hint("merge").join(texts, F.col("wanted_id") == F.col("doc_id")).select("rid", "key", "text")
    return map_arrow(own, sets, "rid long, shingles binary").dropDuplicates(["rid"])


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


#: Places that the members of a hot pivot are dealt to; a pivot is hot with over 1000 pairs and more than one in so many of all.
_SPREAD, _HOT = 256, 10_000


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) of the pairs (pivot, rid) whose full sets are similar enough."""
    own = _sets(pairs.select(F.explode(F.array("pivot", "rid")).alias("rid")).distinct(), docs, classes, p)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for now, rid, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                y = np.frombuffer(raw.as_buffer(), np.uint64)
                if rid is None:  # the pivot's own set comes before those of its members
                    pivot, x = now, y.copy()
                elif now == pivot:
                    shared = _shared(x, y)
                    if p.least_den * shared >= p.least_num * (len(x) + len(y) - shared):
                        links.append((min(pivot, rid), max(pivot, rid)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    hot = pairs.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > max(1000, pairs.count() // _HOT)).select("pivot", F.lit(_SPREAD).alias("spread"))
    dealt = pairs.join(F.broadcast(hot), "pivot", "left").select("pivot", "rid", F.pmod(F.xxhash64("rid"), F.coalesce("spread", F.lit(1))).alias("place"))
    # one join, on what already deals the sets by rid
    centres = dealt.select("pivot", "place").distinct().select("pivot", "place", F.lit(None).cast("long").alias("member"), F.col("pivot").alias("rid"))
    ends = centres.unionByName(dealt.select("pivot", "place", F.col("rid").alias("member"), "rid"))
    met = own.join(ends, "rid").select("pivot", "place", F.col("member").alias("rid"), "shingles")
    met = met.repartition("pivot", "place").sortWithinPartitions("pivot", "place", F.asc_nulls_first("rid"))
    return materialise(map_arrow(met, similar, "a long, b long"), "links")


#: Shingles in a block of documents (a document counts for 512 at least).
_BLOCK = 1 << 18


def _alike(i: int, size: np.ndarray, sig: np.ndarray, root: np.ndarray, side: np.ndarray, p: Params) -> np.ndarray:
    """Members of the other block, of another root than i's, whose sizes and signatures allow a link to it."""
    right = np.flatnonzero((root != root[i]) & ((side == 1) if side[i] == 0 else np.arange(len(size)) > i))
    right = right[p.least_den * np.minimum(size[i], size[right]) >= p.least_num * np.maximum(size[i], size[right])]
    return right[(sig[right] == sig[i]).sum(1) >= p.floor * p.bands * p.rows]


def block_links(sets: list[np.ndarray], sig: np.ndarray, root: np.ndarray, side: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Similar pairs of two blocks (side 0 and 1; 2: one block with itself) whose roots differ."""
    size = np.array([len(s) for s in sets], np.int64)
    out, column = [], None
    for i in np.flatnonzero(side != 1):
        right = _alike(i, size, sig, root, side, p)
        if len(right) > 8:
            if column is None:
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                order = np.argsort(flat, kind="stable")
                column, owner = flat[order], owner[order]
            lo, hi = np.searchsorted(column, sets[i], "left"), np.searchsorted(column, sets[i], "right")
            total = np.cumsum(hi - lo)
            shared = np.bincount(owner[np.repeat(lo - total + (hi - lo), hi - lo) + np.arange(total[-1])], minlength=len(sets))[right]
        else:
            shared = np.array([_shared(sets[i], sets[j]) for j in right], np.int64)
        out += [(i, j) for j in right[p.least_den * shared >= p.least_num * (size[i] + size[right] - shared)]]
    return out


def _by_task(given: DataFrame, function: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """function over the rows of each task (first column), all of them at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    if now is not None and row[0] != now:
                        yield function(held)
                        held = []
                    now = row[0]
                    held.append(row)
        if held:
            yield function(held)

    return map_arrow(given.repartition("task").sortWithinPartitions("task"), run, schema)


def _between(rest: DataFrame, docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """All links between members (band, rid, root, n_shingles) of one bucket whose roots differ.

    A bucket's members are dealt to blocks of bounded size, those of a large root to blocks of its own, and each pair of its blocks that
    can hold different roots is compared inside one task, first by signatures, then by the sets of those that are alike. Only members
    and links leave it."""
    # near copies share many bands: of buckets with the same members the one of the first column is enough
    marks = rest.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("rid", F.lit(1)).cast("decimal(38,0)")).alias("h2"))
    buckets = marks.groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("band").bitwiseAND(63).alias("column"), "band"))["band"].alias("band")).select("band")
    named = materialise(rest.join(buckets, "band", "left_semi").select("rid", "root", "n_shingles", F.col("band").alias("grp")), "buckets")
    weight = F.sum(F.greatest("n_shingles", F.lit(512))).alias("weight")
    by_root = named.groupBy("grp", "root").agg(weight).withColumn("own", F.col("weight") > _BLOCK)
    small = by_root.where("not own").groupBy("grp").agg(F.sum("weight").alias("small"))
    plan = by_root.join(small, "grp", "left").select("grp", "root", "own", F.ceil(F.when(F.col("own"), F.col("weight")).otherwise(F.col("small")) / _BLOCK).alias("k"))
    members = named.join(plan, ["grp", "root"]).withColumn("owner", F.when(F.col("own"), F.col("root")).otherwise(-1)).withColumn("n", F.pmod(F.xxhash64(F.when(F.col("own"), F.col("rid")).otherwise(F.col("root"))), F.col("k")))
    members = materialise(members.select("rid", "root", "grp", "owner", "n"), "blocks")
    blocks = members.select("grp", "owner", "n").distinct()
    other = blocks.select("grp", F.col("owner").alias("owner2"), F.col("n").alias("n2"))
    ordered = F.struct("owner", "n") <= F.struct(F.col("owner2").alias("owner"), F.col("n2").alias("n"))
    tasks = blocks.join(other, "grp").where(ordered & ((F.col("owner") != F.col("owner2")) | (F.col("owner") == -1)))
    tasks = tasks.withColumn("task", F.xxhash64("grp", "owner", "n", "owner2", "n2"))
    same = (F.col("owner") == F.col("owner2")) & (F.col("n") == F.col("n2"))
    first = tasks.select("grp", "owner", "n", "task", F.when(same, 2).otherwise(0).alias("side"))
    second = tasks.where(~same).select("grp", F.col("owner2").alias("owner"), F.col("n2").alias("n"), "task", F.lit(1).alias("side"))
    sides = first.unionByName(second)
    own = materialise(_only(classes, members.select("rid")).select("rid", "sig", "bands", "n_shingles"), "own")
    signed = members.join(sides, ["grp", "owner", "n"]).select("task", "side", "rid", "root", "grp").join(own, "rid")
    signed = signed.select("task", "side", "rid", "root", "sig", "n_shingles", "bands", "grp")

    def candidates(held: list[tuple]) -> pa.RecordBatch:
        task, side, rid, root, sig, size, bands, grp = zip(*held, strict=True)
        side, root, size, bands = np.array(side), np.array(root), np.array(size), np.array(bands)
        sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
        some = np.zeros(len(rid), bool)
        for i in np.flatnonzero(side != 1):
            right = _alike(i, size, sig, root, side, p)
            # a pair is compared where it meets first
            right = right[(bands[right] == bands[i]).argmax(1) == grp[0] & 63] if len(right) else right
            some[right] = True
            some[i] |= len(right) > 0
        some = np.flatnonzero(some)
        return pa.RecordBatch.from_arrays([pa.array([c[i] for i in some], pa.int64()) for c in (task, side, rid, root)], ["task", "side", "rid", "root"])

    # most members of a bucket meet nobody that is alike: signatures say so, and only the others' sets are moved
    met = materialise(_by_task(signed, candidates, "task long, side long, rid long, root long"), "alike")
    sets = _sets(met.select("rid").distinct(), docs, classes, p).join(_only(own, met).select("rid", "sig"), "rid")
    given = sets.join(met, "rid").select("task", "side", "rid", "root", "sig", "shingles")

    def confirmed(held: list[tuple]) -> pa.RecordBatch:
        _, side, rid, root, sig, raw = zip(*held, strict=True)
        found = block_links([np.frombuffer(x, np.uint64) for x in raw], np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1), np.array(root), np.array(side), p)
        return pa.RecordBatch.from_arrays([pa.array([min(rid[i], rid[j]) for i, j in found], pa.int64()), pa.array([max(rid[i], rid[j]) for i, j in found], pa.int64())], ["a", "b"])

    out = materialise(_by_task(given, confirmed, "a long, b long").distinct(), "links")
    for table in (named, members, own, met):
        drop(table)
    return out


def link(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, key, component_id, first) of every row; first: whether its class and doc_id are its component's to keep."""
    written: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        written.append(materialise(df, name))
        return written[-1]

    rows = kept(_profiles(docs, p), "profiles")
    linked = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # the class's least row stands for it
    reps = kept(linked.groupBy("key").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count("*").alias("rows")), "representatives")
    # most rows are the only ones of their classes: those that may not be are few to move
    doubles = kept(linked.select("rid").join(reps.select("rid"), "rid", "left_anti"), "doubles")
    maybe = _perhaps(doubles.select(F.col("rid").alias("doc_id")))(F.col("rid"))
    split = linked.withColumn("double", maybe)
    doubtful = split.where("double").join(doubles, "rid", "left_anti")
    classes = kept(split.where("not double").unionByName(doubtful).drop("double"), "classes")
    band = classes.select("rid", "n_shingles", F.explode("bands").alias("band")).repartition("band")
    shared = band.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = kept(band.join(shared, "band"), "members")
    weight = members.groupBy("rid").agg(F.sum("size").alias("weight"))
    # the order of pivots is one over all buckets, so a pair comes only one way round
    most = F.struct("weight", -F.col("rid"))
    pivots = members.join(weight, "rid").groupBy("band").agg(F.max_by("rid", most).alias("pivot"), F.max_by("n_shingles", most).alias("pivot_n"))
    close = lambda n, m: p.least_den * F.least(n, m) >= p.least_num * F.greatest(n, m)
    stars = members.join(pivots, "band").where((F.col("rid") != F.col("pivot")) & close(F.col("n_shingles"), F.col("pivot_n"))).select("pivot", "rid").distinct()
    tried = kept(_agreeing(kept(stars, "stars"), classes, p), "tried")
    written.append(links := _confirmed(tried, docs, classes, p))
    written.append(roots := components(links))

    # what a star can't show: links between members of one bucket that no chain of links joins yet
    labelled = members.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    open_ = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rest = kept(labelled.join(open_, "band", "left_semi").select("band", "rid", "root", "n_shingles"), "rest")
    if not rest.isEmpty():
        written.append(more := _between(rest, docs, classes, p))
        written.append(roots := components(links.unionByName(more)))

    # class -> component -> least doc_id
    placed = kept(reps.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("key", "least", "rows", F.coalesce("root", "rid").alias("root")), "placed")
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct("least", "key"))["key"].alias("best"), F.count("*").alias("rows"))
    total = rows.count()
    of_key = kept(join_counted(placed.withColumnRenamed("rows", "own"), of_root, ["root"], total).select("key", "component_id", "best", F.col("own").alias("rows")), "classes")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("best"))
    found = join_counted(linked.select("doc_id", "n_shingles", "key"), of_key, ["key"], total).select("doc_id", "n_shingles", "key", "component_id", first.alias("first"))
    others = rows.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", "key", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    out = materialise(found.unionByName(others), "linked")
    for table in written:
        drop(table)
    return out


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    return link(docs, p).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _free(columns: list[str], name: str) -> str:
    """A column name that isn't among these, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def drop_near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs but for all except one of each group; all columns stay. Rows without doc_id and without words stay.

    Of rows that repeat the doc_id and the words of the one to keep, one stays (which, if other columns differ, isn't said)."""
    found = link(docs, p).where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "key").agg(F.max("first").alias("stays"), F.count("*").alias("n"))
    doubtful = materialise(found.where("not stays or n > 1").select("doc_id", "key", "stays"), "doubtful")
    # rows of other ids surely stay and needn't be shuffled
    mark, key, row = (_free(docs.columns, x) for x in ("__maybe", "__key", "__row"))
    maybe = F.coalesce(_perhaps(doubtful)(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.lit(False)) & F.col("doc_id").isNotNull()
    marked = docs.withColumn(mark, maybe)

    @F.pandas_udf("binary")
    def set_key(texts: pd.Series) -> pd.Series:
        parts = words(pa.array(texts, pa.string(), from_pandas=True))
        return pd.Series([digest(s) for _, _, w in parts for s in shingle_sets(w.hashes, w.bounds, p.shingle)], dtype=object)

    # written between the two functions: both in one stage would take two Python workers a core
    some = materialise(marked.where(mark).drop(mark).withColumn(row, F.monotonically_increasing_id()), "marked")
    some = materialise(some.withColumn(key, set_key(F.col("text").cast("string"))), "doubtful")
    named = some.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"))
    best = named.groupBy("doc_id", "key").agg(F.min(row).alias("best"), F.count("*").alias("rows")).join(doubtful, ["doc_id", "key"])
    judged = join_counted(named, best.select("doc_id", "key", F.when(F.col("stays"), F.col("best")).alias("best"), "rows"), ["doc_id", "key"], some.count())
    gone = judged.where(F.col("best").isNull() | (F.col("best") != F.col(row))).select(row)
    left = some.join(gone, row, "left_anti").select(*docs.columns)
    return marked.where(~F.col(mark)).select(*docs.columns).unionByName(left)
