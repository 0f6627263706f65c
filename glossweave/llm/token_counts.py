"""Operator 3: token counts of documents in flat, unindexed token files, by a separator scan.

A flat file is nothing but ids (unsigned little-endian integers of 2 or 4 bytes), each document closed by the end-of-document id.
Files are cut into blocks of equal size without looking at them. Each block is scanned by itself in one vectorised comparison; what a
block can't know (how many documents ended before it, and where the last one ended) comes from a prefix scan over the blocks' counts
and last separators. So a document may span any number of blocks and files of any size are scanned in parallel.

Cases: two separators side by side are an empty document of 0 tokens; ids after the last separator are a document that isn't closed;
an empty file has no documents; null and empty texts are written as the separator alone; a null doc_id stays null; an empty table
writes no files; other columns play no part. write_flat() encodes special strings in texts as ordinary text, so that the separator can't
stand inside a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .storage import file_system, materialise, read_range, write_file
from .tokens import encoder, tokenizer_path, with_end


def write_flat(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 49407) -> DataFrame:
    """One flat file a partition of docs (doc_id, text), which moves no rows. Returns doc_id, file, ordinal (from 0) of every document."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, out = encoder(tokenizer_path(tokenizer), plain=True), f"part-{TaskContext.get().partitionId()}.ids", []
        width = width_of(coder.tokenizer.get_vocab_size(), end_id)

        def parts() -> Iterator[bytes]:
            for batch in batches:
                out.append(batch.column(0).to_pylist())
                for lo in range(0, batch.num_rows, 256):
                    yield with_end(*coder.encode(batch.column(1).slice(lo, 256).to_pylist()), end_id)[0].astype(f"<u{width}").tobytes()

        first = next(it := parts(), None)
        if first is None:
            return
        write_file(f"{path}/{file}", (x for y in ([first], it) for x in y))
        at = 0
        for ids in out:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([file] * len(ids)), pa.array(np.arange(at, at + len(ids)))], ["doc_id", "file", "ordinal"])
            at += len(ids)

    return materialise(map_arrow(given, write, "doc_id long, file string, ordinal long"), "order")


def width_of(vocabulary: int, end_id: int) -> int:
    """Bytes of an id in a flat file."""
    return 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4


def scan(spark: SparkSession, path: str, end_id: int, width: int, block: int = 1 << 22) -> DataFrame:
    """file, ordinal, start, n_tokens (without the separator), closed of every document in the flat files of a folder."""
    from pyarrow import fs

    system, folder = file_system(path)
    found = [(f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    files = spark.createDataFrame(found, "file string, size long")
    ids = max(1, block // width)
    blocks = files.select("file", F.col("size").alias("bytes"), F.explode(F.expr(f"sequence(0L, greatest(0L, (size div {width} - 1) div {ids}))")).alias("block")).where("bytes > 0")
    blocks = blocks.repartition(max(1, min(10_000, sum(-(-s // block) for _, s in found))), "file", "block")

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block_no in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(read_range(f"{path}/{file}", block_no * ids * width, ids * width), f"<u{width}")
                at = np.flatnonzero(data == end_id) + block_no * ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block_no]), pa.array([block_no * ids + len(data)]), pa.array([at.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "stop", "ends"],
                )

    scanned = materialise(map_arrow(blocks, separators, "file string, block long, stop long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", F.size("ends").cast("long").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    prefix = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("ended"), F.coalesce(F.max("last").over(before), F.lit(-1)).cast("long").alias("edge"))
    joined = scanned.join(prefix, ["file", "block"])
    closed = joined.select("file", "ended", "edge", "ends", F.posexplode("ends").alias("i", "end"))
    begin = F.when(F.col("i") == 0, F.col("edge")).otherwise(F.element_at("ends", F.greatest(F.col("i"), F.lit(1)))) + 1
    closed = closed.select("file", (F.col("ended") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = scanned.groupBy("file").agg(F.max("stop").alias("stop"), F.sum(F.size("ends")).cast("long").alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("last"))
    rest = whole.where("stop > last + 1").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("stop") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)
