import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossweave.llm import id_store, packing, token_counts
from glossweave.llm.queries import CONTEXT, LIMITS
from glossweave.llm.packing import Limits, Packer
from glossweave.llm.tokens import Encoder

ODD = ["a", "É", " ", "  ", "\n", " \n", "\t", "'s", "'", "''ll", "1", "½", "!", "日本", "\x01", "\x1c", "\xa0", "µ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "THE", "don't", "é"]


def documents(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["alpha", "beta,", "gamma.\nDelta", "x1", "día"]) for _ in range(r.choice([1, 5, 80, 900])))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "zeta " * 9000), (63, "hello <|endoftext|> world<|startoftext|>x"), (None, "no id"), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, ids string, length int").repartition(3)
    return df, rows


def encoded(rows, name, end_id=2, plain=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    if plain:
        t.encode_special_tokens = True
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end_id]) for i, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, plain):
    r = random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(800)] + [None, "", " ", "x" * 5000, "a " * 3000, " a", "a "]
    e = Encoder(public_tokenizers.path(name), most=300, plain=plain)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    if plain:
        library.encode_special_tokens = True
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert plain or any(i in (50256, 49407) for ids in want for i in ids)
    for _ in range(3):
        flat, lengths = e.encode(texts)
        assert lengths.tolist() == list(map(len, want))
        assert flat.tolist() == [i for ids in want for i in ids]


def test_pack(spark):
    df, rows = documents(spark)
    pieces = packing.pack(df).collect()
    want = encoded(rows, "word_bpe_49k.json")
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    for doc in {i for i, _ in want}:
        ids = sorted(x for i, own in want if i == doc for x in enumerate(own))
        assert sorted((s + n, x) for s, own in by_doc[doc] for n, x in enumerate(own)) == ids
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_pack_with_a_loss_rule(spark):
    df, rows = documents(spark)
    df = df.unionByName(df.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "ids", "length")).unionByName(df.where("doc_id = 62"))
    sequences = defaultdict(list)
    for p in packing.pack(df.coalesce(1), limits=LIMITS, prompt_tokens=CONTEXT).collect():
        assert p["loss_tokens"] == max(0, p["start"] + p["length"] - max(p["start"], CONTEXT))
        sequences[p["sequence_id"]].append((p["length"], p["loss_tokens"]))
    whole = [s for s in sequences.values() if sum(n for n, _ in s) == 4096]
    assert all(len(s) <= 64 and sum(x for _, x in s) <= 4080 for s in sequences.values())
    # the limit binds, and prompts make up what it leaves
    assert len(whole) >= 18 and any(sum(x for _, x in s) == 4080 for s in whole)


def test_packer_keeps_all_limits():
    r = random.Random(2)
    limits = Limits(tokens=64, segments=4, loss=40)
    packer, examples = Packer(limits, window=400, most=30), {}
    out = []
    for n in range(300):
        size = r.choice([1, 2, 7, 30, 90])
        examples[n] = (size, r.randrange(size + 1))
        out += list(packer.add(n, *examples[n]))
    out += list(packer.finish())
    seen = defaultdict(list)
    for pieces in out:
        assert len(pieces) <= limits.segments and sum(p[2] for p in pieces) <= limits.tokens and sum(p[3] for p in pieces) <= limits.loss
        for n, start, size, loss in pieces:
            assert loss == max(0, start + size - max(start, examples[n][1]))
            seen[n] += range(start, start + size)
    assert {n: sorted(x) for n, x in seen.items()} == {n: list(range(size)) for n, (size, _) in examples.items()}


def test_id_store(spark, tmp_path):
    df, rows = documents(spark)
    store = id_store.write_store(df, f"file://{tmp_path}/s", keys_per_index=16)
    want, at = [], 0
    for i, ids in sorted(encoded(rows, "byte_bpe_50k.json"), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, at, len(ids), crc(ids), ids))
        at += len(ids)
    got = id_store.lookup(store, df).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    some = spark.createDataFrame([(62,), (3,), (999,)], "doc_id long")
    assert sorted(r["doc_id"] for r in id_store.lookup(store, some, with_ids=False).collect()) == [3, 3, 3, 62]
    # one id with most rows, and rows without id, over several shards
    null = -(2**63) + 12345
    hot = spark.createDataFrame([(7, f"copy {i} of it") for i in range(300)] + [(None, f"no id {i}") for i in range(200)] + [(i, "other") for i in range(20, 40)] + [(null, "least")], "doc_id long, text string")
    store = id_store.write_store(hot, f"file://{tmp_path}/h", keys_per_index=4, shard_bytes=700)
    places = id_store.find(store, hot.select("doc_id").distinct()).collect()
    assert len({r["shard"] for r in places if r["doc_id"] == 7}) > 1 < len({r["shard"] for r in places if r["doc_id"] is None})
    got = sorted(map(tuple, id_store.lookup(store, hot, with_ids=False).collect()), key=lambda r: r[1])
    want = encoded(hot.collect(), "byte_bpe_50k.json")
    assert sorted((repr(r[0]), r[2], r[3]) for r in got) == sorted((repr(i), len(ids), crc(ids)) for i, ids in want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert [r[0] for r in got] == [None] * 200 + [null] + [7] * 300 + list(range(20, 40))
    assert id_store.lookup(store, hot.where("doc_id is null"), with_ids=False).count() == 200
    empty = id_store.write_store(df.limit(0), f"file://{tmp_path}/e")
    assert id_store.lookup(empty, df.limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(id_store.PerfectHash.build(keys)(keys)) == list(range(len(keys)))


def test_token_counts(spark, tmp_path):
    df, rows = documents(spark)
    order = token_counts.write_flat(df, f"file://{tmp_path}/f")
    for block in (64, 1 << 22):
        found = token_counts.scan(spark, f"file://{tmp_path}/f", 49407, 2, block)
        got = order.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
        want = sorted((repr(i), len(ids) - 1) for i, ids in encoded(rows, "word_bpe_49k.json", plain=True))
        assert sorted((repr(r[0]), r[1]) for r in got) == want and found.where("not closed").count() == 0
    (tmp_path / "g").mkdir()
    np.array([5, 9, 9, 6, 7, 8], "<u2").tofile(tmp_path / "g" / "a.ids")
    (tmp_path / "g" / "b.ids").touch()
    got = token_counts.scan(spark, f"file://{tmp_path}/g", 9, 2, 4).orderBy("ordinal").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 3, False)]
