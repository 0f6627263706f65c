import base64
import gzip
import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from glossweave.llm import kdtree, queries, url_templates, warc


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: y", "same"), (3, "http://b", "same"), (9, None, "same"), (7, "http://c", None), (8, "http://d", ""), (1, "http://e", "é" * 100_000), (None, "http://f", "same"), (3, "http://g", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string").repartition(3)
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    files = warc.resolve(spark, raw, warc.write_archives(pages, raw), out)
    got = warc.read_resolved(spark, out, files).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((len((t or "").encode()), digest(t)) for _, _, t in rows)
    same = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest("same")]
    assert sorted(map(repr, same)) == sorted(map(repr, [(3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3)]))
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 0} == {(7, "response", None), (8, "revisit", 7)}
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nX: y" not in text
    kept = warc.resolve(spark, raw, files, f"file://{tmp_path}/big", least=5)
    assert warc.read_resolved(spark, f"file://{tmp_path}/big", kept).where("record_type = 'revisit'").count() == 0
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_revisits_of_the_input_stay(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    rows = [(i, f"http://{i}", ["same", "other", f"alone{i}"][i % 3]) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    once = warc.resolve(spark, at("raw"), warc.write_archives(pages, at("raw")), at("once"))
    want = sorted(map(repr, warc.read_resolved(spark, at("once"), once).collect()))
    again = warc.resolve(spark, at("once"), once, at("twice"))
    assert sorted(map(repr, warc.read_resolved(spark, at("twice"), again).collect())) == want and len(want) == 30
    # a file of revisits alone: to a record that becomes a revisit, to one that is known by its digest only, and to none of the input
    digest = warc.digest_of(b"same")
    headers = warc.read_headers(spark, at("raw"), once).where(f"digest = '{digest}'").collect()
    last = max(headers, key=lambda r: r["page_id"])
    own = [warc.revisit("urn:a", 100, "u", "d", digest, last["record_id"], "u"), warc.revisit("urn:b", 101, "u", "d", digest, None, None)]
    own += [warc.revisit("urn:c", 102, "u", "d", warc.digest_of(b"gone"), "urn:gone", "http://gone", "2001")]
    warc.write_file(at("raw") + "/revisits.warc.gz", iter(own))
    files = once.select("file").unionByName(spark.createDataFrame([("revisits.warc.gz",)], "file string"))
    done = warc.resolve(spark, at("raw"), files, at("mixed"))
    assert {r["file"]: r["records"] for r in done.collect()}["revisits.warc.gz"] == 3
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_resolved(spark, at("mixed"), done).collect()}
    assert len(got) == 33 and got[100] == got[101] == ("revisit", 0) and got[102] == ("revisit", None)
    fields = [f for f, _ in warc.records(at("mixed") + "/revisits.warc.gz")][2]
    assert (fields["WARC-Refers-To"], fields["WARC-Refers-To-Target-URI"], fields["WARC-Refers-To-Date"]) == ("<urn:gone>", "http://gone", "2001")


def brute(ids, vectors, queries_, k):
    out = {}
    for q, x in queries_:
        scored = sorted((-int(np.dot(v, x)), i) for i, v in zip(ids, vectors, strict=True) if i != q)
        out[q] = [(n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 8)), np.repeat(rng.normal(size=(1, 8)), 40, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [1.0, None] * 4), (1003, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    own = kdtree.quantised(df)
    ids = np.arange(len(x))
    whole = np.floor(1024 * x).astype(np.int64)
    want = brute(ids, whole, [(i, whole[i]) for i in ids if i % 20 == 0], 10)
    for shard in (64, 10**6):
        got: dict = {}
        for r in kdtree.top_k(own, own.where("vec_id % 20 = 0"), 10, block=7, sample=50, leaf=8, shard=shard).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(v) for q, v in got.items()} == want
    few = own.where("vec_id < 4")
    assert kdtree.top_k(few, few.where("vec_id = 0")).count() == 3
    assert kdtree.top_k(own.limit(0), own.limit(0)).count() == 0


def test_large_components_are_exact():
    v = np.array([[2**40 + 1, 3], [2**40, 5], [2**40 - 1, 2**40]], float)
    got = kdtree.Tree(np.arange(3), v).search(np.array([9]), v[:1], np.array([-np.inf]), 3)
    assert {(i, s) for _, i, s in got} == {(i, sum(int(a) * int(b) for a, b in zip(v[i], v[0], strict=True))) for i in range(3)}


def test_lengths_and_large_numbers(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [-1.0, 0.5, 9.0]), (100, [2.0, 1.0, 1.0])]
    schema = "vec_id long, embedding array<double>"
    own = kdtree.quantised(spark.createDataFrame(rows, schema))
    whole = {i: [int(1024 * x) for x in [*v, 0, 0, 0][:3]] for i, v in rows}
    want = brute([i for i in whole if i != 100], [whole[i] for i in whole if i != 100], [(100, whole[100])], 10)
    assert {100: sorted((r["rank"], r["vec_id"], r["score"]) for r in kdtree.top_k(own, own.where("vec_id = 100")).collect())} == want
    big = spark.createDataFrame([(i, [2**61 - i, 1]) for i in range(30)] + [(99, [1, 1])], "vec_id long, v array<long>")
    got = [(r["vec_id"], r["score"]) for r in kdtree.top_k(big, big.where("vec_id = 99"), 5, sample=8, leaf=2).orderBy("rank").collect()]
    assert got == [(i, 2**61 - i + 1) for i in range(5)]
    with pytest.raises(Exception, match="too large"):
        kdtree.quantised(spark.createDataFrame([(1, [1e300])], schema)).collect()


def brute_rule(url):
    _, sep, rest = (url or "").partition("://")
    host = path = ""
    if sep:
        stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:stop], rest[stop:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, says in queries.RULES:
        own, _, begin = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + begin) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, best


def test_url_rules_and_templates(spark):
    urls = [f"http://{h}/{lang}/{n}{tail}" for h in ("WWW.a.com", "b.example.org", "c.net") for lang in ("en", "fr", "de", "es") for n in (1, 22, 333) for tail in ("", "?q=/x", "#t", ".html")]
    urls += [None, "", "nothing", "http://org", "http://x.org?y", "http://É.org/é", "ftp://notorg/", "http://a.com/" + "x/" * 5000, "http://" + "y" * 3000]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(None, urls[0], "z")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_templates.judge(df, queries.RULES).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path, best = brute_rule(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
    assert url_templates.judge(df.limit(0), queries.RULES).count() == 0


def brute_tree(rows, p):
    """{(host, segments): (template, purity)} by recursion over whole lists of (host, segments, label)."""
    labels = [x for _, _, x in rows if x is not None]
    base, out = sum(labels) / len(labels) if labels else 0.0, {}

    def kind(segments):
        if not segments:
            return 0
        return any(c in "0123456789" for c in segments[0]) + 2 * any(c.isalpha() for c in segments[0]) + 4 * any(not (c.isalpha() or c in "0123456789") for c in segments[0])

    def grow(host, template, rest, purity):  # rest: (whole path, segments left, label)
        own = [x for _, _, x in rest if x is not None]
        if len(set(own)) < 2:
            end = "/**" if any(r for _, r, _ in rest) else ""
            out.update({(host, w): (template + end, purity) for w, _, _ in rest})
            return
        while all(r and r[0] == rest[0][1][0] for _, r, _ in rest):
            template += "/" + rest[0][1][0]
            rest = [(w, r[1:], x) for w, r, x in rest]
        out.update({(host, w): (template or "/", purity) for w, r, _ in rest if not r})
        children = {}
        for w, r, x in rest:
            if r:
                children.setdefault(r[0], []).append((w, r[1:], x))
        classes, units = {}, {}
        for s, c in children.items():
            classes.setdefault(int(math.log2(len(c))), []).append(s)
        for size, names in classes.items():
            some = [x for s in names for _, _, x in children[s] if x is not None]
            share = sum(some) / len(some) if some else 0
            for s in names:
                unit, mine = "=" + s, [x for _, _, x in children[s] if x is not None]
                if len(names) > p.fan:
                    unit = f"*{size}"
                    if mine and 0 < share < 1:
                        q = sum(mine) / len(mine)
                        far = sum(a * math.log(a / b) for a, b in ((q, share), (1 - q, 1 - share)) if a)
                        if 2 * len(names) * math.exp(-len(mine) * far) < p.chance:
                            unit += "+" if q > share else "-"
                units.setdefault(unit, []).append(s)
        names = sorted(units)
        stats = []
        for u in names:
            below = [y for s in units[u] for y in children[s]]
            mine = [x for _, _, x in below if x is not None]
            stats.append((u, len(below), len(mine), sum(mine), [sum(kind(r) == k for _, r, _ in below) for k in range(8)]))
        groups = url_templates.merge_siblings(stats, p)
        for g, name in zip(groups, url_templates.group_names([(u, len(units[u])) for u in names], groups), strict=True):
            k, b = sum(stats[i][2] for i in g), sum(stats[i][3] for i in g)
            grow(host, f"{template}/{name}", [y for i in g for s in units[names[i]] for y in children[s]], (b + p.weight * purity) / (k + p.weight))

    for host in {h for h, _, _ in rows}:
        mine = [(tuple(s), s, x) for h, s, x in rows if h == host]
        own = [x for _, _, x in mine if x is not None]
        grow(host, "", mine, (sum(own) + p.weight * base) / (len(own) + p.weight))
    return out


def test_tree_equals_recursion(spark):
    r = random.Random(12)
    rows = []
    for host in ("a", "b", "c", "", "plain"):
        share = {s: r.random() for s in "uvwxyz"}
        for _ in range(400):
            first = [r.choice("uvwxyz")] if r.random() < 0.7 else [f"slug-{r.randrange(10**6)}"]
            path = first + r.choice([[], ["p", "q"], [str(r.randrange(99))], ["p", "q", r.choice(["spam", "good"]), f"{r.randrange(9)}.html"], ["p", "é!", "*", "(x"]])
            bad = 0.95 if "spam" in path else 0.02 if "good" in path else share.get(first[0], 0.4)
            rows.append((host, path, int(r.random() < bad) if host != "plain" and r.random() < 0.6 else None))
    rows += [("deep", ["d"] * 30 + [x], int(x == "bad")) for x in ("bad", "fine") for _ in range(9)] + [("deep", ["d"] * 30 + ["bad", "n"], None), ("long", ["x"] * 5000, None), ("long", [], 1)]
    p = url_templates.Params()
    got = {(x["host"], tuple(x["segments"])): (x["template"], x["purity"]) for x in url_templates.purities(spark.createDataFrame(rows, "host string, segments array<string>, label int").repartition(3), p).collect()}
    want = brute_tree(rows, p)
    assert set(got) == set(want)
    for at, (template, purity) in want.items():
        assert got[at][0] == template and got[at][1] == pytest.approx(purity), at
    assert len({t for (h, _), (t, _) in got.items() if h == "a"}) > 6
    assert got["deep", (*["d"] * 30, "bad")][1] > 0.7 > 0.3 > got["deep", (*["d"] * 30, "fine")][1]


def test_siblings_and_wildcards():
    p = url_templates.Params()
    at = lambda *kinds: [*kinds, *[0] * (8 - len(kinds))]
    units = [("=de", 300, 100, 100, at(0, 300)), ("=fr", 300, 100, 0, at(0, 300)), ("=en", 900, 0, 0, at(0, 900)), ("=ads", 90, 0, 0, at(90)), ("=it", 200, 60, 60, at(0, 200))]
    groups = [sorted(units[i][0] for i in g) for g in url_templates.merge_siblings(units, p)]
    # alike in labels and shape: one branch; like both labelled branches, or like none: apart
    assert sorted(groups) == [["=ads"], ["=de", "=it"], ["=en"], ["=fr"]]
    one = [u for u in units if u[0] in ("=de", "=en")]
    assert [sorted(g) for g in url_templates.merge_siblings(one, p)] == [[0, 1]]
    assert url_templates.group_names([("=a", 1), ("=*", 1), ("*0", 300), ("*3+", 21)], [[0], [1], [2], [3]]) == ["a", "\\*", "*", "(*3+|*)"]


def test_templates_learn_a_bad_branch(spark):
    rows = [("h", ["bad", "{n}"], 1 if i < 30 else None) for i in range(40)] + [("h", ["good", "{n}"], 0 if i < 30 else None) for i in range(40)]
    rows += [("h", ["misc", f"s{i}"], None) for i in range(50)] + [("other", ["bad", "{n}"], None)]
    df = spark.createDataFrame(rows, "host string, segments array<string>, label int")
    got = {(r["host"], r["segments"][0]): (r["template"], r["purity"]) for r in url_templates.purities(df).collect()}
    assert got["h", "bad"][1] > 0.8 and got["h", "bad"][0] == "/bad/**"
    assert got["h", "good"][1] < 0.1 and 0.2 < got["h", "misc"][1] < 0.8 and got["h", "misc"][0] == "/misc/**"
    assert 0.2 < got["other", "bad"][1] < 0.8


def test_rare_branches_that_differ_keep_their_node(spark):
    rows = [("h", ["fr", "{n}"], 0)] * 600 + [("h", ["de", "{n}"], 1)] * 30 + [("h", [f"s{i}", "{n}"], None) for i in range(23) for _ in range(59)]
    rows += [("v", [f"slug{i}"], int(i % 10 == 0)) for i in range(300)] + [("v", ["new"], None)]
    rows += [("w", [f"s{i}", "{n}"], int(i == 7)) for i in range(40) for _ in range(20)]
    df = spark.createDataFrame(rows, "host string, segments array<string>, label int")
    got = {(r["host"], r["segments"][0]): (r["template"], r["purity"]) for r in url_templates.purities(df).collect()}
    assert got["h", "de"][0].startswith("/de/") and got["h", "de"][1] > 0.8
    assert got["h", "fr"][1] < 0.1 and all(got["h", f"s{i}"][1] < 0.2 for i in range(23))
    # one label each tells nothing: the slugs stay one variable segment with the share of all
    assert {got["v", f"slug{i}"][0] for i in range(300)} == {"/*"} and 0.05 < got["v", "new"][1] < 0.15
    # one value of a variable segment that is far from the others
    assert got["w", "s7"][1] > 0.8 and all(got["w", f"s{i}"][1] < 0.1 for i in range(40) if i != 7)


def test_method_blocks(spark):
    rows = [(i, f"http://x.com/de/a/{i}") for i in range(60)] + [(100 + i, f"http://x.com/es/a/{i}") for i in range(5)] + [(200 + i, f"http://y.com/{t}/a/{i}") for t in ("fr", "de", "es") for i in range(60)]
    got = {(r["host"], r["path"][1:3]): (r["rule"], r["verdict"]) for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).collect()}
    assert got == {("x.com", "de"): ("com/de/", "block"), ("x.com", "es"): (None, "block"), ("y.com", "fr"): ("com/fr/", "allow"), ("y.com", "de"): ("com/de/", "block"), ("y.com", "es"): (None, "allow")}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.schema.names == docs.schema.names, name
        assert after.join(docs, "doc_id", "left_anti").count() == 0
    from tests.llm.test_documents import brute_components

    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bench = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i for i, (_, root) in brute_components(rows).items() if i == root}
    want = {i for i, t in rows if i in kept and not any(b in " ".join(t.lower().split()) for b in bench)}
    pieces = corpus_pipeline.run(spark, sf).select("doc_id", "length", "doc_tokens").collect()
    assert {r["doc_id"] for r in pieces} == want


def test_pipeline_cases(spark, tmp_path):
    r = random.Random(4)
    lists = {"en": "the and with house water people under going".split(), "fr": "le et avec maison eau gens très vers".split()}
    body = lambda k, n=40: " ".join(r.choices(lists[k], k=n))
    rows = [(i, body(k), k) for i in range(60) for k in [("en", "fr")[i % 2]]]
    same, leak = body("en"), body("fr", 30)
    rows += [(100, same, "en"), (100, same, "en"), (101, same, None), (None, same, "en"), (102, None, "en"), (103, "", None), (104, "12 34", "fr"), (105, f"{body('fr', 9)} {leak} {body('fr', 9)}", "fr"), (None, leak, None), (106, body("en", 12_000), "en")]
    docs = spark.createDataFrame([(i, t, k, -1.0, "own", n, 7) for n, (i, t, k) in enumerate(rows)], "doc_id long, text string, lang string, score double, Lang_Pred string, rid long, __maybe int").repartition(3)
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.select("score", "Lang_Pred", "__maybe").distinct().collect() == [(-1.0, "own", 7)]
    got = sorted(((x["doc_id"], x["rid"]) for x in now.collect()), key=repr)
    assert [i for i, _ in got if i is not None] == sorted([*range(60), 100, 106], key=repr) and [n for i, n in got if i is None] == [63]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {x["doc_id"] for x in pieces} == {i for i, _ in got} and all(x["length"] <= 4096 for x in pieces)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
