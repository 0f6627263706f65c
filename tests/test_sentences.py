"""Queries over all sentences of documents, against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from glossweave.operators import near_texts, redundancy
from glossweave.plans import queries


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        if min(row) > most:
            return most + 1
    return row[-1]


def features(norm):
    own = list(dict.fromkeys(w for w in norm.split(" ") if len(w) > 1))
    padded = f" {norm} "
    grams = [] if len(own) > 2 else dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2))
    return ["w:" + w for w in own] + ["g:" + g for g in grams]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents, and their nodes: most have frequent words only, some have accents and rare words."""
    r = random.Random(5)
    frequent = "alpha brücke gamma delta été zeta".split()
    lines = [" ".join(r.choices(frequent, k=r.randint(3, 7))) for _ in range(700)] + [" ".join(frequent + [w]) for w in frequent]
    lines += [f"{r.choice(frequent)} überall{i // 2} naïve{i // 2}{'s' * (i % 2)} señor" for i in range(30)] + ["Kurz", "kurz", "kurze", "x", "“Kurz”\tda"]
    r.shuffle(lines)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(n, ".".join(lines[n * 20 : n * 20 + 20]).upper() if n % 2 else "\n".join(lines[n * 20 : n * 20 + 20]), "de") for n in range(len(lines) // 20 + 1)]
    spark.createDataFrame([*docs, (99, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    nodes: dict[str, int] = {}
    for n, text, _ in docs:
        for at, line in enumerate(text.replace("\n", ".").split(".")):
            norm = " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())
            if len(norm) >= 3:
                nodes.setdefault(norm, (n << 24) + at)
    return folder, nodes


def test_sentence_queries(spark, corpus):
    folder, nodes = corpus
    posted = defaultdict(list)
    for norm, node in nodes.items():
        for f in features(norm):
            posted[f].append(node)
    got = {x["feature"]: x["n_nodes"] for x in queries.sentence_postings(spark, folder).collect()}
    assert got == {f: len(n) for f, n in posted.items()}

    pairs, fallback = set(), 0
    for norm, node in nodes.items():
        own = features(norm)
        blocked = [f for f in own if len(posted[f]) <= 300]
        fallback += not blocked
        for f in blocked or [min(own, key=lambda f: len(posted[f]))]:
            pairs |= {(node, other) for other in posted[f] if other > node}
    assert fallback > 100
    assert {(x["a"], x["b"]) for x in queries.sentence_pairs(spark, folder).collect()} == pairs

    text, edges = {n: t for t, n in nodes.items()}, {}
    for a, b in pairs:
        p, q = text[a], text[b]
        longer = max(len(p), len(q))
        most = int(0.15 * longer + 1e-9)
        if sum(((Counter(p) - Counter(q)) | (Counter(q) - Counter(p))).values()) > 2 * most:
            continue
        d = min(distance(p, q, most), distance(" ".join(sorted(p.split())), " ".join(sorted(q.split())), most))
        mask = lambda s: "".join("#" if c.isdigit() else c for c in s)
        while "##" in (p := mask(p)):
            p = p.replace("##", "#")
        while "##" in (q := mask(q)):
            q = q.replace("##", "#")
        if d <= most and 1 - d / longer >= 0.85 and p != q:
            edges[a, b] = round(1 - d / longer, 6)
    assert len(edges) > 20
    assert {(x["a"], x["b"]): pytest.approx(x["similarity"], abs=2e-6) for x in queries.sentence_edges(spark, folder).collect()} == edges

    parent = {n: n for e in edges for n in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {x["node"]: x["root"] for x in queries.sentence_components(spark, folder).collect()} == {n: find(n) for n in parent}


def test_words_of_whole_texts(spark, corpus):
    folder, _ = corpus
    texts = [x["text"] or "" for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = Counter(w for t in texts for w in "".join(c if c.isalnum() else " " for c in t).split())
    assert want["BRÜCKE"] > 100 and want["été"] > 100
    assert {x["word"]: x["n"] for x in queries.words_tokens(spark, folder).collect()} == want
    assert {x["word"] for x in queries.lemmas(spark, folder).collect()} == set(want)
    assert "brücke" in {x["id"] for x in queries.term_list(spark, folder).collect()}


def test_all_part_keys(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.page_keys(spark, sf).count() == spark.read.parquet(f"{sf}/part.parquet").count() + 4


def test_full_scan_counts_near_duplicates(spark, tmp_path):
    names = ["green delivery note"] * 4 + ["green delivery notes", "two words", "blue pallet", "red pallet exchange"]
    spark.createDataFrame(list(enumerate(names, 3)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    [row] = queries.scan_summary(spark, str(tmp_path)).collect()
    assert (row["fuzzy_keys"], row["fuzzy_groups"], row["redundant_keys"], row["redundant_percent"]) == (5, 1, 5, 62.5)
    assert row["duplicate_or_variant_keys"] == 4


def test_near_edges_write_few_pairs(spark, corpus, monkeypatch):
    """The edges of the plain operators, from a small part of their pairs; shuffled files go, whole or in slices of the features."""
    from pyspark.sql import functions as F

    folder, _ = corpus
    real, rows = near_texts.written, {}

    def counted(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_texts, "written", counted)
    odd = ["𝒳𝒴 naïve 𝒵𝒲", "𝒳𝒴 naïve 𝒵𝒲s", "12 alpha 34", "13 alpha 35", "aaa", "aab", "a b c", "été été", "été étés"] + ["lang" * 45 + "x" * i for i in range(6)]
    own = queries.sentence_nodes(spark, folder).unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "node long, norm string").select(F.col("norm"), F.col("node")))
    own = real(own, "nodes")
    plain = redundancy.candidate_pairs(real(redundancy.postings(own), "postings"))
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(redundancy.fuzzy_edges(own, plain))
    assert len(want) > 30
    assert order(near_texts.near_edges(own)) == want
    assert rows["near"] < 0.1 * plain.count()
    monkeypatch.setattr(near_texts, "SLICE", 200)
    monkeypatch.setattr(near_texts, "LOT", max(1, rows["near"] // 3))
    monkeypatch.setattr(near_texts, "_BLOCK", 7)
    monkeypatch.setattr(near_texts, "_PAIRS", 50)
    assert order(near_texts.near_edges(own)) == want
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
