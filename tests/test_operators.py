import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import alignment as A
from glossweave.operators import completeness, consistency, definitions, pairs, redundancy, terms
from glossweave.operators.components import connected_components


def strings(spark, rows, locale="en"):
    return spark.createDataFrame([(locale, k, v, i) for i, (k, v) in enumerate(rows)], "locale string, key string, value string, ord long")


def test_duplicates_and_variants(spark):
    rows = [("a", "Submit order"), ("b", "Submit order"), ("c", "SUBMIT ORDER"), ("d", "Submit order."), ("e", ""), ("f", " "), ("g", "..."), ("h", "?"), ("i", "Other")]
    s = strings(spark, rows)
    assert [(r["value"], r["keys"]) for r in redundancy.find_duplicates(s).collect()] == [("Submit order", ["a", "b"])]
    (v,) = redundancy.find_variants(s).collect()
    assert v["kinds"] == ["casing", "punctuation"]
    assert [m["keys"] for m in v["members"]] == [["a", "b"], ["c"], ["d"]]


def test_fuzzy_groups(spark):
    s = strings(spark, [("a", "Issue date"), ("b", "Date issue"), ("c", "Reverse the delivery now"), ("d", "Reversed the delivery now"), ("e", "Level 1 of 3"), ("f", "Level 2 of 3"), ("g", "issue DATE")])
    found = redundancy.find_fuzzy(s).collect()
    assert [(r["min_similarity"], [m["keys"][0] for m in r["members"]]) for r in found] == [(1.0, ["a", "g", "b"]), (0.96, ["c", "d"])]


def test_fuzzy_options_and_empty(spark):
    s = strings(spark, [("a", "De-hire pallets"), ("b", "Off-hire pallets")])
    assert redundancy.find_fuzzy(s, 0.85).count() == 0
    assert redundancy.find_fuzzy(s, 0.7).count() == 1
    assert redundancy.find_fuzzy(s, 0.7, 10).count() == 0
    assert redundancy.find_fuzzy(s.limit(0)).count() == 0


def test_distance_counts_utf16_units(spark):
    s = strings(spark, [("a", "garden \U0001d538\U0001d539"), ("b", "garden \U0001d538\U0001d538")])
    two = strings(spark, [("a", "plot \U00020000\U00020001 north"), ("b", "plot \U00020000\U00020402 north")])
    # the first pair is letters that NFKC turns into plain ones; of the second both units of one character differ, of 15
    assert redundancy.find_fuzzy(s, 0.8).count() == 1
    assert [r["min_similarity"] for r in redundancy.find_fuzzy(two, 0.5).collect()] == [0.867]


def test_sources_are_encoded_once(spark):
    class Counting(A.HashEncoder):
        def encode(self, texts, spans):
            if "Weed the bed" in texts:
                Counting.calls += 1
            return super().encode(texts, spans)

    Counting.calls, known = 0, {}
    encoder = Counting()
    rows = [A.align_pair("Weed the bed", t, "de", encoder, known=known) for t in ("Beet jäten", "Das Beet", "")]
    assert Counting.calls == 1 and rows[0] == A.align_pair("Weed the bed", "Beet jäten", "de", encoder)
    schema = "id long, lang string, src string, tgt string"
    pairs_ = spark.createDataFrame([(n, lang, "Weed the bed", f"Beet {n}") for n, lang in enumerate(["de", "fr", "th"] * 4)], schema).repartition(3)
    assert A.align(pairs_).count() == 12


def test_rarest_feature_when_all_are_common(spark):
    posted = spark.createDataFrame([(n, f"w:{w}", i, 9 if w != "z" else 8, 5) for n in (1, 2) for i, w in enumerate("yz")] + [(3, "w:y", 0, 9, 5)], "node long, feature string, place int, n long, size int")
    assert [tuple(r) for r in redundancy.candidate_pairs(posted, 5).collect()] == [(1, 2)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_missing(spark):
    en = strings(spark, [("title", "Pool stock"), ("dehire", "De-hire pallets"), ("offhire", "Off-hire"), ("currency", "EUR"), ("ok", "Fine words")])
    de = strings(spark, [("title", "Pool stock"), ("dehire", " "), ("currency", "EUR"), ("ok", "Fine words"), ("legacy", "Alt")], "de")
    codes = spark.createDataFrame([("en",), ("de",), ("fr",)], "locale string")
    allowed = spark.createDataFrame([("Fine words",)], "value string")
    found = completeness.find_missing(en.unionByName(de), codes, "en", allowed)
    got = {(r["key"], r["category"]) for r in found.where("locale = 'de'").collect()}
    assert got == {("offhire", "absent"), ("dehire", "empty"), ("title", "untranslated"), ("legacy", "extra")}
    counts = {r["locale"]: r.asDict() for r in completeness.missing_counts(found, codes, "en").collect()}
    assert counts["fr"]["absent"] == 5 and counts["de"]["extra"] == 1


def test_unused(spark):
    files = [
        ("plot.vue", "show('plot.size')\nask(\"plot.owner\")\nsay(`plot.free`)"),
        ("crops.ts", "const row = 'crop_'; title(`season.${month}.name`); other(`${any}.tail`)"),
        ("long.js", "'" + "q" * 50_000 + "' + 'ab.'"),
    ]
    expected = {"plot.size": "used", "plot.owner": "used", "plot.free": "used", "crop_beet": "dynamic", "season.may.name": "dynamic", "ab.cd": "dynamic", "plot": "unused", "x.tail": "unused", "crop": "unused", "fence.gate": "unused"}
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(expected)], "key string, ord long")
    code = spark.createDataFrame(files, "path string, content string")
    assert {r["key"]: r["status"] for r in completeness.key_usage(keys, code).collect()} == expected
    told = {r["key"]: r["status"] for r in completeness.key_usage(keys, code, ["fence."]).collect()}
    assert told == expected | {"fence.gate": "dynamic"}


def test_terms(spark):
    values = ["Issue", "Issues report", "Report an issue now please today", "Old issue", "issue list", "Docket number", "Docket number 2", "Docket number list", "Print docket number on the next page again"]
    got = {r["id"]: r for r in terms.extract_terms(strings(spark, [(str(i), v) for i, v in enumerate(values)]), ["Off-hire", "issue"], 3).collect()}
    assert got["issue"]["df"] == 5 and got["issue"]["seeded"] and got["issue"]["surfaces"]["Issues"] == 1
    assert got["off-hire"]["df"] == 0
    assert "number" not in got and got["docket number"]["label_share"] == 0.75


def test_plan_and_requests(spark):
    en = strings(spark, [("a", "Issue {V1} pallets"), ("b", "Issue  pallets"), ("c", "Nothing here")])
    de = [("a", "Paletten {V1} ausgeben"), ("b", "Paletten ausgeben"), ("c", "Nichts")]
    fr = [("a", "Emettre"), ("b", "Issue  pallets"), ("c", " ")]
    whole = en
    for code, rows in (("de-de", de), ("de", de), ("fr", fr), ("en-gb", de)):
        whole = whole.unionByName(strings(spark, rows, code))
    codes = spark.createDataFrame([(x,) for x in ("de-de", "de", "fr", "en-gb", "en")], "locale string")
    plan = pairs.plan_locales(whole, codes, "en")
    assert {r["locale"]: (r["rep"], r["role"]) for r in plan.collect()} == {"de": ("de", "rep"), "de-de": ("de", "alias"), "fr": ("fr", "rep"), "en-gb": (None, "skipped")}
    known = spark.createDataFrame([("issue", ["issue"])], "id string, lemmas array<string>")
    got = [tuple(r) for r in pairs.build_requests(whole, "en", plan, known).orderBy("id").collect()]
    assert got == [(0, "de", "de", "Issue pallets", "Paletten ausgeben", ["a", "b"]), (1, "fr", "fr", "Issue pallets", "Emettre", ["a"])]


def test_kernels():
    sim = np.array([[0.9, 0.1, 0.2], [0.8, 0.3, 0.75], [0.1, 0.6, 0.2]])
    assert np.argwhere(A.mutual_argmax(sim)).tolist() == [[0, 0], [2, 1]]
    assert np.argwhere(A.itermax(sim)).tolist() == [[0, 0], [1, 2], [2, 1]]
    wide = np.array([[0.9, 0.8, 0.7, 0.1, 0.2], [0.1, 0.2, 0.3, 0.8, 0.1]])
    links = A.mutual_argmax(wide)
    assert A.grow_spans(wide, links, 8) == [(0, 2), (3, 3)]
    assert A.grow_spans(wide, links, 1) == [(0, 1), (3, 3)]
    assert A.grow_spans(wide, np.zeros_like(links), 8) == [None, None]
    assert A.scores(wide, links) == [0.9, 0.8]


def _aligned(spark, pairs_, lang="de"):
    rows = [(i, f"{code}", code, [f"k{i}"]) for i, (code, _, _) in enumerate(pairs_)]
    requests = spark.createDataFrame(rows, "id long, locale string, lang string, keys array<string>")
    results = [(i, ["issue"], [text], [text.lower()[:5]], " ", [(0, 0)], [(0, 0)], [score]) for i, (_, text, score) in enumerate(pairs_)]
    return requests, spark.createDataFrame(results, A.RESULT)


@pytest.mark.parametrize(("label", "tier"), [(0.5, "ambiguous"), (0.05, "phrasing")])
def test_split_in_three_languages(spark, label, tier):
    texts = {"de": ("Ausgabe", "Problem"), "fr": ("Sortie", "Souci"), "pl": ("Wydanie", "Kwestia")}
    requests, results = _aligned(spark, [(code, t, 0.8) for code, two in texts.items() for t in two for _ in range(3)])
    known = spark.createDataFrame([("issue", ["issue"], 10, False, label, 5.0)], "id string, lemmas array<string>, df long, seeded boolean, label_share double, zipf double")
    plan = spark.createDataFrame([(c, c, "rep", None) for c in texts], "locale string, rep string, role string, reason string")
    found, stats = consistency.measure(known, requests, results, plan)
    assert [r["tier"] for r in found.collect()] == [tier]
    german = stats.where("locale = 'de'").first()
    assert sorted((c["forms"][0]["text"], c["count"]) for c in german["clusters"]) == [("Ausgabe", 3), ("Problem", 3)]
    assert german["dominant_share"] == 0.5 and german["multiple"]
    counts = {r["name"]: r["n"] for r in consistency.estimate(found).collect()}
    assert counts[f"tier:{tier}"] == 1 and counts["candidates"] == 1


def test_low_scores_and_english(spark):
    requests, results = _aligned(spark, [("de", "Issue", 0.8)] * 3 + [("fr", "Issue", 0.8)] * 3 + [("pl", "issues", 0.8)] * 3 + [("it", "Problema", 0.3)] * 2)
    known = spark.createDataFrame([("issue", ["issue"], 10, False, 0.5, 5.0)], "id string, lemmas array<string>, df long, seeded boolean, label_share double, zipf double")
    plan = spark.createDataFrame([(c, c, "rep", None) for c in ("de", "fr", "pl", "it")], "locale string, rep string, role string, reason string")
    found, stats = consistency.measure(known, requests, results, plan)
    assert found.first()["tier"] == "keep-english" and found.first()["kept_english_share"] == 1.0
    assert tuple(stats.where("locale = 'it'").select("occurrences", "unaligned").first()) == (0, 2)


def test_folds():
    c = lambda key, count, kept=False: {"key": key, "count": count, "forms": [{"text": key, "count": count}], "example_keys": [key], "kept_english": kept}
    assert [(x["key"], x["count"]) for x in consistency.merge_compounds([c("palettendepot", 2), c("palett", 3), c("=en", 9, True)])] == [("=en", 9), ("palett", 5)]
    assert [(x["key"], x["count"]) for x in consistency.merge_inflections([c("regiões", 2), c("região", 3)])] == [("região", 5)]
    assert consistency.same_inflection("un", "uno") and not consistency.same_inflection("der", "das")
    assert consistency.snap_to_script_runs(list("サポート窓口"), 1, 3, "ja") == (0, 3)
    assert consistency.snap_to_script_runs(list("abc"), 1, 1, "de") == (1, 1)


def test_rank(spark):
    rows = [("docket", "jargon", 12, 0.5, 0, 0), ("issue", "ambiguous", 10, 0.5, 3, 3), ("stable", "stable", 99, 0.5, 0, 3)]
    df = spark.createDataFrame(rows, "term string, tier string, df long, label_share double, locales_flagged long, locales_evaluated long")
    assert [r["term"] for r in consistency.rank_for_glossary(df).collect()] == ["issue", "docket"]


def test_definitions(spark, tmp_path):
    good = definitions.StubProvider().define("", 'Term: "issue" (')
    assert definitions.check_definition(good) is good
    for bad in ({}, good | {"senses": []}, good | {"confidence": "sure"}, good | {"senses": [{"label": "x"}]}, []):
        with pytest.raises(definitions.BadDefinition):
            definitions.check_definition(bad)
    prompts = spark.createDataFrame([("issue", 'Term: "issue" ('), ("docket", 'Term: "docket" (')], "term string, prompt string")
    for _ in range(2):
        got = {r["term"]: json.loads(r["definition"])["senses"][0]["label"] for r in definitions.define_terms(prompts, definitions.StubProvider, str(tmp_path / "cache")).collect()}
        assert got == {"issue": "issue", "docket": "docket"}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_cosine_table(spark):
    a = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 2.0])], "pair int, i int, v array<double>")
    b = spark.createDataFrame([(0, 0, [0.0, 1.0]), (0, 1, [1.0, 0.1])], "pair int, j int, w array<double>")
    got = A.mutual_argmax_table(A.cosine_table(a, b)).select("i", "j").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 0)]
    assert A.align(spark.createDataFrame([(1, "de", "Issue date", "Issue Datum"), (2, "de", "", "x")], "id long, lang string, src string, tgt string")).where(F.size("links") > 0).count() == 1
