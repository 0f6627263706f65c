import json

import pytest

from glossweave.cli import main
from glossweave.operators.alignment import align, request_keys
from glossweave.sources.caches import through_cache
from glossweave.sources.locales import flatten_json, load_locale_dir, locale_code, parse_file, read_lines
from glossweave.streaming.incremental import align_stream

EN = {
    "plan.title": "Plan of the plot",
    "plan.frost": "Frost expected tonight",
    "plan.frost_again": "Frost expected tonight",
    "plan.frost_loud": "FROST expected tonight",
    "tool.rake": "Bring back the rake",
    "tool.rakes": "Bring back the rakes",
    "unit.kg": "KG",
    "shed.who": "Mornings by the warden",
}
DE = {
    "plan.title": "Plan der Parzelle",
    "plan.frost": "",
    "plan.frost_again": "Heute Nacht Frost",
    "plan.frost_loud": "Heute Nacht FROST",
    "tool.rake": "Bring back the rake",
    "tool.rakes": "Rechen zurückbringen",
    "unit.kg": "KG",
    "attic": "Dachboden",
}


@pytest.fixture
def flat(tmp_path):
    for name, data in (("en", EN), ("en-gb", EN), ("de", DE)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    (tmp_path / "package.json").write_text("{}")
    return str(tmp_path)


def test_flatten():
    assert flatten_json({"a": {"b": "x", "c": 3}, "d": [1], "e": None, "f": True}, "/", "ns") == ({"ns/a/b": "x"}, [("ns/a/c", "number"), ("ns/d", "array"), ("ns/e", "null"), ("ns/f", "boolean")])
    assert list(parse_file(b'{"b": "1", "10": "2", "2": "3", "b": "4"}')[0].items()) == [("2", "3"), ("10", "2"), ("b", "4")]
    assert parse_file(b"[]")[2] and parse_file(b"{")[2].startswith("Invalid JSON") and parse_file(b"\xef\xbb\xbf{}")[2]
    deep = "x"
    for _ in range(50_000):
        deep = {"a": deep}
    assert len(flatten_json(deep)[0]) == 1
    assert locale_code("en_GB") == "en-gb" and locale_code("package") is None


def test_nested_layout(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "common.json").write_text('{"actions": {"save": "Save", "cancel": "Cancel"}, "count": 3, "tags": ["a"]}')
    (tmp_path / "en" / "orders.json").write_text('{"title": "Orders"}')
    (tmp_path / "en.json").write_text('{"orders.title": "Later", "x": "y"}')
    (tmp_path / "fr.json").write_text("{")
    (tmp_path / "pl.json").write_text("{}")
    found = load_locale_dir(spark, str(tmp_path))
    assert [(r["key"], r["value"]) for r in found.source("en").orderBy("ord").collect()] == [("common.actions.save", "Save"), ("common.actions.cancel", "Cancel"), ("orders.title", "Later"), ("x", "y")]
    assert {r["locale"] for r in found.locales.collect()} == {"en", "pl"}
    assert {(r["locale"], r["key"]) for r in found.warnings.collect()} == {("en", "common.count"), ("en", "common.tags"), ("en", "orders.title"), ("fr", None)}
    with pytest.raises(ValueError, match="not found"):
        found.source("xx")


def test_scan_command(spark, flat, capsys, tmp_path):
    assert main([flat], spark) == 0
    text = capsys.readouterr().out
    assert "8 keys" in text and "3 locales" in text and "3 of 8 keys" in text
    out = str(tmp_path / "out" / "r.json")
    assert main(["scan", flat, "--format", "both", "--out", out, "--fail-on", "missing,unused"], spark) == 1
    report = json.load(open(out))
    keys = {(r["locale"], r["category"], r["key"]) for r in report["missing_keys"]}
    assert {k for k in keys if k[0] == "de"} == {("de", "absent", "shed.who"), ("de", "empty", "plan.frost"), ("de", "extra", "attic"), ("de", "untranslated", "tool.rake")}
    assert [m["keys"] for m in report["fuzzy"][0]["members"]] == [["tool.rake"], ["tool.rakes"]]
    assert report["fuzzy"][0]["min_similarity"] == 0.95 and report["summary"]["collapsible_keys"] == 2


@pytest.mark.parametrize("wrong", [["--top", "-1"], ["--top", "x"], ["--format", "both"], ["--format", "xml"], ["--fuzzy-threshold", "2"], ["--fuzzy-max-len", "0"], ["--fail-on", "x"], ["--source", "xx"], ["--nope"], ["twice"]])
def test_wrong_options(spark, flat, wrong):
    assert main(["scan", flat, *wrong], spark) == 2


@pytest.mark.parametrize(
    ("wrong", "says"),
    [([], "one folder"), (["f", "--min-df", "0"], "--min-df"), (["f", "--top", "0"], "--top"), (["f", "--model-for", "th"], "lang=model"), (["f", "--format", "both"], "requires --out"), (["f", "--provider", "foo"], "--provider must be one of stub"), (["f", "--define"], "--domain")],
)
def test_wrong_vocab_options(spark, wrong, says, capsys):
    assert main(["vocab", *wrong], spark) == 2
    assert says in capsys.readouterr().err


def test_help(spark, capsys):
    for argv, says in ((["help"], "--fail-on"), (["help", "vocab"], "--define-model"), (["--help"], "scan <folder>"), (["vocab", "--help"], "--model-for"), (["scan", "-h"], "--separator")):
        assert main(argv, spark) == 0
        assert says in capsys.readouterr().out


def test_lists_are_whole(spark, tmp_path, capsys):
    (tmp_path / "en.json").write_text(json.dumps({f"k{i}": f"value {'ab'[i % 2]} {i // 2}" for i in range(3000)} | {f"m{i}": f"value a {i}" for i in range(1500)}))
    (tmp_path / "de.json").write_text("{}")
    assert main([str(tmp_path), "--no-fuzzy", "--format", "json", "--top", "0", "--fail-on", " missing , unused"], spark) == 1
    report = json.loads(capsys.readouterr().out)
    assert len(report["duplicates"]) == 1500 and len(report["missing_keys"]) == 4500 and report["reportVersion"] == 1
    assert main([str(tmp_path), "--no-fuzzy", "--format", "text", "--top", "0"], spark) == 0
    assert "1,500 groups" in capsys.readouterr().out


def test_allow_list_skips_blank_lines(spark, tmp_path):
    (tmp_path / "allow.txt").write_text("one\n\n  \n two \n")
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "allow.txt")).collect()] == ["one", " two "]


def test_vocab_command(spark, flat, capsys, tmp_path):
    args = ["vocab", flat, "--min-df", "2", "--cache", str(tmp_path / "c"), "--define", "--domain", "allotments"]
    assert main(args, spark) == 0
    assert "VOCABULARY ESTIMATE" in capsys.readouterr().out
    assert main(args, spark) == 0
    out = str(tmp_path / "vocab.json")
    assert main([*args, "--format", "json", "--out", out, "--model-for", "de=xlm-roberta-base", "--define-model", "none"], spark) == 0
    report = json.load(open(out))
    assert report["models"] == ["de: xlm-roberta-base"] and all(t["definition"]["senses"] for t in report["terms"] if t["tier"] == "jargon")
    capsys.readouterr()
    assert main(["vocab", flat, "--locales", "en-gb"], spark) == 2 and "No target locales left" in capsys.readouterr().err


def test_cache_and_stream(spark, tmp_path):
    schema = "id long, lang string, src string, tgt string"
    rows = request_keys(spark.createDataFrame([(1, "de", "Sow date", "Saattag"), (2, "de", "Sow date", "Saattag"), (3, "fr", "Sow date", "Jour")], schema))
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return align(missing).join(missing.select("id", "k"), "id").drop("id")

    path = str(tmp_path / "cache")
    assert through_cache(rows, path, compute).count() == 2
    assert through_cache(rows, path, compute).count() == 2
    assert calls == [2, 0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"lang": "de", "src": "Rake", "tgt": "Harke"}\n{"lang": "de", "src": "Sow date", "tgt": "Saattag"}\n')
    stream = spark.readStream.schema("lang string, src string, tgt string").json(str(tmp_path / "in"))
    align_stream(stream, path, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(path).count() == 3
