"""Reports of a scan and of a vocabulary run: whole JSON, a piece at a time, and text that shows the first rows of each list."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_VERSION = 1


def number(n: int) -> str:
    return f"{n:,}"


def percent(part: int, whole: int) -> str:
    return f"{part / whole * 100:.1f}%" if whole else "0%"


def quote(value: str, most: int = 70) -> str:
    flat = " ".join(value.split())
    return json.dumps(flat[: most - 1] + "…" if len(flat) > most else flat, ensure_ascii=False)


def key_list(keys: list[str], most: int = 4) -> str:
    return ", ".join([*keys[:most], *([f"... +{len(keys) - most}"] if len(keys) > most else [])])


def json_parts(result: dict) -> Iterator[str]:
    """A report as JSON text, a piece at a time. Values that are DataFrames are lists of all their rows: partitions come to the driver one
    after the other, each row as the text that Spark makes of it."""
    head = {"reportVersion": REPORT_VERSION, "generatedAt": datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")}
    yield "{"
    for n, (name, value) in enumerate((head | result).items()):
        yield f"{',' if n else ''}\n  {json.dumps(name)}: "
        if isinstance(value, DataFrame):
            yield "["
            for k, row in enumerate(value.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).toLocalIterator()):
                yield f"{',' if k else ''}\n    {row['row']}"
            yield "\n  ]"
        else:
            yield json.dumps(value, indent=2, ensure_ascii=False, default=str).replace("\n", "\n  ")
    yield "\n}\n"


def write_report(spark: SparkSession, result: dict, path: str) -> None:
    """The JSON report as one file, by Hadoop's file system, so that any of Spark's stores will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out = jvm.java.io.OutputStreamWriter(stream, "UTF-8")
    try:
        held: list[str] = []
        for part in json_parts(result):
            held.append(part)
            if len(held) >= 1000:
                out.write("".join(held))
                held.clear()
        out.write("".join(held))
    finally:
        out.close()


def _section(title: str, rows: list[str], total: int | None = None) -> list[str]:
    if not rows and not total:
        return []
    return ["", title if total is None else f"{title} ({number(total)} in all)", *("  " + r for r in rows)]


def _members(group: dict) -> list[str]:
    return [f"  {quote(m['value'])}  <- {key_list(m['keys'], 3)}" for m in group["members"]]


def first(rows: DataFrame | list, top: int) -> list[dict]:
    """The first rows of a report's list."""
    return [x.asDict(True) for x in rows.limit(top).collect()] if isinstance(rows, DataFrame) and top else list(rows[:top]) if isinstance(rows, list) else []


def render_text(r: dict, top: int = 10, threshold: float | None = None, fuzzy: bool = True) -> str:
    """A scan's report. r: what plans.scan.scan() gives; empty sections are left out."""
    s = r["summary"]
    kinds = ", ".join(f"{k} {number(n)}" for k, n in sorted(r["kinds"].items(), key=lambda x: -x[1]))
    near = f"{number(s['fuzzy_keys'])} keys in {number(s['fuzzy_groups'])} groups" + (f" (similarity >= {threshold})" if threshold else "")
    lines = [
        f'glossweave scan: source "{r["source"]}" ({number(r["source_keys"])} keys), {len(r["locales"])} locales',
        "",
        "REDUNDANCY",
        f"  duplicates and variants  {s['duplicate_or_variant_percent']}% ({number(s['duplicate_or_variant_keys'])} of {number(r['source_keys'])} keys)",
        *([f"  with near-duplicates     {s['redundant_percent']}% ({number(s['redundant_keys'])} keys)"] if fuzzy else []),
        f"  exact duplicates         {number(s['duplicate_keys'])} keys in {number(s['duplicate_groups'])} groups",
        f"  normalised variants      {number(s['variant_keys'])} keys in {number(s['variant_groups'])} groups" + (f" ({kinds})" if kinds else ""),
        f"  fuzzy near-duplicates    {near if fuzzy else '(disabled)'}",
        f"  keys that merging duplicates and variants removes: {number(s['collapsible_keys'])}",
    ]
    lines += _section("EXACT DUPLICATES", [x for g in first(r["duplicates"], top) for x in (f"x{len(g['keys'])}  {quote(g['value'])}", f"     {key_list(g['keys'])}")], s["duplicate_groups"])
    lines += _section("VARIANTS", [x for g in first(r["variants"], top) for x in (f"[{', '.join(g['kinds'])}]", *_members(g))], s["variant_groups"])
    tag = lambda g: "[same words, different order]" if g["min_similarity"] == 1 else f"[similarity >= {g['min_similarity']}]"
    lines += _section("NEAR-DUPLICATES", [x for g in first(r["fuzzy"], top) for x in (tag(g), *_members(g))], s["fuzzy_groups"])
    table = [f"{'locale':<8} {'absent':>8} {'empty':>8} {'untranslated':>18} {'extra':>8}"]
    for m in r["missing"]:
        same = "n/a (same language)" if m["same_language"] else f"{number(m['untranslated'])} ({percent(m['untranslated'], r['source_keys'])})"
        table.append(f"{m['locale']:<8} {number(m['absent']):>8} {number(m['empty']):>8} {same:>18} {number(m['extra']):>8}")
    lines += _section(f"MISSING TRANSLATIONS (against {r['source']})", table)
    if u := r.get("unused"):
        head = f"{number(u['count'])} of {number(r['source_keys'])} keys in none of {number(u['files'])} files ({number(u['dynamic'])} more may be built at run time)"
        more = [f"... +{number(u['count'] - top)} more"] if u["count"] > top else []
        lines += _section("UNUSED KEYS", [head, *(k["key"] for k in first(r["unused_keys"], top)), *more])
    warn = [f"{w['locale']}{' ' + w['key'] if w['key'] else ''}: {w['message']}" for w in first(r["warnings"], top)]
    lines += _section("WARNINGS", warn + ([f"... +{number(r['warning_count'] - top)} more"] if r["warning_count"] > top else []), None)
    return "\n".join(lines) + "\n"


# How large a glossary is called.
SCALE = ((100, "dozens of"), (300, "low hundreds of"))


def renderings(p: dict) -> str:
    shown = [f"{'(English) ' if c['kept_english'] else ''}{c['forms'][0]['text']} x{c['count']}" for c in p["clusters"][:4]]
    return " · ".join(shown + ([f"+{len(p['clusters']) - 4} more"] if len(p["clusters"]) > 4 else []))


def _term(t: dict, most: int) -> list[str]:
    zipf = f", zipf {t['zipf']:.1f}" if t["zipf"] is not None else ""
    out = [f"{t['term']}  ({number(t['df'])} strings, {t['locales_flagged']}/{t['locales_evaluated']} languages split, consistency {int(t['consistency'] * 100 + 0.5)}%{zipf})"]
    used = sorted((p for p in t["per_locale"] if p["occurrences"] > 0), key=lambda p: (not p["multiple"], p["dominant_share"]))
    out += [f"    {p['locale'] + ('*' if p['aliases'] else ''):<10} {renderings(p)}" for p in used[:most]]
    if d := t.get("definition"):
        out += [f"    > {x['label']}: {x['definition']}" for x in d["senses"]] + ([f"    > note: {d['translatorNote']}"] if d["translatorNote"] else [])
    return out


def render_vocab_text(r: dict, top: int = 20, locales_per_term: int = 5) -> str:
    """A vocabulary run's report. r: what plans.vocab.vocab() gives."""
    e, groups = r["estimate"], r["locale_groups"]
    aliases, skipped = sum(map(len, groups.values())), ", ".join(s["locale"] for s in r["skipped"])
    core = e["glossary:10"]
    scale = next((words for limit, words in SCALE if core < limit), "hundreds of")
    tiers = ("ambiguous", "jargon", "keep-english", "phrasing", "stable", "insufficient")
    lines = [
        f'glossweave vocab: source "{r["source"]}", {len(groups)} target locales' + (f" (+{aliases} equal ones folded in)" if aliases else "") + (f", skipped {skipped} (same language)" if skipped else ""),
        f"{number(r['pairs'])} distinct pairs aligned ({'; '.join(r['models'])})",
        "",
        "VOCABULARY ESTIMATE",
        f"  {number(e['candidates'])} candidate terms",
        *[f"  {t:<14}{number(e['tier:' + t]):>8}" for t in tiers],
        "  for a glossary: " + ", ".join(f"{number(n)} at >={k.split(':')[1]} strings" for k, n in e.items() if k.startswith("glossary:")),
        f"  so the vocabulary is {scale} concepts, and {number(e['tier:keep-english'])} words are not to be translated",
    ]
    of = lambda tier: [t for t in r["shown"] if t["tier"] == tier]
    lines += _section("MOST INCONSISTENT TERMS", [x for t in of("ambiguous")[:top] for x in _term(t, locales_per_term)], e["tier:ambiguous"])
    keep = of("keep-english")
    lines += _section("KEEP IN ENGLISH", [", ".join(t["term"] for t in keep[: 2 * top])] if keep else [], e["tier:keep-english"] or None)
    lines += _section("JARGON", [x for t in of("jargon")[:top] for x in _term(t, min(3, locales_per_term))], e["tier:jargon"])
    return "\n".join(lines) + "\n"
