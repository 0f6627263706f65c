"""The scan of a locale set: all analyses over one written `strings`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import completeness, redundancy
from ..sources.locales import LocaleSet

FAIL_ON = ("missing", "untranslated", "duplicates", "variants", "fuzzy", "unused")


def scan(found: LocaleSet, source: str = "en", threshold: float | None = 0.85, most_length: int = 200, allowed: DataFrame | None = None, code: DataFrame | None = None, prefixes: list[str] = ()) -> dict:
    """The result of a scan; threshold None: no fuzzy search. Lists are whole DataFrames in the order of the report, counts are numbers."""
    own = written(found.source(source), "source")
    strings = written(found.strings, "strings")
    duplicates, variants = written(redundancy.find_duplicates(own), "duplicates"), written(redundancy.find_variants(own), "variants")
    fuzzy = None
    if threshold is not None:
        fuzzy = written(redundancy.find_fuzzy(own, threshold, most_length), "fuzzy")
    summary = redundancy.summary(own, duplicates, variants, fuzzy).first().asDict()
    missing = written(completeness.find_missing(strings, found.locales, source, allowed), "missing")
    warnings = written(found.warnings, "warnings")
    counts = {r["locale"]: r.asDict() for r in completeness.missing_counts(missing, found.locales, source).collect()}
    order = [r["locale"] for r in found.locales.orderBy("ord").select("locale").collect()]
    out = {
        "source": source,
        "source_keys": summary.pop("source_keys"),
        "locales": order,
        "summary": summary,
        "kinds": {r["kind"]: r["n"] for r in redundancy.kind_counts(variants).collect()},
        "duplicates": duplicates.orderBy(F.desc("n"), F.expr("value collate UNICODE")),
        "variants": variants.orderBy(F.desc("n"), F.expr("normalised collate UNICODE")),
        "fuzzy": fuzzy.orderBy(F.desc("min_similarity"), "n") if fuzzy is not None else [],
        "missing": [counts[x] for x in order if x in counts],
        "missing_keys": missing.orderBy("locale", "category", "ord"),
        "warning_count": warnings.count(),
        "warnings": warnings.orderBy("ord").drop("ord"),
    }
    if code is not None:
        usage = written(completeness.key_usage(own.select("key", "ord"), code, list(prefixes)), "usage")
        n = {r["status"]: r["count"] for r in usage.groupBy("status").count().collect()}
        out["unused"] = {"files": code.count(), "count": n.get("unused", 0), "dynamic": n.get("dynamic", 0)}
        out["unused_keys"] = usage.where("status = 'unused'").orderBy("ord").select("key")
    return out


def failures(result: dict, fail_on: list[str]) -> list[str]:
    """Which of the asked-for findings a scan has; `unused` never without code."""
    sums = {k: sum(m[k] for m in result["missing"]) for k in ("absent", "empty", "untranslated")}
    has = {
        "missing": sums["absent"] + sums["empty"] > 0,
        "untranslated": sums["untranslated"] > 0,
        "duplicates": result["summary"]["duplicate_groups"] > 0,
        "variants": result["summary"]["variant_groups"] > 0,
        "fuzzy": result["summary"]["fuzzy_groups"] > 0,
        "unused": bool(result.get("unused", {}).get("count")),
    }
    return [x for x in fail_on if has[x]]
