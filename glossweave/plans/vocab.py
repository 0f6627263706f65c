"""The vocabulary run: terms, locale plan, alignment through its cache, consistency, estimate, and definitions if asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import work_dir, written
from ..operators import alignment, consistency, definitions, pairs, terms
from ..sources.caches import through_cache
from ..sources.locales import LocaleSet


def vocab(found: LocaleSet, source: str = "en", only: list[str] | None = None, seeds: list[str] = (), least_df: int = 5, most_n: int = 3, zipf: DataFrame | None = None, encoder: Callable | None = None, cache: str | None = None, options: consistency.Options = consistency.Options(), provider: Callable[[], definitions.Provider] | None = None, domain: str = "", define_top: int = 40, shown: int = 20, progress: Callable[[str], None] = lambda text: None) -> dict:
    """The result of a vocabulary run. `terms` is a DataFrame of all terms with their locales and definitions, most frequent first;
    `shown` has the first so many terms of each tier for a text report (twice as many of those that stay English)."""
    spark = found.strings.sparkSession
    own = written(found.source(source), "source")
    if provider is not None:
        provider()  # one that can't be made fails before the alignment, not after it
    cache = cache or f"{work_dir(spark)}/cache"
    known = terms.extract_terms(own, list(seeds), least_df, most_n)
    known = written(terms.with_zipf(known, zipf) if zipf is not None else known.withColumn("zipf", F.lit(None).cast("double")), "terms")
    progress(f"vocab: {known.count()} candidate terms")
    plan = written(pairs.plan_locales(found.strings, found.locales, source, only), "plan")
    groups = plan.where("role = 'rep'").count()
    if not groups:
        raise ValueError("No target locales left to analyse")
    requests = written(alignment.request_keys(pairs.build_requests(found.strings, source, plan, known), options.routing), "requests")

    progress(f"vocab: aligning {requests.count()} string pairs across {groups} locales")

    def keyed(missing: DataFrame) -> DataFrame:
        numbered = written(missing.withColumn("id", F.monotonically_increasing_id()), "missing")
        return alignment.align(numbered, encoder, options.routing).join(numbered.select("id", "k"), "id").drop("id")

    results = requests.select("id", "k").join(through_cache(requests, f"{cache}/align", keyed), "k").drop("k")
    rows, stats = consistency.measure(known, requests, results, plan, options)
    rows, stats = written(rows, "results"), written(stats, "stats")
    place = F.struct(F.length("locale").alias("size"), F.expr("locale collate UNICODE").alias("name"))
    per_locale = stats.groupBy("term").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(*stats.columns).alias("row")))).alias("p")).select("term", F.transform("p", lambda x: x["row"]).alias("per_locale"))
    whole = rows.join(per_locale, "term", "left")
    if provider is not None:
        asked = [r.asDict(True) for r in consistency.rank_for_glossary(whole).limit(define_top).collect()]
        keys = sorted({k for t in asked for p in t["per_locale"] or [] for c in p["clusters"] for k in c["example_keys"]})
        texts = {r["key"]: r["value"] for r in own.where(F.col("key").isin(keys)).collect()} if keys else {}
        prompts = spark.createDataFrame([(t["term"], definitions.build_prompt(t, t["per_locale"] or [], texts, domain)) for t in asked], "term string, prompt string")
        progress(f"vocab: drafting definitions of {len(asked)} terms")
        said = definitions.define_terms(prompts, provider, f"{cache}/definitions")
        whole = whole.join(said.withColumn("definition", F.from_json("definition", definitions.RECORD)), "term", "left")
    whole = written(whole, "terms")
    tiers = {"ambiguous": shown, "jargon": shown, "keep-english": 2 * shown}
    first = [r.asDict(True) for tier, n in tiers.items() for r in (consistency.rank_for_glossary(whole) if tier in consistency.GLOSSARY else whole.orderBy(F.desc("df"), F.expr("term collate UNICODE"))).where(F.col("tier") == tier).limit(n).collect()]
    places = plan.collect()
    languages = [r["lang"] for r in requests.select("lang").distinct().orderBy("lang").collect()]
    return {
        "source": source,
        "locale_groups": {r["locale"]: sorted(x["locale"] for x in places if x["role"] == "alias" and x["rep"] == r["locale"]) for r in places if r["role"] == "rep"},
        "skipped": [{"locale": r["locale"], "reason": r["reason"]} for r in places if r["role"] == "skipped"],
        "pairs": requests.count(),
        "models": [f"{x}: {options.routing.of(x)}" for x in languages],
        "estimate": {r["name"]: r["n"] for r in consistency.estimate(rows).collect()},
        "shown": [t | {"per_locale": t["per_locale"] or []} for t in first],
        "terms": whole.orderBy(F.desc("df"), F.expr("term collate UNICODE")),
    }
