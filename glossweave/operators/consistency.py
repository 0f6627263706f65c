"""How consistently terms are translated: occurrences in aligned pairs, clusters of renderings, statistics, tiers, glossary estimate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written
from ..runtime import ship
from .alignment import LEAST_SCORE, UNSPACED, Routing

TIERS = ("ambiguous", "jargon", "keep-english", "phrasing", "stable", "insufficient")
GLOSSARY = ("ambiguous", "jargon")
CUTOFFS = (5, 10, 25, 50)
CLUSTER = "array<struct<key:string,count:bigint,forms:array<struct<text:string,count:bigint>>,example_keys:array<string>,kept_english:boolean>>"


@dataclass(frozen=True)
class Options:
    least_score: dict[str, float] = field(default_factory=lambda: dict(LEAST_SCORE))
    routing: Routing = Routing()
    occurrences: int = 5
    alternative_share: float = 0.2
    alternative_count: int = 3
    flagged: int = 3
    ambiguous_share: float = 0.25
    jargon_zipf: float = 3.5
    label_share: float = 0.15
    keep_english: float = 0.5
    example_keys: int = 5


# --- spans of unspaced languages ----------------------------------------------------------------------------------------------

# Characters at which a span of these languages may grow.
_SNAPS = {"ja": regex.compile(r"[\p{Script=Katakana}ー\p{Script=Han}A-Za-z0-9]"), "zh": regex.compile("[A-Za-z0-9]"), "th": regex.compile("[A-Za-z0-9]")}
_SCRIPTS = (("kana", regex.compile(r"[\p{Script=Katakana}ー]")), ("han", regex.compile(r"\p{Script=Han}")), ("latin", regex.compile("[A-Za-z0-9]")))


def _script(char: str) -> str:
    return next((name for name, pattern in _SCRIPTS if pattern.match(char)), "other")


def snap_to_script_runs(units: list[str], lo: int, hi: int, lang: str) -> tuple[int, int]:
    """Grow a span while the next unit goes on with the same script across the edge."""
    snaps = _SNAPS.get(lang)
    if snaps is None:
        return lo, hi

    def joined(at: int) -> bool:
        """Whether the units on both sides of the gap before `at` belong together."""
        left, right = units[at - 1][-1:], units[at][:1]
        return bool(left and right and snaps.match(left) and snaps.match(right)) and _script(left) == _script(right)

    while lo > 0 and joined(lo):
        lo -= 1
    while hi + 1 < len(units) and joined(hi + 1):
        hi += 1
    return lo, hi


# --- occurrences --------------------------------------------------------------------------------------------------------------


def term_occurrences(requests: DataFrame, results: DataFrame, terms: DataFrame) -> DataFrame:
    """term, id, locale, lang, start (from 0), size, and the aligned arrays: every place where a term's lemmas stand in a source."""
    held = requests.select("id", "locale", "lang", "keys").join(results, "id").withColumn("lemmas", F.transform("src_words", T.lemma))
    at = held.select("*", F.posexplode("lemmas").alias("start", "first"))
    known = terms.select(F.col("id").alias("term"), F.col("lemmas").alias("term_lemmas"), F.get("lemmas", F.lit(0)).alias("first"))
    met = at.join(known, "first").where(F.slice("lemmas", F.col("start") + 1, F.size("term_lemmas")) == F.col("term_lemmas"))
    return met.select("term", "id", "locale", "lang", "start", F.size("term_lemmas").alias("size"), "src_words", "tgt_units", "tgt_stems", "joiner", "spans", "scores", "keys")


def _bar(options: Options) -> Column:
    model = options.routing.column(F.col("lang"))
    out = F.lit(0.0)
    for name, score in options.least_score.items():
        out = F.when(model == name, float(score)).otherwise(out)
    return out


def renderings(occurrences: DataFrame, options: Options = Options()) -> DataFrame:
    """term, locale, id, start, keys, text, cluster, kept_english; text and cluster are null where nothing good enough is aligned."""
    ship(occurrences.sparkSession)

    @F.pandas_udf("struct<lo:int,hi:int>")
    def snapped(units: pd.Series, lo: pd.Series, hi: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = [(a, b) if a is None or pd.isna(a) else snap_to_script_runs(list(u), int(a), int(b), code) for u, a, b, code in zip(units, lo, hi, lang, strict=True)]
        return pd.DataFrame(rows, columns=["lo", "hi"]).astype("Int32")

    own = lambda name: F.slice(name, F.col("start") + 1, F.col("size"))
    good = F.filter(F.arrays_zip(own("spans").alias("span"), own("scores").alias("score")), lambda x: x["span"].isNotNull() & (F.coalesce(x["score"], F.lit(0.0)) >= F.col("bar")))
    rows = occurrences.withColumn("bar", _bar(options)).withColumn("good", good)
    rows = rows.withColumn("lo", F.array_min(F.transform("good", lambda x: x["span"]["lo"]))).withColumn("hi", F.array_max(F.transform("good", lambda x: x["span"]["hi"])))
    unspaced = F.col("lang").isin(*UNSPACED)
    snap = snapped(F.when(unspaced, F.col("tgt_units")).otherwise(F.array().cast("array<string>")), F.when(unspaced, F.col("lo")), F.when(unspaced, F.col("hi")), F.col("lang"))
    rows = rows.withColumn("snap", snap).withColumn("lo", F.coalesce("snap.lo", "lo")).withColumn("hi", F.coalesce("snap.hi", "hi"))
    width = F.col("hi") - F.col("lo") + 1
    aligned = F.col("lo").isNotNull() & (width <= F.when(unspaced, 12).otherwise(2 * F.col("size") + 1))
    part = lambda name, joiner: F.array_join(F.slice(name, F.coalesce(F.col("lo"), F.lit(0)) + 1, F.greatest(F.coalesce(width, F.lit(0)), F.lit(0))), joiner)
    rows = rows.withColumn("text", F.when(aligned, F.when(unspaced, part("tgt_units", "")).otherwise(part("tgt_units", " "))))
    english = F.array_join(own("src_words"), " ")
    rows = rows.withColumn("kept_english", F.when(aligned, T.kept_english(F.col("text"), english, F.col("term"))))
    stems = F.lower(F.when(unspaced, part("tgt_stems", "")).otherwise(part("tgt_stems", " ")))
    key = F.when(F.col("kept_english"), F.lit("=en")).when(F.col("lang") == "ja", T.japanese_key(F.col("text"))).otherwise(stems)
    return rows.select("term", "locale", "id", "start", "keys", "text", F.when(aligned, key).alias("cluster"), "kept_english")


# --- clusters -----------------------------------------------------------------------------------------------------------------


def rendering_clusters(found: DataFrame, example_keys: int = 5) -> DataFrame:
    """term, locale, cluster, count, forms (text, count), example_keys, kept_english, first: one row a cluster of equal keys.

    Forms are counted before they are gathered, so a rendering used a million times is one of a group's few rows."""
    aligned = found.where("cluster is not null").withColumn("place", F.struct("id", "start"))
    forms = aligned.groupBy("term", "locale", "cluster", "text").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.first("kept_english").alias("kept_english"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "place", "text", F.col("n").alias("count"))))
    grouped = forms.groupBy("term", "locale", "cluster").agg(F.sum("n").alias("count"), ordered.alias("f"), F.min("place").alias("first"), F.first("kept_english").alias("kept_english"))
    # the first keys of a cluster: each use gives its keys in order, so only the first uses matter; others are dropped before the shuffle
    use = F.row_number().over(Window.partitionBy("term", "locale", "cluster").orderBy("place"))
    ranked = aligned.select("term", "locale", "cluster", "place", F.slice("keys", 1, example_keys).alias("own"), use.alias("use")).where(F.col("use") <= example_keys)
    kept = ranked.groupBy("term", "locale", "cluster").agg(F.array_sort(F.collect_list(F.struct("place", "own"))).alias("lists"))
    keys = kept.select("term", "locale", "cluster", F.slice(F.flatten(F.transform("lists", lambda x: x["own"])), 1, example_keys).alias("example_keys"))
    tidy = F.transform("f", lambda x: F.struct(x["text"].alias("text"), x["count"].alias("count")))
    return grouped.join(keys, ["term", "locale", "cluster"]).select("term", "locale", "cluster", "count", tidy.alias("forms"), "example_keys", "kept_english", "first")


def same_inflection(a: str, b: str) -> bool:
    """Whether two cluster keys are inflections of the same words."""
    left, right = a.split(" "), b.split(" ")

    def alike(x: str, y: str) -> bool:
        shared = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        short = min(len(x), len(y))
        long_enough = shared >= max(4, -(-6 * short // 10))
        ending_only = short <= 3 and shared >= max(2, short - 1) and abs(len(x) - len(y)) <= 2
        return x == y or long_enough or ending_only

    return len(left) == len(right) and all(map(alike, left, right))


def _fold(clusters: list[dict], order, belongs, merge_keys: bool) -> list[dict]:
    """Go through clusters in an order; one that belongs to a cluster kept before is added to the first such."""
    kept: list[dict] = []
    for c in sorted(clusters, key=order):
        host = None if c["kept_english"] else next((k for k in kept if not k["kept_english"] and belongs(k["key"], c["key"])), None)
        if host is None:
            kept.append({**c, "forms": list(c["forms"]), "example_keys": list(c["example_keys"])})
            continue
        host["count"] += c["count"]
        host["forms"] = sorted([*host["forms"], *c["forms"]], key=lambda f: -f["count"])
        if merge_keys:
            host["example_keys"] = [*host["example_keys"], *c["example_keys"]][: max(len(host["example_keys"]), 5)]
    return sorted(kept, key=lambda c: -c["count"])


def _length(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def merge_compounds(clusters: list[dict]) -> list[dict]:
    """Compounds join the cluster of a one-word key of at least four characters that they contain."""
    return _fold(clusters, lambda c: _length(c["key"]), lambda host, key: " " not in host and _length(host) >= 4 and host in key, True)


def merge_inflections(clusters: list[dict]) -> list[dict]:
    return _fold(clusters, lambda c: -c["count"], same_inflection, False)


def merged_clusters(clusters: DataFrame) -> DataFrame:
    """term, locale, clusters: the clusters of each term and locale, compounds and then inflections folded; most frequent first.

    The folds depend on order, so a group's clusters (distinct keys, not uses) meet in one function call."""
    ship(clusters.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                own = [
                    {"key": c["cluster"], "count": int(c["count"]), "forms": [{"text": f["text"], "count": int(f["count"])} for f in c["forms"]], "example_keys": list(c["example_keys"]), "kept_english": bool(c["kept_english"])}
                    for c in r.own
                ]
                rows.append((r.term, r.locale, merge_inflections(merge_compounds(own))))
            yield pd.DataFrame(rows, columns=["term", "locale", "clusters"])

    own = F.array_sort(F.collect_list(F.struct("first", "cluster", "count", "forms", "example_keys", "kept_english")))
    return clusters.groupBy("term", "locale").agg(own.alias("own")).mapInPandas(fold, f"term string, locale string, clusters {CLUSTER}")


# --- statistics ---------------------------------------------------------------------------------------------------------------


def locale_stats(found: DataFrame, merged: DataFrame, plan: DataFrame, options: Options = Options()) -> DataFrame:
    """term, locale, aliases, occurrences, unaligned, clusters, dominant_share, kept_english_share, multiple."""
    counts = found.groupBy("term", "locale").agg(F.count("cluster").alias("occurrences"), F.count(F.when(F.col("cluster").isNull(), 1)).alias("unaligned"))
    aliases = plan.where("role = 'alias'").groupBy(F.col("rep").alias("locale")).agg(F.array_sort(F.collect_list("locale")).alias("aliases"))
    rows = counts.join(merged, ["term", "locale"], "left").join(aliases, "locale", "left")
    rows = rows.withColumn("clusters", F.coalesce("clusters", F.array().cast(CLUSTER))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    translated = F.transform(F.filter("clusters", lambda c: ~c["kept_english"]), lambda c: c["count"])
    rows = rows.withColumn("translated", translated).withColumn("n", F.aggregate("translated", F.lit(0).cast("long"), lambda a, x: a + x))
    bar = F.greatest(F.lit(options.alternative_count), F.ceil(F.lit(options.alternative_share) * F.col("n")))
    dominant = F.coalesce(F.try_element_at("translated", F.lit(1)), F.lit(0))
    share = lambda part, whole: F.when(whole > 0, T.round_half_up(part / whole, 3)).otherwise(0.0)
    multiple = (F.col("n") >= options.occurrences) & (F.size(F.filter("translated", lambda x: x >= bar)) >= 2)
    return rows.select("term", "locale", "aliases", "occurrences", "unaligned", "clusters", share(dominant, F.col("n")).alias("dominant_share"), share(F.col("occurrences") - F.col("n"), F.col("occurrences")).alias("kept_english_share"), multiple.alias("multiple"))


def term_results(terms: DataFrame, stats: DataFrame, options: Options = Options()) -> DataFrame:
    """term, df, seeded, zipf, label_share, kept_english_share, tier, locales_evaluated, locales_flagged, consistency.

    A locale is evaluated by its rounded share of kept English, so 6 uses of which 1 is English are not enough for 5."""
    evaluated = F.col("occurrences") * (1 - F.col("kept_english_share")) >= options.occurrences
    sums = stats.groupBy("term").agg(
        F.count(F.when(evaluated, 1)).alias("locales_evaluated"),
        F.count(F.when(evaluated & F.col("multiple"), 1)).alias("locales_flagged"),
        T.round_half_up(F.avg(F.when(evaluated, F.col("dominant_share"))), 3).alias("consistency"),
        F.count(F.when(F.col("occurrences") > 0, 1)).alias("with_data"),
        T.round_half_up(F.avg(F.when(F.col("occurrences") > 0, F.col("kept_english_share"))), 3).alias("kept_english_share"),
    )
    rows = terms.withColumnRenamed("id", "term").join(sums, "term", "left")
    if "zipf" not in terms.columns:
        rows = rows.withColumn("zipf", F.lit(None).cast("double"))
    rows = rows.fillna(0, ["locales_evaluated", "locales_flagged", "with_data"]).fillna(0.0, ["consistency", "kept_english_share"])
    rare = F.coalesce(F.col("zipf") < options.jargon_zipf, F.lit(False))
    split = (F.col("locales_flagged") >= options.flagged) & (F.col("locales_flagged") / F.col("locales_evaluated") >= options.ambiguous_share)
    tier = (
        F.when((F.col("with_data") >= 3) & (F.col("kept_english_share") >= options.keep_english), "keep-english")
        .when((F.col("locales_evaluated") < 3) & rare & (F.col("df") > 0), "jargon")
        .when(F.col("locales_evaluated") < 3, "insufficient")
        .when(split & (F.col("label_share") >= options.label_share), "ambiguous")
        .when(split, "phrasing")
        .when(rare, "jargon")
        .otherwise("stable")
    )
    return rows.select("term", *[c for c in ("surfaces",) if c in rows.columns], "df", "seeded", "zipf", "label_share", "kept_english_share", tier.alias("tier"), "locales_evaluated", "locales_flagged", "consistency")


def measure(terms: DataFrame, requests: DataFrame, results: DataFrame, plan: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(term_results, locale_stats) of aligned requests."""
    found = written(renderings(term_occurrences(requests, results, terms), options), "renderings")
    stats = written(locale_stats(found, merged_clusters(rendering_clusters(found, options.example_keys)), plan, options), "stats")
    return term_results(terms, stats, options), stats


def estimate(results: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """name, n: all candidates, terms of every tier (zeros too), glossary terms with at least so many uses."""
    spark = results.sparkSession
    names = spark.createDataFrame([("candidates",), *[(f"tier:{t}",) for t in TIERS], *[(f"glossary:{c}",) for c in cutoffs]], "name string")
    glossary = F.col("tier").isin(*GLOSSARY)
    tags = F.array(F.lit("candidates"), F.concat(F.lit("tier:"), "tier"), *[F.when(glossary & (F.col("df") >= c), F.lit(f"glossary:{c}")) for c in cutoffs])
    counts = results.select(F.explode(tags).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rank_for_glossary(results: DataFrame) -> DataFrame:
    """The glossary tiers with `score`, those most in need of a definition first."""
    split = F.col("locales_flagged") / F.greatest(F.col("locales_evaluated"), F.lit(1))
    score = F.when(F.col("tier") == "ambiguous", 10 + split * F.log10(F.col("df") + 10.0) * F.least(F.lit(1.0), F.col("label_share") * 2)).otherwise(1.0)
    return results.where(F.col("tier").isin(*GLOSSARY)).withColumn("score", score).orderBy(F.desc("score"), F.desc("df"), F.expr("term collate UNICODE"))
