"""Which locales to align and the distinct text pairs to align in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import numbered


def fingerprints(strings: DataFrame, locales: DataFrame) -> DataFrame:
    """locale, fingerprint of its whole content; locales without strings have one of their own.

    Two sums of 64-bit hashes of (key, value), and the count: aggregates that are combined before the shuffle, so that a locale with a
    third of all strings is a few rows."""
    halves = [F.sum(F.xxhash64(F.lit(salt), "key", "value").cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    sums = strings.groupBy("locale").agg(*halves, F.count("*").alias("n"))
    full = locales.select("locale").distinct().join(sums, "locale", "left")
    return full.select("locale", F.sha2(F.concat_ws(":", F.coalesce("h1", F.lit(0)), F.coalesce("h2", F.lit(0)), F.coalesce("n", F.lit(0))), 256).alias("fingerprint"))


def _shortest_first() -> list[Column]:
    return [T.units(F.col("locale")), F.expr("locale collate UNICODE")]


def plan_locales(strings: DataFrame, locales: DataFrame, source: str, only: list[str] | None = None) -> DataFrame:
    """locale, rep, role (rep, alias, skipped), reason: the shortest of equal locales stands for all of them."""
    targets = fingerprints(strings, locales).where(F.col("locale") != source)
    if only is not None:
        targets = targets.where(F.col("locale").isin(only) | T.language(F.col("locale")).isin(only))
    same = T.language(F.col("locale")) == T.language(F.lit(source))
    skipped = targets.where(same).select("locale", F.lit(None).cast("string").alias("rep"), F.lit("skipped").alias("role"), F.lit("same language as source").alias("reason"))
    first = F.first("locale").over(Window.partitionBy("fingerprint").orderBy(*_shortest_first()))
    kept = targets.where(~same).withColumn("rep", first)
    role = F.when(F.col("rep") == F.col("locale"), "rep").otherwise("alias")
    return kept.select("locale", "rep", role.alias("role"), F.lit(None).cast("string").alias("reason")).unionByName(skipped)


def build_requests(strings: DataFrame, source: str, plan: DataFrame, terms: DataFrame) -> DataFrame:
    """id, locale, lang, src, tgt, keys: distinct cleaned pairs of every representative locale whose source holds a term's first word.

    Ids are dense, in the order of locales and first keys."""
    firsts = terms.select(F.get("lemmas", F.lit(0)).alias("lemma")).distinct()
    own = strings.where(F.col("locale") == source).select("key", "ord", F.col("value").alias("raw"))
    held = own.select("key", F.explode(F.array_distinct(T.lemmas(F.col("raw")))).alias("lemma")).join(firsts, "lemma", "left_semi").select("key").distinct()
    relevant = own.join(held, "key", "left_semi").withColumn("src", T.clean(F.col("raw")))
    reps = plan.where("role = 'rep'").select("locale")
    theirs = strings.join(reps, "locale", "left_semi").select("locale", "key", F.col("value").alias("target"))
    joined = relevant.join(theirs, "key").where(~T.is_blank(F.col("target")) & (F.col("target") != F.col("raw")))
    joined = joined.withColumn("tgt", T.clean(F.col("target"))).where("tgt <> ''")
    keys = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"])
    pairs = joined.groupBy("locale", "src", "tgt").agg(keys.alias("keys"), F.min("ord").alias("first"))
    # ids in one order: numbers inside each locale, after a running count of the locales before it
    counts = pairs.groupBy("locale").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(*_shortest_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = numbered(pairs, ["locale"], ["first"], "inside").join(F.broadcast(before), "locale")
    return inside.select((F.col("base") + F.col("inside")).cast("long").alias("id"), "locale", T.language(F.col("locale")).alias("lang"), "src", "tgt", "keys")
