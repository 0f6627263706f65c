"""Candidate terms of a source locale: n-grams of lemmas with their document frequency, filtered by frequency, cohesion and subsumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written


def _grams(strings: DataFrame, most_n: int) -> DataFrame:
    """words, grams (array of id, surface): every candidate n-gram use of each distinct value of strings (value)."""
    distinct = strings.select("value").distinct().select(T.words(F.col("value")).alias("forms"))
    distinct = distinct.select("forms", F.transform("forms", T.lemma).alias("lemmas"), F.size("forms").alias("words"))

    def grams(n: int) -> Column:
        starts = F.when(F.col("words") >= n, F.sequence(F.lit(1), F.col("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.slice("lemmas", i, n).alias("gram"), F.array_join(F.slice("forms", i, n), " ").alias("surface")))

    kept = F.filter(F.concat(*[grams(n) for n in range(1, most_n + 1)]), lambda g: T.is_candidate(g["gram"]))
    return distinct.select("words", F.transform(kept, lambda g: F.struct(F.array_join(g["gram"], " ").alias("id"), g["surface"].alias("surface"))).alias("grams"))


def gram_counts(strings: DataFrame, most_n: int = 3) -> DataFrame:
    """id, n, df (distinct values with it), labels (of those, short ones of at most n + 3 words).

    A value's grams are made distinct before they are exploded, so a count of rows is the df and no text is shuffled."""
    # ids alone: distinct strings are hashed, distinct structs would be compared in pairs; a word holds no space
    once = _grams(strings, most_n).select("words", F.explode(F.array_distinct(F.transform("grams", lambda g: g["id"]))).alias("id"))
    size = F.length("id") - F.length(F.replace(F.col("id"), F.lit(" "), F.lit(""))) + 1
    counts = once.withColumn("n", size).groupBy("id", "n").agg(F.count("*").alias("df"), F.count(F.when(F.col("words") <= F.col("n") + 3, 1)).alias("labels"))
    return counts.select("id", "n", "df", "labels")


def surfaces(strings: DataFrame, ids: DataFrame, most_n: int = 3) -> DataFrame:
    """id, surface, n_uses: how often each form stands for one of the terms (id)."""
    # of a value's grams the distinct ones, with their numbers, are exploded as text: an array of structs would be copied for each
    use = F.transform("grams", lambda g: F.concat(g["id"], F.lit("\t"), g["surface"]))
    uses = _grams(strings, most_n).select(F.explode(use).alias("use")).select(F.split_part("use", F.lit("\t"), F.lit(1)).alias("id"), F.split_part("use", F.lit("\t"), F.lit(2)).alias("surface"))
    return uses.join(ids, "id", "left_semi").groupBy("id", "surface").agg(F.count("*").alias("n_uses"))


def seed_ids(spark: SparkSession, seeds: list[str]) -> DataFrame:
    """id of each seed that has words."""
    return spark.createDataFrame([(s,) for s in seeds], "seed string").select(F.array_join(T.lemmas(F.col("seed")), " ").alias("id")).where("id <> ''").distinct()


def candidates(counts: DataFrame, seeds: DataFrame, least_df: int = 5, least_cohesion: float = 0.3) -> DataFrame:
    """id, n, df, labels, seeded: grams that are frequent and, as phrases, used as labels and cohesive; seeds in any case."""
    marked = counts.join(seeds.withColumn("seed", F.lit(True)), "id", "left").withColumn("seeded", F.col("seed").isNotNull())
    single = counts.where("n = 1").select(F.col("id").alias("word"), F.col("df").alias("word_df"))
    parts = marked.where((F.col("n") > 1) & ((F.col("df") >= least_df) | F.col("seeded"))).select("id", "df", F.explode(F.filter(F.split("id", " "), lambda w: ~w.isin(T.INNER))).alias("word"))
    rarest = parts.join(single, "word", "left").groupBy("id").agg(F.min(F.coalesce("word_df", "df")).alias("rarest"))
    phrase = (F.col("labels") > 0) & (F.col("df") / F.col("rarest") >= least_cohesion)
    kept = (F.col("df") >= least_df) & ((F.col("n") == 1) | phrase)
    return marked.join(rarest, "id", "left").where(F.col("seeded") | F.coalesce(kept, F.lit(False))).select("id", "n", "df", "labels", "seeded")


def subsumed(terms: DataFrame, share: float = 0.9) -> DataFrame:
    """id of terms that one longer term covers in at least this share of their uses."""
    words = F.split("id", " ")
    lengths = F.sequence(F.lit(1), F.col("n") - 1)
    inner = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    longer = terms.where("n > 1").select(F.col("df").alias("longer_df"), F.explode(inner).alias("id"))
    return terms.join(longer, "id").where(F.col("longer_df") >= share * F.col("df")).select("id").distinct()


def extract_terms(strings: DataFrame, seeds: list[str] = (), least_df: int = 5, most_n: int = 3, least_cohesion: float = 0.3, share: float = 0.9) -> DataFrame:
    """id, lemmas, surfaces (map), df, seeded, label_share, most frequent first. Seeds that never occur have df 0."""
    spark = strings.sparkSession
    seeds_df = seed_ids(spark, list(seeds))
    counts = written(gram_counts(strings, most_n), "counts")
    terms = written(candidates(counts, seeds_df, least_df, least_cohesion), "terms")
    kept = terms.join(subsumed(terms, share).withColumn("gone", F.lit(True)), "id", "left").where(F.col("seeded") | F.col("gone").isNull())
    forms = surfaces(strings, kept.select("id"), most_n).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "n_uses")))).alias("surfaces"))
    found = kept.join(forms, "id").select("id", F.split("id", " ").alias("lemmas"), "surfaces", "df", "seeded", T.round_half_up(F.col("labels") / F.col("df"), 2).alias("label_share"))
    unseen = seeds_df.join(counts, "id", "left_anti").select("id", F.split("id", " ").alias("lemmas"), F.create_map().cast("map<string,bigint>").alias("surfaces"), F.lit(0).cast("long").alias("df"), F.lit(True).alias("seeded"), F.lit(0.0).alias("label_share"))
    return found.unionByName(unseen).orderBy(F.desc("df"), F.expr("id collate UNICODE"))


def with_zipf(terms: DataFrame, zipf: DataFrame) -> DataFrame:
    """terms with the general-English frequency of a table (term, zipf); null where it has none."""
    return terms.join(zipf.select(F.col("term").alias("id"), "zipf"), "id", "left")
