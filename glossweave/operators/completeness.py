"""Missing translations of target locales, and keys that no source code uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Code files and folders that are skipped.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "svelte", "html")
SKIPPED = ("node_modules", ".git", "dist", "build", "coverage", ".next")
# Unrolled possessive groups: other forms overflow the regex stack on long literals.
LITERAL = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'" + r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
FRAGMENT = r"^[\w\-]+(?:\.[\w\-]+)*[._]$"


def find_missing(strings: DataFrame, locales: DataFrame, source: str, allowed: DataFrame | None = None) -> DataFrame:
    """locale, key, category (absent, empty, untranslated, extra), ord over all targets at once.

    strings: locale, key, value, ord; locales: locale (a locale may have no strings), few enough for a list; allowed: value, source values
    that may stay. A null value counts as absent."""
    own = strings.where(F.col("locale") == source).select("key", F.col("value").alias("source_value"), F.col("ord").alias("source_ord"))
    targets = locales.where(F.col("locale") != source).select("locale").distinct()
    names = [r["locale"] for r in targets.collect()]
    theirs = strings.where(F.col("locale").isin(names)).select("locale", "key", "value")
    # a source key is absent from the targets that it isn't in: only keys that some target lacks are held against all targets
    known = theirs.where("value is not null").groupBy("key").agg(F.collect_set("locale").alias("has"))
    every = F.array(*map(F.lit, names)).cast("array<string>")
    lacking = own.join(known, "key", "left").select("key", "source_value", "source_ord", F.explode(F.array_except(every, F.coalesce("has", F.array().cast("array<string>")))).alias("locale"))
    absent = lacking.select("locale", "key", F.lit("absent").alias("category"), F.col("source_ord").alias("ord"))
    joined = own.join(theirs.where("value is not null"), "key")
    if allowed is not None:
        joined = joined.join(allowed.select(F.col("value").alias("source_value"), F.lit(True).alias("may_stay")).distinct(), "source_value", "left")
    else:
        joined = joined.withColumn("may_stay", F.lit(None).cast("boolean"))
    other = T.language(F.col("locale")) != T.language(F.lit(source))
    same = other & (F.col("value") == F.col("source_value")) & ~T.is_invariant(F.col("source_value")) & F.col("may_stay").isNull()
    category = F.when(T.is_blank(F.col("value")) & ~T.is_blank(F.col("source_value")), "empty").when(same, "untranslated")
    found = joined.select("locale", "key", category.alias("category"), F.col("source_ord").alias("ord")).where("category is not null")
    extra = strings.where(F.col("locale") != source).join(own, "key", "left_anti").select("locale", "key", F.lit("extra").alias("category"), "ord")
    return found.unionByName(absent).unionByName(extra)


def missing_counts(missing: DataFrame, locales: DataFrame, source: str) -> DataFrame:
    """locale, same_language, absent, empty, untranslated, extra of every target, zeros too."""
    counts = missing.groupBy("locale").pivot("category", ["absent", "empty", "untranslated", "extra"]).count()
    targets = locales.where(F.col("locale") != source).select("locale").distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("absent", "empty", "untranslated", "extra")]
    return targets.join(counts, "locale", "left").select("locale", (T.language(F.col("locale")) == T.language(F.lit(source))).alias("same_language"), *zero)


def string_literals(code: DataFrame) -> DataFrame:
    """path, quote, body of every string literal in code (path, content), left to right; escapes stay as they are."""
    found = code.select("path", F.explode(F.regexp_extract_all("content", F.lit(LITERAL), F.lit(0))).alias("raw"))
    return found.select("path", F.substring("raw", 1, 1).alias("quote"), F.substring(F.col("raw"), F.lit(2), F.length("raw") - 2).alias("body"))


def used_literals(literals: DataFrame) -> DataFrame:
    """literal: what a key can equal. Templates with a substitution are none."""
    return literals.where((F.col("quote") != "`") | (F.instr("body", "${") == 0)).select(F.col("body").alias("literal")).distinct()


def dynamic_prefixes(literals: DataFrame, given: list[str] = ()) -> DataFrame:
    """prefix: beginnings of keys that are put together at run time, three characters at least."""
    cut = F.instr("body", "${")
    quoted = literals.where((F.col("quote") != "`") & F.col("body").rlike(FRAGMENT)).select(F.col("body").alias("prefix"))
    templates = literals.where((F.col("quote") == "`") & (cut > 1)).select(F.substring(F.col("body"), F.lit(1), cut - 1).alias("prefix"))
    own = literals.sparkSession.createDataFrame([(p,) for p in given], "prefix string")
    return quoted.unionByName(templates).unionByName(own).where(T.units(F.col("prefix")) >= 3).distinct()


def key_usage(keys: DataFrame, code: DataFrame, given: list[str] = ()) -> DataFrame:
    """key, ord, status (used, dynamic, unused) of keys (key, ord).

    A key's own beginnings are joined to the prefixes by equality, so no nested loop is needed."""
    literals = string_literals(code)
    used = used_literals(literals).select(F.col("literal").alias("key"), F.lit(True).alias("used"))
    prefixes = dynamic_prefixes(literals, given)
    begun = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    dynamic = begun.join(prefixes, "prefix", "left_semi").select("key").distinct().withColumn("dynamic", F.lit(True))
    status = F.when(F.col("used"), "used").when(F.col("dynamic"), "dynamic").otherwise("unused")
    return keys.join(used, "key", "left").join(dynamic, "key", "left").select("key", "ord", status.alias("status"))


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the code files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split(":", 1)[-1].replace("//", "/")
    below = F.substring(F.col("path"), F.instr("path", base) + len(base), F.length("path"))
    kept = ~T.any_of([below.contains(f"/{d}/") for d in SKIPPED]) & F.element_at(F.split("path", r"\."), -1).isin(list(EXTENSIONS))
    return files.where(kept).select("path", F.decode("content", "UTF-8").alias("content"))
