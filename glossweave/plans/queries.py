"""The reference operators as registered queries over the driver's tables, with equivalent SQL where SQL can say the same.

The driver has no locale files, so part names, sentences of documents, conversations and pages stand in for them (adapters below)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written
from ..operators import alignment, completeness, consistency, near_texts, pairs, redundancy, terms
from ..sources import caches, locales

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- adapters -----------------------------------------------------------------------------------------------------------------


def part_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, ord: part names as one locale."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("ord"))


def decorated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, three in four of them changed: upper case, a full stop, or doubled spaces."""
    kind = F.col("ord") % 4
    value = F.when(kind == 0, F.upper("value")).when(kind == 1, F.concat("value", F.lit("."))).when(kind == 2, F.regexp_replace("value", " ", "  ")).otherwise(F.col("value"))
    return part_strings(spark, sf_dir).withColumn("value", value)


def marked_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with placeholders, tags, entities, codes and links."""
    kind = F.col("ord") % 8
    value = (
        F.when(kind == 0, F.concat("value", F.lit(" {V1}")))
        .when(kind == 1, F.concat(F.lit("<b>"), "value", F.lit("</b>")))
        .when(kind == 2, F.concat("value", F.lit(" %s of %1$d")))
        .when(kind == 3, F.concat("value", F.lit(" &nbsp; {{ count }}")))
        .when(kind == 4, F.concat(F.lit("B"), F.col("key"), F.lit("A")))
        .when(kind == 5, F.concat(F.lit("https://example.org/"), F.col("key")))
        .when(kind == 6, F.lit("OK"))
        .otherwise(F.col("value"))
    )
    return part_strings(spark, sf_dir).withColumn("value", value)


def two_locales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(strings, locales): part names as en, and as de with some keys absent, blank, the same, and new."""
    part = table(spark, sf_dir, "part")
    own = part_strings(spark, sf_dir).select(F.lit("en").alias("locale"), "key", "value", "ord")
    k = F.col("p_partkey")
    value = F.when(k % 11 == 0, " ").when(k % 5 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    german = part.where(k % 7 != 0).select(F.lit("de").alias("locale"), k.cast("string").alias("key"), value.alias("value"), k.alias("ord"))
    extra = part.where(k % 13 == 0).select(F.lit("de").alias("locale"), F.concat(F.lit("x"), k.cast("string")).alias("key"), F.col("p_name").alias("value"), (k + 1_000_000_000).alias("ord"))
    return own.unionByName(german).unionByName(extra), spark.createDataFrame([("en", 0), ("de", 1)], "locale string, ord int")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: distinct sentences of all documents, in any language and script."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[.\n]+")).alias("value")).distinct()


def text_word_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word: every word of the whole text of every document."""
    return table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, norm: distinct normal forms of the part names with a changed letter here and there."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    value = F.concat_ws(" ", F.when(k % 3 == 0, F.concat("p_name", F.lit("s"))).when(k % 3 == 1, F.regexp_replace("p_name", "a", "")).otherwise(F.col("p_name")), F.col("p_brand"))
    return redundancy.fuzzy_nodes(part.select(k.cast("string").alias("key"), value.alias("value"), k.alias("ord")))


def sentence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, norm: distinct normal forms of all sentences of all documents; a node is the place of its first sentence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.\n]+")).alias("at", "value"))
    first = docs.groupBy("value").agg(F.min(F.shiftleft("doc_id", 24) + F.col("at")).alias("ord"))
    return redundancy.fuzzy_nodes(first.select(F.col("ord").cast("string").alias("key"), "value", "ord"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ord: words that pages have as literals, and all part keys, which they don't have."""
    found = part_strings(spark, sf_dir).select(F.concat(F.lit("/p"), "key").alias("key"), "ord")
    return found.unionByName(spark.createDataFrame([("</p>", -1), ("utf-8", -2), ("/The", -3), ("ad", -4)], "key string, ord long"))


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, i, j, s: cosines of even against odd vectors of a label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    even = e.where("vec_id % 2 = 0").select(F.col("label").alias("pair"), F.col("vec_id").alias("i"), "v")
    odd = e.where("vec_id % 2 = 1").select(F.col("label").alias("pair"), F.col("vec_id").alias("j"), F.col("v").alias("w"))
    return alignment.cosine_table(even, odd)


def talk_strings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(strings, locales): user turns as en, the answers as de."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws(".", F.col("conv_id"), F.col("turn"))
    order = F.col("conv_id") * 1000 + F.col("turn")
    own = c.where("role = 'user' and text is not null").groupBy(key.alias("key")).agg(F.min("text").alias("value"), F.min(order).alias("ord")).select(F.lit("en").alias("locale"), "key", "value", "ord")
    answer = F.concat_ws(".", F.col("conv_id"), F.col("turn") - 1)
    theirs = c.where("role = 'assistant' and text is not null").groupBy(answer.alias("key")).agg(F.min("text").alias("value"), F.min(order).alias("ord")).select(F.lit("de").alias("locale"), "key", "value", "ord")
    return own.unionByName(theirs), spark.createDataFrame([("en", 0), ("de", 1)], "locale string, ord int")


def word_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lemmas, df, seeded, zipf, label_share: the words of part names as terms."""
    word = table(spark, sf_dir, "part").select("p_name").distinct().select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    size = F.length("word")
    return word.select(T.lemma(F.col("word")).alias("id"), F.array(T.lemma(F.col("word"))).alias("lemmas"), "df", F.lit(False).alias("seeded"), (size * 1.0).alias("zipf"), F.when(size % 2 == 0, 0.5).otherwise(0.05).alias("label_share"))


def aligned_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, results, plan): part names, aligned word by word to made-up renderings in three locales. One row in ten scores badly; a
    word is rendered in one of two ways, the second sometimes with an ending, or kept; words of three letters have one way, those of
    six are kept."""
    part = table(spark, sf_dir, "part")
    locale = F.element_at(F.array(*map(F.lit, ("de", "fr", "pl"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = part.select(F.col("p_partkey").alias("id"), locale.alias("locale"), locale.alias("lang"), F.array(F.col("p_partkey").cast("string")).alias("keys"), F.split("p_name", " ").alias("src_words"), "p_size")

    def rendering(w: Column) -> Column:
        kind = F.when(F.length(w) == 3, 0).when(F.length(w) == 6, 5).otherwise((F.col("p_size") + F.length(w)) % 6)
        return F.when(kind < 3, F.concat(F.lit("ka"), F.reverse(w))).when(kind == 3, F.concat(F.lit("zo"), F.reverse(w))).when(kind == 4, F.concat(F.lit("zo"), F.reverse(w), F.lit("n"))).otherwise(w)

    units = F.transform("src_words", rendering)
    at = lambda value: F.transform("src_words", lambda _, i: value(i))
    results = rows.select(
        "id", "src_words", units.alias("tgt_units"), units.alias("tgt_stems"), F.lit(" ").alias("joiner"), at(lambda i: F.struct(i.alias("i"), i.alias("j"))).alias("links"),
        at(lambda i: F.struct(i.alias("lo"), i.alias("hi"))).alias("spans"), at(lambda i: F.when(F.col("id") % 10 == 0, 0.3).otherwise(0.8)).alias("scores"),
    )
    plan = spark.createDataFrame([(x, x, "rep") for x in ("de", "fr", "pl")] + [("de-at", "de", "alias")], "locale string, rep string, role string")
    return rows.select("id", "locale", "lang", "keys"), results, plan


# --- queries ------------------------------------------------------------------------------------------------------------------


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redundancy.find_duplicates(part_strings(spark, sf_dir))
    return found.select("value", F.col("n").alias("n_keys"), F.explode("keys").alias("key"))


def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redundancy.find_variants(decorated_strings(spark, sf_dir))
    members = found.select("normalised", F.array_join("kinds", ",").alias("kinds"), F.explode("members").alias("m"))
    return members.select("normalised", "kinds", F.col("m.value").alias("value"), F.size("m.keys").cast("long").alias("n_keys"))


def variant_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.kind_counts(redundancy.find_variants(decorated_strings(spark, sf_dir)))


def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.normalised(decorated_strings(spark, sf_dir)).select("key", "norm")


def masked_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_strings(spark, sf_dir).select("key", T.normalise(F.col("value")).alias("norm"))


def strip_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_strings(spark, sf_dir).select("key", T.clean(F.col("value")).alias("clean"))


def invariant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_strings(spark, sf_dir).select("key", "value", T.is_invariant(F.col("value")).alias("invariant"))


def blocking_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.postings(nodes(spark, sf_dir)).groupBy("feature").agg(F.count("*").alias("n_nodes"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.candidate_pairs(written(redundancy.postings(nodes(spark, sf_dir)), "postings"))


def fuzzy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(nodes(spark, sf_dir), "nodes")
    pairs_ = redundancy.candidate_pairs(written(redundancy.postings(own), "postings"), threshold=0.85)
    return redundancy.fuzzy_edges(own, pairs_).select("a", "b", T.round_half_up(F.col("similarity"), 6).alias("similarity"))


def fuzzy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(nodes(spark, sf_dir), "nodes")
    pairs_ = redundancy.candidate_pairs(written(redundancy.postings(own), "postings"), threshold=0.85)
    return redundancy.fuzzy_components(written(redundancy.fuzzy_edges(own, pairs_), "edges"))


def sentence_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.postings(sentence_nodes(spark, sf_dir)).groupBy("feature").agg(F.count("*").alias("n_nodes"))


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.candidate_pairs(written(redundancy.postings(sentence_nodes(spark, sf_dir)), "postings"))


def _sentence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts.near_edges(sentence_nodes(spark, sf_dir))


def sentence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentence_edges(spark, sf_dir).select("a", "b", T.round_half_up(F.col("similarity"), 6).alias("similarity"))


def sentence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.fuzzy_components(_sentence_edges(spark, sf_dir))


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = decorated_strings(spark, sf_dir)
    return redundancy.summary(own, redundancy.find_duplicates(own), redundancy.find_variants(own), redundancy.find_fuzzy(own))


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings, codes = two_locales(spark, sf_dir)
    return completeness.find_missing(strings, codes, "en").drop("ord")


def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings, codes = two_locales(spark, sf_dir)
    return completeness.missing_counts(completeness.find_missing(strings, codes, "en"), codes, "en")


def string_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.string_literals(code(spark, sf_dir)).groupBy("quote", "body").agg(F.count("*").alias("n"))


def unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.key_usage(page_keys(spark, sf_dir), code(spark, sf_dir)).select("key", "status")


def words_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_word_uses(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_word_uses(spark, sf_dir).distinct().select("word", T.lemma(F.col("word")).alias("lemma"))


def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.gram_counts(part_strings(spark, sf_dir)).select("id", F.col("n").cast("long").alias("n"), "df", "labels")


def term_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terms.extract_terms(sentences(spark, sf_dir), ["Thisword neverseen"], 3)
    return found.select("id", "df", "seeded", "label_share")


def subsumed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(terms.gram_counts(sentences(spark, sf_dir)), "counts")
    return terms.subsumed(terms.candidates(counts, terms.seed_ids(spark, []), 2))


def locale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings, _ = two_locales(spark, sf_dir)
    twin = strings.where("locale = 'de'").withColumn("locale", F.lit("de-at"))
    british = strings.where("locale = 'en'").withColumn("locale", F.lit("en-gb"))
    codes = spark.createDataFrame([(x,) for x in ("en", "de", "de-at", "en-gb", "fr")], "locale string")
    return pairs.plan_locales(strings.unionByName(twin).unionByName(british), codes, "en")


def align_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings, codes = two_locales(spark, sf_dir)
    plan = pairs.plan_locales(strings, codes, "en")
    found = pairs.build_requests(strings, "en", plan, word_terms(spark, sf_dir))
    return found.select("id", "locale", "lang", "src", "tgt", F.size("keys").cast("long").alias("n_keys"))


def align_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings, codes = talk_strings(spark, sf_dir)
    known = written(terms.extract_terms(strings.where("locale = 'en'"), [], 5, 2), "terms")
    found = alignment.align(written(pairs.build_requests(strings, "en", pairs.plan_locales(strings, codes, "en"), known), "requests"))
    return found.select("id", F.size("src_words").alias("words"), F.size("links").alias("links"), F.size(F.filter("spans", lambda s: s.isNotNull())).alias("spans"))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, results, _ = aligned_parts(spark, sf_dir)
    return consistency.term_occurrences(requests, results, word_terms(spark, sf_dir))


def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrences(spark, sf_dir).select("term", "id", "locale", F.col("start").cast("long").alias("start"))


def renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.renderings(_occurrences(spark, sf_dir)).select("term", "locale", "id", F.col("start").cast("long").alias("start"), "text", "cluster", "kept_english")


def rendering_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.rendering_clusters(consistency.renderings(_occurrences(spark, sf_dir)))
    return found.select("term", "locale", "cluster", "count", F.size("forms").cast("long").alias("n_forms"), F.array_join("example_keys", ",").alias("example_keys"), "kept_english")


def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.merged_clusters(consistency.rendering_clusters(consistency.renderings(_occurrences(spark, sf_dir))))
    return found.select("term", "locale", F.explode("clusters").alias("c")).select("term", "locale", F.col("c.key").alias("cluster"), F.col("c.count").alias("count"), F.size("c.forms").cast("long").alias("n_forms"))


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests, results, plan = aligned_parts(spark, sf_dir)
    return consistency.measure(word_terms(spark, sf_dir), requests, results, plan)


def term_locale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _measured(spark, sf_dir)[1].withColumn("aliases", F.array_join("aliases", ",")).withColumn("n_clusters", F.size("clusters").cast("long"))
    return found.select("term", "locale", "aliases", "occurrences", "unaligned", "n_clusters", "dominant_share", "kept_english_share", "multiple")


def term_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)[0]


def glossary_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.estimate(_measured(spark, sf_dir)[0])


def glossary_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.rank_for_glossary(_measured(spark, sf_dir)[0]).select("term", "tier", T.round_half_up(F.col("score"), 6).alias("score"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names and types, half of them in a cache."""
    part = table(spark, sf_dir, "part").select(F.lit("de").alias("lang"), F.col("p_name").alias("src"), F.col("p_type").alias("tgt"), "p_partkey")
    keyed = alignment.request_keys(part)
    return caches.misses(keyed, keyed.where("p_partkey % 2 = 0").select("k").distinct()).select("src", "tgt").distinct()


def cosine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).select("pair", "i", "j", T.round_half_up(F.col("s"), 4).alias("s"))


def mutual_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.mutual_argmax_table(similarities(spark, sf_dir)).select("pair", "i", "j", T.round_half_up(F.col("s"), 4).alias("s"))


def itermax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.itermax_table(similarities(spark, sf_dir)).select("pair", "i", "j", T.round_half_up(F.col("s"), 4).alias("s"))


def grow_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over even vectors (words) and odd ones (units) of a label, each numbered from 0."""
    sim = similarities(spark, sf_dir)
    return alignment.spans_table(sim, alignment.mutual_argmax_table(sim), 2)


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON files with nested objects, numbers, arrays and nulls."""
    docs = table(spark, sf_dir, "documents")
    inner = F.struct("lang", F.col("n_chars").alias("size"), F.array("source").alias("tags"), F.struct(F.col("text").alias("body")).alias("deep"))
    data = F.to_json(F.struct("source", inner.alias("meta"), (F.col("n_chars") > 100).alias("long"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    files = docs.select(F.lit("en").alias("locale"), F.col("doc_id").cast("string").alias("path"), F.lit("d").alias("prefix"), F.col("doc_id").alias("ord"), F.encode(data, "UTF-8").alias("content"))
    return locales.flattened(files).select(F.col("file_ord").alias("ord"), "kind", "key", F.md5(F.encode("value", "UTF-8")).alias("value_md5"))


def locale_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("n_name"), F.lit(".json"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.locale_of_file(name).alias("locale"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.lit("de").alias("lang"), F.col("p_name").alias("src"), F.col("p_type").alias("tgt"))
    return alignment.request_keys(part.distinct()).select("src", "tgt", "k")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    exact_duplicates, variant_groups, variant_kind_counts, normalised_values, masked_placeholders, strip_placeholders, invariant_values,
    blocking_postings, candidate_pairs, fuzzy_edges, fuzzy_components, sentence_postings, sentence_pairs,
    sentence_edges, sentence_components, scan_summary, missing_keys, missing_counts, string_literals,
    unused_keys, words_tokens, lemmas, ngram_df, term_list, subsumed_terms, locale_plan, align_requests, align_results,
    term_occurrences, renderings, rendering_clusters, merged_clusters, term_locale_stats, term_tiers, glossary_estimate, glossary_rank,
    cosine_matrix, mutual_argmax, itermax, grow_spans, json_flatten, locale_codes, cache_keys, cache_misses,
)}

# --- SQL ----------------------------------------------------------------------------------------------------------------------

_BARE = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
_DECORATED = """d AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN upper(p_name)
    WHEN 1 THEN p_name || '.' WHEN 2 THEN replace(p_name, ' ', '  ') ELSE p_name END AS value FROM part)"""
_STAGED = f"""{_DECORATED},
    s AS (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS white, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS low, {_BARE.format('value')} AS norm FROM d)"""
_MARKED = """m AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 8 WHEN 0 THEN p_name || ' {V1}' WHEN 1 THEN '<b>' || p_name || '</b>'
    WHEN 2 THEN p_name || ' %s of %1$d' WHEN 3 THEN p_name || ' &nbsp; {{ count }}' WHEN 4 THEN 'B' || p_partkey || 'A'
    WHEN 5 THEN 'https://example.org/' || p_partkey WHEN 6 THEN 'OK' ELSE p_name END AS value, p_partkey AS ord FROM part)"""
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(value, '\{\{\s*[\w.]+\s*\}\}|\{\s*[\w.]+\s*\}|%(?:\d+\$)?[sdif@]|</?[a-z][^>]*>|&[a-z]+;|&#\d+;', ' ', 'gi'),
    'https?://\S+', ' ', 'g'), '\s+', ' ', 'g'))"""
_SENTENCES = r"v AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[.\n]+')) AS value FROM documents)"
#: Words of any text: without placeholders; words and lemmas have plain apostrophes.
_WORDS = rf"""regexp_extract_all({_CLEAN}, '[\p{{L}}\p{{N}}\p{{M}}]+(?:[''’\-][\p{{L}}\p{{N}}\p{{M}}]+)*')"""
_LOWER = "replace(lower({0}), '’', '''')"
_TEXT_WORDS = f"t AS (SELECT unnest({_WORDS}) AS word FROM (SELECT text AS value FROM documents))"
_LEMMA = """CASE WHEN length(w) <= 3 OR regexp_matches(w, '[0-9]') THEN w
    WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
    WHEN regexp_matches(w, '(ss|sh|ch|x|z|us)es$') THEN left(w, length(w) - 2)
    WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|''s)$') THEN left(w, length(w) - 1) ELSE w END"""
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_INNER = ", ".join(f"'{w}'" for w in T.INNER)


def _grams(source: str, most: int) -> str:
    """CTEs up to g(value, id, n, words): candidate grams of the distinct values of `source`."""
    return f"""w AS (SELECT value, {_WORDS} AS ws FROM (SELECT DISTINCT value FROM {source})),
        l AS (SELECT value, list_transform(list_transform(ws, lambda x: {_LOWER.format('x')}), lambda w: {_LEMMA}) AS ls FROM w),
        e AS (SELECT value, ls, len(ls) AS words, unnest(range(1, {most + 1})) AS n FROM l),
        f AS (SELECT value, ls, words, n, unnest(range(1, words - n + 2)) AS i FROM e WHERE n <= words),
        h AS (SELECT value, words, n, ls[i:i + n - 1] AS gram FROM f),
        g AS (SELECT value, words, n, array_to_string(gram, ' ') AS id FROM h WHERE
            CASE WHEN n = 1 THEN length(gram[1]) >= 3 AND gram[1] NOT IN ({_STOP}) AND NOT regexp_matches(gram[1], '^[0-9]')
            ELSE gram[1] NOT IN ({_STOP}) AND gram[-1] NOT IN ({_STOP}) AND len(list_filter(gram, lambda x: regexp_matches(x, '^[0-9]'))) = 0
                AND len(list_filter(gram[2:-2], lambda x: x IN ({_STOP}) AND x NOT IN ({_INNER}))) = 0 END),
        c AS (SELECT id, n, count(DISTINCT value) AS df, count(DISTINCT CASE WHEN words <= n + 3 THEN value END) AS labels FROM g GROUP BY ALL)"""


_NODES = f"""z AS (SELECT p_partkey AS ord, concat_ws(' ', CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN replace(p_name, 'a', '') ELSE p_name END, p_brand) AS value FROM part),
    nodes AS (SELECT min(ord) AS node, norm FROM (SELECT ord, {_BARE.format('value')} AS norm FROM z) WHERE length(norm) BETWEEN 3 AND 200 GROUP BY norm),
    own AS (SELECT node, norm, list_distinct(list_filter(string_split(norm, ' '), lambda x: length(x) > 1)) AS ws FROM nodes),
    feat AS (SELECT DISTINCT node, unnest(list_concat(list_transform(ws, lambda x: 'w:' || x), CASE WHEN len(ws) > 2 THEN [] ELSE
        list_transform(range(1, length(norm) + 1), lambda i: 'g:' || substr(' ' || norm || ' ', i, 3)) END)) AS feature FROM own),
    post AS (SELECT *, count(*) OVER (PARTITION BY feature) AS n FROM feat)"""
#: All nodes of the adapter have a feature of at most 300 nodes (their brand), or the oracle would need the features' order.
_PAIRS = f"""{_NODES},
    pairs AS (SELECT DISTINCT x.node AS a, y.node AS b FROM post x JOIN post y ON x.feature = y.feature AND x.node < y.node WHERE x.n <= 300)"""
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_EDGES = f"""{_PAIRS},
    t AS (SELECT a, b, x.norm AS p, y.norm AS q, {_SORTED.format('x.norm')} AS ps, {_SORTED.format('y.norm')} AS qs, greatest(length(x.norm), length(y.norm)) AS longer
        FROM pairs JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b
        WHERE least(length(x.norm), length(y.norm)) >= CAST(0.85 AS DOUBLE) * greatest(length(x.norm), length(y.norm))
        AND regexp_replace(x.norm, '[0-9]+', '#', 'g') <> regexp_replace(y.norm, '[0-9]+', '#', 'g')),
    u AS (SELECT a, b, least(levenshtein(p, q), levenshtein(ps, qs)) AS d, longer FROM t),
    edges AS (SELECT a, b, 1 - CAST(d AS DOUBLE) / longer AS similarity FROM u WHERE d <= floor((1 - CAST(0.85 AS DOUBLE)) * longer) AND 1 - CAST(d AS DOUBLE) / longer >= CAST(0.85 AS DOUBLE))"""
_TWO = """en AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS value FROM part),
    de AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN p_name ELSE p_type || ' ' || p_name END AS value
        FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'x' || p_partkey, p_name FROM part WHERE p_partkey % 13 = 0),
    found AS (SELECT 'de' AS locale, en.key, CASE WHEN de.key IS NULL THEN 'absent' WHEN trim(de.value) = '' THEN 'empty' WHEN de.value = en.value THEN 'untranslated' END AS category
        FROM en LEFT JOIN de ON en.key = de.key UNION ALL SELECT 'de', key, 'extra' FROM de WHERE key NOT IN (SELECT key FROM en))"""
_LITERALS = r"""lit AS (SELECT left(raw, 1) AS quote, substr(raw, 2, length(raw) - 2) AS body FROM (SELECT unnest(regexp_extract_all(html,
    '''(?:[^''\\\n]|\\.)*''|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\(?s:.))*`')) AS raw FROM pages))"""
_COSINES = """s AS (SELECT a.label AS pair, a.vec_id AS i, b.vec_id AS j,
    list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b
    ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""

_CANDIDATES = f"""{_SENTENCES}, {_grams('v', 3)},
    q AS (SELECT id, df, unnest(string_split(id, ' ')) AS word FROM c WHERE n > 1 AND df >= @least),
    rare AS (SELECT q.id, min(coalesce(u.df, q.df)) AS rarest FROM q LEFT JOIN (SELECT id, df FROM c WHERE n = 1) u ON u.id = q.word WHERE q.word NOT IN ({_INNER}) GROUP BY q.id),
    t AS (SELECT c.* FROM c LEFT JOIN rare USING (id) WHERE df >= @least AND (n = 1 OR (labels > 0 AND CAST(df AS DOUBLE) / rarest >= CAST(0.3 AS DOUBLE)))),
    i AS (SELECT df, string_split(id, ' ') AS ws, n, unnest(range(1, n)) AS m FROM t), j AS (SELECT df, ws, n, m, unnest(range(1, n - m + 2)) AS a FROM i),
    x AS (SELECT DISTINCT t.id FROM j JOIN t ON t.id = array_to_string(ws[a:a + m - 1], ' ') WHERE j.df >= CAST(0.9 AS DOUBLE) * t.df)"""

_TERMS = f"""tw AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM (SELECT DISTINCT p_name FROM part)),
    terms AS (SELECT {_LEMMA} AS term, count(*) AS df, length(w)::DOUBLE AS zipf, CASE WHEN length(w) % 2 = 0 THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END AS label_share FROM tw GROUP BY w)"""
_RENDERED = f"""{_TERMS},
    a AS (SELECT p_partkey AS id, ['de', 'fr', 'pl'][p_partkey % 3 + 1] AS locale, string_split(p_name, ' ') AS ws, p_size, p_partkey % 10 <> 0 AS good FROM part),
    u AS (SELECT id, locale, p_size, good, ws, unnest(range(1, len(ws) + 1)) AS k FROM a), y AS (SELECT *, ws[k] AS w FROM u),
    z AS (SELECT *, {_LEMMA} AS term, CASE length(w) WHEN 3 THEN 0 WHEN 6 THEN 5 ELSE (p_size + length(w)) % 6 END AS kind FROM y),
    occ AS (SELECT term, id, locale, k - 1 AS start, kind, CASE WHEN good THEN CASE WHEN kind < 3 THEN 'ka' || reverse(w) WHEN kind = 3 THEN 'zo' || reverse(w)
        WHEN kind = 4 THEN 'zo' || reverse(w) || 'n' ELSE w END END AS text FROM z WHERE term IN (SELECT term FROM terms)),
    ren AS (SELECT term, locale, id, start, kind, text, CASE WHEN text IS NOT NULL THEN CASE WHEN kind = 5 THEN '=en' ELSE text END END AS cluster, CASE WHEN text IS NOT NULL THEN kind = 5 END AS kept_english FROM occ)"""
_MERGED = f"""{_RENDERED},
    merged AS (SELECT term, locale, arg_min(cluster, length(cluster)) AS cluster, count(*) AS count, count(DISTINCT text) AS n_forms, bool_or(kept_english) AS kept FROM ren
        WHERE cluster IS NOT NULL GROUP BY term, locale, CASE WHEN kind IN (3, 4) THEN 'zo' ELSE cluster END)"""
_ROUND = "floor(({0}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"
_STATS = f"""{_MERGED},
    uses AS (SELECT term, locale, count(cluster) AS occurrences, count(*) - count(cluster) AS unaligned FROM ren GROUP BY ALL),
    told AS (SELECT term, locale, count(*) AS n_clusters, coalesce(sum(count) FILTER (NOT kept), 0) AS n, coalesce(max(count) FILTER (NOT kept), 0) AS best FROM merged GROUP BY ALL),
    often AS (SELECT term, locale, count(*) AS ways FROM merged JOIN told USING (term, locale) WHERE NOT kept AND count >= greatest(3, ceil(CAST(0.2 AS DOUBLE) * n)) GROUP BY ALL),
    stats AS (SELECT term, locale, CASE locale WHEN 'de' THEN 'de-at' ELSE '' END AS aliases, occurrences, unaligned, coalesce(n_clusters, 0) AS n_clusters,
        CASE WHEN n > 0 THEN {_ROUND.format('best::DOUBLE / n')} ELSE 0 END AS dominant_share,
        CASE WHEN occurrences > 0 THEN {_ROUND.format('(occurrences - coalesce(n, 0))::DOUBLE / occurrences')} ELSE 0 END AS kept_english_share,
        coalesce(n >= 5 AND ways >= 2, false) AS multiple FROM uses LEFT JOIN told USING (term, locale) LEFT JOIN often USING (term, locale))"""
_TIERS = f"""{_STATS},
    sums AS (SELECT term, count(*) FILTER (e) AS locales_evaluated, count(*) FILTER (e AND multiple) AS locales_flagged, coalesce({_ROUND.format('avg(dominant_share) FILTER (e)')}, 0) AS consistency,
        count(*) FILTER (occurrences > 0) AS with_data, coalesce({_ROUND.format('avg(kept_english_share) FILTER (occurrences > 0)')}, 0) AS kept_english_share
        FROM (SELECT *, occurrences * (1 - kept_english_share) >= 5 AS e FROM stats) GROUP BY term),
    tiers AS (SELECT term, df, false AS seeded, zipf, label_share, kept_english_share, CASE WHEN with_data >= 3 AND kept_english_share >= 0.5 THEN 'keep-english'
        WHEN locales_evaluated < 3 AND zipf < 3.5 THEN 'jargon' WHEN locales_evaluated < 3 THEN 'insufficient'
        WHEN locales_flagged >= 3 AND locales_flagged::DOUBLE / locales_evaluated >= 0.25 THEN CASE WHEN label_share >= 0.15 THEN 'ambiguous' ELSE 'phrasing' END
        WHEN zipf < 3.5 THEN 'jargon' ELSE 'stable' END AS tier, locales_evaluated, locales_flagged, consistency FROM terms JOIN sums USING (term))"""
_FIRST_LINKS = f"""{_COSINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY s DESC, j) AS a, row_number() OVER (PARTITION BY pair, j ORDER BY s DESC, i) AS b FROM s),
    links AS (SELECT pair, i, j, s FROM ranked WHERE a = 1 AND b = 1)"""

ORACLE_SQL: dict[str, str] = {
    "exact_duplicates": "SELECT p_name AS value, n AS n_keys, CAST(p_partkey AS VARCHAR) AS key FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE n > 1 AND trim(p_name) <> ''",
    "variant_groups": f"""WITH {_STAGED}, k AS (SELECT norm, count(DISTINCT value) AS a, count(DISTINCT white) AS b, count(DISTINCT low) AS c FROM s GROUP BY norm HAVING count(DISTINCT value) > 1)
        SELECT norm AS normalised, concat_ws(',', CASE WHEN b < a THEN 'whitespace' END, CASE WHEN c < b THEN 'casing' END, CASE WHEN 1 < c THEN 'punctuation' END) AS kinds,
        value, count(*) AS n_keys FROM s JOIN k USING (norm) GROUP BY ALL""",
    "variant_kind_counts": f"""WITH {_STAGED}, k AS (SELECT norm, count(DISTINCT value) AS a, count(DISTINCT white) AS b, count(DISTINCT low) AS c FROM s GROUP BY norm HAVING count(DISTINCT value) > 1),
        t AS (SELECT unnest(list_filter([CASE WHEN b < a THEN 'whitespace' END, CASE WHEN c < b THEN 'casing' END, CASE WHEN 1 < c THEN 'punctuation' END], lambda x: x IS NOT NULL)) AS kind FROM k)
        SELECT kind, count(*) AS n FROM t GROUP BY kind""",
    "normalised_values": f"WITH {_STAGED} SELECT key, norm FROM s",
    "strip_placeholders": f"WITH {_MARKED} SELECT key, {_CLEAN} AS clean FROM m",
    "invariant_values": rf"""WITH {_MARKED}, t AS (SELECT key, value, {_CLEAN} AS text FROM m), u AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters FROM t)
        SELECT key, value, letters <= 2 OR (regexp_full_match(text, '[\p{{Lu}}\p{{N}}_\-./:#]+') AND (letters <= 4 OR regexp_matches(text, '\p{{N}}'))) AS invariant FROM u""",
    "blocking_postings": f"WITH {_NODES} SELECT feature, count(*) AS n_nodes FROM post GROUP BY feature",
    "candidate_pairs": f"WITH {_PAIRS} SELECT a, b FROM pairs",
    "fuzzy_edges": f"WITH {_EDGES} SELECT a, b, floor(similarity * 1e6 + 0.5) / 1e6 AS similarity FROM edges",
    "fuzzy_components": f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
        r AS (SELECT DISTINCT a, a AS b FROM ways UNION SELECT r.a, ways.b FROM r JOIN ways ON r.b = ways.a), m AS (SELECT a AS node, min(b) AS root FROM r GROUP BY a),
        k AS (SELECT root, floor(min(similarity) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS min_similarity FROM edges JOIN m ON node = a GROUP BY root)
        SELECT node, root, min_similarity FROM m JOIN k USING (root)""",
    "scan_summary": f"""WITH RECURSIVE {_STAGED}, {_EDGES.replace('FROM z)', 'FROM d)')}, ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
        r AS (SELECT DISTINCT a, a AS b FROM ways UNION SELECT r.a, ways.b FROM r JOIN ways ON r.b = ways.a), m AS (SELECT a AS node, min(b) AS root FROM r GROUP BY a),
        fuzzy AS (SELECT nodes.norm, root FROM m JOIN nodes USING (node)), x AS (SELECT key, norm, value, count(*) OVER (PARTITION BY value) > 1 AS d FROM s),
        v AS (SELECT norm FROM s GROUP BY norm HAVING count(DISTINCT value) > 1),
        y AS (SELECT *, norm IN (SELECT norm FROM v) AS v, norm IN (SELECT norm FROM fuzzy) AS f FROM x)
        SELECT count(*) FILTER (d) AS duplicate_keys, count(*) FILTER (v) AS variant_keys, count(*) FILTER (f) AS fuzzy_keys, count(*) FILTER (d OR v) AS duplicate_or_variant_keys,
        count(*) FILTER (d OR v OR f) AS redundant_keys, count(DISTINCT CASE WHEN d THEN value END) AS duplicate_groups, (SELECT count(*) FROM v) AS variant_groups,
        (SELECT count(DISTINCT root) FROM fuzzy) AS fuzzy_groups, count(*) AS source_keys, count(*) - count(DISTINCT norm) AS collapsible_keys,
        floor(CAST(count(*) FILTER (d OR v) AS DOUBLE) / count(*) * 100 * 10 + 0.5) / 10.0::DOUBLE AS duplicate_or_variant_percent,
        floor(CAST(count(*) FILTER (d OR v OR f) AS DOUBLE) / count(*) * 100 * 10 + 0.5) / 10.0::DOUBLE AS redundant_percent FROM y""",
    "missing_keys": f"WITH {_TWO} SELECT * FROM found WHERE category IS NOT NULL",
    "missing_counts": f"""WITH {_TWO} SELECT 'de' AS locale, false AS same_language, count(*) FILTER (category = 'absent') AS absent, count(*) FILTER (category = 'empty') AS empty,
        count(*) FILTER (category = 'untranslated') AS untranslated, count(*) FILTER (category = 'extra') AS extra FROM found""",
    "string_literals": f"WITH {_LITERALS} SELECT quote, body, count(*) AS n FROM lit GROUP BY ALL",
    "unused_keys": rf"""WITH {_LITERALS}, keys AS (SELECT '/p' || p_partkey AS key FROM part UNION ALL SELECT unnest(['</p>', 'utf-8', '/The', 'ad'])),
        p AS (SELECT body AS prefix FROM lit WHERE quote <> '`' AND regexp_full_match(body, '[\w\-]+(?:\.[\w\-]+)*[._]') UNION SELECT left(body, instr(body, '${{') - 1) FROM lit WHERE quote = '`' AND instr(body, '${{') > 1)
        SELECT key, CASE WHEN key IN (SELECT body FROM lit WHERE quote <> '`' OR instr(body, '${{') = 0) THEN 'used'
        WHEN EXISTS (SELECT 1 FROM p WHERE length(prefix) >= 3 AND starts_with(key, prefix)) THEN 'dynamic' ELSE 'unused' END AS status FROM keys""",
    "words_tokens": f"WITH {_TEXT_WORDS} SELECT word, count(*) AS n FROM t GROUP BY word",
    "lemmas": f"WITH {_TEXT_WORDS}, u AS (SELECT DISTINCT word, {_LOWER.format('word')} AS w FROM t) SELECT word, {_LEMMA} AS lemma FROM u",
    "ngram_df": f"WITH p AS (SELECT p_name AS value FROM part), {_grams('p', 3)} SELECT id, n, df, labels FROM c",
    "term_list": f"""WITH {_CANDIDATES.replace('@least', '3')}
        SELECT id, df, false AS seeded, floor(CAST(labels AS DOUBLE) / df * 100 + 0.5) / 100.0::DOUBLE AS label_share FROM t WHERE id NOT IN (SELECT id FROM x)
        UNION ALL SELECT 'thisword neverseen', 0, true, 0.0""",
    "subsumed_terms": f"WITH {_CANDIDATES.replace('@least', '2')} SELECT id FROM x",
    "cosine_matrix": f"WITH {_COSINES} SELECT pair, i, j, floor(s * 1e4 + 0.5) / 1e4 AS s FROM s",
    "mutual_argmax": f"""WITH {_COSINES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY s DESC, j) AS a, row_number() OVER (PARTITION BY pair, j ORDER BY s DESC, i) AS b FROM s)
        SELECT pair, i, j, floor(s * 1e4 + 0.5) / 1e4 AS s FROM r WHERE a = 1 AND b = 1""",
    "locale_codes": "SELECT n_nationkey, CASE WHEN regexp_full_match(n_name, '[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})*') THEN lower(replace(n_name, '_', '-')) END AS locale FROM nation",
    "cache_keys": "SELECT DISTINCT p_name AS src, p_type AS tgt, sha1(concat_ws(chr(31), '3', 'bert-base-multilingual-cased', '8', 'itermax', 'de', p_name, p_type)) AS k FROM part",
    "cache_misses": "SELECT p_name AS src, p_type AS tgt FROM part EXCEPT SELECT p_name, p_type FROM part WHERE p_partkey % 2 = 0",
    "masked_placeholders": rf"""WITH {_MARKED}, k AS (SELECT key, regexp_replace(regexp_replace(value, '</?[a-z][^>]*>|&[a-z]+;|&#\d+;', ' ', 'gi'),
        '\{{\{{\s*[\w.]+\s*\}}\}}|[$%]\{{\s*[\w.]+\s*\}}|\{{\s*[\w.]+\s*\}}|%(?:\d+\$)?[sdif@]', chr(57344), 'gi') AS value FROM m)
        SELECT key, trim(regexp_replace(lower(value), '[^\p{{L}}\p{{N}}\p{{M}}\x{{E000}}]+', ' ', 'g')) AS norm FROM k""",
    "locale_plan": f"""WITH {_TWO}, c AS (SELECT locale, string_agg(key || '=' || value, '|' ORDER BY key) AS content FROM (SELECT unnest(['de', 'de-at']) AS locale, key, value FROM de) GROUP BY locale
        UNION ALL SELECT 'fr', NULL), r AS (SELECT locale, first_value(locale) OVER (PARTITION BY content ORDER BY length(locale), locale) AS rep FROM c)
        SELECT locale, rep, CASE WHEN rep = locale THEN 'rep' ELSE 'alias' END AS role, NULL::VARCHAR AS reason FROM r UNION ALL SELECT 'en-gb', NULL, 'skipped', 'same language as source'""",
    "align_requests": f"""WITH {_TWO}, p AS (SELECT en.value AS src, de.value AS tgt, min(CAST(key AS BIGINT)) AS first, count(*) AS n_keys FROM en JOIN de USING (key)
        WHERE trim(de.value) <> '' AND de.value <> en.value GROUP BY ALL) SELECT row_number() OVER (ORDER BY first) - 1 AS id, 'de' AS locale, 'de' AS lang, src, tgt, n_keys FROM p""",
    "term_occurrences": f"WITH {_RENDERED} SELECT term, id, locale, start FROM ren",
    "renderings": f"WITH {_RENDERED} SELECT term, locale, id, start, text, cluster, kept_english FROM ren",
    "rendering_clusters": f"""WITH {_RENDERED} SELECT term, locale, cluster, count(*) AS count, count(DISTINCT text) AS n_forms,
        array_to_string((list(CAST(id AS VARCHAR) ORDER BY id, start))[1:5], ',') AS example_keys, bool_or(kept_english) AS kept_english FROM ren WHERE cluster IS NOT NULL GROUP BY term, locale, cluster""",
    "merged_clusters": f"WITH {_MERGED} SELECT term, locale, cluster, count, n_forms FROM merged",
    "term_locale_stats": f"WITH {_STATS} SELECT * FROM stats",
    "term_tiers": f"WITH {_TIERS} SELECT * FROM tiers",
    "glossary_estimate": f"""WITH {_TIERS}, names AS (SELECT unnest(['candidates', {', '.join(f"'tier:{x}'" for x in consistency.TIERS)}, {', '.join(f"'glossary:{c}'" for c in consistency.CUTOFFS)}]) AS name)
        SELECT name, count(tier) AS n FROM names LEFT JOIN tiers ON name = 'candidates' OR name = 'tier:' || tier
        OR (tier IN ('ambiguous', 'jargon') AND starts_with(name, 'glossary:') AND df >= TRY_CAST(split_part(name, ':', 2) AS INTEGER)) GROUP BY name""",
    "glossary_rank": f"""WITH {_TIERS} SELECT term, tier, floor(CASE tier WHEN 'ambiguous' THEN 10 + locales_flagged::DOUBLE / greatest(locales_evaluated, 1) * log10(df + 10.0::DOUBLE) * least(1.0::DOUBLE, label_share * 2)
        ELSE 1.0::DOUBLE END * 1e6 + 0.5) / 1e6 AS score FROM tiers WHERE tier IN ('ambiguous', 'jargon')""",
    "itermax": f"""WITH {_FIRST_LINKS}, w AS (SELECT s.*, 2 - (r.i IS NOT NULL)::INT - (k.j IS NOT NULL)::INT AS sides FROM s
            LEFT JOIN links r ON r.pair = s.pair AND r.i = s.i LEFT JOIN links k ON k.pair = s.pair AND k.j = s.j),
        e AS (SELECT pair FROM w GROUP BY pair HAVING least(count(DISTINCT i), count(DISTINCT j)) > 2 AND max(sides) = 2),
        v AS (SELECT *, s * least(CAST(0.9 AS DOUBLE) * sides, 1) AS t FROM w WHERE pair IN (SELECT pair FROM e)),
        k AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY t DESC, j) AS a, row_number() OVER (PARTITION BY pair, j ORDER BY t DESC, i) AS b FROM v)
        SELECT pair, i, j, floor(s * 1e4 + 0.5) / 1e4 AS s FROM (SELECT pair, i, j, s FROM links UNION ALL SELECT pair, i, j, s FROM k WHERE a = 1 AND b = 1 AND sides > 0)""",
    "grow_spans": f"""WITH {_FIRST_LINKS}, place AS (SELECT pair, j, row_number() OVER (PARTITION BY pair ORDER BY j) - 1 AS at FROM (SELECT DISTINCT pair, j FROM s)),
        loose AS (SELECT r.pair, p.at, r.i FROM ranked r JOIN place p ON p.pair = r.pair AND p.j = r.j LEFT JOIN links k ON k.pair = r.pair AND k.j = r.j WHERE r.b = 1 AND k.j IS NULL),
        own AS (SELECT k.pair, k.i, p.at FROM links k JOIN place p ON p.pair = k.pair AND p.j = k.j)
        SELECT o.pair, o.i, o.at - CASE WHEN l1.i IS NULL THEN 0 WHEN l2.i IS NULL THEN 1 ELSE 2 END AS lo, o.at + CASE WHEN h1.i IS NULL THEN 0 WHEN h2.i IS NULL THEN 1 ELSE 2 END AS hi FROM own o
        LEFT JOIN loose l1 ON l1.pair = o.pair AND l1.i = o.i AND l1.at = o.at - 1 LEFT JOIN loose l2 ON l2.pair = o.pair AND l2.i = o.i AND l2.at = o.at - 2
        LEFT JOIN loose h1 ON h1.pair = o.pair AND h1.i = o.i AND h1.at = o.at + 1 LEFT JOIN loose h2 ON h2.pair = o.pair AND h2.i = o.i AND h2.at = o.at + 2""",
    "json_flatten": """WITH leaf AS (SELECT doc_id AS ord, 'd.source' AS key, source AS v FROM documents UNION ALL SELECT doc_id, 'd.meta.lang', lang FROM documents UNION ALL SELECT doc_id, 'd.meta.deep.body', text FROM documents),
        other AS (SELECT doc_id AS ord, 'd.meta.size' AS key, CASE WHEN n_chars IS NULL THEN 'null' ELSE 'number' END AS v FROM documents UNION ALL SELECT doc_id, 'd.meta.tags', 'array' FROM documents
            UNION ALL SELECT doc_id, 'd.long', CASE WHEN n_chars IS NULL THEN 'null' ELSE 'boolean' END FROM documents UNION ALL SELECT doc_id, 'd.none', 'null' FROM documents)
        SELECT ord, CASE WHEN v IS NULL THEN 'skipped' ELSE 'string' END AS kind, key, md5(coalesce(v, 'null')) AS value_md5 FROM leaf
        UNION ALL SELECT ord, 'skipped', key, md5(v) FROM other UNION ALL SELECT doc_id, 'file', NULL, NULL FROM documents""",
}
