"""Loading a directory of JSON translation files into relations.

Layouts: <locale>.json, and <locale>/<namespace>.json with keys below `<namespace>.`. Files are listed through Hadoop's file system,
read and flattened in parallel, and merged by DataFrame operations: the last value of a key wins, its first place stays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import numbered, written
from ..runtime import ship

_LOCALE = re.compile(T.LOCALE.replace("(?i:", "(?:"), re.IGNORECASE | re.ASCII)

# What warnings say.
ROOT = "Locale file root must be a JSON object"
DUPLICATE = "Duplicate key; later value wins"
INVALID = "Invalid JSON: "


@dataclass(frozen=True)
class LocaleSet:
    """strings: locale, key, value, ord; locales: locale, ord; files: locale, file, ord; warnings: locale, file, key, message, ord."""

    strings: DataFrame
    locales: DataFrame
    files: DataFrame
    warnings: DataFrame

    def source(self, locale: str) -> DataFrame:
        """The strings of one locale; an error that names the others if there is none."""
        if self.locales.where(F.col("locale") == locale).isEmpty():
            have = ", ".join(r["locale"] for r in self.locales.orderBy("ord").select("locale").collect())
            raise ValueError(f'Source locale "{locale}" not found (have: {have})')
        return self.strings.where(F.col("locale") == locale)


def locale_code(name: str) -> str | None:
    """The canonical locale of a name that is a locale code."""
    return name.replace("_", "-").lower() if _LOCALE.fullmatch(name) else None


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, str, str, int]]:
    """(locale, path, key prefix, order) of the locale files in a folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(at) -> list[tuple[str, bool, str]]:
        return [(s.getPath().getName(), s.isDirectory(), s.getPath().toString()) for s in system.listStatus(at)]

    # entries come in the order of root collation, files of a namespace folder in that of UTF-16 units
    top = entries(path)
    order = {r["name"]: i for i, r in enumerate(spark.createDataFrame([(n,) for n, _, _ in top], "name string").orderBy(F.expr("name collate UNICODE")).collect())} if top else {}
    out: list[tuple[str, str, str, int]] = []
    for name, folder_entry, full in sorted(top, key=lambda e: order[e[0]]):
        if folder_entry and locale_code(name):
            for inner, _, inner_full in sorted(entries(jvm.org.apache.hadoop.fs.Path(full)), key=lambda e: e[0].encode("utf-16-be")):
                if inner.endswith(".json"):
                    out.append((locale_code(name), inner_full, inner[: -len(".json")], len(out)))
        elif not folder_entry and name.endswith(".json") and locale_code(name[: -len(".json")]):
            out.append((locale_code(name[: -len(".json")]), full, "", len(out)))
    return out


_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")


def _ordered(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """An object's members as they are enumerated: array-index keys ascending, then the others; a repeated name keeps its first place."""
    members = dict(pairs)
    index = sorted((k for k in members if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    return {k: members[k] for k in [*index, *(k for k in members if k not in set(index))]}


def flatten_json(data: object, separator: str = ".", prefix: str = "") -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(strings by joined path, skipped leaves as (path, type)), depth first in document order, without recursion."""
    strings: dict[str, str] = {}
    skipped: list[tuple[str, str]] = []
    stack: list[tuple[str, object]] = [(prefix, data)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, str):
            strings[path] = node
        elif isinstance(node, dict):
            stack += [(f"{path}{separator}{k}" if path else k, v) for k, v in reversed(node.items())]
        else:
            skipped.append((path, "array" if isinstance(node, list) else "null" if node is None else "boolean" if isinstance(node, bool) else "number"))
    return strings, skipped


def _reject(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def parse_file(content: bytes, separator: str = ".", prefix: str = "") -> tuple[dict[str, str], list[tuple[str, str]], str | None]:
    """(strings, skipped leaves, error)."""
    try:
        data = json.loads(content.decode("utf-8"), object_pairs_hook=_ordered, parse_constant=_reject)
    except (ValueError, RecursionError) as e:
        return {}, [], INVALID + str(e)
    if not isinstance(data, dict):
        return {}, [], ROOT
    return *flatten_json(data, separator, prefix), None


_PARSED = "locale string, file string, file_ord long, place long, kind string, key string, value string"


def flattened(files: DataFrame, separator: str = ".") -> DataFrame:
    """_PARSED rows of files (locale, path, prefix, ord, content): string, skipped, error; one `file` row for each that has an object."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples():
                strings, skipped, error = parse_file(r.content, separator, r.prefix)
                head = (r.locale, r.path, r.ord)
                rows += [(*head, i, "string", k, v) for i, (k, v) in enumerate(strings.items())]
                rows += [(*head, i, "skipped", k, t) for i, (k, t) in enumerate(skipped)]
                rows.append((*head, 0, "error", None, error) if error else (*head, 0, "file", None, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PARSED.split(", ")])

    return files.select("locale", "path", "prefix", "ord", "content").mapInPandas(run, _PARSED)


def merge(parsed: DataFrame) -> LocaleSet:
    """Locale files as one set: the last value of a key wins, its first place stays, and a key of several files is a warning."""
    strings = parsed.where("kind = 'string'").withColumn("at", F.struct("file_ord", "place"))
    merged = strings.groupBy("locale", "key").agg(F.max_by("value", "at").alias("value"), F.min("at").alias("first"))
    ordered = numbered(merged, ["locale"], ["first"], "ord")
    files = parsed.where("kind = 'file'").select("locale", "file", F.col("file_ord").alias("ord"))
    locales = files.groupBy("locale").agg(F.min("ord").alias("ord"))
    again = strings.withColumn("n", F.row_number().over(Window.partitionBy("locale", "key").orderBy("at"))).where("n > 1")
    warn = lambda df, rank, key, message: df.select("locale", "file", key.alias("key"), message.alias("message"), F.struct("file_ord", F.lit(rank).alias("rank"), "place").alias("at"))
    none = F.lit(None).cast("string")
    warnings = (
        warn(parsed.where("kind = 'error'"), 0, none, F.col("value"))
        .unionByName(warn(again, 1, F.col("key"), F.lit(DUPLICATE)))
        .unionByName(warn(parsed.where("kind = 'skipped'"), 2, F.col("key"), F.concat(F.lit("Skipped non-string value ("), "value", F.lit(")"))))
    )
    return LocaleSet(ordered.select("locale", "key", "value", "ord"), locales, files, warnings.select("locale", "file", "key", "message", F.col("at").alias("ord")))


def load_locale_dir(spark: SparkSession, folder: str, separator: str = ".") -> LocaleSet:
    """The locale set of a folder."""
    listed = list_files(spark, folder)
    if not listed:
        raise ValueError(f"No locale files found in {folder}")
    names = spark.createDataFrame(listed, "locale string, path string, prefix string, ord long")
    # files that can't be read as files (a folder named x.json) are kept, with content that doesn't parse
    content = spark.read.format("binaryFile").load([p for _, p, _, _ in listed]).select(F.col("path"), "content")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    joined = names.join(content.select(same(F.col("path")).alias("at"), "content"), same(F.col("path")) == F.col("at"), "left")
    parsed = written(flattened(joined.withColumn("content", F.coalesce("content", F.lit(b""))), separator), "parsed")
    return merge(parsed)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value of every line that isn't blank, untrimmed: allow-lists and seed lists."""
    return spark.read.text(path).where(~T.is_blank(F.col("value")))


def read_zipf(spark: SparkSession, path: str) -> DataFrame:
    """term, zipf of a CSV table with a header: general-English frequencies."""
    return spark.read.option("header", True).schema("term string, zipf double").csv(path)
