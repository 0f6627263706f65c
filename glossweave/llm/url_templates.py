"""Operator 8: URL filtering by rules and a tree of path templates per host.

A host's root holds its distinct paths with their numbers of URLs and of labels. The tree grows level by level, by counts alone:

1. A run of segments that all paths of a node share is one step. Below it, the node's children are the values of the next segment;
   paths that end there stay with the node.
2. Children with between 2^k and 2^(k+1) - 1 URLs are one class. A class of more than `fan` children is a variable segment: its
   children become one wildcard, apart from those whose labelled share of blocked URLs is too high, or too low, for chance (Chernoff's
   bound with the class's share, times its number of children): these become two wildcards of their own. Every other child is a unit
   of its own. So a node has some hundreds of units at most, whatever it holds.
3. Units are merged with similar siblings. Two are similar if neither the shares of blocked among their labels (two-sample z-test with
   one label of each kind added to both) nor the kinds of segments that follow (two-sample chi-square test) differ. Labelled
   units come first, by number of labels, and join the most similar of the groups that don't differ. Units without labels come after,
   by number of URLs: one that resembles a single labelled group joins it; one that resembles several can't be told from either and
   stays with unlabelled siblings that it resembles.
4. Every group is a node of the next level, with the purity

       (blocked + weight * purity of its parent) / (labelled + weight)

   where a host's parent is the whole table. A node grows on while its labels are of both kinds; at any other all paths below would
   get the same verdict, and its template ends in `**`. There is no limit to the depth.

A template is rejected from purity `reject` on. Labels are the rules' verdicts, or any 0/1 column. Rows are counted per path before
anything is shuffled. Node and class sums are combined before their shuffles and come back by equi-joins in which rows of hot keys (a
host with a third of all rows) aren't moved; only the units of a node, bounded as above, meet in one task. The verdicts meet the rows
again in one equi-join on host and path.

Template names: a segment; `*` for the wildcard of most children at a node; `(x|*)` for another group with x as its first member;
a literal segment that begins with one of `*(\\` has a backslash before it.

Cases: a null url or one without `://` has an empty host and path and belongs to the tree of the empty host; a null page_id stays
null; repeated rows are counted and judged each; without any label all purities are 0 and nothing is rejected; an empty table gives an
empty result; other columns play no part. Paths of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .skew import join_counted
from .storage import drop, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of segments: whether there is a digit, a letter, something else; 0 is the end of the path.
KINDS = 8


@dataclass(frozen=True)
class Params:
    #: Children of one count class from which on they are a variable segment.
    fan: int = 20
    #: A child of a variable segment stays apart if one as different as it is has less than this chance to be among so many.
    chance: float = 0.05
    #: Standard errors by which the shares of siblings must differ to stay apart. Low: a needless split costs a little evidence, a
    #: needless merge hides a bad branch.
    differ: float = 0.85
    #: The normal quantile of the chi-square test of sub-shapes (one in a thousand).
    shape: float = 3.09
    weight: float = 4.0
    reject: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty where there are none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    pick = lambda n: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(pick(1), _UPPER, _LOWER), pick(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (text, verdict) that fits; its text is a host, then a path. Null: none."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def segments_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def shares_z(known: float, bad: float, known2: float, bad2: float) -> float:
    """Standard errors between two shares, one label of each kind added to both."""
    p, q = (bad + 1) / (known + 2), (bad2 + 1) / (known2 + 2)
    return abs(p - q) / math.sqrt(p * (1 - p) / (known + 2) + q * (1 - q) / (known2 + 2))


def shapes_differ(a: list[int], b: list[int], quantile: float) -> bool:
    """Two-sample chi-square test of two histograms, its critical value by Wilson and Hilferty."""
    n, m = sum(a), sum(b)
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x + y]
    if len(filled) < 2 or not n or not m:
        return False
    value = sum((math.sqrt(m / n) * x - math.sqrt(n / m) * y) ** 2 / (x + y) for x, y in filled)
    free = len(filled) - 1
    return value >= free * (1 - 2 / (9 * free) + quantile * math.sqrt(2 / (9 * free))) ** 3


def merge_siblings(units: list[tuple[str, int, int, int, list[int]]], p: Params) -> list[list[int]]:
    """Groups of similar units (name, n, known, bad, histogram of kinds), as lists of their numbers."""
    groups: list[list[int]] = []
    sums: list[list] = []

    def put(i: int, g: int | None) -> None:
        _, _, known, bad, kinds = units[i]
        if g is None:
            groups.append([i])
            sums.append([known, bad, list(kinds)])
            return
        groups[g].append(i)
        sums[g] = [sums[g][0] + known, sums[g][1] + bad, [x + y for x, y in zip(sums[g][2], kinds, strict=True)]]

    for i in sorted((i for i, u in enumerate(units) if u[2]), key=lambda i: (-units[i][2], units[i][0])):
        z = {g: shares_z(units[i][2], units[i][3], s[0], s[1]) for g, s in enumerate(sums) if not shapes_differ(units[i][4], s[2], p.shape)}
        near = [g for g, x in z.items() if x < p.differ]
        put(i, min(near, key=lambda g: (z[g], g), default=None))
    labelled = len(groups)
    for i in sorted((i for i, u in enumerate(units) if not u[2]), key=lambda i: (-units[i][1], units[i][0])):
        alike = [g for g, s in enumerate(sums) if not shapes_differ(units[i][4], s[2], p.shape)]
        told = [g for g in alike if g < labelled]
        put(i, told[0] if len(told) == 1 else next((g for g in alike if g >= labelled), None))
    return groups


def group_names(units: list[tuple[str, int]], groups: list[list[int]]) -> list[str]:
    """A name for each group of units (name, children); a unit of a single child is named `=segment`, others are wildcards."""
    literal = lambda x: "\\" + x if x[:1] in ("*", "(", "\\") else x
    wild = [g for g, own in enumerate(groups) if len(own) > 1 or not units[own[0]][0].startswith("=")]
    most = max(wild, key=lambda g: (sum(units[i][1] for i in groups[g]), -g), default=None)
    out = []
    for g, own in enumerate(groups):
        first = units[own[0]][0]
        first = literal(first[1:]) if first.startswith("=") else first
        out.append("*" if g == most else f"({first}|*)" if g in wild else first)
    return out


_GROUP = "host string, template string, unit string, rows long, branch string, group_known long, group_bad long"


def _grouped(units: DataFrame, p: Params) -> DataFrame:
    """The branch of every unit: siblings meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            own = sorted(held, key=lambda r: r[2])
            held.clear()
            groups = merge_siblings([(r[2], r[4], r[5], r[6], list(r[7:])) for r in own], p)
            names = group_names([(r[2], r[3]) for r in own], groups)
            rows = [(*own[i][:4], name, sum(own[j][5] for j in g), sum(own[j][6] for j in g)) for g, name in zip(groups, names, strict=True) for i in g]
            kinds = [pa.string()] * 3 + [pa.int64(), pa.string()] + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _GROUP.split(", ")])

        now = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and row[:2] != now:
                    yield flush()
                now = row[:2]
                held.append(row)
        if held:
            yield flush()

    return map_arrow(units.repartition("host", "template").sortWithinPartitions("host", "template"), run, _GROUP)


def _divergence(own: Column, share: Column) -> Column:
    """Kullback-Leibler divergence of two shares, 0 < share < 1."""
    part = lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(y))).otherwise(0.0)
    return part(own, share) + part(1 - own, 1 - share)


def _units(children: DataFrame, total: int, p: Params) -> DataFrame:
    """children (host, template, segment, n, known, bad, k0..) with the unit that each belongs to."""
    size = F.floor(F.log2(F.col("n") + 0.5)).cast("long")
    classed = children.withColumn("size", size)
    classes = classed.groupBy("host", "template", "size").agg(F.count("*").alias("m"), F.sum("known").alias("mk"), F.sum("bad").alias("mb"))
    joined = join_counted(classed, classes.withColumn("rows", F.col("m")), ["host", "template", "size"], total)
    own, share = F.col("bad") / F.greatest("known", F.lit(1)), F.col("mb") / F.greatest("mk", F.lit(1))
    odd = (F.col("known") > 0) & (share > 0) & (share < 1) & (2 * F.col("m") * F.exp(-F.col("known") * _divergence(own, share)) < p.chance)
    side = F.when(odd & (own > share), "+").when(odd & (own < share), "-").otherwise("")
    unit = F.when(F.col("m") <= p.fan, F.concat(F.lit("="), "segment")).otherwise(F.concat(F.lit("*"), F.col("size").cast("string"), side))
    return joined.withColumn("unit", unit).drop("size", "m", "mk", "mb")


def purities(urls: DataFrame, p: Params = Params()) -> DataFrame:
    """host, segments, template, purity of all paths in urls (host, segments, label): label 1 blocked, 0 allowed, null unknown."""
    label = F.col("label")
    counted = urls.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count(label).alias("known"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("bad"))
    paths = materialise(counted, "paths")
    whole = paths.agg(F.sum("known"), F.sum("bad"), F.count("*")).first()
    total = whole[2]
    base = float(whole[1] or 0) / (whole[0] or 1)

    def smoothed(bad: Column, known: Column, parent: Column) -> Column:
        return (bad + p.weight * parent) / (known + p.weight)

    hosts = paths.groupBy("host").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"), F.count("*").alias("rows"))
    now = join_counted(paths, hosts.select("host", smoothed(F.col("b"), F.col("k"), F.lit(base)).alias("purity"), "rows"), ["host"], total)
    now = now.withColumn("at", F.lit(0)).withColumn("template", F.lit(""))
    now = materialise(now, "level")
    done: list[DataFrame] = []
    while True:
        rest = F.slice("segments", F.col("at") + 1, F.greatest(F.size("segments") - F.col("at"), F.lit(0)))
        nodes = now.groupBy("host", "template").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"), F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.count("*").alias("rows"))
        shared = F.expr("aggregate(sequence(0, greatest(least(size(lo), size(hi)), 1) - 1), 0, (n, i) -> if(n = i and get(lo, i) = get(hi, i), n + 1, n))")
        nodes = nodes.select("host", "template", ((F.col("b") > 0) & (F.col("b") < F.col("k"))).alias("grows"), shared.alias("run"), (F.size("hi") > 0).alias("below"), "rows")
        marked = materialise(join_counted(now, nodes, ["host", "template"], total), "nodes")
        drop(now)
        ended = marked.where("not grows").withColumn("template", F.when(F.col("below"), F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
        done.append(materialise(ended.select("host", "segments", "template", "purity"), "settled"))
        grows = marked.where("grows")
        if grows.isEmpty():
            drop(marked)
            break
        step = F.concat_ws("/", F.slice("segments", F.col("at") + 1, F.col("run")))
        here = grows.withColumn("template", F.when(F.col("run") > 0, F.concat("template", F.lit("/"), step)).otherwise(F.col("template")))
        here = here.withColumn("at", F.col("at") + F.col("run"))
        here = here.withColumn("segment", F.get("segments", F.col("at"))).withColumn("next", F.get("segments", F.col("at") + 1))
        # paths that end here stay with the node
        done.append(materialise(here.where("segment is null").select("host", "segments", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), "purity"), "settled"))
        here = here.where("segment is not null")
        kind = F.when(F.col("next").isNull(), 0).otherwise(F.col("next").rlike("[0-9]").cast("int") + 2 * F.col("next").rlike(r"\p{L}").cast("int") + 4 * F.col("next").rlike(r"[^0-9\p{L}]").cast("int"))
        kinds = [F.sum(F.when(kind == i, F.col("n")).otherwise(0)).alias(f"k{i}") for i in range(KINDS)]
        children = here.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "known", "bad")), *kinds, F.count("*").alias("rows"))
        children = materialise(_units(children, total, p), "children")
        sums = [F.sum(c).alias(c) for c in ("n", "known", "bad", *(f"k{i}" for i in range(KINDS)))]
        groups = materialise(_grouped(children.groupBy("host", "template", "unit").agg(F.count("*").alias("children"), *sums), p), "groups")
        branches = join_counted(children.select("host", "template", "segment", "unit", F.col("rows").alias("paths")), groups, ["host", "template", "unit"], total)
        now = join_counted(here, materialise(branches.drop("unit").withColumnRenamed("paths", "rows"), "branches"), ["host", "template", "segment"], total)
        now = now.withColumn("purity", smoothed(F.col("group_bad"), F.col("group_known"), F.col("purity")))
        now = now.withColumn("template", F.concat("template", F.lit("/"), "branch")).withColumn("at", F.col("at") + 1)
        now = materialise(now.select("host", "segments", "n", "known", "bad", "purity", "at", "template"), "level")
        for table in (marked, children, groups):
            drop(table)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], p: Params = Params()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of all rows of pages (page_id, url).

    template and purity are null where a rule decides."""
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = materialise(urls.select("*", rule.alias("rule"), says.alias("says"), segments_of(F.col("path")).alias("segments")), "urls")
    known = purities(urls.select("host", "segments", F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0).alias("label")), p)
    ruled = urls.where("rule is not null").select("page_id", "host", "path", "rule", F.col("says").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    others = urls.where("rule is null").join(known, ["host", "segments"])
    verdict = F.when(F.col("purity") >= p.reject, "block").otherwise("allow")
    return ruled.unionByName(others.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"))
