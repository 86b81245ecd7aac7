"""URL allow and block lists: a trie over reversed host labels and path segments with longest-match precedence.

A rule (host, path) fits its host and all subdomains when the url's path starts with the rule's path. The deepest
host wins, then the longest path; of two equal rules, block wins. The host runs from the first ``://`` up to ``/``,
``?``, ``#`` or the end, with A-Z lower-cased; the path from there up to ``?``, ``#`` or the end. A null url, or one without
``://``, has both empty and no rule fits it. Without a rule the verdict is the default.

The trie goes to the tasks with the function. That is for lists up to ``MAX_RULES``; a longer list is a
DataFrame and goes through ``judge_by_join``, which gives the same by equi-joins on each url's host suffixes and path prefixes.

Repeated rows are judged alike, an empty table gives an empty one, long urls are read whole. Other columns stay; those called like an
added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered

MAX_RULES = 200_000
#: Fixed values of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Children by label, then by whole path segment; an unfinished last segment of a rule is kept as a prefix."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node, host = self.root, host.translate(str.maketrans(UPPER, LOWER))
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {})
            node.setdefault("sizes", set()).add(len(rest))
            if verdict == "block" or rest not in ends:
                ends[rest] = (f"{host}{path}", verdict)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        nodes, node = [], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(("host", label))
            if node is None:
                break
            nodes.append(node)
        segments = path.split("/")
        for node in reversed(nodes):  # the deepest host first
            best = None
            for k, segment in enumerate(segments):
                if "ends" in node:
                    rest = "/".join(segments[k:])
                    fit = max((n for n in node["sizes"] if rest[:n] in node["ends"] and n <= len(rest)), default=None)
                    best = best if fit is None else node["ends"][rest[:fit]]
                node = node.get(("path", segment))
                if node is None or k == len(segments) - 1:
                    break
            if best:
                return best
        return None


def parts(url: str = "url") -> tuple:
    """Host and path of a url as columns."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to each row; columns that are already called so are replaced."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are too many to send to each task; use judge_by_join")
    trie = Trie(rules)

    @F.pandas_udf("rule string, verdict string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [trie.longest(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    host, path = parts(url)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_judged")]
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    return rows.withColumn("_judged", verdict("host", "path")).select(*keep, "host", "path", "_judged.rule", "_judged.verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The same for rules of any number, a DataFrame (verdict, host, path).

    A rule's path is its whole segments and a rest. Each distinct (host, path) is looked up once: its host suffixes times its
    whole path prefixes meet the rules' lengths of rests in one equi-join, and the text of each such length meets the
    rules in another, so a url costs as many rows as there are lengths, however many rules share a host and a prefix.
    """
    host, path = parts(url)
    rows, names = numbered(pages.select(*(c for c in pages.columns if c not in ("host", "path", "rule", "verdict")), host.alias("host"), path.alias("path")))
    own = {names["host"]: "host", names["path"]: "path"}
    rows = rows.withColumnsRenamed(own)
    known = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), "verdict").groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("whole", F.regexp_extract("p", "(?s)^(.*/)?", 0)).withColumn("rest", F.expr("substring(p, length(whole) + 1)"))
    sizes = known.select("h", "whole", F.length("rest").alias("size")).distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    tried = rows.select("host", "path").distinct().withColumn("h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/"))))
    tried = tried.where("host <> ''").withColumn("whole", F.explode(prefixes)).join(sizes, ["h", "whole"])
    tried = tried.withColumn("rest", F.expr("substring(path, length(whole) + 1, size)")).where("length(rest) = size")
    hit = tried.join(known, ["h", "whole", "rest"]).withColumn("rule", F.concat("h", "p"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.size(F.split("h", r"\.")), F.length("p"), "rule", "verdict")).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*(F.col(own.get(c, c)).alias(n) for n, c in names.items()), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
