"""URL allow and block lists as a trie over host labels and path segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number travel as a broadcast trie; more are joined.
MAX_BROADCAST_RULES = 1_000_000
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Trie over reversed host labels, then path segments.

    A node is ``[children by label, root of its paths or None]``; a path node is
    ``[children by whole segment, {open segment prefix: verdict}, verdict]``.
    A rule fits its host and every subdomain if the url's path starts with the
    rule's path.  The longest host wins, then the longest path; of an allow and
    a block entry for one place the block entry wins.
    """

    def __init__(self, rules):
        self.root = [{}, None]
        self.size = 0
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict {verdict!r}")
        node = self.root
        for label in reversed(host.split(".")):
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}, None]
        place = node[1]
        *whole, stem = path.split("/")
        for segment in whole:
            place = place[0].setdefault(segment, [{}, {}, None])
        old = place[1].get(stem) if stem else place[2]
        new = BLOCK if BLOCK in (old, verdict) else ALLOW
        if stem:
            place[1][stem] = new
        else:
            place[2] = new
        self.size += 1

    def match(self, host: str, path: str):
        """``(rule, verdict)`` of the entry that decides, or ``(None, None)``."""
        node, best, used, segments = self.root, None, 0, None
        labels = host.split(".")
        for label in reversed(labels):
            node = node[0].get(label)
            if node is None:
                break
            used += 1
            if node[1] is not None:
                segments = path.split("/") if segments is None else segments
                found = self._path(node[1], segments)
                if found:
                    best = (".".join(labels[len(labels) - used:]) + found[0], found[1])
        return best or (None, None)

    @staticmethod
    def _path(place, segments):
        best, done = None, ""
        for i, segment in enumerate(segments):
            if place[2]:
                best = (done, place[2])
            if place[1]:
                stems = [s for s in place[1] if "/".join(segments[i:]).startswith(s)]
                if stems:
                    stem = max(stems, key=len)
                    best = (done + stem, place[1][stem])
            if i + 1 == len(segments) or segment not in place[0]:
                return best
            place, done = place[0][segment], f"{done}{segment}/"
        return best


def judge(pages: DataFrame, rules, default: str = ALLOW, url_col: str = "url",
          max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and
    ``verdict``; columns of those names are replaced, all others stay.

    ``rules`` is a list of ``(verdict, host, path)`` or a DataFrame with these
    columns (nulls in it are dropped).  Urls that are null or hold no ``://``
    have an empty host and path and get ``default``.  Rows are never dropped;
    repeated rows are judged alike; an empty table stays empty.  Up to
    ``max_broadcast_rules`` rules are broadcast as a trie (its size is bounded
    by that count); a longer list is joined on the candidate places of each
    url with the same result.
    """
    parsed = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).drop("rule", "verdict")
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "host", "path").dropna()
        if rules.limit(max_broadcast_rules + 1).count() > max_broadcast_rules:
            return _joined(parsed, rules, default)
        rules = [tuple(r) for r in rules.collect()]
    elif len(rules) > max_broadcast_rules:
        return _joined(parsed, spark.createDataFrame(list(rules), "verdict string, host string, path string"), default)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) for h, p in zip(host, path)]
        return pd.DataFrame([(r, v or default) for r, v in found], columns=["rule", "verdict"])

    return (parsed.withColumn("__found", decide("host", "path"))
            .withColumns({"rule": F.col("__found.rule"), "verdict": F.col("__found.verdict")}).drop("__found"))


def _joined(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by joins, for lists too long to broadcast: the
    distinct places are expanded to every (host suffix, path prefix) that a
    rule could name, matched, and the longest match is taken per place."""
    places = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    expanded = (places.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(
        ".", F.slice(labels, F.size(labels) - i + 1, i)))).alias("h"))
        .select("*", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")),
                                           lambda i: F.substring("path", F.lit(1), i))).alias("p")))
    named = rules.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("verdict").alias("verdict"))
    best = (expanded.join(named, ["h", "p"]).groupBy("host", "path")
            .agg(F.max(F.struct(F.length("h").alias("a"), F.length("p").alias("b"), "h", "p", "verdict")).alias("x"))
            .select("host", "path", F.concat("x.h", "x.p").alias("rule"), F.col("x.verdict").alias("verdict")))
    return (parsed.join(best, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*parsed.columns, "rule", "verdict"))
