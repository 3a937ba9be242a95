"""Operator 7. URL allow and block lists in a trie over reversed host labels and path segments.

``example.com/en/7`` lies under the labels ``com``, ``example`` and then the segment ``en``;
its last, perhaps partial segment ``7`` is a prefix test at that node. The walk goes down the
labels of the url's host, and at each host node down the segments of its path; the deepest
host with a fitting rule wins, and on it the longest path, whether allow or block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, map_rows, others

#: A trie whose pickle is larger is not broadcast; the join form takes over.
MOST_BYTES = 32_000_000

Rule = tuple[str, str]  # (allow or block, host/path)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def build_trie(rules: Iterable[Rule]) -> dict:
    """Host node: {label: node, "/": path node}. Path node: {"s": {segment: node}, "p": {prefix: (verdict, rule)}, "l": lengths of "p", falling}.

    A rule given twice with both verdicts blocks.
    """
    root: dict = {}
    for verdict, rule in sorted(set(rules)):  # allow before block: block replaces it
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
        host, path = split_rule(rule)
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        at = node.setdefault("/", {})
        *whole, last = path.split("/")
        for segment in whole:
            at = at.setdefault("s", {}).setdefault(segment, {})
        at.setdefault("p", {})[last] = (verdict, rule)
        at["l"] = tuple(sorted({*at.get("l", ()), len(last)}, reverse=True)) if len(last) not in at.get("l", ()) else at["l"]
    return root


def longest_match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the rule that fits host and path and is longest: deepest host, then longest path."""
    node, found = root, None
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        at = node.get("/")
        best = None
        for segment in segments:
            if at is None:
                break
            for n in at.get("l", ()):  # one lookup for each length of a tail
                if n <= len(segment) and (fit := at["p"].get(segment[:n])):
                    best = fit
                    break
            at = at.get("s", {}).get(segment)
        found = best or found
    return found


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    cut = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(urls: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add host, path, rule and verdict to ``urls``; all rows stay and columns of these names are replaced.

    A null url, or one without ``://``, has an empty host and path, no rule and the default
    verdict. Empty tables, repeated rows and other columns of any name need no special case: each
    row stands alone. Without rules every verdict is the default. The trie is broadcast if its
    pickle takes at most ``most_bytes``; a larger list of rules is joined instead, on the host
    suffixes and path prefixes of each url that rules can have.
    """
    rules = list(rules)
    keep = others(urls, "host", "path", "rule", "verdict")
    cut = urls.select(*map(col, keep), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    packed = pickle.dumps(build_trie(rules))
    if len(packed) > most_bytes:
        return _joined(cut, rules, keep, default)
    sent = urls.sparkSession.sparkContext.broadcast(packed)
    host, path = fresh(cut, "host_read", "path_read")

    def make():
        root = pickle.loads(sent.value)

        def step(cols):
            found = [longest_match(root, h, p) for h, p in zip(cols[host], cols[path], strict=True)]
            return {"rule": [f[1] if f else None for f in found], "verdict": [f[0] if f else default for f in found]}

        return step

    return map_rows(cut.select("*", F.col("host").alias(host), F.col("path").alias(path)), make, "rule string, verdict string", cut.columns, 2000)


def _joined(cut: DataFrame, rules: list[Rule], keep: list[str], default: str) -> DataFrame:
    """The same by equi-joins: distinct (host, path) meet rules on host suffix and path prefix."""
    spark = cut.sparkSession
    if not rules:
        return cut.select(*map(col, keep), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = spark.createDataFrame([(*split_rule(r), r, v) for v, r in sorted(set(rules))], "r_host string, r_path string, rule string, verdict string")
    lengths = [r[0] for r in listed.select(F.length("r_path").alias("n")).distinct().orderBy("n").collect()]  # at most as many as a path has characters
    pages = cut.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    tried = pages.select("host", "path", F.explode(suffixes).alias("r_host")).select("*", F.explode(F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("r_path"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("r_host"), F.length("r_path"), "verdict"))
    of_host, of_path, match = fresh(cut, "of_host", "of_path", "match")
    found = tried.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(best.alias(match)).withColumnsRenamed({"host": of_host, "path": of_path})
    back = cut.join(found, (F.col("host") == F.col(of_host)) & (F.col("path") == F.col(of_path)), "left")
    return back.select(*map(col, keep), "host", "path", F.col(match)["rule"].alias("rule"), F.coalesce(F.col(match)["verdict"], F.lit(default)).alias("verdict"))
