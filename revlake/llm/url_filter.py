"""URL filter: a trie over reversed host labels, then path characters, broadcast to the tasks; the longest rule wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: A trie beyond this many nodes is refused: rules are a configuration, not a corpus.
MOST_NODES = 2_000_000
_RULE = 0  # key of a node's rule; labels and path segments are strings


class UrlTrie:
    """Nodes are dicts. A host's labels lead, last label first, to a node whose "/" child holds its path rules by segment."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        """rules: (verdict, host, path); a path is compared as a prefix, so its last segment may be cut."""
        self.root: dict = {}
        self.nodes = 0
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = self._child(node, label)
            node = self._child(node, "/")
            whole, _, rest = path.rpartition("/")
            for segment in whole.split("/")[1:] if path else []:
                node = self._child(node, segment + "/")
            ends = node.setdefault(_RULE, [])
            ends.append((rest if path else None, f"{host}{path}", verdict))
            ends.sort(key=lambda e: (-len(e[0] or ""), e[0] is None, e[2] != "block"))

    def _child(self, node: dict, key: str) -> dict:
        if key not in node:
            self.nodes += 1
            if self.nodes > MOST_NODES:
                raise ValueError(f"more than {MOST_NODES} trie nodes")
        return node.setdefault(key, {})

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        """The longest path rule under a host node."""
        best, at = None, 1
        while True:
            for rest, rule, verdict in node.get(_RULE, ()):
                if rest is None or path.startswith("/" if at else "") and path.startswith(rest, at):
                    best = rule, verdict
                    break
            end = path.find("/", at)
            if end < 0 or (node := node.get(path[at : end + 1])) is None:
                return best
            at = end + 1

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, host and path taken together; of two as long, the one with the
        shorter host, and block before allow for one host and path."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node and (fit := self._path(node["/"], path)):
                best = max(best or ("", ""), fit, key=lambda x: len(x[0]))
        return best


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, char_length(substring_index(`{url}`, '://', 1)) + 4)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    head = F.regexp_extract(rest, "^[^?#]*", 0)
    return F.translate(F.regexp_extract(head, "^[^/]*", 0), UPPER, LOWER), F.regexp_extract(head, "(?s)^[^/]*(.*)$", 1)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict (the rule's, else default).

    A null url or one without :// has empty host and path and gets the default. A rule fits its host and all subdomains
    if the path starts with the rule's. Repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        longest = trie.value.longest
        for hosts, paths in parts:
            yield pd.DataFrame([longest(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    host, path = host_and_path("u")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).select("id", host.alias("host"), path.alias("path"))
    return rows.select(F.col("id").alias(id_col), "host", "path", judge("host", "path").alias("j")).select(id_col, "host", "path", "j.rule", "j.verdict")
