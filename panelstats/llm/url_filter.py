"""Operator 4: URL filters by a trie over reversed host labels and path segments.

The rules are few and known to the driver; their size is checked against
``MAX_RULE_BYTES`` and the trie is broadcast. A URL walks its host labels from
the right (``org``, ``example``, ``www``) and, at each node that carries path
rules, its path segments; the last piece of a rule's path may end inside a
segment (``/en/1`` fits ``/en/166``). The longest rule wins: more host labels
first, then the longer path; of two equal rules ``block`` wins. Without a
fitting rule the verdict is the default, ``allow``.

Defined results: a null URL or one without ``://`` has an empty host and path
and gets the default; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_RULE_BYTES = 64 << 20
DEFAULT = "allow"


class UrlTrie:
    """Nested dicts: host labels from the right, then path segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        rules = list(rules)
        if sum(len(h) + len(p) + 16 for _, h, p in rules) > MAX_RULE_BYTES:
            raise ValueError("rule list exceeds the broadcast bound MAX_RULE_BYTES")
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(("label", label), {})
            node = node.setdefault("paths", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            ends = node.setdefault("ends", {})
            if ends.get(tail, ("", ""))[1] != "block":
                ends[tail] = (host + path, verdict)

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            ends = node.get("ends")
            if ends:
                fit = max((t for t in ends if segment.startswith(t)), key=len, default=None)
                best = best if fit is None else ends[fit]
            node = node.get(("segment", segment))
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            if "paths" in node:
                best = self._path(node["paths"], path) or best
        return best


_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path of a URL."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id",
               url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row; ``rules`` are (verdict, host, path)."""
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    rows = pages.select(key, url)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            found = [trie.value.match(h, p) if h else None for h, p in split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()),
                 pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=[key, "host", "path", "rule", "verdict"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
