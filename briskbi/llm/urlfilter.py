"""URL filter: a trie over reversed host labels and path segments, longest match wins.

``judge`` broadcasts a trie of allow and block entries and looks every url up in
it.  A rule ``host/path`` fits its host and all subdomains when the url's path
starts with the rule's path.  Of all fitting rules the one with the most host
labels wins, then the longest path; an entry listed twice takes ``block``.

Defined cases: null url or no ``://``: host and path are empty, no rule, default
verdict.  Rules with a null host or verdict are ignored; no rules: every url gets
the default.  Repeated rows are judged alike.  Extra columns are not read.  A very long url takes
time in proportion to its length and the number of different lengths of rule tails.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of rule text that are broadcast at most; more rules are joined by key.
BROADCAST_BYTES = 64 << 20
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return _lower(host), slash + path


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


class Trie:
    """Nodes are dicts: host labels from the right, then path segments under one marker key."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in rules:
            if rule is None or verdict is None:
                continue
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault("/paths", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            tails = node.setdefault("/tails", {})
            if tail not in tails or verdict == "block":
                tails[tail] = (rule, verdict)
            lengths = node.setdefault("/lengths", [])
            if len(tail) not in lengths:
                lengths.append(len(tail))
                lengths.sort(reverse=True)

    @staticmethod
    def _below(paths: dict, path: str) -> tuple[str, str] | None:
        """The longest rule path that ``path`` starts with."""
        best, node = None, paths
        for segment in path.split("/"):
            tails = node.get("/tails", {})
            for n in node.get("/lengths", ()):  # no other prefix of the segment can be a tail
                if n <= len(segment) and segment[:n] in tails:
                    best = tails[segment[:n]]
                    break
            if segment not in node:
                break
            node = node[segment]
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        labels = host.split(".") if host else []
        for i in range(len(labels) + 1):
            if "/paths" in node:
                best = self._below(node["/paths"], path) or best
            if i == len(labels) or labels[-1 - i] not in node:
                break
            node = node[labels[-1 - i]]
        return best


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` (column expressions, no Python)."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def judge(urls: DataFrame, rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row; see the module text.

    The rules are broadcast while their text is below ``BROADCAST_BYTES``;
    longer lists are dealt out in blocks of that size, each block judges every
    url and the best of a url's block verdicts is taken by group.
    """
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for rule, verdict in rules:
        if rule is None or verdict is None:
            continue
        size += len(rule.encode())
        if size > BROADCAST_BYTES:
            blocks.append([])
            size = len(rule.encode())
        blocks[-1].append((rule, verdict))
    base = with_parts(urls.select(F.col(id_col).alias(id_col), F.col(url).alias("_url")), "_url").select(id_col, "host", "path")
    kind = base.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, host string, path string, rule string, verdict string"

    def against(block: list[tuple[str, str]]) -> DataFrame:
        trie = Trie(block)  # Spark sends it with the function, to each executor once

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [trie.find(h, p) or (None, None) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

        return base.mapInArrow(run, schema)

    if len(blocks) == 1:
        out = against(blocks[0])
    else:
        out = None
        for block in blocks:
            out = against(block) if out is None else out.unionByName(against(block))
        labels = F.when(F.col("rule").isNull(), -1).otherwise(F.size(F.split(F.split_part("rule", F.lit("/"), F.lit(1)), r"\.")))
        rank = F.struct(labels.alias("labels"), F.coalesce(F.length("rule"), F.lit(-1)).alias("chars"), (F.col("verdict") == "block").alias("block"), "rule", "verdict")
        repeats = base.groupBy(id_col, "host", "path").agg(F.count("*").alias("copies"))
        best = out.groupBy(id_col, "host", "path").agg(F.max(rank).alias("best")).select(id_col, "host", "path", "best.rule", "best.verdict")
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (id_col, "host", "path")]
        out = best.alias("x").join(repeats.alias("y"), same).select("x.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
