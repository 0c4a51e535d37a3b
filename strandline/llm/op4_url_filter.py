"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is a host and a path. Its labels go down the trie from the top-level domain, its whole path
segments further down; what follows its last slash (a beginning of a segment) waits at the node it
hangs from, under its text: however many rules end there, a segment is looked up once for each length
that they have. The trie is broadcast after its number of rules is checked; a url walks it once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules in one broadcast trie at most, about 500 bytes each; more go in several passes.
MOST_RULES = 200_000

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@dataclass
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: beginning of the next segment (it may be empty) -> verdict and rule, and the lengths that beginnings have
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: set[int] = field(default_factory=set)


class Trie:
    """Rules (verdict, host, path). Of rules that fit, the one with the longest host + path wins,
    and of equally long ones block before allow."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root = Node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, Node())
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            node.ends[rest] = max(node.ends.get(rest, ("", "")), (verdict, host + path))  # block before allow
            node.lengths.add(len(rest))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        best: tuple[int, str, str] | None = None
        node: Node | None = self.root
        parts = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            below: Node | None = node
            for part in parts:
                for n in below.lengths:
                    found = below.ends.get(part[:n]) if n <= len(part) else None
                    if found:
                        best = max(best or (-1, "", ""), (len(found[1]), *found))
                below = below.segments.get(part)
                if below is None:
                    break
        return best and (best[1], best[2])


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path; both empty for null or without ://."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:cut]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (host + path, null if none fits) and verdict.

    Without a fitting rule the verdict is `default`. Null, empty and long urls are rows like others,
    repeated rows too; other columns are ignored and an empty table gives no rows. With more than
    MOST_RULES rules the table passes several tries, one after the other, and keeps the longest match.
    """
    spark = pages.sparkSession
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    kind = out.schema["page_id"].dataType.simpleString()
    passes = [rules[k : k + MOST_RULES] for k in range(0, len(rules), MOST_RULES)] or [[]]
    for k, part in enumerate(passes):
        shared = spark.sparkContext.broadcast(Trie(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            for batch in batches:
                urls = batch.column(1).to_pylist()
                old = [(None, None)] * len(urls) if first else list(zip(*(c.to_pylist() for c in batch.columns[4:6])))
                places = [split_url(u) for u in urls]
                found = []
                for (host, path), (rule, verdict) in zip(places, old):
                    got = trie.find(host, path)
                    now = max(((len(r), v, r) for v, r in [x for x in (got, rule and (verdict, rule)) if x]), default=None)
                    found.append((now[2], now[1]) if now else (None, None))
                columns = [[h for h, _ in places], [p for _, p in places], [r for r, _ in found], [v for _, v in found]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.string()) for c in columns)], ["page_id", "url", "host", "path", "rule", "verdict"])

        out = out.mapInArrow(run, f"page_id {kind}, url string, host string, path string, rule string, verdict string")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp) * 2 + (verdict = 'block')::INT) AS rule, arg_max(verdict, length(rh || rp) * 2 + (verdict = 'block')::INT) AS verdict
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
