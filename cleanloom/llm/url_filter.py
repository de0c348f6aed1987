"""URL filter: a trie over reversed host labels and path segments, with the longest match deciding.

A rule is a host and a path. It fits its host and all subdomains of it, if the URL's path starts with the rule's. Walking
the trie down the URL's host labels from the last to the first, every node on the way may hold rules; their paths form a
second trie of segments, whose last step may end inside a segment. Of all rules that fit, the one with the longest host, then with
the longest path, decides; of equal rules a block precedes an allow. The trie is small by contract: the number of rules is checked before they are gathered
for broadcast, and a larger rule table is joined instead, host suffix by host suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm._common import lower_ascii, shipped

shipped(__name__)

#: Up to so many rules, of so many bytes together, are gathered into one broadcast trie.
MOST_RULES, MOST_BYTES = 200_000, 16 << 20


@dataclass
class _Paths:
    """A node of the path trie: children by segment, and rules that end here (whole) or within a child's segment (part)."""

    children: dict = field(default_factory=dict)
    whole: tuple | None = None
    part: dict = field(default_factory=dict)


@dataclass
class _Hosts:
    """A node of the host trie: children by label, and the rules of the host that ends here."""

    children: dict = field(default_factory=dict)
    paths: _Paths | None = None


class UrlTrie:
    """Rules (verdict, host, path), compiled."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root = _Hosts()
        for verdict, host, path in sorted(rules, key=lambda r: (r[1], r[2], r[0] != "block"), reverse=True):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.children.setdefault(label, _Hosts())
            node.paths = node.paths or _Paths()
            at = node.paths
            *segments, last = path.split("/")
            for segment in segments:
                at = at.children.setdefault(segment, _Paths())
            if last:
                at.part[last] = (verdict, host + path)
            else:
                at.whole = (verdict, host + path)

    @staticmethod
    def _path(at: _Paths, path: str) -> tuple | None:
        """The rule with the longest path among those that path starts with."""
        best, segments, k = None, path.split("/"), 0
        while True:
            best = at.whole or best
            segment = segments[k]
            if at.part:
                for n in range(len(segment), 0, -1):
                    if segment[:n] in at.part:
                        best = at.part[segment[:n]]
                        break
            k += 1
            at = at.children.get(segment)
            if at is None or k == len(segments):
                return best

    def match(self, host: str, path: str) -> tuple | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._path(node.paths, path) or best
        return best


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z in lower case; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judge(trie: UrlTrie, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch({
                "page_id": batch.column(0),
                "host": batch.column(1),
                "path": batch.column(2),
                "rule": pa.array([f and f[1] for f in found], pa.string()),
                "verdict": pa.array([f[0] if f else default for f in found], pa.string()),
            })

    return run


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages (page_id long, url string).

    rules has the columns verdict (allow or block), host and path; an empty path fits every path, and hosts are taken in
    lower case. rule is the deciding rule's host and path, null where none fits; the verdict is then `default`. A null url,
    or one without ://, has an empty host and path and fits no rule with a host. Rows that repeat are judged one by one;
    empty pages give an empty result; without rules every verdict is the default. Rules with a null host or verdict are ignored.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    usable = rules.where("host is not null and verdict in ('allow', 'block')").select("verdict", lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    size = usable.agg(F.count("*").alias("rules"), F.coalesce(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")), F.lit(0)).alias("bytes")).first()
    if size.rules <= most_rules and size.bytes <= MOST_BYTES:
        trie = UrlTrie([(r.verdict, r.rule_host, r.rule_path) for r in usable.collect()])
        return plain.mapInArrow(_judge(trie, default), "page_id long, host string, path string, rule string, verdict string")
    return joined_verdicts(plain, usable, default)


def joined_verdicts(plain: DataFrame, usable: DataFrame, default: str) -> DataFrame:
    """The same verdicts by a join on host suffixes, for rule tables too large to gather."""
    urls = plain.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    hit = urls.withColumn("rule_host", suffix).join(usable, "rule_host").where("startswith(path, rule_path)")
    key = F.struct(F.length("rule_host"), F.length("rule_path"), (F.col("verdict") == "block"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    best = hit.groupBy("host", "path").agg(F.max(key).alias("best"))
    out = plain.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
