"""URL rules in a trie over reversed host labels, then path segments.

The driver builds the trie from the rule list and broadcasts it; each URL walks it
once. A rule fits its host and every subdomain if the URL's path starts with the
rule's path. The longest rule that fits wins: more host labels first, then the longer
path; of an allow and a block entry for the same place, block wins. A rule's last,
unfinished path segment may end inside a segment of the URL.

The rule list is bounded by ``MAX_TRIE_RULES``. Beyond it, ``judge_urls`` joins the
places that each URL could match (its host suffixes times its path prefixes) with the
rules by equality instead, with the same result.

Defined results: a null URL or one without ``://`` has an empty host and path, which no
rule fits; so do hosts and paths that are empty. Repeated rows get the same verdict, very long
URLs and rules are walked whole, empty tables give empty results and other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm.common import map_batches

ALLOW, BLOCK = "allow", "block"
MAX_TRIE_RULES = 1_000_000
_URL = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def place(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    segments: dict[str, _Node] = field(default_factory=dict)
    ends: list[tuple[str, str, str]] = field(default_factory=list)  # unfinished segment, rule, verdict


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    host = _URL.match(rest[2])[0]
    after = rest[2][len(host) :]
    return host.translate(_LOWER), _PATH.match(after)[0]


class UrlTrie:
    """Longest-match lookups over a rule list."""

    def __init__(self, rules: Iterable[UrlRule]):
        self.root, self.rules = _Node(), list(rules)
        for rule in self.rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            node.ends.append((rest, rule.place, rule.verdict))
        self._order(self.root)

    def __reduce__(self):
        """Sent as its rules: a trie may be deeper than pickling recurses."""
        return UrlTrie, (self.rules,)

    def _order(self, root: _Node) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            node.ends.sort(key=lambda e: (-len(e[0]), e[2] != BLOCK))
            todo += [*node.labels.values(), *node.segments.values()]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            if (node := node.labels.get(label)) is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for segment in segments:
                best = next((e for e in node.ends if segment.startswith(e[0])), best)
                if (node := node.segments.get(segment)) is None:
                    break
            if best:
                return best[1], best[2]
        return None


def _judge_by_join(urls: DataFrame, rules: list[UrlRule], default: str) -> DataFrame:
    """The same verdicts by an equality join with (host, finished segments), for lists too long to broadcast."""
    spark = urls.sparkSession
    rows = [(r.host, r.path.rpartition("/")[0], "/" in r.path, r.path.rpartition("/")[2], r.place, r.verdict, r.host.count("."), len(r.path)) for r in rules]
    listed = spark.createDataFrame(rows, "r_host string, r_dir string, r_slash boolean, r_rest string, r_place string, r_verdict string, r_labels int, r_length int")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]')) - i + 1), '.'))")
    depth = F.expr("sequence(0, size(split(path, '/')) - 1)")
    places = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("r_host")).select("*", F.explode(depth).alias("d"))
    places = places.withColumns({"r_slash": F.col("d") > 0, "r_dir": F.expr("array_join(slice(split(path, '/'), 1, d), '/')"), "tail": F.expr("array_join(slice(split(path, '/'), d + 1, size(split(path, '/'))), '/')")})
    fits = places.join(listed, ["r_host", "r_dir", "r_slash"]).filter(F.col("tail").startswith(F.col("r_rest")))
    rank = F.struct("r_labels", "r_length", (F.col("r_verdict") == BLOCK).alias("b"), "r_place", "r_verdict")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.r_place").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = ALLOW, max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """page_id, host, path, rule (null without one) and verdict of each row; ``default`` is the verdict where no rule fits."""
    kind = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select("page_id", "url")
    if len(rules) > max_trie_rules:

        def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string())], ["page_id", "host", "path"])

        return _judge_by_join(map_batches(slim, parse, f"page_id {kind}, host string, path string"), rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [split_url(u) for u in batch.column("url").to_pylist()]
        found = [trie.value.find(*p) for p in parts]
        columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] if f else None for f in found], [f[1] if f else default for f in found]]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(slim, walk, f"page_id {kind}, host string, path string, rule string, verdict string")
