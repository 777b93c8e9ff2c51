"""URL filter: a trie over reversed host labels and path segments decides between allow and block entries.

Host labels are walked from the last to the first, so an entry for a domain is met on the way to each of its
subdomains. Below every host node hangs a trie of whole path segments; what a rule's path has after its last slash
may be a part of a segment. The entry with the longest host wins, among those the one with the longest path.

The trie goes to the tasks as one broadcast while the rules fit ``BROADCAST_BYTES``; beyond that the same rules are
met by joins, host suffixes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import byte_texts, small_batches, stored

#: Characters of all rules together up to which the trie is broadcast; a trie takes about 20 times that in a worker.
BROADCAST_BYTES = 8 << 20
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: bytes | None) -> tuple[bytes, bytes]:
    """Host, lower-cased in A-Z only, and path; both empty for null and for texts without ``://``."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    rest = rest.split(b"#", 1)[0].split(b"?", 1)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


class Trie:
    """Nodes are dicts: labels or segments lead on, ``PATHS`` to the path trie of a host, ``ENDS`` to what ends here.

    ``ENDS`` holds the parts of a segment that end rules, by their length.
    """

    PATHS, ENDS = 0, 1

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in self.labels(host.encode()):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, rest = path.encode().split(b"/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(self.ENDS, {}).setdefault(len(rest), {})
            if ends.get(rest, (None, ALLOW))[1] == ALLOW:  # equal entries: block goes before allow
                ends[rest] = (host + path, verdict)

    @staticmethod
    def labels(host: bytes) -> list[bytes]:
        return host.split(b".")[::-1] if host else []

    def match(self, host: bytes, path: bytes) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits."""
        at, hosts = self.root, [self.root]
        for label in self.labels(host):
            at = at.get(label)
            if at is None:
                break
            hosts.append(at)
        segments = path.split(b"/")
        for node in reversed(hosts):
            if self.PATHS in node and (found := self._longest(node[self.PATHS], segments)):
                return found
        return None

    def _longest(self, node: dict, segments: list[bytes]) -> tuple[str, str] | None:
        best = None
        for k, segment in enumerate(segments):
            ends = node.get(self.ENDS, {})
            best = next((ends[n][segment[:n]] for n in sorted(ends, reverse=True) if segment[:n] in ends[n]), best)
            # A segment is whole only if a slash follows it.
            node = node.get(segment) if k < len(segments) - 1 else None
            if node is None:
                break
        return best


_DDL = "key bigint, host string, path string, rule string, verdict string"


def _matcher(shared, otherwise: str):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in small_batches(batches, 4096):
            parts = [host_and_path(url) for url in byte_texts(batch.column(1))]
            found = [trie.match(*p) or (None, otherwise) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.binary()).cast(pa.string()) for c in columns),
                 *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))],
                names=["key", "host", "path", "rule", "verdict"],
            )

    return judge


def _checked(rules: DataFrame) -> DataFrame:
    verdict = F.when(F.col("verdict").isin(ALLOW, BLOCK), F.col("verdict")).otherwise(F.raise_error(F.lit("a verdict is allow or block")))
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rules.select(F.coalesce(lower, F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), verdict.alias("verdict"))


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", otherwise: str = ALLOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages`` (columns ``key`` and ``url``; others are not read).

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains of it, on label borders, if the
    url's path starts with the rule's; an empty host fits every host, null parts count as empty. The longest host
    wins, then the longest path; of equal entries block. Without a fitting rule: rule null, verdict ``otherwise``.
    Null urls, and those without ``://``, have an empty host and path. Every repeated row gets its own row; an empty
    table gives an empty result. Hosts stand as written: ports and user names are part of the last and first label.
    """
    rules = stored(_checked(rules).distinct(), "rules")
    size = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 64), F.lit(0)).alias("n")).first()["n"]
    chosen = pages.select(F.col(key).cast("bigint").alias("key"), F.col("url").cast("string").alias("url"))
    if size > broadcast_bytes:
        return _joined(chosen, rules, otherwise).withColumnRenamed("key", key)
    trie = Trie([(r["host"], r["path"], r["verdict"]) for r in rules.toLocalIterator()])
    shared = pages.sparkSession.sparkContext.broadcast(trie)
    return chosen.mapInArrow(_matcher(shared, otherwise), _DDL).withColumnRenamed("key", key)


def _host(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(chosen: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """The same verdicts by joins, for rules past the broadcast bound.

    Each different (host, path) meets the rules by a host suffix and a run of whole path segments; the rest of a
    rule's path is checked on the joined rows. Copies of a url count once in the joins.
    """
    url = F.coalesce("url", F.lit(""))
    parts = stored(chosen.select("key", _host(url).alias("host"), F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1).alias("path")), "urls")
    whole = F.regexp_extract("path", "(?s)^(.*/)?", 1)
    labelled = rules.select("host", whole.alias("whole"), "path", "verdict")
    labels, segments = F.split("host", "[.]"), F.split("path", "/")
    tails = F.concat(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")), F.array(F.lit(""))
    )
    heads = F.concat(F.array(F.lit("")), F.when(F.size(segments) > 1, F.transform(
        F.sequence(F.lit(1), F.size(segments) - 1), lambda k: F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/"))
    )).otherwise(F.array().cast("array<string>")))
    different = parts.select("host", "path").distinct()
    suffixes = different.select("host", "path", F.explode(F.array_distinct(tails)).alias("tail"))
    hosts = labelled.select(F.col("host").alias("tail")).distinct().hint("merge")
    candidates = suffixes.join(hosts, "tail").select("host", "path", "tail", F.explode(F.array_distinct(heads)).alias("whole"))
    named = labelled.select(F.col("host").alias("tail"), "whole", F.col("path").alias("rule_path"), "verdict").hint("merge")
    met = candidates.join(named, ["tail", "whole"]).filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(
        F.when(F.col("tail") == "", 0).otherwise(F.size(F.split("tail", "[.]"))).alias("labels"), F.length("rule_path").alias("n"),
        (F.col("verdict") == BLOCK).alias("block"), F.concat("tail", "rule_path").alias("rule"),
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best")).hint("merge")
    return parts.join(best, ["host", "path"], "left").select(
        "key", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best").isNull(), otherwise).when(F.col("best.block"), BLOCK).otherwise(ALLOW).alias("verdict"),
    )
