"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is host and path. It fits its host and every subdomain if the url's path starts with the rule's. Of all rules that
fit, the one with most host labels wins, then the one with the longest path; of an allow and a block rule alike, block.
The trie is broadcast while its pickled size is at most ``MAX_TRIE_BYTES``; larger rule sets are joined on
(host suffix, path prefix) instead, with the same result.

Cases: a null url or one without ``://`` has empty host and path and fits no rule but those with an empty host; a path
may be empty and then starts with no rule's ``/``; repeated urls are judged alike; an empty table or rule set works;
further columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower

MAX_TRIE_BYTES = 64 << 20
RESULT = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


class Trie:
    """Nodes are ``[children by label, path node]``; path nodes are ``[children by segment, [(rest, rule name, verdict)]]``."""

    def __init__(self, rules: list[Rule]):
        self.root: list = [{}, None]
        for r in sorted(rules, key=lambda r: r.verdict):  # block is put last and so wins
            node = self.root
            for label in reversed(r.host.split(".")) if r.host else ():
                node = node[0].setdefault(label, [{}, None])
            node[1] = at = node[1] or [{}, []]
            *segments, rest = r.path.split("/")
            for s in segments:
                at = at[0].setdefault(s, [{}, []])
            at[1][:] = [x for x in at[1] if x[0] != rest] + [(rest, r.name, r.verdict)]

    @staticmethod
    def _in_path(node: list, path: str) -> tuple[str, str] | None:
        best, pieces, depth, at = None, path.split("/"), 0, 0
        while True:
            fits = [x for x in node[1] if path.startswith(x[0], at)]
            if fits:
                best = max(fits, key=lambda x: len(x[0]))[1:]
            # The last piece has no slash behind it and completes no segment.
            if depth >= len(pieces) - 1 or (node := node[0].get(pieces[depth])) is None:
                return best
            at += len(pieces[depth]) + 1
            depth += 1

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule name, verdict) of the longest rule that fits."""
        best, node = None, self.root
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            if node[1] is not None:
                best = self._in_path(node[1], path) or best
            node = node[0].get(next(labels, None))
        return best


def _with_parts(df: DataFrame, url: str) -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.drop(*[c for c in RESULT if c != url]).withColumn("_rest", rest)
    return df.withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0))).withColumn(
        "path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    ).drop("_rest")


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict to every row."""
    trie = Trie(rules)
    parts = _with_parts(df, url)
    if len(pickle.dumps(trie)) > MAX_TRIE_BYTES:
        return _joined(parts, rules, default)
    held = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tree = held.value
        for hosts, paths in batches:
            got = [tree.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(got, columns=["rule", "verdict"])

    return parts.withColumn("_got", find("host", "path")).select("*", "_got.rule", "_got.verdict").drop("_got")


def _joined(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by joining distinct (host, path) pairs, exploded to (host suffix, whole path segments), with the rules."""
    spark: SparkSession = parts.sparkSession
    table = spark.createDataFrame([(r.host, r.path[: r.path.rfind("/") + 1], r.path, r.name, r.verdict) for r in rules], "_h string, _s string, _p string, rule string, verdict string")
    pairs = parts.select("host", "path").distinct().withColumn("_l", F.split("host", r"\."))
    pairs = pairs.withColumn("_h", F.explode(F.expr("array_distinct(concat(transform(sequence(1, size(_l)), i -> array_join(slice(_l, i, size(_l)), '.')), array('')))")))
    pairs = pairs.withColumn("_x", F.split("path", "/")).withColumn(
        "_s", F.explode(F.expr("array_distinct(transform(sequence(0, size(_x) - 1), i -> CASE WHEN i = 0 THEN '' ELSE concat(array_join(slice(_x, 1, i), '/'), '/') END))"))
    )
    fits = pairs.join(table, ["_h", "_s"]).where("startswith(path, _p)")
    rank = F.struct(F.when(F.col("_h") == "", 0).otherwise(F.size(F.split("_h", r"\."))), F.length("_p"), F.col("verdict"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_got"))
    got = parts.join(best, ["host", "path"], "left")
    return got.select("*", F.col("_got.rule").alias("rule"), F.coalesce("_got.verdict", F.lit(default)).alias("verdict")).drop("_got")
