"""URL filters by a sort-merge range join. DataFrame operations only.

A host's key is its labels reversed, each with a dot after it: ``blog.example.net`` is
``net.example.blog.``. All hosts under a rule's host then form one interval of keys, from the rule's key
up to the same with its last dot replaced by the next character; such intervals nest or are disjoint.
A sweep over the sorted ends of the intervals keeps a stack of active rules and cuts the keys into
segments, each with the stack that holds there. Rules are the caller's parameter, so this sweep is over
a list it already has; pages are never collected.

Pages and segment starts are then sorted together by key, and each page takes the last segment start
before it. Any page can be looked up apart from any other, so rows are dealt out in turn, whatever they
hold, into as many sweeps as there are shuffle partitions, with all segments in each: neither a hot host
nor a url of many rows, or of none, is a hot task. Of the stack's rules whose path begins the page's path, the longest wins: by host and
path together, then by host.

Defined results: a null url or one without ``://`` has an empty host and path; no rule fits an empty
host. Where no rule fits, the verdict is ``default``. Repeated rows are judged alike. Of rules with the
same host and path the last counts. Other columns pass through ``filtered``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import LOWER, UPPER

DOWN = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path, both empty where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def segments(rules: list[Rule]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Segment starts in order, each with the (host, path, verdict) that hold from there, the longest first."""
    last = {(r.host.translate(DOWN), r.path): r.verdict for r in rules}
    by_key: dict[str, list[tuple[str, str, str]]] = {}
    for (host, path), verdict in last.items():
        by_key.setdefault(".".join(reversed(host.split("."))) + ".", []).append((host, path, verdict))
    ends = sorted([(k, 1, k) for k in by_key] + [(f"{k[:-1]}/", 0, k) for k in by_key], key=lambda x: (x[0].encode(), x[1]))
    stack: list[str] = []
    out: dict[str, list[tuple[str, str, str]]] = {}
    for at, opens, key in ends:
        if opens:
            stack.append(key)
        else:
            stack.remove(key)  # the top, or one of those that end at the same key
        out[at] = sorted((r for k in stack for r in by_key[k]), key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))
    return list(out.items())


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", sweeps: int | None = None) -> DataFrame:
    """The rows with host, path, rule and verdict in a struct column ``judged``."""
    spark = pages.sparkSession
    n = sweeps or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.col(url))
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    kind = "array<struct<host:string,path:string,verdict:string>>"
    points = pages.select(own.alias("row"), host.alias("host"), path.alias("path"))
    points = points.select("row", "host", "path", reversed_key(F.col("host")).alias("key"), F.lit(1).alias("is_page"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias("sweep"), F.lit(None).cast(kind).alias("stack"))
    cuts = spark.createDataFrame(segments(rules), f"key string, stack {kind}")
    cuts = cuts.select("key", "stack", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sweep"), F.lit(0).alias("is_page"))
    both = points.unionByName(cuts, allowMissingColumns=True)
    order = Window.partitionBy("sweep").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("active", F.last("stack", ignorenulls=True).over(order)).filter("is_page = 1")
    best = F.try_element_at(F.filter("active", lambda r: F.col("path").startswith(r["path"])), F.lit(1))
    found = found.withColumn("best", best)
    return found.select("row", F.struct("host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).alias("judged"))


def filtered(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """The rows that are allowed, with their own columns only."""
    return judged(pages, rules, url, default).filter("judged.verdict = 'allow'").select("row.*")
