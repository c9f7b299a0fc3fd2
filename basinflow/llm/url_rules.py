"""URL rules by a sort-merge range join.

A rule is a host and a path beginning; it fits the host, its subdomains and paths that
begin so. Hosts are reversed label by label and joined with the path into a canonical
key, so a rule is a key prefix: an interval of the key order. A URL has a key for each
suffix of its host. Keys are dealt to ranges of the order, a rule to every range its
interval meets; each range is sorted and swept once, a stack holding the nested rules
that are active. No rule is broadcast, and equal URLs are judged once.
"""

from __future__ import annotations

import bisect
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

_END = "\U0010ffff"
_LABEL, _PATH = "\u0001", "\u0000"
#: Boundaries are cut to so many characters: any string divides the order.
_BOUND_CHARS = 200


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: str, path: str) -> str:
    """Key of a rule, or of a URL under one suffix of its host."""
    return _LABEL.join(reversed(host.split("."))) + _PATH + path


def _keys(host: str, path: str) -> Iterator[str]:
    # the key's own separators can't be part of a rule's host; here they must not look like one
    labels = host.replace(_LABEL, "\u0002").replace(_PATH, "\u0002").split(".")[::-1]
    prefix = ""
    for i, label in enumerate(labels):
        prefix = prefix + _LABEL + label if i else label
        yield prefix + _PATH + path


_EVENTS = "part int, key string, kind int, host string, path string, rule string, verdict string"


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    *,
    default: str = "allow",
) -> DataFrame:
    """Longest fitting rule of every page's URL.

    ``rules`` has columns host, path and verdict. Returns (page_id, host, path, rule,
    verdict), a row per page: rule is host + path of the longest rule that fits, null if
    none does, and verdict then ``default``. Of rules of equal text the verdict that
    sorts first counts. A null URL or one without "://" has an empty host and path; an
    empty host fits no rule. Rules with a null part are ignored; repeated pages, null
    ids and extra columns do no harm; without rules every page gets the default.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-rules")
    url = pages[url_col].cast("string")
    named = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = scratch.keep(named.where("host <> ''").select("host", "path").distinct(), "urls")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = urls.count()
    draw = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) / float(1 << 30)
    # a sample of bounded size gives the boundaries of the ranges
    sample = urls.where(draw < min(1.0, 40 * ranges / max(total, 1))).select(F.substring("host", 1, _BOUND_CHARS), F.substring("path", 1, _BOUND_CHARS)).limit(200 * ranges).collect()
    keys = sorted({k[:_BOUND_CHARS] for h, p in sample for k in _keys(h, p)})
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    shared = spark.sparkContext.broadcast(bounds)

    def url_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(bisect.bisect_right(shared.value, k), k, 1, h, p, None, None) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in _keys(h, p)]
            yield _batch(rows)

    def rule_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, p, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                k = canonical(h, p)
                first, last = bisect.bisect_right(shared.value, k), bisect.bisect_right(shared.value, k + _END)
                rows += [(part, k, 0, None, None, h + p, v) for part in range(first, last + 1)]
            yield _batch(rows)

    clean = rules.select(*(rules[c].cast("string").alias(c) for c in ("host", "path", "verdict"))).where("host is not null and path is not null and verdict is not null and host <> ''")
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    events = urls.mapInArrow(url_events, _EVENTS).union(clean.mapInArrow(rule_events, _EVENTS))
    swept = events.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(_sweep, "host string, path string, rule string, verdict string")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    joined = named.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4]
    names = ["part", "key", "kind", "host", "path", "rule", "verdict"]
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events to the longest active rule of every URL key that has one."""
    part, stack = None, []
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for at, key, kind, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            elif stack:
                for c, v in zip(out, (host, path, *stack[-1][1:])):
                    c.append(v)
        yield pa.record_batch([pa.array(c, pa.string()) for c in out], names=["host", "path", "rule", "verdict"])


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
