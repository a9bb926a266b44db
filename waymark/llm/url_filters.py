"""URL filters by a sort-merge range join.

A rule names a host and a path prefix.  With the labels of a host in reverse
order (``a.b.org`` -> ``org.b.a.``; a label never holds a dot) the hosts under
a rule's host are one interval of keys.  URLs and rules are dealt over range buckets of that key; a
rule goes to every bucket its interval touches, and a key that fills several
buckets is salted over them.  Each bucket is sorted once and swept once, with
a stack of the nested rule hosts that are open at the current key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import fold, shuffle_partitions

#: Keys read per bucket to place the bucket bounds.  Bounds steer balance alone, never results.
SAMPLE_PER_BUCKET = 20

_OUT = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
    ]
)


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path columns; both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    rx = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return fold(F.regexp_extract(u, rx, 1)), F.regexp_extract(u, rx, 2)


def host_key(host: F.Column) -> F.Column:
    """Labels in reverse order, each with a dot after it: a host is under another if and only if its key begins with the other's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _after(key: str) -> str:
    """The least string after all that begin with a key: a slash, the character after the dot, for its last dot."""
    return key[:-1] + "/"


def _sweep(batches, default):
    """Rows in order of bucket, key and kind (rules first)."""
    bucket, stack = None, []
    for batch in batches:
        d = batch.to_pydict()
        out = {k: [] for k in ("page_id", "host", "path", "rule", "verdict")}
        for b, key, kind, page, host, path, verdict in zip(*(d[k] for k in ("bucket", "key", "kind", "page_id", "host", "path", "verdict")), strict=True):
            if b != bucket:
                bucket, stack = b, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, set()))
                stack[-1][2].setdefault(path, verdict)  # of equal rules the first verdict in order holds: allow
                stack[-1][3].add(len(path))
                continue
            best = None
            for _, rule_host, rules, sizes in stack:
                for n in sizes:
                    if n <= len(path) and (v := rules.get(path[:n])) is not None:
                        rank = (len(rule_host) + n, len(rule_host))
                        if best is None or rank > best[0]:
                            best = (rank, rule_host + path[:n], v)
            out["page_id"].append(page)
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(best and best[1])
            out["verdict"].append(best[2] if best else default)
        if out["page_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), *((k, pa.string()) for k in ("host", "path", "rule", "verdict"))]))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row of ``pages`` by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's; of the fitting rules the longest (host and path together, then the
    longer host) wins.  One row per input row: page_id, host, path, rule (null
    if none fits), verdict (``default`` if none fits).  Null URLs and those
    without ``://`` have an empty host and path; repeated rows stay repeated;
    null ids stay null; rules with a null field fit nothing; of equal rules
    with two verdicts, ``allow`` holds.  Other columns are not read.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    n = shuffle_partitions(spark)
    sample = sorted(r[0] for r in urls.select("key", F.xxhash64("page_id", "key", "path").alias("h")).orderBy("h").limit(SAMPLE_PER_BUCKET * n).select("key").collect())
    splits = sample[SAMPLE_PER_BUCKET::SAMPLE_PER_BUCKET]

    @F.pandas_udf("int")
    def url_bucket(key: pd.Series, salt: pd.Series) -> pd.Series:
        def place(k, s):
            lo = bisect_left(splits, k)
            return lo + s % (bisect_right(splits, k) - lo + 1)

        return pd.Series([place(k, s) for k, s in zip(key, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def rule_buckets(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(splits, k), bisect_left(splits, _after(k)) + 1)) for k in key])

    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 30))
    points = urls.select(url_bucket("key", salt).alias("bucket"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    known = rules.select(fold(F.col("host")).alias("host"), "path", "verdict").dropna().distinct().withColumn("key", host_key(F.col("host")))
    opened = known.select(F.explode(rule_buckets("key")).alias("bucket"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    dealt = points.unionByName(opened).repartitionById(len(splits) + 1, F.col("bucket"))
    ordered = dealt.sortWithinPartitions("bucket", "key", "kind", "path", "verdict")
    return ordered.mapInArrow(lambda batches: _sweep(batches, default), _OUT)
