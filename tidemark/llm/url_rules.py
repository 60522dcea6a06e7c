"""URL rules by a sort-merge range join.

A rule (host, path) fits its host and all subdomains when the url's path starts
with the rule's path.  Hosts are reversed label by label (``www.a.com`` becomes
``com.a.www.``), so a rule's hosts are one interval of keys, and intervals of
different rules are nested or apart.  Urls are dealt to ranges of keys; each
range sweeps its sorted keys once, keeping a stack of the rules whose interval
is open, and the longest rule on the stack whose path fits wins."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import partitions

#: Keys drawn for the range bounds, for each range; they are all the driver sees.
DRAWN = 40
MOST_RANGES = 4000


def parts(url: str = "url"):
    """Host and path of a url as columns; both empty where it has no ``://``."""
    after = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(host, empty), F.coalesce(path, empty)


def host_key(host):
    """The reversed host, every label closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys that cut the table into even ranges."""
    total = keys.count()
    if ranges < 2 or total == 0:
        return []
    share = min(1.0, DRAWN * ranges / total)
    drawn = sorted(r[0] for r in keys.sample(share, seed=7).limit(2 * DRAWN * ranges).collect())
    return [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []


def sweep(keys: list[str], paths: list[str], rules: list[tuple[str, str, str, str]]) -> list[int]:
    """The rule, by its number, of every url; -1 for none.

    ``rules`` hold (lower key, path, name, verdict).  Urls are visited in key
    order; a rule is pushed when its lower key is passed and popped when the
    keys leave its prefix."""
    out = [-1] * len(keys)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    queue = sorted(range(len(rules)), key=lambda r: (rules[r][0], len(rules[r][1]), rules[r][3] == "block"))
    stack: list[int] = []
    at = 0
    for i in order:
        key = keys[i]
        while at < len(queue) and rules[queue[at]][0] <= key:
            while stack and not rules[queue[at]][0].startswith(rules[stack[-1]][0]):
                stack.pop()
            stack.append(queue[at])
            at += 1
        while stack and not key.startswith(rules[stack[-1]][0]):
            stack.pop()
        for r in reversed(stack):  # innermost host, then longest path, then block
            if paths[i].startswith(rules[r][1]):
                out[i] = r
                break
    return out


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", row: str = "page_id",
          default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` has host, path and verdict.  Longest means the innermost host and
    then the longest path; of equal rules ``block`` wins.  A url that no rule
    fits gets ``default``.  A null url, or one without ``://``, has an empty
    host and path, which only a rule with empty host and path would fit.  Rows
    may repeat and ids may be null; every row is kept.  Other columns of
    ``pages`` are not carried.  Rules with a null host or path are ignored.

    One host, or one url, may hold any share of the rows: ranges are cut over
    key and path, and rows equal in both are dealt to all ranges they span."""
    spark = pages.sparkSession
    host, path = parts(url)
    rows = pages.select(F.col(row).cast("string").alias("_row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_key", F.concat(host_key(F.col("host")), F.lit("/"), F.col("path")))
    ranges = min(partitions(spark), MOST_RANGES)
    bounds = _bounds(rows.select("_key"), ranges)
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def dealt(key: pd.Series, spread: pd.Series) -> pd.Series:
        cut = shared.value
        low = np.array([bisect_left(cut, k) for k in key], np.int64)
        high = np.array([bisect_right(cut, k) for k in key], np.int64)
        return pd.Series((low + spread.to_numpy() % (high - low + 1)).astype(np.int32))

    @F.pandas_udf("array<int>")
    def reached(low: pd.Series) -> pd.Series:
        cut = shared.value
        return pd.Series([list(range(bisect_left(cut, k), bisect_right(cut, k[:-1] + "/") + 1)) for k in low])

    spread = F.pmod(F.xxhash64("_row"), F.lit(1 << 30)).cast("int")
    rows = rows.withColumn("_range", dealt("_key", spread))
    stops = (rules.select("host", F.col("path").alias("_path"), "verdict").dropna(subset=["host", "_path"]).dropDuplicates()
             .select(host_key(F.col("host")).alias("_low"), "_path", F.concat("host", "_path").alias("_name"), "verdict")
             .withColumn("_range", F.explode(reached("_low"))))
    made = "_row string, host string, path string, rule string, verdict string"

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = list(right[["_low", "_path", "_name", "verdict"]].itertuples(index=False, name=None))
        got = sweep(left["_key"].tolist(), left["path"].tolist(), held)
        return pd.DataFrame({"_row": left["_row"].tolist(), "host": left["host"].tolist(), "path": left["path"].tolist(),
                             "rule": [held[g][2] if g >= 0 else None for g in got],
                             "verdict": [held[g][3] if g >= 0 else default for g in got]}, dtype=object)

    out = rows.groupBy("_range").cogroup(stops.groupBy("_range")).applyInPandas(one, made)
    return out.select(F.col("_row").cast(pages.schema[row].dataType).alias(row), "host", "path", "rule", "verdict")
