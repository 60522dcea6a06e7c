"""Merkle manifest against a plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.catalogue import without_line_breaks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def grow(nodes):
    """Top, and for each node its siblings as (left, right) pairs."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for w, p in zip(ways, at):
            run = level[p - p % 3:p - p % 3 + 3]
            w.append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], ways


def brute(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((first(r[0]), leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grow([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in names]
    root, over = grow([t[0] for t in trees])
    out = []
    for s, (top, ways), upper in zip(names, trees, over):
        for (_, digest, r), way in zip(sorted(by[s], key=lambda x: x[:2]), ways):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[1].replace("\n", "")) if even and r[1] is not None else digest
            for left, right in way + upper:
                node = H(left, node, right)
            out.append((r[0], digest, top, root, H(*[x for pair in way + upper for x in pair]), node, node == root))
    return out


def got(frame, levels):
    out = manifest.digest(manifest.manifest(frame, tampered=without_line_breaks("doc_id", "text"), levels=levels))
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def mine(sizes, seed=1):
    rng = random.Random(seed)
    rows, ids = [], iter(rng.sample(range(10 ** 12), sum(sizes.values())))
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "ß\nx", "one\ntwo\n", "no break"]) if rng.random() < 0.5 else f"text {rng.random()}\n"
            rows.append((next(ids), text, rng.choice([None, "en"]), source, rng.choice([None, 3])))
    return rows


@pytest.mark.parametrize("levels", [2, 5])
def test_manifest_equals_a_plain_recursion(spark, levels):
    rows = mine({None: 1, "": 2, "a": 3, "ä": 4, "b": 9, "hot": 260, "z": 10, "Z": 28})
    rows += [(None, "no id", None, "a", 1), (None, "no id", None, "a", 1), (None, "another", None, "a", 1)]
    rows += [(7, "same id", "en", "hot", 1), (7, "same id, other text\n", "en", "hot", 1), rows[20], rows[20]]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(got(frame, levels), key=str) == sorted(brute(rows), key=str)


def test_manifest_with_few_rows(spark, empty):
    assert got(empty, 5) == []
    one = [(5, "a\nb", None, None, None)]
    assert got(spark.createDataFrame(one, SCHEMA), 5) == brute(one)
    even = brute(one)[0]
    assert even[1] == even[2] == even[3]  # a lone leaf is subroot and root
    two = [(1, "a", None, None, None), (2, "b\n", "x", "s", 9)]
    assert sorted(got(spark.createDataFrame(two, SCHEMA), 5)) == sorted(brute(two))


def test_identical_rows_are_spread_and_other_columns_ignored(spark, monkeypatch):
    rows = [(9, "copy\n", "en", "s", 4)] * 2000 + mine({"s": 50})
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("clash")).withColumn("leaf", F.lit(1)).withColumn("_n", F.lit(1))
    assert sorted(got(frame.repartition(6), 5), key=str) == sorted(brute(rows), key=str)
    held, store = [], manifest.stored
    monkeypatch.setattr(manifest, "stored", lambda df, name: held.append(store(df, name)) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one task
    placed = manifest.ordered(frame.select("source", "doc_id").repartition(8), "source", ["doc_id"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r._pos for r in placed.collect()) == list(range(len(rows)))
    tasks = [r["count"] for r in held[0].groupBy(F.shiftright("_id", 33)).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 0.7 * len(rows)


def test_only_every_few_levels_are_kept(spark):
    nodes = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("pos"), F.lit(1000).cast("long").alias("n"),
                                     F.struct(F.sha2(F.col("id").cast("string"), 256).alias("digest")).alias("node"))
    forest = manifest.Forest(nodes, 2, "test")
    assert [sum(len(r.nodes) for r in kept.collect()) for kept in forest.kept] == [1000, 112, 13, 2]
    assert max(len(r.nodes) for kept in forest.kept for r in kept.collect()) == 9
    assert forest.tops.first().digest == grow([H(str(i)) for i in range(1000)])[0]
