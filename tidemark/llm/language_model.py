"""Scores of a recurrent language model for whole documents.

Word counts of all training texts are grouped in Spark.  The most frequent
words, of a bounded number, are the model's output words; every other word is
one of a fixed number of groups by its last letters, and has a smoothed share of
its group's counts.  The recurrent net is trained in parallel on all training
texts, whole: their tokens decide the number of shards, every shard is trained
from the same weights on one portion of its texts after another, and after each
portion the results are averaged in lots before they reach the driver.  All texts are then scored in full.

Counts of the most frequent words are broadcast, again of a bounded number; the
few other words of each text are joined with the counts by hash."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm import words as W
from tidemark.llm.store import regroup, slices, small_batches, stored

#: Output words, groups of the others, words whose counts are broadcast.
WORDS, GROUPS, KNOWN = 2000, 128, 1 << 18
#: Training tokens of a shard (about so many), rounds over all of them, and the
#: portions of a round after each of which the shards' weights are averaged.
SHARD_TOKENS, ROUNDS, PORTIONS = 1 << 23, 1, 4
#: Parallel streams at most and least, steps of a window, and updates below which there are fewer streams.
STREAMS, FEWEST, STEPS, UPDATES = 512, 16, 16, 128
#: Step sizes at the start and at the end of training.
RATE, LAST_RATE = 0.04, 0.004
#: Texts scored together hold about so many bytes.
TOGETHER = 12 << 20
END = W.mix(np.array([0x656E64], W.U))[0]


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash and group of every token, each text closed by its end; tokens per text."""
    s, e, first = W.spans(data, offsets)
    h = W.hashes(data, s, e)
    last = W.LOWER[data[e - 1]].astype(np.int64)
    before = np.where(e - s > 1, W.LOWER[data[np.maximum(e - 2, 0)]], 0).astype(np.int64)
    group = ((last * 256 + before) * 40503 >> 4) % GROUPS
    ends = first[1:]
    return np.insert(h, ends, END), np.insert(group, ends, 0), np.diff(first) + 1


@dataclass
class Lexicon:
    """What scoring needs of the counts."""

    total: int  # training tokens
    kinds: int  # distinct ones
    hashes: np.ndarray  # of the known words, sorted
    counts: np.ndarray
    output: np.ndarray  # output word of each, or -1
    group_total: np.ndarray  # tokens and kinds of the other words, by group
    group_kinds: np.ndarray
    starts: np.ndarray  # classes of output words and groups
    place: np.ndarray  # their place in class order
    weights: np.ndarray  # their counts in class order

    @cached_property
    def begins(self) -> tuple[int, np.ndarray]:
        """Hashes go by their first bits, so many are left, and the place of the first hash of each."""
        bits = len(self.hashes).bit_length() + 2
        left = 64 - bits
        return left, np.searchsorted(self.hashes >> W.U(left), np.arange((1 << bits) + 1, dtype=W.U)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each known word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        left, begins = self.begins
        bits = (h >> W.U(left)).astype(np.int64)
        at, end = begins[bits], begins[bits + 1]
        out = np.where(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h, at, np.int32(-1))
        # Only those that share their first bits with others need a further look.
        more = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(more):
            at[more] += 1
            hit = self.hashes[at[more]] == h[more]
            out[more[hit]] = at[more[hit]]
            more = more[~hit & (at[more] + 1 < end[more])]
        return out

    def outputs(self, known: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Place in the net of each token."""
        own = np.where(known >= 0, self.output[known] if len(self.output) else -1, -1)
        return self.place[np.where(own >= 0, own, WORDS + group)]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(h, g, c) of every token of ``docs``, map-side combined by batch."""
    def run(batches):
        for batch in batches:
            parts = []
            for _, _, data, offsets in slices(batch.column(0)):
                h, g, _ = tokens(data, offsets)
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                parts.append((u, g[at], c))
            if not parts:
                continue
            h, g, c = (np.concatenate(x) for x in zip(*parts))
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            sums = np.bincount(back, weights=c).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(g[at].astype(np.int32)), pa.array(sums)], ["h", "g", "c"])

    return docs.select(text).mapInArrow(run, "h long, g int, c long").groupBy("h", "g").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals, and the counts of the most frequent words."""
    top = counts.orderBy(F.desc("c"), "h").limit(KNOWN).toArrow()
    h, g, c = (top.column(n).to_numpy() for n in ("h", "g", "c"))
    h = h.view(W.U) if len(h) else np.zeros(0, W.U)
    order = np.lexsort((h, -c))
    h, g, c = h[order], g[order].astype(np.int64), c[order].astype(np.int64)
    groups = counts.groupBy("g").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k")).collect()
    t, k = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for row in groups:
        t[row["g"]], k[row["g"]] = row["t"], row["k"]
    total, kinds = int(t.sum()), int(k.sum())
    n = min(WORDS, len(h))
    np.subtract.at(t, g[:n], c[:n])
    np.subtract.at(k, g[:n], 1)
    weight = np.zeros(WORDS + GROUPS)
    weight[:n], weight[WORDS:] = c[:n], t
    by_class, starts = gru.classes(weight)
    place = np.empty(len(weight), np.int64)
    place[by_class] = np.arange(len(weight))
    output = np.where(np.arange(len(h)) < n, np.arange(len(h)), -1)
    by_hash = np.argsort(h)
    return Lexicon(total, kinds, h[by_hash], c[by_hash], output[by_hash], t, k, starts, place, weight[by_class])


def fit(docs: DataFrame, text: str, lex: Lexicon, *, row: str | None = None, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> gru.Net:
    """Train the net on all of ``docs``, every text to its end in every round.

    Shards and their portions are dealt by the hash of id and text, so that
    copies are spread."""
    net = gru.new(lex.weights, lex.starts)
    spark = docs.sparkSession
    shards = max(1, round(lex.total / shard_tokens))
    lots = max(1, math.isqrt(shards))
    words = spark.sparkContext.broadcast(lex)

    def encode(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                h, g, n = tokens(data, offsets)
                ids = words.value.outputs(words.value.find(h), g).astype("<i4")
                cut = np.concatenate(([0], np.cumsum(n)))
                texts = pa.array([ids[cut[d]:cut[d + 1]].tobytes() for d in range(j - i)], pa.binary())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["shard", "portion", "ids"])

    key = F.xxhash64(*[c for c in (row, text) if c])
    shard, portion = F.pmod(key, F.lit(shards)).cast("int"), F.pmod(F.shiftright(key, 40), F.lit(PORTIONS)).cast("int")
    held = stored(docs.filter(F.col(text).isNotNull()).select(shard.alias("shard"), portion.alias("portion"), text)
                  .mapInArrow(encode, "shard int, portion int, ids binary"), "sample")
    turns = rounds * PORTIONS
    for turn in range(turns):
        now = spark.sparkContext.broadcast(net)
        at = turn % PORTIONS
        rates = [RATE + (LAST_RATE - RATE) * x / turns for x in (turn, turn + 1)]
        parts = held.filter(F.col("portion") <= at).repartition(shards, "shard").groupBy("shard").applyInArrow(_shard(now, at, *rates), "shard int, n long, w binary")
        name = "weights" if at == PORTIONS - 1 else "portion-weights"
        sums = stored(parts.groupBy((F.col("shard") % lots).alias("lot")).applyInArrow(_sum, "lot int, n long, w binary"), name).orderBy("lot").collect()
        total = sum(s["n"] for s in sums)
        if total:
            flat, at, p = sum(np.frombuffer(s["w"], "<f8") for s in sums) / total, 0, {}
            for key in sorted(net.p):
                p[key] = flat[at:at + net.p[key].size].reshape(net.p[key].shape).astype(np.float32)
                at += net.p[key].size
            net = gru.Net(net.starts, p)
        now.unpersist()
    return net


def _shard(now, portion: int, rate: float, last_rate: float):
    """Training on one portion of a shard, from the broadcast net; the weights
    count for the tokens the shard has seen in this round."""
    def run(key, group):
        seen = group.column("ids").combine_chunks()
        texts = sorted(x.as_py() for x in group.filter(pc.equal(group.column("portion"), portion)).column("ids"))
        got = now.value
        if texts:
            sizes = np.array([len(x) // 4 for x in texts])
            begins = np.zeros(sizes.sum(), bool)
            begins[np.cumsum(sizes) - sizes] = True
            streams = min(STREAMS, max(FEWEST, len(begins) // (STEPS * UPDATES)))
            got, _ = gru.train(got, np.frombuffer(b"".join(texts), "<i4").astype(np.int64), begins, rate=rate, last_rate=last_rate, streams=streams, steps=STEPS)
        flat = np.concatenate([got.p[k].ravel() for k in sorted(got.p)]).astype("<f4").tobytes()
        n = (pc.sum(pc.binary_length(seen)).as_py() or 0) // 4
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": [n], "w": pa.array([flat], pa.binary())})

    return run


def _sum(key, group):
    """Weights of a lot of shards summed by the tokens they saw, in order of shard."""
    order = np.argsort(group.column("shard").to_numpy())
    n, w = group.column("n").to_pylist(), group.column("w")
    total = sum(np.frombuffer(w[i].as_py(), "<f4") * np.float64(n[i]) for i in order)
    return pa.table({"lot": pa.array([key[0].as_py()], pa.int32()), "n": [sum(n)], "w": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def score(docs: DataFrame, lex: Lexicon, net: gru.Net, counts: DataFrame, *, text: str = "text", row: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, n_known, base_score and
    score (log10 probabilities under unigram counts and under the net).

    A null or empty text is its end alone.  Rows may repeat and ids may be null.
    Without training texts every word is unknown.  Other columns are not carried."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lex, net))
    kind = docs.schema[row].dataType.simpleString()
    rare_type = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int32()), ("n", pa.int32())]))

    def run(batches):
        lexis, model = shared.value
        key = TaskContext.get().partitionId() << 33
        log_counts = np.log10(lexis.counts + 0.5)
        for batch in regroup(batches, 1, TOGETHER):
            for i, j, data, offsets in slices(batch.column(1), TOGETHER):
                h, g, place, log_base, n = [], [], [], [], []
                known_by, out_by, at_by = [], [], []
                for a, b, part, cuts in slices(batch.column(1).slice(i, j - i)):
                    ph, pg, pn = tokens(part, cuts)
                    at = lexis.find(ph)
                    place.append(lexis.outputs(at, pg).astype(np.int64))
                    first = np.cumsum(pn) - pn
                    log_base.append(np.add.reduceat(np.where(at >= 0, log_counts[at] if len(log_counts) else 0.0, 0.0), first))
                    known_by.append(np.add.reduceat((at >= 0).astype(np.int64), first))
                    out_by.append((at >= 0) & (lexis.output[at] >= 0) if len(lexis.output) else np.zeros(len(at), bool))
                    h.append(ph), g.append(pg), n.append(pn), at_by.append(at)
                h, g, place, n, out, at = map(np.concatenate, (h, g, place, n, out_by, at_by))
                log_base, known_n = np.concatenate(log_base), np.concatenate(known_by)
                ll = gru.score(model, place, n) / np.log(10)
                owner = np.repeat(np.arange(j - i), n)
                # Known words outside the net's own: their share of the group.
                mid = (at >= 0) & ~out
                ll += np.bincount(owner[mid], weights=log_counts[at[mid]] if mid.any() else None, minlength=j - i)
                norm = np.log10(lexis.group_total + 0.5 * (lexis.group_kinds + 1))
                ll -= np.bincount(owner[~out], weights=norm[g[~out]], minlength=j - i)
                # Words whose counts are not here go on to the join.
                far = np.flatnonzero(at < 0)
                o = np.lexsort((h[far], owner[far]))
                far = far[o]
                new = np.flatnonzero(np.concatenate(([True], (h[far][1:] != h[far][:-1]) | (owner[far][1:] != owner[far][:-1])))) if len(far) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(far)))
                lists = pa.ListArray.from_arrays(np.searchsorted(owner[far][new], np.arange(j - i + 1)).astype(np.int32), pa.StructArray.from_arrays(
                    [pa.array(h[far][new].view(np.int64)), pa.array(g[far][new].astype(np.int32)), pa.array(times.astype(np.int32))], ["h", "g", "n"]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(key + np.arange(j - i)), pa.array(n), pa.array(known_n), pa.array(log_base), pa.array(ll), lists.cast(rare_type)],
                    ["row", "key", "n_tokens", "n_known", "log_base", "log_model", "rare"])
                key += j - i

    made = f"row {kind}, key long, n_tokens long, n_known long, log_base double, log_model double, rare array<struct<h:bigint,g:int,n:int>>"
    held = stored(docs.select(row, text).mapInArrow(run, made), "scored")
    rare = held.select("key", F.explode("rare").alias("r")).select("key", F.col("r.h").alias("h"), F.col("r.n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    found = (rare.join(counts.select("h", "c"), "h", "left").groupBy("key")
             .agg(F.sum(F.log10(c + 0.5) * F.col("n")).alias("log_rare"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more")))
    every = float(np.log10(lex.total + 0.5 * (lex.kinds + 1)))
    zero = F.lit(0.0)
    out = held.drop("rare").join(found, "key", "left")
    return out.select(
        F.col("row").alias(row), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("log_base") + F.coalesce("log_rare", zero) - F.col("n_tokens") * every).alias("base_score"),
        (F.col("log_model") + F.coalesce("log_rare", zero)).alias("score"))


def train_and_score(docs: DataFrame, train: DataFrame, *, text: str = "text", row: str = "doc_id") -> DataFrame:
    """Learn from ``train`` and score ``docs``."""
    small_batches(docs.sparkSession)
    counts = stored(count_words(train, text), "counts")
    lex = lexicon(counts)
    return score(docs, lex, fit(train, text, lex, row=row), counts, text=text, row=row)
