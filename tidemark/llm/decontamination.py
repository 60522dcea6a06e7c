"""Benchmark decontamination by a prefix-filtered set join.

Each window of an item is a set of shingles, all of which a text must hold, so
one necessary token is enough to find it: the window's rarest shingle, by its
count over the whole corpus.  Texts are probed with those prefix shingles; a
hit fixes the place where the window would have to begin, which the bounds of
the text must allow (position and length), and the words there are compared
one by one with the window's.

Benchmarks are handled in blocks of bounded size; a block's tables are all that
is broadcast.  Texts are read twice, never shuffled, and each whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.store import slices, small_batches

#: Words in a window, and words in a shingle.
WINDOW, SHINGLE = 13, 4
#: Bytes of item text whose tables are broadcast together.
BLOCK_BYTES = 4 << 20
SIEVE = 1 << 20


@dataclass
class Block:
    """Windows of some items, and their shingles."""

    names: list[str] = field(default_factory=list)  # item of each number
    tokens: list[list[bytes]] = field(default_factory=list)  # words of each window
    owners: list[list[int]] = field(default_factory=list)  # items with that window
    sizes: np.ndarray | None = None  # words in each window
    #: by shingle size: hashes sorted, and for prefixes also window and place
    shingles: dict[int, np.ndarray] = field(default_factory=dict)
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    sieves: dict[int, np.ndarray] = field(default_factory=dict)


def split(text: str) -> list[bytes]:
    """Words of one text, ASCII letters in lower case."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    s, e, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
    low = W.LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(s.tolist(), e.tolist())]


def _shingles(tokens: list[bytes], n: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    s, e, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
    return W.grams(W.hashes(data, s, e), n)


def _sieve(values: np.ndarray) -> np.ndarray:
    out = np.zeros(SIEVE, bool)
    out[(values & W.U(SIEVE - 1)).astype(np.int64)] = True
    return out


def block(items: list[tuple[str, str]], window: int, shingle: int) -> Block:
    """Distinct windows of (name, text) items with all their shingles."""
    out, seen, number = Block(), {}, {}
    for name, text in items:
        ws = split(text)
        if not ws:
            continue
        item = number.setdefault(name, len(number))
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1):
            key = tuple(ws[i:i + n])
            at = seen.setdefault(key, len(seen))
            if at == len(out.tokens):
                out.tokens.append(list(key))
                out.owners.append([])
            if item not in out.owners[at]:
                out.owners[at].append(item)
    out.names = list(number)
    out.sizes = np.array([len(t) for t in out.tokens], np.int64)
    for n in sorted({min(shingle, len(t)) for t in out.tokens}):
        out.shingles[n] = np.unique(np.concatenate([_shingles(t, n) for t in out.tokens if min(shingle, len(t)) == n]))
        out.sieves[n] = _sieve(out.shingles[n])
    return out


def choose(b: Block, counts: dict[int, np.ndarray], shingle: int) -> Block:
    """Order each window's shingles by rarity and keep the rarest as its prefix."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for w, t in enumerate(b.tokens):
        n = min(shingle, len(t))
        h = _shingles(t, n)
        found = counts[n][np.searchsorted(b.shingles[n], h)]
        at = int(np.lexsort((h, found))[0])
        rows.setdefault(n, []).append((int(h[at]), w, at))
    for n, got in rows.items():
        got.sort()
        keys = np.array([g[0] for g in got], W.U)
        b.prefixes[n] = (keys, np.array([g[1] for g in got], np.int64), np.array([g[2] for g in got], np.int64))
        b.sieves[n] = _sieve(keys)
    return b


def _probe(grams: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Places whose shingle is among the sorted ``keys``."""
    at = np.flatnonzero(sieve[(grams & W.U(SIEVE - 1)).astype(np.int64)])
    if not len(at):
        return at
    i = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
    return at[keys[i] == grams[at]]


def _crossing(first: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` words from ``at`` on stay inside one text."""
    return at + n <= first[np.searchsorted(first, at, "right")]


def blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    rows = items.select(F.col(key).cast("string"), F.col(text)).dropna().dropDuplicates()
    for name, body in rows.toLocalIterator():
        if held and size + len(body) > limit:
            yield held
            held, size = [], 0
        held.append((name, body))
        size += len(body)
    if held:
        yield held


def count_shingles(docs: DataFrame, b: Block, text: str) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast((b.shingles, b.sieves))

    def partial(batches):
        shingles, sieves = shared.value
        sums = {n: np.zeros(len(k), np.int64) for n, k in shingles.items()}
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                s, e, first = W.spans(data, offsets, W.ALNUM)
                h = W.hashes(data, s, e)
                for n, keys in shingles.items():
                    g = W.grams(h, n)
                    at = _probe(g, keys, sieves[n])
                    at = at[_crossing(first, at, n)]
                    np.add.at(sums[n], np.searchsorted(keys, g[at]), 1)
        for n, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(v[at])], ["n", "at", "c"])

    rows = docs.select(text).mapInArrow(partial, "n int, at long, c long").groupBy("n", "at").agg(F.sum("c").alias("c")).collect()
    out = {n: np.zeros(len(k), np.int64) for n, k in b.shingles.items()}
    for n, at, c in rows:
        out[n][at] = c
    shared.unpersist()
    return out


def find(data: np.ndarray, offsets: np.ndarray, chosen: list[Block]):
    """For each text: number of words, hit runs of words, items found."""
    s, e, first = W.spans(data, offsets, W.ALNUM)
    h = W.hashes(data, s, e)
    total = len(s)
    cover = np.zeros(total + 1, np.int64)
    items: dict[int, set[str]] = {}
    low = None
    for b in chosen:
        for n, (keys, windows, places) in b.prefixes.items():
            g = W.grams(h, n)
            at = _probe(g, keys, b.sieves[n])
            if not len(at):
                continue
            left, right = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            times = right - left
            at = np.repeat(at, times)
            row = np.repeat(left, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            w = windows[row]
            start, size = at - places[row], b.sizes[w]
            doc = np.searchsorted(first, at, "right") - 1
            fits = (start >= first[doc]) & (start + size <= first[doc + 1])
            low = W.LOWER[data].tobytes() if low is None else low
            for p, k, d in zip(start[fits].tolist(), w[fits].tolist(), doc[fits].tolist()):
                tokens = b.tokens[k]
                m = len(tokens)
                if all(low[x:y] == t for x, y, t in zip(s[p:p + m].tolist(), e[p:p + m].tolist(), tokens)):
                    cover[p] += 1
                    cover[p + m] -= 1
                    items.setdefault(d, set()).update(b.names[o] for o in b.owners[k])
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    if len(offsets) > 2:  # runs end with their text
        inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < total)]
        inner = np.unique(inner)
        both = inner[hit[inner] & hit[inner - 1]]
    else:
        both = np.zeros(0, np.int64)
    begins = np.sort(np.concatenate((np.flatnonzero(edge == 1), both)))
    stops = np.sort(np.concatenate((np.flatnonzero(edge == -1), both)))
    doc = np.searchsorted(first, begins, "right") - 1
    return np.diff(first), (begins - first[doc], stops - first[doc], doc), items


RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_runs (word spans, end exclusive) and found_items.

    A null or wordless text has no words and no hits.  Items that repeat count
    once; items with a null id or text, or without words, have no windows.  Rows
    of ``docs`` may repeat, its ids may be null, and its columns may be called
    anything but the three added names, which replace columns so called."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = []
    for rows in blocks(items, item, item_text, block_bytes):
        b = block(rows, window, shingle)
        if b.tokens:
            chosen.append(spark.sparkContext.broadcast(choose(b, count_shingles(docs, b, text), shingle)))
    carried = [c for c in docs.columns if c.lower() not in ("n_words", "hit_runs", "found_items")]
    body = carried.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in carried]).schema)
    schema += ", n_words long, hit_runs array<struct<start:int,end:int>>, found_items array<string>"

    def mark(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(body)):
                n, (starts, ends, doc), items_of = find(data, offsets, [c.value for c in chosen])
                cuts = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(
                    [pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["start", "end"]))
                found = pa.array([sorted(items_of.get(d, ())) for d in range(j - i)], pa.list_(pa.string()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), runs.cast(RUNS), found],
                                                 [*carried, "n_words", "hit_runs", "found_items"])

    return docs.select(*[f"`{c}`" for c in carried]).mapInArrow(mark, schema)


def digest(marked: DataFrame) -> DataFrame:
    """Hit words, items, their hash and the verdict from the marked texts."""
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]).cast("long"))
    out = marked.withColumn("n_hit", hit).withColumn("n_items", F.size("found_items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("found_items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
