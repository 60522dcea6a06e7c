"""Ranked lexical search of all documents for a set of items, without an index.

The terms of the items go into one Aho-Corasick automaton, each with a blank on
either side, so that only whole terms match.  A text is brought to the same
form, bytes outside terms as blanks, and one pass of the automaton over it
counts the occurrences of every item's terms; what a term adds to a score goes
to all items that hold it.

Two passes over the documents: the first sums documents, terms and document
frequencies, the second scores, each task keeping the best documents of each
item.  Only these few rows per task and item are shuffled.  Items come in blocks
of bounded bytes: the automaton of a block is what is sent to the executors,
and both passes are run for each block."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.store import slices, small_batches, stored
from tidemark.llm.words import ALNUM, LOWER

TOP = 20
#: Bytes of item texts in a block, and scores held at once while a task adds them up.
BLOCK_BYTES, HELD = 2 << 20, 1 << 20
#: Groups in which an item's rows are ranked before all of them are.
SALTS = 256
N_DOCS, N_TERMS = -1, -2

#: ASCII letters in lower case, everything outside terms a blank.
FORM = bytes(np.where(ALNUM, LOWER, 32).astype(np.uint8))


@dataclass
class Book:
    """A block of items: ids, the terms they hold, and for each term its items
    with the number of times it is in each."""

    ids: list
    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def book(rows: list[tuple]) -> Book:
    held: dict[bytes, dict[int, int]] = {}
    for i, (_, text) in enumerate(rows):
        for term in (text or "").encode("utf-8", "surrogatepass").translate(FORM).split(b" "):
            if term:
                at = held.setdefault(term, {})
                at[i] = at.get(i, 0) + 1
    terms = sorted(held)
    sizes = [len(held[t]) for t in terms]
    return Book([r[0] for r in rows], terms, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64),
                np.array([i for t in terms for i in held[t]], np.int64), np.array([n for t in terms for n in held[t].values()], np.int64))


_built: dict[str, ahocorasick.Automaton] = {}


def automaton(b: Book) -> ahocorasick.Automaton:
    """The block's automaton, built once per Python worker.  It reads bytes as
    characters of the same number."""
    if b.token not in _built:
        _built.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(b.terms):
            made.add_word(f" {term.decode('latin-1')} ", i)
        made.make_automaton()
        _built[b.token] = made
    return _built[b.token]


def tally(data: np.ndarray, offsets: np.ndarray, b: Book):
    """Terms of each text, and the occurrences of the block's terms: text, term, number."""
    raw = data.tobytes()
    n = len(offsets) - 1
    line = b" " + b" ".join(raw[offsets[i]:offsets[i + 1]] for i in range(n)).translate(FORM) + b" "
    begins = 1 + offsets[:-1] + np.arange(n)
    blank = np.frombuffer(line, np.uint8) == 32
    words = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    counts = np.diff(np.searchsorted(words, np.append(begins, len(line))))
    none = np.zeros(0, np.int64)
    if not b.terms:
        return counts, none, none, none
    found = np.fromiter(chain.from_iterable(automaton(b).iter(line.decode("latin-1"))), np.int64).reshape(-1, 2)
    doc = np.searchsorted(begins, found[:, 0] - 1, "right") - 1
    pairs, tf = np.unique(doc * len(b.terms) + found[:, 1], return_counts=True)
    return counts, pairs // len(b.terms), pairs % len(b.terms), tf


def statistics(docs: DataFrame, text: str, shared) -> dict[int, int]:
    """Documents with a term, all terms, and the documents that hold each of the
    block's terms."""
    def partial(batches):
        b = shared.value
        df, total, with_terms = np.zeros(len(b.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                counts, _, term, _ = tally(data, offsets, b)
                df += np.bincount(term, minlength=len(df))
                total, with_terms = total + int(counts.sum()), with_terms + int((counts > 0).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [N_DOCS, N_TERMS])), pa.array(np.append(df[at], [with_terms, total]))], ["term", "v"])

    sums = docs.select(text).mapInArrow(partial, "term long, v long").groupBy("term").agg(F.sum("v").alias("v"))
    return dict(map(tuple, sums.collect()))  # no more rows than the block has terms


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def scores(counts: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, b: Book, weights: np.ndarray, n_docs: int, n_terms: int
           ) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of consecutive texts with every item, from the first text's number on."""
    m = 75 + (25 * counts * n_docs) // max(n_terms, 1)
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    times = b.starts[term + 1] - b.starts[term]
    ends = np.cumsum(times)
    width = max(len(b.ids), 1)
    i, step = 0, max(1, HELD // width)
    while i < len(counts):
        j = min(len(counts), i + step)
        lo, hi = np.searchsorted(doc, [i, j])
        sums = np.zeros((j - i) * width, np.int64)
        while lo < hi:  # as many postings at once as memory allows
            before = ends[lo - 1] if lo else 0
            cut = min(hi, max(lo + 1, int(np.searchsorted(ends, before + HELD, "right"))))
            t = times[lo:cut]
            row = np.repeat(b.starts[term[lo:cut]] - (ends[lo:cut] - t - before), t) + np.arange(t.sum())
            np.add.at(sums, np.repeat((doc[lo:cut] - i) * width, t) + b.items[row], np.repeat(part[lo:cut], t) * b.times[row])
            lo = cut
        yield i, sums.reshape(j - i, width)
        i = j


class Best:
    """The best rows of each item so far: highest score, then smallest id, a
    null id before all others."""

    ORDER = [("item", "ascending"), ("score", "descending"), ("id", "ascending")]

    def __init__(self, n_items: int, top: int, id_type: pa.DataType):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("id", id_type)])
        self.rows, self.waiting, self.n_waiting = self.schema.empty_table(), [], 0

    def add(self, scored: np.ndarray, ids: pa.Array) -> None:
        doc, item = np.nonzero(scored >= self.least)
        if len(doc):
            self.waiting.append(pa.Table.from_arrays([pa.array(item), pa.array(scored[doc, item]), ids.take(pa.array(doc))], schema=self.schema))
            self.n_waiting += len(doc)
            if self.n_waiting > max(self.rows.num_rows, 50_000):
                self.settle()

    def settle(self) -> pa.Table:
        if self.waiting:
            order = pa.concat_tables([self.rows, *self.waiting]).combine_chunks()
            # Null ids come first in Spark's order too.
            order = order.take(pc.sort_indices(order, sort_keys=self.ORDER, null_placement="at_start"))
            item = order.column("item").to_numpy()
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            last = rank == self.top - 1
            self.least[item[last]] = order.column("score").to_numpy()[last]
            self.rows, self.waiting, self.n_waiting = order.filter(pa.array(rank < self.top)), [], 0
        return self.rows


def blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``limit`` bytes, one at a time on the driver."""
    rows = items.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).filter(F.col("body").isNotNull()).dropDuplicates()
    size = rows.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0
    n = -(-size // limit)
    for i in range(n):
        mine = rows.filter(F.pmod(F.xxhash64("id", "body"), F.lit(n)) == i)
        yield [tuple(r) for r in mine.collect()]


def search(docs: DataFrame, items: DataFrame, *, row: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of each item with a score above 0: the item's id,
    rank from 1, the document's id, score; equal scores by ascending id.

    A null text has no terms; a document without terms counts for nothing and
    is never found, an item without them finds nothing.  Every row of ``docs``
    is a document, also where ids repeat or are null (null before others).
    Identical items count once; an id with several texts has a ranking for each.
    Empty tables give no rows.  Other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    body, names = docs.select(F.col(f"`{row}`").alias("id"), F.col(f"`{text}`").alias("body")), (item, "rank", row, "score")
    kind, found_kind = items.schema[item].dataType, docs.schema[row].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind), T.StructField("id", found_kind), T.StructField("score", T.LongType())])
    item_type, out = to_arrow_type(kind), None
    for rows in blocks(items, item, item_text, block_bytes):
        b = book(rows)
        shared = spark.sparkContext.broadcast(b)
        sums = statistics(body, "body", shared)
        n_docs, n_terms = sums.get(N_DOCS, 0), sums.get(N_TERMS, 0)
        weights = term_weights(np.array([sums.get(i, 0) for i in range(len(b.terms))], np.int64), n_docs)

        def rank(batches, shared=shared, weights=weights, n_docs=n_docs, n_terms=n_terms):
            b, best, types = shared.value, None, None
            for batch in batches:
                best = best or Best(len(b.ids), top, batch.schema.field(0).type)
                for i, j, data, offsets in slices(batch.column(1)):
                    counts, doc, term, tf = tally(data, offsets, b)
                    for k, scored in scores(counts, doc, term, tf, b, weights, n_docs, n_terms):
                        best.add(scored, batch.column(0).slice(i + k, len(scored)))
            if best is not None:
                held = best.settle()
                which = held.column("item").to_pylist()
                yield from pa.Table.from_arrays([held.column("item"), pa.array([b.ids[i] for i in which], item_type), held.column("id"), held.column("score")],
                                                ["item", "item_id", "id", "score"]).combine_chunks().to_batches()

        found = body.mapInArrow(rank, schema).withColumn("_salt", F.spark_partition_id() % SALTS)
        best = [F.desc("score"), F.asc_nulls_first("id")]
        near = found.withColumn("_n", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*best))).filter(F.col("_n") <= top)
        last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= top)
        done = stored(last.select(F.col("item_id").alias(item), "rank", F.col("id").alias(row), "score"), "search")
        shared.destroy()
        out = done if out is None else out.unionByName(done)
    if out is None:
        fields = zip(names, (kind, T.IntegerType(), found_kind, T.LongType()))
        out = spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in fields]))
    return out.select(*[F.col(f"`{c}`") for c in names])
