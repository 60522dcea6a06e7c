"""Jaccard join of shingle sets by PartEnum signatures.

Sizes fall into bands such that linked sets lie in one band or in neighbours.
For each pair of neighbouring bands a link allows at most ``k`` differing
elements, so if the element domain is cut into ``k + 1 + e`` partitions by hash,
linked sets agree on ``e + 1`` partitions at least; each subset of a partition
is a signature.  A set with at most ``e`` empty partitions needs none of those,
because it must also agree on a partition that holds something.  (This is the
enumeration with first-level subsets of one partition; ``e`` makes up for the
second level.)

Texts with one signature are first compared with the one of them that has most
signatures, which joins families of copies in linear work.  Signatures whose
texts are then still in different components are what is left: texts that share
fewer of them than a link needs are dropped, and of the others those pairs of
different components are compared that share one of their rarest elements, as
any link must.  Comparisons are exact, on whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.store import dealt, partitions, slices, small_batches, stored

SHINGLE = 5
#: Similarity as a fraction, exact in whole numbers.
NEAR = (4, 5)
FLUSH = 700_000


def bands(most: int, near: tuple[int, int] = NEAR) -> np.ndarray:
    """First size of each band, up to one beyond ``most``."""
    p, q = near
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * q // p + 1))
    for _ in range(2):
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * q // p + 1))
    return np.array(lows, np.int64)


def cuts(lows: np.ndarray, near: tuple[int, int] = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of bands (j, j + 1): number of partitions, and spare ones."""
    p, q = near
    a, b = lows[1:-1] - 1, lows[2:] - 1
    k = (a + b) * (q - p) // (q + p)  # |A| + |B| - 2 |A and B| at the least similarity
    spare = (k + 1) * 3 // 20 + 1
    return k + 1 + spare, spare


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE):
    """Distinct shingles of each text, sorted, end to end, and their numbers."""
    s, e, first = W.spans(data, offsets)
    h = W.hashes(data, s, e)
    g = W.grams(h, n)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for d in range(len(offsets) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= n:
            u = np.unique(g[a:b - n + 1])
        elif b > a:
            u = W.grams(h[a:b], b - a)
        else:
            continue
        out.append(u)
        sizes[d] = len(u)
    return np.concatenate(out) if out else np.zeros(0, W.U), sizes


def signatures(elements: np.ndarray, sizes: np.ndarray, near: tuple[int, int] = NEAR):
    """Signature values, the set each belongs to, and how many a link of that
    set needs to share."""
    lows = bands(int(sizes.max(initial=1)), near)
    parts, spare = cuts(lows, near)
    band = np.searchsorted(lows, sizes, "right") - 1
    low, high = elements & W.U(0xFFFFFFFF), elements >> W.U(32)
    mixed = W.mix(elements ^ W.U(0x5851F42D4C957F2D))
    m_low, m_high = (mixed & W.U(0xFFFFFFFF)).astype(np.float64), (mixed >> W.U(32)).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = W.mix(low ^ (high << W.U(7))) >> W.U(32)
    values, sets, needs = [], [], np.full(len(sizes), 255, np.int64)
    for shift in (0, 1):  # as the smaller band of a pair and as the larger
        joint = band - shift
        n = np.where((sizes > 0) & (joint >= 0), parts[np.maximum(joint, 0)], 0)
        base = np.cumsum(n) - n
        own = n[owner] > 0
        o = owner[own]
        key = base[o] + ((place[own] * n[o].astype(W.U)) >> W.U(32)).astype(np.int64)
        total = int(n.sum())
        count = np.bincount(key, minlength=total)
        add = lambda v: np.bincount(key, weights=v[own], minlength=total).astype(W.U)  # noqa: B023, E731
        at = np.repeat(np.arange(len(sizes)), n)
        number = np.arange(total) - base[at]
        value = add(m_low) + (add(m_high) << W.U(32)) + count.astype(W.U) * W.U(0x2545F4914F6CDD1D)
        value = W.mix(W.mix(value) ^ ((joint[at].astype(W.U) << W.U(32)) + number.astype(W.U)))
        empty = np.bincount(at[count == 0], minlength=len(sizes))
        e = spare[np.maximum(joint, 0)]
        keep = (count > 0) | (empty > e)[at]
        values.append(value[keep])
        sets.append(at[keep])
        needs = np.where(n > 0, np.minimum(needs, np.maximum(1, e + 1 - empty)), needs)
    return np.concatenate(values), np.concatenate(sets), needs


def set_table(docs: DataFrame, text: str, row: str, n: int = SHINGLE) -> DataFrame:
    """(row, size, hash of the set in two halves) of every text."""
    kind = docs.schema[row].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                elements, sizes = shingle_sets(data, offsets, n)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                halves = []
                for seed in (0x9E6C63D0876A9A47, 0xD1B54A32D192ED03):
                    sums = np.concatenate((np.zeros(1, W.U), np.cumsum(W.mix(elements ^ W.U(seed)))))
                    halves.append((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), *map(pa.array, halves)], ["row", "size", "h1", "h2"])

    return docs.select(row, text).mapInArrow(run, f"row {kind}, size long, h1 long, h2 long")


def shared_signatures(docs: DataFrame, text: str, row: str, n: int, near: tuple[int, int]) -> DataFrame:
    """(sig, center, row, need) for signatures of more than one of ``docs``, the
    center being the smallest of them.  Signatures travel as arrays."""
    buckets = partitions(docs.sparkSession)
    wide = np.dtype("<i8")

    def sign(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            v, r, k = (np.concatenate(x) for x in zip(*held))
            bucket = ((v >> W.U(20)) % W.U(buckets)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            v, r, k, bucket = v[order], r[order], k[order], bucket[order]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(starts[1:], len(v))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32))] + [
                pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (v, r, k)], ["bucket", "v", "r", "k"])

        for batch in batches:
            ids = batch.column(0).to_numpy().astype(wide)
            for i, j, data, offsets in slices(batch.column(1)):
                elements, sizes = shingle_sets(data, offsets, n)
                v, s, needs = signatures(elements, sizes, near)
                held.append((v, ids[i:j][s], np.minimum(needs, 255).astype(np.uint8)[s]))
                size += len(v)
                if size >= FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        if size:
            yield from flush()

    def meet(batches):
        parts = [[], [], []]
        for batch in batches:
            for c, (column, kind) in enumerate(zip(("v", "r", "k"), (W.U, wide, np.uint8))):
                parts[c] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(column)]
        if not parts[0]:
            return
        v, r, k = (np.concatenate(p) for p in parts)
        order = np.argsort(v)
        order = order[_twins(v[order])]
        v, r, k = v[order], r[order], k[order]
        order = np.lexsort((r, v))
        v, r, k = v[order], r[order], k[order]
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(v)))
        center = np.repeat(r[starts], lengths)
        last = np.repeat(r[starts + lengths - 1], lengths)
        own = np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1]))) if len(v) else np.zeros(0, bool)
        keep = np.flatnonzero((center != last) & own)
        for i in range(0, len(keep), 100_000):
            at = keep[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(center[at]), pa.array(r[at]), pa.array(k[at].astype(np.int32))],
                                             ["sig", "center", "row", "need"])

    signed = docs.select(F.col(row).cast("long"), text).mapInArrow(sign, "bucket int, v binary, r binary, k binary")
    return dealt(signed, "bucket").mapInArrow(meet, "sig long, center long, row long, need int")


def _twins(v: np.ndarray) -> np.ndarray:
    """Places of sorted values that occur more than once."""
    same = v[1:] == v[:-1]
    return np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))


def sets_of(docs: DataFrame, rows: DataFrame, text: str, row: str, n: int) -> DataFrame:
    """(row, elements, two sorted bytes of each) of the texts named by ``rows``."""
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                elements, sizes = shingle_sets(data, offsets, n)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                each = [elements[cut[d]:cut[d + 1]] for d in range(j - i)]
                thin = [np.sort((e & W.U(0xFFFF)).astype(np.uint16)).tobytes() for e in each]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([e.tobytes() for e in each], pa.binary()), pa.array(thin, pa.binary())],
                                                 ["row", "elements", "thin"])

    chosen = docs.select(F.col(row).cast("long").alias("row"), text).join(rows, "row", "left_semi")
    # Repeated rows of one id: the set that is smallest by its bytes stands for it.
    out = chosen.mapInArrow(run, "row long, elements binary, thin binary")
    if docs.groupBy(row).count().filter("count > 1").isEmpty():
        return out
    return out.groupBy("row").agg(F.min(F.struct("elements", "thin")).alias("s")).select("row", "s.*")


def _similar(p: int, q: int, kind):
    """Pairs whose sorted arrays have enough values of the smaller in the larger."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) * q < len(large) * p:
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(both * q >= (len(x) + len(y) - both) * p)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def linked(pairs: DataFrame, sets: DataFrame, near: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    p, q = near
    run, bound = _similar(p, q, W.U), _similar(p, q, np.uint16)
    # Most pairs fall to an upper bound by two bytes of each element, a quarter of the data.
    return _both(_both(pairs, sets, "thin").mapInArrow(bound, "a long, b long"), sets, "elements").mapInArrow(run, "a long, b long")


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    side = lambda name, as_: sets.select(F.col("row").alias(name), F.col(column).alias(as_))
    return pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")


def _hubs(shared: DataFrame) -> DataFrame:
    """Each text of a signature with the one of them that has most signatures:
    in a family of edited copies that is the text nearest to all others."""
    degree = shared.groupBy("row").agg(F.count(F.lit(1)).alias("degree"))
    rows = shared.select("sig", "row").join(degree, "row")
    hub = rows.groupBy("sig").agg(F.max(F.struct("degree", (-F.col("row")).alias("row"))).alias("hub")).select("sig", (-F.col("hub.row")).alias("hub"))
    pairs = rows.join(hub, "sig").filter("hub <> row").groupBy("row", "hub").agg(F.lit(1))
    return pairs.select(F.least("hub", "row").alias("a"), F.greatest("hub", "row").alias("b")).distinct()


def _left_over(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Memberships of signatures that still join different components, without
    texts that share too few of them to be linked across."""
    now = shared.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row")).select("sig", "row", "need", "label")
    for _ in range(2):
        mixed = now.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("sig")
        now = now.join(mixed, "sig", "left_semi")
        enough = now.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least")).filter("n >= least").select("row")
        now = now.join(enough, "row", "left_semi")
    return now


def _rare_pairs(rest: DataFrame, sets: DataFrame, near: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of rows of different labels that share one of their rarest
    elements.  Linked sets share most elements, so whatever the order of all
    elements, they share one among the first few of each; rarest first, a
    passage that very many texts share is never among them."""
    p, q = near
    rows = rest.select("row", "label").distinct().join(sets, "row")

    def spread(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                each = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("elements")]
                n = np.array([len(e) for e in each])
                at = pa.array(np.repeat(np.arange(len(each)), n))
                yield pa.RecordBatch.from_arrays([part.column("row").take(at), part.column("label").take(at), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.concatenate(each))],
                                                 ["row", "label", "size", "element"])

    tokens = stored(rows.select("row", "label", "elements").mapInArrow(spread, "row long, label long, size int, element long"), "elements")
    often = tokens.groupBy("element").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("often", "element"))
    first = tokens.join(often.filter("often > 1"), "element", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("place", place)
    # The others of a row come later than all that a link may lack.
    first = stored(first.filter((F.col("often") > 1) & (F.col("place") <= F.col("size") - F.ceil(F.col("size") * p / q) + 1)).select("element", "row", "label", "size", "place"), "rarest")
    other = first.select("element", F.col("row").alias("b"), F.col("label").alias("label_b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    fits = (F.col("label") < F.col("label_b")) & (F.col("size") * q >= F.col("size_b") * p) & (F.col("size_b") * q >= F.col("size") * p)
    # From the first element that two sets share only what follows it can be shared.
    most = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) + 1
    fits &= most * (p + q) >= (F.col("size") + F.col("size_b")) * p
    return first.join(other, "element").filter(fits).select(F.col("row").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", row: str = "doc_id", shingle: int = SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id (the smallest
    id reachable by links, its own included).

    A text of fewer than ``shingle`` words is one shingle; a null, empty or
    wordless text has none and is a component of its own.  Equal texts under
    different ids are linked.  A row with a null id takes the component of
    texts with its set, or null.  Rows that repeat an id are linked with each
    other's partners.  Other columns are not carried."""
    small_batches(docs.sparkSession)
    kind = docs.schema[row].dataType
    sets = stored(set_table(docs, text, row, shingle).withColumn("row", F.col("row").cast("long")), "sets")
    first = sets.filter("size > 0 and row is not null").groupBy("h1", "h2", "size").agg(F.min("row").alias("first"))
    # Equal sets count as one: their smallest id.
    named = docs.select(F.col(row).cast("long").alias("row"), text)
    named = named.join(first.select(F.col("first").alias("row")), "row", "left_semi")
    shared = stored(shared_signatures(named, text, "row", shingle, near), "signatures")
    elements = stored(sets_of(docs, shared.select("row").distinct(), text, row, shingle), "elements")
    pairs = _hubs(shared)
    links = stored(linked(pairs, elements, near), "near")
    labels = components(links)
    rest = stored(_left_over(shared.select("sig", "row", "need"), labels), "rest")
    more = linked(_rare_pairs(rest, elements, near), elements, near)
    labels = components(links.unionByName(more))
    of_set = first.join(labels.withColumnRenamed("node", "first"), "first", "left").withColumn("label", F.coalesce("label", "first"))
    out = sets.join(of_set.select("h1", "h2", "size", "label"), ["h1", "h2", "size"], "left")
    own = F.when(F.col("size") > 0, F.col("label")).otherwise(F.col("row"))
    return out.select(F.col("row").cast(kind).alias(row), F.col("size").alias("n_shingles"), own.cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame, *, text: str = "text", row: str = "doc_id", **rules) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all
    their columns; of rows that repeat an id one stays.  Rows with a null id
    stay unless an equal text has one."""
    found = stored(near_duplicates(docs, text=text, row=row, **rules), "components")
    chosen = found.filter(F.col(row) == F.col("component_id")).select(F.col(row).alias("_row"))
    out = docs.join(chosen.hint("shuffle_hash"), docs[row] == chosen["_row"], "left_semi")
    if not chosen.groupBy("_row").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([row])
    if not found.filter(F.col(row).isNull()).isEmpty():
        # Without an id of its own a text is only known by its words; equal ones stay once.
        lone = docs.filter(F.col(row).isNull()).dropDuplicates([text])
        known = docs.filter(F.col(row).isNotNull()).select(F.xxhash64(text).alias("_text"))
        out = out.unionByName(lone.join(known, F.xxhash64(text) == F.col("_text"), "left_anti"))
    return out
