"""Removal of repeated byte strings by suffix arrays over shards.

A string of ``SPAN`` bytes is dealt to a shard by the smallest hash among its
``GRAM``-byte strings, which depends on its content alone, so equal strings
always meet.  Neighbouring strings mostly share that smallest hash and travel
together as one segment.  Segments are first compared by hash, map-side and
then by shard: where whole segments are equal, the one of the smallest document
stands for all, and the others are repeats.  Only segments that share a
smallest hash and yet differ have their bytes fetched, and of these only those
that agree further on one side of the ``GRAM`` bytes: a string reaches at least
half of its other bytes to the left or to the right.  Each shard sorts theirs
into a suffix array (Larsson-Sadakane refinement, as deep as a string is
long), takes common prefixes of neighbours, and finds for every string the smallest document that holds it.

A smallest hash with very many different segments is split over several shards;
their sorted strings are then merged, again by content, with binary searches.
Texts are only read in whole files and shuffled twice; no key gathers more than
a bounded part of one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.store import dealt, partitions, regroup, slices, small_batches, stored

SPAN, GRAM = 50, 16
#: Strings in a segment at most; different segments of one hash in a shard at most.
SEGMENT, SHARE = 512, 4096
#: Shards, each with a suffix array of its own, that one task works through.
SHARDS = 32
#: Bytes of text whose equal segments are combined before they are sent.
TOGETHER = 8 << 20
U = W.U
REPEAT, SOURCE, TEST = 0, 1, 2


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number, zeros beyond the end."""
    n = len(data)
    raw = np.concatenate((data, np.zeros(16, np.uint8))).tobytes()
    out = np.empty(n, U)
    for k in range(min(8, n)):
        part = np.frombuffer(raw, ">u8", (n - k + 7) // 8, k)
        out[k::8] = part
    return out


def sliding(best: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """The minimum or maximum of ``w`` values from each place on."""
    step = 1
    while step * 2 <= w:
        x = best(x[:-step], x[step:])
        step *= 2
    return best(x[:len(x) - (w - step)], x[w - step:]) if w > step else x


def anchors(hashes: np.ndarray, least: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of equal values of ``least``, the minima of ``w`` hashes from
    each place on: the first place of that hash, and how often it occurs."""
    pad = np.zeros(w - 1, U)
    # A hash is the minimum of some w if it is the largest minimum of those it belongs to.
    at = np.flatnonzero(sliding(np.maximum, np.concatenate((pad, least, pad)), w) == hashes)
    runs = np.flatnonzero(np.concatenate(([True], hashes[at[1:]] != hashes[at[:-1]])))
    return at[runs], np.diff(np.append(runs, len(at)))


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """First string, number of strings, smallest hash, content hash and sides of
    the segments of several texts; places count from the start of ``data``.

    The sides are short hashes of the bytes with the smallest hash and half of a
    string's others to the left, and to the right; 0 where no string of the
    segment reaches so far.  Segments with an equal string have an equal side
    other than 0, unless one holds its smallest hash repeatedly: both are 0 then."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    x = eight(data)
    h = x[:n - gram + 1] * U(0x9E3779B97F4A7C15)
    for k in range(8, gram, 8):
        h += x[k:k + len(h)] * U(0xC2B2AE3D27D4EB4F + 2 * k)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    w = span - gram + 1
    each, h = h, sliding(np.minimum, h, w)
    anchor, times = anchors(each, h, w)
    run = np.cumsum(np.concatenate(([False], h[1:] != h[:-1])))
    valid = np.zeros(len(h) + 1, np.int8)  # strings that lie in one text
    a, b = offsets[:-1], offsets[1:] - span + 1
    ok = b > a
    np.add.at(valid, a[ok], 1)
    np.add.at(valid, np.minimum(b[ok], len(h)), -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    first = np.zeros(len(h), bool)
    first[a[ok]] = True
    edge = np.ones(len(h), bool)
    edge[1:] = (h[1:] != h[:-1]) | ~valid[:-1]
    begins = np.flatnonzero((edge | first) & valid)
    stop = np.ones(len(h), bool)
    stop[:-1] = (h[1:] != h[:-1]) | ~valid[1:] | first[1:]
    number = np.flatnonzero(stop & valid) - begins + 1
    long = number > SEGMENT
    if long.any():
        pieces = -(-number // SEGMENT)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins, number = np.repeat(begins, pieces) + k * SEGMENT, np.minimum(np.repeat(number, pieces) - k * SEGMENT, SEGMENT)
    at, back = W.powers(n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(W.CODES[data] * at[:n], out=sums[1:])
    of = lambda a, b: (sums[b] - sums[a]) * back[a]
    half = (span - gram) // 2
    place, once = anchor[run[begins]], times[run[begins]] == 1
    sides = []
    for a, reached in ((place - half, begins <= place - half), (place, begins + number > place - half)):
        a = np.where(once & reached, a, 0)
        sides.append(np.where(once & reached, np.maximum(W.mix(of(a, a + gram + half)) >> U(48), U(1)), U(0)).astype(np.uint16))
    return begins, number, h[begins], W.mix(of(begins, begins + number + span - 1) + number.astype(U)), *sides


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of ``text`` in the order of what follows, or of at least ``depth``
    bytes of it.

    The first eight bytes sort everything; each round doubles the depth and
    sorts only groups that are still tied, by the rank of the place the
    current depth further on."""
    n = len(text)
    keys = eight(text)
    sa = np.argsort(keys)
    new = np.ones(n + 1, bool)
    ordered = keys[sa]
    new[1:n] = ordered[1:] != ordered[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0)) + 1  # 0 lies beyond the end
    h = 8
    while h < (n if depth is None else min(n, depth)):
        tied = np.flatnonzero(~(new[:n] & new[1:]))
        if not len(tied):
            break
        place = sa[tied]
        key = (rank[place] << 32) | rank[np.minimum(place + h, n)]
        order = np.argsort(key)
        place, key = place[order], key[order]
        sa[tied] = place
        split = np.ones(len(tied), bool)
        split[1:] = key[1:] != key[:-1]
        new[tied] = split
        rank[place] = np.maximum.accumulate(np.where(split, tied, 0)) + 1
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, begins: np.ndarray, lengths: np.ndarray, most: int = SPAN) -> np.ndarray:
    """For each place of the stretches that begin at ``begins`` the bytes it shares
    with the one of these places before it in ``sa``, up to ``most``; 0 for the
    first of them and for other places.  Eight bytes are compared at a time, and
    the next eight only where all before are equal."""
    n = len(text)
    order = sa[_inside(n, begins, lengths)[sa]]
    eights = np.concatenate((eight(text), np.zeros(most + 8, U)))
    shared = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k in range(0, most, 8):
        differ = eights[order[open_ - 1] + k] ^ eights[order[open_] + k]
        same = sum((differ < U(1 << 8 * j)).astype(np.int64) for j in range(8))
        shared[open_] += same
        open_ = open_[same == 8]
    shared[1:] = np.minimum(shared[1:], n - np.maximum(order[1:], order[:-1]))  # nothing is beyond the end
    out = np.zeros(n, np.int16)
    out[order] = np.minimum(shared, most)
    return out


def _inside(n: int, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in the stretches."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def shard_repeats(text: np.ndarray, lengths: np.ndarray, number: np.ndarray, doc: np.ndarray, span: int = SPAN):
    """For segments laid end to end: whether a smaller document of this shard
    holds the string at each place (false where no string starts), and whether a
    string starts there."""
    begins = np.cumsum(lengths) - lengths
    inside = _inside(len(text), begins, number)
    sa = suffix_array(text, span)
    shared = common_prefixes(text, sa, begins, number, span)
    sa = sa[inside[sa]]
    owner = np.repeat(doc, lengths)[sa]
    starts = np.flatnonzero(shared[sa] < span)
    least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(sa))))
    repeated = np.zeros(len(text), bool)
    repeated[sa] = least < owner
    return repeated, inside


def merge_sorted(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings of several shards with their smallest documents.
    Each shard's sorted list is searched in what has been merged so far."""
    keys, least = lists[0]
    for more, docs in lists[1:]:
        at = np.searchsorted(keys, more)
        hit = keys[np.minimum(at, len(keys) - 1)] == more
        np.minimum.at(least, at[hit], docs[hit])
        keys, least = np.insert(keys, at[~hit], more[~hit]), np.insert(least, at[~hit], docs[~hit])
    return keys, least


def _runs(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true, also cut at the given places."""
    pad = np.zeros(len(flags) + 1, bool)
    pad[cut] = True
    prev = np.concatenate(([False], flags[:-1]))
    nxt = np.concatenate((flags[1:], [False]))
    return np.flatnonzero(flags & (~prev | pad[:-1])), np.flatnonzero(flags & (~nxt | pad[1:]))


def _blobs(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each bucket with its part of every column as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    cols = [c[order] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32))] + [
        pa.array([c[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for c in cols], ["bucket", *names])


def _joined(batches, kinds: dict[str, object]) -> list[np.ndarray]:
    parts = {k: [] for k in kinds}
    for batch in batches:
        for name, kind in kinds.items():
            parts[name] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(name)]
    return [np.concatenate(p) if p else np.zeros(0, kinds[k]) for k, p in parts.items()]


def _documents(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest and the largest document of its group."""
    order = np.argsort(group)
    new = np.concatenate(([True], np.diff(group[order]) != 0))
    starts, of = np.flatnonzero(new), np.empty(len(group), np.int64)
    of[order] = np.cumsum(new) - 1
    return np.minimum.reduceat(doc[order], starts)[of], np.maximum.reduceat(doc[order], starts)[of]


FOUND = "doc long, start int, number int, h long, s long, salt int, role int"
NAMES = ["doc", "start", "number", "h", "s", "salt", "role"]


def _found(doc, start, number, h, s, salt, role) -> pa.RecordBatch:
    n = len(doc)
    full = lambda v, t: np.full(n, v, t) if np.isscalar(v) else np.asarray(v).astype(t)
    return pa.RecordBatch.from_arrays([pa.array(full(doc, np.int64)), pa.array(full(start, np.int32)), pa.array(full(number, np.int32)),
                                       pa.array(full(h, U).view(np.int64)), pa.array(full(s, U).view(np.int64)), pa.array(full(salt, np.int32)), pa.array(full(role, np.int32))], NAMES)


def _candidates(docs: DataFrame, text: str, row: str) -> DataFrame:
    """Segments that equal one of a smaller document (REPEAT), and those that
    have to be compared byte by byte (SOURCE, and TEST if they may repeat)."""
    buckets = partitions(docs.sparkSession)
    kinds = {"h": U, "s": U, "doc": np.int64, "start": np.int32, "number": np.int32, "left": np.uint16, "right": np.uint16, "known": np.int8}

    def cut(batches):
        for batch in regroup(batches, 1, TOGETHER):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            ids, body = ids[order], batch.column(1).take(pa.array(order))
            cols = [[] for _ in range(7)]
            for i, _, data, offsets in slices(body, 512 << 10):
                at, number, h, s, left, right = segments(data, offsets)
                d = np.searchsorted(offsets, at, "right") - 1
                for c, v in zip(cols, (h, s, ids[i + d], (at - offsets[d]).astype(np.int32), number.astype(np.int32), left, right)):
                    c.append(v)
            h, s, doc, start, number, left, right = (np.concatenate(c) for c in cols)
            if not len(h):
                continue
            # Equal segments met here: later documents repeat the first, so one row says all of them.
            order = np.argsort(s, kind="stable")
            h, s, doc, start, number, left, right = (v[order] for v in (h, s, doc, start, number, left, right))
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])))
            first = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            known = (doc > first).astype(np.int8)
            bucket = np.where(known, W.mix(doc.astype(U)), h >> U(17)) % U(buckets)
            yield _blobs(bucket.astype(np.int64), [h, s, doc, start, number, left, right, known], list(kinds))

    def meet(batches):
        h, s, doc, start, number, left, right, known = _joined(batches, kinds)
        done = known == 1
        yield from repeat_rows(doc[done], start[done], number[done])
        h, s, doc, start, number, left, right = (v[~done] for v in (h, s, doc, start, number, left, right))
        if not len(h):
            return
        order = np.lexsort((doc, s, h))
        h, s, doc, start, number, left, right = (v[order] for v in (h, s, doc, start, number, left, right))
        same_h, same_s, lead = leads(h, s)
        repeat = doc > doc[lead]
        yield from repeat_rows(doc[repeat], start[repeat], number[repeat])
        # Of the others, those whose smallest hash another document has too.
        starts = np.flatnonzero(same_h)
        shared = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc[lead], starts))[np.cumsum(same_h) - 1]
        at = np.flatnonzero(shared & ~repeat)
        if not len(at):
            return
        h, s, doc, start, number, left, right = (v[at] for v in (h, s, doc, start, number, left, right))
        group = np.cumsum(leads(h, s)[0]) - 1
        # Of these, those of which another document has a side too.
        least, most = doc.copy(), doc.copy()
        for side in (left, right):
            k = np.flatnonzero(side)
            if len(k):
                low, high = _documents(group[k] << 16 | side[k], doc[k])
                least[k], most[k] = np.minimum(least[k], low), np.maximum(most[k], high)
        any_side = np.isin(group, group[(left == 0) & (right == 0)])
        if any_side.any():
            least[any_side], most[any_side] = _documents(group[any_side], doc[any_side])
        at = np.flatnonzero(least < most)
        h, s, doc, start, number, least = (v[at] for v in (h, s, doc, start, number, least))
        same_h, same_s, _ = leads(h, s)
        group, starts, number_in = np.cumsum(same_h) - 1, np.flatnonzero(same_h), np.cumsum(same_s) - 1
        kinds_of = np.diff(np.append(number_in[starts], number_in[-1:] + 1))
        salt = np.where((kinds_of > SHARE)[group], (number_in - number_in[starts][group]) // SHARE, -1)
        role = np.where(doc > least, TEST, SOURCE)
        for i in range(0, len(h), 100_000):
            at = slice(i, i + 100_000)
            yield _found(doc[at], start[at], number[at], h[at], s[at], salt[at], role[at])

    def leads(h, s):
        """Where a hash begins, where a segment begins, and the first row of each row's segment; rows are sorted."""
        same_h = np.concatenate(([True], h[1:] != h[:-1]))[:len(h)]
        same_s = same_h | np.concatenate(([True], s[1:] != s[:-1]))[:len(h)]
        return same_h, same_s, np.maximum.accumulate(np.where(same_s, np.arange(len(h)), 0))

    def repeat_rows(doc, start, number):
        for i in range(0, len(doc), 100_000):
            at = slice(i, i + 100_000)
            yield _found(doc[at], start[at], number[at], U(0), U(0), -1, REPEAT)

    named = docs.filter(F.col(row).isNotNull()).select(F.col(row).cast("long"), text)
    parts = named.mapInArrow(cut, "bucket int, " + ", ".join(f"{k} binary" for k in kinds))
    return dealt(parts, "bucket").mapInArrow(meet, FOUND)


def _compared(docs: DataFrame, found: DataFrame, text: str, row: str) -> DataFrame:
    """(kind, doc, start, number, key) from the suffix arrays: runs of repeated
    strings (kind 0), and strings of split hashes still to be merged (kind 1)."""
    buckets = partitions(docs.sparkSession)
    kinds = {"doc": np.int64, "start": np.int32, "number": np.int32, "role": np.int8, "split": np.int8, "shard": np.uint8}
    wanted = found.filter(F.col("role") > REPEAT).groupBy("doc").agg(F.collect_list(F.struct("start", "number", "h", "s", "salt", "role")).alias("parts"))

    def fetch(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            heads = []
            lists = batch.column(2)
            flat, cuts = lists.values, lists.offsets.to_numpy()
            start, number, h, s, salt, role = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            ids = batch.column(0).to_numpy()
            for i, j, data, offsets in slices(batch.column(1), 512 << 10):
                at, end = cuts[i], cuts[j]
                d = np.repeat(np.arange(j - i), np.diff(cuts[i:j + 1]))
                a = offsets[d] + start[at:end]
                b = a + number[at:end] + SPAN - 1
                fits = b <= offsets[d + 1]
                p, back = W.powers(len(data) + 1)
                sums = np.concatenate((np.zeros(1, U), np.cumsum(W.CODES[data] * p[:len(data)])))
                a0, b0 = np.where(fits, a, 0), np.where(fits, b, 0)
                fits &= W.mix((sums[b0] - sums[a0]) * back[a0] + number[at:end].astype(U)).view(np.int64) == s[at:end]
                k = np.flatnonzero(fits)
                mixed = W.mix(h[at:end][k].view(U) + (salt[at:end][k].astype(np.int64).view(U) + U(1)) * U(0x9E3779B97F4A7C15))
                heads.append(((mixed >> U(8)) % U(buckets)).astype(np.int64))
                for c, v in zip(cols, (ids[i + d[k]].astype(np.int64), start[at:end][k], number[at:end][k], role[at:end][k].astype(np.int8), (salt[at:end][k] >= 0).astype(np.int8),
                                       (mixed & U(SHARDS - 1)).astype(np.uint8))):
                    c.append(v)
                raw = data.tobytes()
                cols[6] += [raw[x:y] for x, y in zip(a[k].tolist(), b[k].tolist())]
            if not heads:
                continue
            bucket = np.concatenate(heads)
            order = np.argsort(bucket, kind="stable")
            out = _blobs(bucket, [np.concatenate(c) for c in cols[:6]], list(kinds))
            starts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(bucket))
            texts = [b"".join(cols[6][x] for x in order[a:b]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(texts, pa.binary())], ["bucket", *kinds, "bytes"])

    def sort(batches):
        doc, start, number, role, split, part, text_ = _joined(batches, kinds | {"bytes": np.uint8})
        ends = np.cumsum(number.astype(np.int64) + SPAN - 1)
        for k in np.unique(part):
            own = np.flatnonzero(part == k)
            raw = np.concatenate([text_[ends[i] - number[i] - SPAN + 1:ends[i]] for i in own])
            yield from shard(doc[own], start[own], number[own], role[own], split[own], raw)

    def shard(doc, start, number, role, split, text_):
        lengths = number.astype(np.int64) + SPAN - 1
        begins = np.cumsum(lengths) - lengths
        repeated, inside = shard_repeats(text_, lengths, number, doc)
        tested = np.repeat(role == TEST, lengths)
        a, b = _runs(repeated & tested, begins)
        seg = np.searchsorted(begins, a, "right") - 1
        yield _strings(0, doc[seg], start[seg] + (a - begins[seg]), b - a + 1, None)
        left = np.flatnonzero(inside & ~repeated & np.repeat(split == 1, lengths))
        raw = text_.tobytes()
        for i in range(0, len(left), 20_000):
            p = left[i:i + 20_000]
            seg = np.searchsorted(begins, p, "right") - 1
            yield _strings(1, doc[seg], start[seg] + (p - begins[seg]), np.where(role[seg] == TEST, 1, 0), [raw[x:x + SPAN] for x in p.tolist()])

    body = docs.filter(F.col(row).isNotNull()).select(F.col(row).cast("long").alias("doc"), text).join(wanted, "doc")
    parts = body.select("doc", text, "parts").mapInArrow(fetch, "bucket int, " + ", ".join(f"{k} binary" for k in [*kinds, "bytes"]))
    return dealt(parts, "bucket").mapInArrow(sort, "kind int, doc long, start int, number int, key binary")


def _strings(kind, doc, start, number, keys) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(doc.astype(np.int64)), pa.array(np.asarray(start).astype(np.int32)),
                                       pa.array(np.asarray(number).astype(np.int32)), pa.array(keys, pa.binary()) if keys is not None else pa.nulls(n, pa.binary())],
                                      ["kind", "doc", "start", "number", "key"])


def _merged(strings: DataFrame) -> DataFrame:
    """Strings of split hashes that a smaller document holds in another shard."""
    def meet(batches):
        lists, tested = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column("key").to_pylist(), f"S{SPAN}")
            doc, start = batch.column("doc").to_numpy(), batch.column("start").to_numpy()
            order = np.lexsort((doc, keys))
            new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
            lists.append((keys[order][new], doc[order][new].copy()))
            t = np.flatnonzero(batch.column("number").to_numpy() == 1)
            tested.append((keys[t], doc[t], start[t]))
        if not lists:
            return
        keys, least = merge_sorted(lists)
        for k, doc, start in tested:
            hit = np.flatnonzero(least[np.searchsorted(keys, k)] < doc)
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(start[hit]), pa.array(np.ones(len(hit), np.int32))], ["doc", "start", "number"])

    n_parts = partitions(strings.sparkSession)
    return (strings.filter("kind = 1").select("doc", "start", "number", "key").repartition(n_parts, F.xxhash64("key"))
            .mapInArrow(meet, "doc long, start int, number int"))


RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def repeats(docs: DataFrame, *, text: str = "text", row: str = "doc_id") -> DataFrame:
    """(row, n_bytes, removed_runs, kept_bytes) for every row of ``docs``.

    removed_runs are the places in bytes (end exclusive) covered by a string of
    ``SPAN`` bytes that also starts in a document with a smaller id, as judged
    on the input; kept_bytes are the others.  A null or empty text, and one of
    fewer bytes than ``SPAN``, keeps all.  A row with a null id is compared with
    nothing.  Rows that share an id are one document; each loses its places.
    Other columns are not carried."""
    small_batches(docs.sparkSession)
    found = stored(_candidates(docs, text, row), "segments")
    compared = stored(_compared(docs, found, text, row), "compared")
    runs = (found.filter(F.col("role") == REPEAT).select("doc", "start", "number")
            .unionByName(compared.filter("kind = 0").select("doc", "start", "number")).unionByName(_merged(compared)))
    of_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "number")).alias("parts"))
    kind = docs.schema[row].dataType.simpleString()

    def drop(batches):
        for batch in batches:
            removed, kept, sizes = [], [], []
            for body, parts in zip(batch.column(1), batch.column(2)):
                raw = np.frombuffer(body.as_buffer(), np.uint8) if body.is_valid else np.zeros(0, np.uint8)
                sizes.append(len(raw))
                if not parts.is_valid or not len(raw):
                    removed.append([])
                    kept.append(raw.tobytes())
                    continue
                a, n = parts.values.field(0).to_numpy(), parts.values.field(1).to_numpy()
                a, b = np.minimum(a, len(raw)), np.minimum(a + n + SPAN - 1, len(raw))
                gone = np.zeros(len(raw) + 1, np.int32)
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                gone = np.cumsum(gone[:-1]) > 0
                x, y = _runs(gone, np.zeros(0, np.int64))
                removed.append([{"start": int(p), "end": int(q) + 1} for p, q in zip(x, y)])
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, RUNS), pa.array(kept, pa.binary())], [row, "n_bytes", "removed_runs", "kept_bytes"])

    joined = docs.select(row, text).join(of_doc, F.col(row).cast("long") == F.col("doc"), "left").select(row, text, "parts")
    return joined.mapInArrow(drop, f"`{row}` {kind}, n_bytes long, removed_runs array<struct<start:int,end:int>>, kept_bytes binary")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of what is kept."""
    gone = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]).cast("long"))
    return (found.withColumn("n_removed", gone).withColumn("n_spans", F.size("removed_runs").cast("long"))
            .withColumn("kept_sha256", F.sha2("kept_bytes", 256)).drop("removed_runs", "kept_bytes"))
