"""Packing by minimum bin slack.

Texts become token ids and an end; whole windows are cut off long ones, and the
remaining lengths of a batch are packed: the longest left opens a window, and a
subset-sum over bitsets of the other lengths, longest first and as often as
they are left, picks the multiset that fills it closest to capacity.  Only
counts of lengths matter, so the chosen counts are read back through the saved
bitsets and then handed to the texts in order.  What cannot fill a window at the
end of a batch is cut into powers of two, which need no padding.

Batches pack on their own: nothing is shuffled, one text crosses no task, and a
task that runs again gives the same sequences."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches

WINDOW = 2048
#: Texts of about so many bytes are packed together.
BATCH_BYTES = 24 << 20
END = 1

_encoders: dict[str, object] = {}


class Encoder:
    """Ids of the vocabulary file.  The same vocabulary as byte ranks is read
    where it lies beside it, because that form is several times faster; texts
    with the special token's string go through the file itself."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.plain = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.fast = None
        if name == "byte_bpe_50k.json":
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length sum closest to ``capacity`` without exceeding it.

    Bit s of the bitset says that s can be reached.  A length with count c is
    added in steps of 1, 2, 4, ... copies; the bitset before each step is saved,
    and the steps taken are found by walking back from the best sum."""
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            copies *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` (each 1 to ``capacity``), window by window."""
    held: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        held.setdefault(lengths[i], []).append(i)
    counts = {k: len(v) for k, v in held.items()}
    out = []
    while counts:
        top = max(counts)
        members = [held[top].pop()]
        counts[top] -= 1
        if not counts[top]:
            del counts[top]
        if top < capacity:
            for length, n in fill(counts, capacity - top).items():
                members += [held[length].pop() for _ in range(n)]
                counts[length] -= n
                if not counts[length]:
                    del counts[length]
        out.append(members)
    return out


def plan(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (text, start, length, sequence, offset) of one batch."""
    pieces, rest, sequence = [], [], 0
    for doc, n in enumerate(sizes):
        whole = n // window
        for k in range(whole):
            pieces.append((doc, k * window, window, sequence, 0))
            sequence += 1
        if n % window:
            rest.append((doc, whole * window, n % window))
    packed = windows([r[2] for r in rest], window)
    full = [g for g in packed if sum(rest[i][2] for i in g) == window]
    short = [i for g in packed if sum(rest[i][2] for i in g) < window for i in g]
    for group in full:
        at = 0
        for i in group:
            pieces.append((*rest[i], sequence, at))
            at += rest[i][2]
        sequence += 1
    # The few texts of unfilled windows are laid end to end and cut.
    room, at = 0, 0
    total = sum(rest[i][2] for i in short)
    for i in short:
        doc, start, left = rest[i]
        while left:
            if not room:
                room, at = (window if total >= window else 1 << (total.bit_length() - 1)), 0
            n = min(left, room)
            pieces.append((doc, start, n, sequence, at))
            start, left, room, at, total = start + n, left - n, room - n, at + n, total - n
            sequence += not room
    return pieces


def pack(docs: DataFrame, *, text: str = "text", row: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", end: int = END,
         window: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece: the row's id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are the end token alone.  Every row is packed: rows may
    repeat and ids may be null (the piece's id is then null).  An empty table
    gives no pieces.  Other columns are not carried."""
    small_batches(docs.sparkSession)
    kind = docs.schema[row].dataType.simpleString()
    schema = f"`{row}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        held, keys, size = [], [], 0

        def flush():
            nonlocal held, keys, size, base
            pieces = plan([len(h) for h in held], window)
            for k in range(0, len(pieces), 8192):
                part = pieces[k:k + 8192]
                cols = list(zip(*part))
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[d] for d in cols[0]], key_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array([held[d][s:s + n].tobytes() for d, s, n, _, _ in part], pa.binary()),
                    pa.array([len(held[d]) for d in cols[0]], pa.int64()),
                    pa.array([base + q for q in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())],
                    [row, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            base += max((p[3] for p in pieces), default=-1) + 1
            held, keys, size = [], [], 0

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py() or ""
                ids = encode.ids(body)
                held.append(np.append(ids, np.uint32(end)).astype("<u4"))
                keys.append(key)
                size += len(body)
                if size >= batch_bytes:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(row, text).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
