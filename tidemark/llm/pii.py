"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns find the base spans.  Where they swallow a neighbour (two card
numbers in a row, a phone number before an address) they drop the whole match;
the field recovers such spans.  It scores whole candidate segments of tokens,
checksums, shapes and borders included, and a dynamic program over segments of
bounded length chooses boundaries and kinds jointly.  Its weights are learned
by likelihood from a bounded sample of texts whose base spans are the labels.

Only stretches around a digit or an ``@`` can hold a span, so only those are
tokenised; they cover every such place of every whole text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches, stored

KINDS = ("email", "ip", "card", "phone")
#: Texts to learn from at most, their bytes together, tokens in a span, rounds.
SAMPLE, SAMPLE_BYTES, MOST_TOKENS, ROUNDS = 2000, 32 << 20, 24, 60

TRIGGER = re.compile("[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def plain_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_quad(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` so that long words cost no more."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = LOCAL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Base spans in order, and the matches that were dropped."""
    found = [("email", *m) for m in emails(text)] if "@" in text else []
    dropped = []
    for kind, pattern, good in (("ip", QUAD, is_quad),
                                ("card", DIGITS, lambda s: 14 <= len(d := plain_digits(s)) <= 19 and luhn(d)),
                                ("phone", PHONE, lambda s: 10 <= len(plain_digits(s)) <= 15)):
        if kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            if good(m[0]):
                found.append((kind, *m.span()))
            elif kind != "card" or m.end() - m.start() > 13:
                dropped.append(m.span())
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))), dropped


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of blank-separated pieces with a digit or ``@``, joined over single blanks."""
    out: list[list[int]] = []
    at = 0
    while m := TRIGGER.search(text, at):
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a - out[-1][1] <= 1:
            out[-1][1] = b
        else:
            out.append([a, b])
        at = b
    return [(a, b) for a, b in out]


def shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 9)}", s))


def _valid(s: str) -> list[str]:
    """Kinds a whole span can be."""
    out = []
    if LOCAL.fullmatch(s):
        out.append("email")
    if QUAD.fullmatch(s) and is_quad(s):
        out.append("ip")
    d = plain_digits(s)
    if 13 <= len(d) <= 19 and DIGITS.fullmatch(s) and luhn(d):
        out.append("card")
    if 10 <= len(d) <= 15 and PHONE.fullmatch(s):
        out.append("phone")
    return out


def _features(kind: str, s: str, before: str, after: str) -> list[str]:
    digits = plain_digits(s)
    out = [kind, f"{kind} digits {min(len(digits), 20)}", f"{kind} groups {min(len(re.findall('[0-9]+', s)), 8)}"]
    if kind != "email":
        out.append(f"{kind} shape {shape(s)}")
    joined = lambda c: c != "" and (c.isalnum() or c in "@_%+")
    out.append(f"{kind} left {'word' if joined(before) else 'mark' if before.strip() else 'blank'}")
    out.append(f"{kind} right {'word' if joined(after) else 'mark' if after.strip() else 'blank'}")
    if kind == "card" and not 14 <= len(digits) <= 19:
        out.append("card odd length")
    return out


@dataclass
class Zone:
    """Tokens of a stretch and its candidate segments with their features."""

    at: list[int]  # start of each token, and the end of the last
    segments: list[tuple[int, int, str, list[str]]] = field(default_factory=list)


def zone(text: str, a: int, b: int) -> Zone:
    at = [a + m.start() for m in TOKEN.finditer(text[a:b])] + [b]
    z, n = Zone(at), len(at) - 1
    good_end = [text[at[k + 1] - 1].isalnum() for k in range(n)]
    for i in range(n):
        first = text[at[i]]
        if not (first.isalnum() or first in "+._%-"):
            continue
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            if not good_end[j - 1]:
                continue
            s = text[at[i]:at[j]]
            if len(s) < 5:
                continue
            for kind in _valid(s):
                z.segments.append((i, j, kind, _features(kind, s, text[at[i] - 1] if at[i] else "", text[at[j]:at[j] + 1])))
    return z


@dataclass
class Field:
    """Weights of span features; outside tokens score nothing."""

    weights: dict[str, float]

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def decode(self, z: Zone) -> list[tuple[str, int, int]]:
        """The best segmentation of a stretch."""
        n = len(z.at) - 1
        by_end: dict[int, list[tuple[int, str, float]]] = {}
        for i, j, kind, f in z.segments:
            by_end.setdefault(j, []).append((i, kind, self.score(f)))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kind, s in by_end.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, z.at[i], z.at[j]))
                j = i
        return out[::-1]


def fit(texts: list[str], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Likelihood ascent: for each stretch, features of the labelled segments
    against their expectation over all segmentations (forward and backward sums)."""
    zones, names = [], {}
    for text in texts:
        spans, dropped = base_spans(text)
        labels = {(a, b, k) for k, a, b in spans}
        for a, b in stretches(text):
            if any(x < b and a < y for x, y in dropped):
                continue  # the patterns failed here, so there is no label
            z = zone(text, a, b)
            if z.segments:
                ids = [np.array([names.setdefault(f, len(names)) for f in s[3]]) for s in z.segments]
                gold = np.array([(z.at[i], z.at[j], k) in labels for i, j, k, _ in z.segments])
                zones.append((len(z.at) - 1, [s[0] for s in z.segments], [s[1] for s in z.segments], ids, gold))
    w = np.zeros(len(names))
    squares = np.full(len(names), 1e-6)
    for _ in range(rounds):
        grad = -decay * len(zones) * w
        for n, starts, ends, ids, gold in zones:
            s = np.array([w[f].sum() for f in ids])
            order = np.argsort(ends, kind="stable")
            fwd, k = np.zeros(n + 1), 0
            for j in range(1, n + 1):
                fwd[j] = fwd[j - 1]
                while k < len(order) and ends[order[k]] == j:
                    fwd[j] = np.logaddexp(fwd[j], fwd[starts[order[k]]] + s[order[k]])
                    k += 1
            back, order, k = np.zeros(n + 1), np.argsort(starts, kind="stable")[::-1], 0
            for i in range(n - 1, -1, -1):
                back[i] = back[i + 1]
                while k < len(order) and starts[order[k]] == i:
                    back[i] = np.logaddexp(back[i], back[ends[order[k]]] + s[order[k]])
                    k += 1
            p = np.exp(fwd[starts] + s + back[ends] - fwd[n])
            for f, d in zip(ids, gold - p):
                grad[f] += d
        squares += grad * grad
        w += rate * grad / np.sqrt(squares)
    return Field({f: float(w[k]) for f, k in names.items()})


def added(text: str, base: list[tuple[str, int, int]], model: Field) -> list[tuple[str, int, int]]:
    """Spans the field finds apart from base spans."""
    out = []
    for a, b in stretches(text):
        z = zone(text, a, b)
        if z.segments:
            out += [s for s in model.decode(z) if not any(x < s[2] and s[1] < y for _, x, y in base)]
    return out


def sample(docs: DataFrame, text: str = "text", size: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """Up to ``size`` distinct texts with a digit or ``@``, whole and of any
    length, in order of a hash of the text, as long as all of them together
    have at most ``most_bytes`` (the first is taken in any case)."""
    h = F.xxhash64(text)
    # Hashes are written, so that the texts are searched once and then only read again for those chosen.
    rows = stored(docs.filter(F.col(text).rlike("[0-9@]")).select(h.alias("h"), F.octet_length(text).alias("n")), "sample")
    total = rows.count()
    place = F.pmod(F.col("h"), F.lit(1_000_003))
    drawn = rows.filter(place / F.lit(1_000_003.0) < 4 * size / max(total, 1))
    sizes = drawn.distinct().orderBy(place, "h").limit(size).collect()
    chosen, held = [], 0
    for key, n in sizes:
        if chosen and held + n > most_bytes:
            break
        chosen.append(key)
        held += n
    if not chosen:
        return []
    return sorted({r[0] for r in docs.filter(h.isin(chosen)).filter(F.col(text).rlike("[0-9@]")).select(text).distinct().collect()})


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, model: Field, *, text: str = "text", mark: str | None = None) -> DataFrame:
    """``docs`` with pii_spans (kind, start, end in code points, whether base),
    by start and then kind, in place of a column so called in any case.  With ``mark``,
    such as ``<{}>``, the text also has each span replaced; overlapping spans
    are replaced as one, by the first's kind.

    A null text stays null and, like an empty one, has no spans.  Rows may
    repeat and any other column may be null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c.lower() != "pii_spans"]
    body = carried.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in carried]).schema)
    schema += ", pii_spans array<struct<kind:string,start:int,end:int,base:boolean>>"

    def spans_of(t: str):
        if not t or not TRIGGER.search(t):
            return []
        base, _ = base_spans(t)
        more = added(t, base, shared.value)
        every = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in more]
        return sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    def replaced(t, spans):
        if not spans:
            return t
        out, at = [], 0
        for k, a, b, _ in spans:
            if a >= at:
                out += [t[at:a], mark.format(k.upper())]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                texts = part.column(body).to_pylist()
                found = [spans_of(t) for t in texts]
                columns = list(part.columns)
                if mark is not None:
                    columns[body] = pa.array([replaced(t, s) for t, s in zip(texts, found)], part.column(body).type)
                rows = pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in f] for f in found], SPANS)
                yield pa.RecordBatch.from_arrays([*columns, rows], [*carried, "pii_spans"])

    return docs.select(*[f"`{c}`" for c in carried]).mapInArrow(run, schema)


def digest(marked: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, and all spans as one text."""
    words = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii_spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))
    out = marked.withColumns({f"n_{kind}": F.size(of_kind(kind)).cast("long") for kind in KINDS})
    return out.withColumn("base_sha256", F.sha2(words(base), 256)).withColumn("spans", words(F.col("pii_spans")))
