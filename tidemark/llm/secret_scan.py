"""Secrets in texts: fixed patterns, and sliding-window entropy of long strings.

Candidates are runs of the characters that keys are written in.  A candidate is
hexadecimal if all its characters are, else base64; each class has its window,
its alphabet and its threshold.  A window moves along the candidate with the
counts of its characters: per step one count grows and one shrinks, and the sum
of ``c * log2(c)`` follows by the differences of these two.  Windows with enough
entropy that hold digits and others are merged into spans.  Strings on the
allow-list (identifiers, slugs and paths of words, placeholders) are left out.

Everything happens within the row of a text, in DataFrame functions; nothing is
shuffled.  ``c * log2(c)`` is kept in millionths, as integers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
#: A match is a whole run, so the least length may stand in the pattern.
HEX = r"[0-9a-f]{16,}"
#: Kinds of the fixed patterns, the group whose length counts, and the least length.
BASE = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16)}

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
PARTS = 1_000_000
BLOCK = 512


@dataclass(frozen=True)
class CharacterClass:
    """Strings of one class: their characters, the window and the least entropy in bits."""

    kind: str
    alphabet: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of ``c * log2(c)`` that a window with enough entropy has."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * PARTS)

    @property
    def terms(self) -> list[int]:
        return [round(c * math.log2(c) * PARTS) if c else 0 for c in range(self.window + 1)]


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEXADECIMAL = CharacterClass("hexadecimal", DIGITS + "abcdefABCDEF", 16, 3.0)
BASE64 = CharacterClass("base64", DIGITS + LOWER + UPPER + "+/_-=", 20, 3.75)
CLASSES = (HEXADECIMAL, BASE64)
KINDS = (*BASE, *(c.kind for c in CLASSES))

#: Strings that are known to be no secrets: identifiers, placeholders, runs of the alphabet.
ALLOWED = (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
           r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",
           r"0123456789|abcdefghij|ABCDEFGHIJ")
#: Slugs and paths: every part between separators is a word or a short number.
SEPARATORS, WORD = r"[+/_=-]+", r"^([A-Z]?[a-z]*|[A-Z]*|[0-9]{0,4})$"


def _let(value: Column, use) -> Column:
    """``use(value)``, computing ``value`` once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(steps: Column, start: Column) -> Column:
    """Sum of ``start`` and the steps before each step, and of all of them."""
    return F.aggregate(steps, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def running(steps: Column) -> Column:
    """Sum of all steps before each step.  Blocks of steps keep the work in
    proportion to a text's number of matches, however many there are."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)
    within = lambda b, s: _let(_before(b, s), lambda x: F.slice(x, F.lit(1), F.size(b)))
    return _let(blocks, lambda bs: _let(_before(F.transform(bs, total), F.lit(0)), lambda starts: F.flatten(
        F.transform(bs, lambda b, i: within(b, F.get(starts, i))))))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: ``body`` (the group), start and end
    in code points.  Null where there is none.

    The pieces between matches and the matches, taken in turn, make up the text,
    so that their lengths give the places."""
    def places(gaps, whole, body):
        gap, size = lambda i: F.length(F.get(gaps, i)), lambda i: F.length(F.get(whole, i))
        steps = F.transform(whole, lambda m, i: gap(i) + F.length(m))
        return _let(running(steps), lambda at: F.transform(body, lambda m, i: F.struct(
            m.alias("body"), (F.get(at, i) + gap(i)).alias("start"), (F.get(at, i) + gap(i) + size(i)).alias("end"))))
    took = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    inner = lambda gaps, whole: places(gaps, whole, whole) if group == 0 else _let(took(group), lambda body: places(gaps, whole, body))
    return F.when(text.rlike(pattern), _let(F.split(text, pattern), lambda gaps: _let(took(0), lambda whole: inner(gaps, whole))))


SPAN = "struct<start:int,rank:int,end:int>"
NO_SPANS = f"array<{SPAN}>"


def _spans(found: Column, kind: str) -> Column:
    return F.coalesce(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"))),
                      F.array().cast(NO_SPANS))


def allowed(candidate: Column, patterns: tuple[str, ...] = ALLOWED) -> Column:
    words = F.forall(F.split(candidate, SEPARATORS), lambda p: p.rlike(WORD))
    out = words
    for p in patterns:
        out = out | candidate.rlike(p)
    return out


def dense_windows(candidate: Column, c: CharacterClass) -> Column:
    """Merged windows of the candidate with enough entropy and both digits and
    others: ``start`` and ``end`` within it.

    The state: places passed, counts by character, the sum of ``c * log2(c)``,
    digits in the window, the open run of windows, and the runs before it."""
    w = c.window
    terms = F.array(*[F.lit(t).cast("long") for t in c.terms])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    runs = "array<struct<start:int,end:int>>"
    first = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"),
                     F.lit(0).alias("digits"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(runs).alias("runs"))

    def step(codes):
        def move(a, code):
            gone = F.get(codes, a["i"] - w)  # null while the window fills
            more, fewer = F.get(a["counts"], code), F.get(a["counts"], gone)
            # The entering character is counted after the leaving one has gone.
            more = F.when(gone == code, more - 1).otherwise(more)
            change = F.get(terms, more + 1) - F.get(terms, more) + F.coalesce(F.get(terms, fewer - 1) - F.get(terms, fewer), F.lit(0))
            counts = F.transform(a["counts"], lambda n, k: n + (k == code).cast("int") - F.coalesce((k == gone).cast("int"), F.lit(0)))
            digits = a["digits"] + (code < 10).cast("int") - F.coalesce((gone < 10).cast("int"), F.lit(0))
            return F.struct((a["i"] + 1).alias("i"), counts.alias("counts"), (a["sum"] + change).alias("sum"), digits.alias("digits"),
                            a["start"].alias("start"), a["end"].alias("end"), a["runs"].alias("runs"))

        def judge(b):
            enough = (b["i"] >= w) & (b["sum"] <= c.most) & (b["digits"] > 0) & (b["digits"] < w)
            apart = enough & (b["i"] - w > b["end"])
            closed = F.when(apart & (b["end"] > 0), F.array_append(b["runs"], F.struct(b["start"].alias("start"), b["end"].alias("end")))).otherwise(b["runs"])
            return F.struct(b["i"].alias("i"), b["counts"].alias("counts"), b["sum"].alias("sum"), b["digits"].alias("digits"),
                            F.when(apart, b["i"] - w).otherwise(b["start"]).alias("start"), F.when(enough, b["i"]).otherwise(b["end"]).alias("end"), closed.alias("runs"))

        last = lambda a: F.when(a["end"] > 0, F.array_append(a["runs"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["runs"])
        return F.aggregate(codes, first, lambda a, code: _let(move(a, code), judge), last)

    return _let(codes, step)


def entropy_spans(found: Column, patterns: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of dense windows in located candidates that are not allowed."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def of(m):
        is_hex = m["body"].rlike(r"^[0-9A-Fa-f]+$")
        worth = m["body"].rlike("[0-9]") & ~allowed(m["body"], patterns)
        parts = []
        for c in CLASSES:
            mine = worth & (is_hex if c is HEXADECIMAL else ~is_hex) & (F.length(m["body"]) >= c.window)
            parts.append(_ranked(m, F.when(mine, dense_windows(m["body"], c)).otherwise(none), KINDS.index(c.kind)))
        return F.concat(*parts)

    return F.coalesce(F.flatten(F.transform(found, of)), F.array().cast(NO_SPANS))


def _ranked(m: Column, runs: Column, rank: int) -> Column:
    return F.transform(runs, lambda r: F.struct((m["start"] + r["start"]).alias("start"), F.lit(rank).alias("rank"), (m["start"] + r["end"]).alias("end")))


ADDED = ("secret_base", "secret_spans")


def scan(docs: DataFrame, *, text: str = "text", patterns: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with secret_base, the matches of the fixed patterns, and
    secret_spans, these and the entropy spans that lie in none of them: arrays
    of (kind, start, end) in code points, end exclusive, by start and kind.

    A null or empty text has none.  Rows may repeat, ids are not used, an empty
    table gives no rows, and columns may be called anything but the two added
    names, which replace columns so called in any case."""
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), body.alias("_body"))
    for kind, (pattern, group, _) in BASE.items():
        rows = rows.withColumn(f"_{kind}", located(F.col("_body"), pattern, group))
    rows = rows.withColumn("_long", located(F.col("_body"), CANDIDATE))
    base = F.array_sort(F.concat(*[_spans(_of_length(k, least), k) for k, (_, _, least) in BASE.items()]))
    rows = rows.select("_doc", base.alias("_base"), entropy_spans(F.col("_long"), patterns).alias("_more"))
    inside = lambda s: F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    rows = rows.withColumn("_all", F.array_sort(F.concat("_base", F.filter("_more", lambda s: ~inside(s)))))
    return rows.select(*[F.col(f"_doc.`{c}`") for c in kept], _named("_base").alias("secret_base"), _named("_all").alias("secret_spans"))


def _of_length(kind: str, least: int) -> Column:
    return F.filter(F.col(f"_{kind}"), lambda m: F.length(m["body"]) >= least)


def _named(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Matches by fixed pattern, the hash of their places, and all spans as text."""
    def count(kind):
        return F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("*", *[count(k) for k in BASE], F.sha2(_joined("secret_base"), 256).alias("base_sha256"), _joined("secret_spans").alias("spans"))
