"""Language of texts with mixed-language spans.

Character sequences of one to three letters, blanks at word ends included,
give each word a log-likelihood per language, learned from a bounded sample of
labelled rows.  The scripts of a word's letters narrow the languages it can be
in.  A Viterbi pass over the words, with a penalty for every change of
language, labels spans.  All texts of a batch advance together, word by word,
so the pass is a few numpy steps over many texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import regroup, small_batches

#: Texts per language to learn from (drawn by a hash of text), and of all languages together.
SAMPLE, MOST_TEXTS = 1500, 96_000
#: Languages up to which their counts are broadcast, a few bytes each.
MOST_SENT = 1 << 16
BUCKETS = 1 << 16
#: Cost of a change of language, in natural log units; share of a language's letters that makes a script one of its own.
PENALTY, LEAST_SCRIPT = 6.0, 0.02
CHUNK = 1 << 20
#: Texts labelled together hold about so many bytes.
TOGETHER = 8 << 20

#: Script ranges of Unicode blocks: first code point and script number, to the next.
SCRIPTS = [(0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x900, 6), (0x980, 7), (0xA00, 8), (0xB80, 9), (0xC00, 10),
           (0xE00, 11), (0xE80, 12), (0x10A0, 13), (0x1100, 14), (0x1200, 15), (0x1780, 16), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 17),
           (0x3100, 18), (0x3130, 14), (0x3190, 18), (0xA000, 19), (0xAC00, 14), (0xD7B0, 19), (0xF900, 18), (0xFB00, 0), (0xFB50, 5), (0xFE00, 0), (0x20000, 18), (0x30000, 19)]
N_SCRIPTS = 20
_starts = np.array([s[0] for s in SCRIPTS])
_numbers = np.array([s[1] for s in SCRIPTS], np.int8)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(texts: list[str]):
    """Words of several texts as hashed character sequences.

    Returns the number of words of each text, the three feature numbers of each
    letter, each word's first letter and its letters' scripts as a bit mask."""
    joined = "\n".join(texts).lower() if texts else ""
    lower = [len(t.lower()) for t in texts]
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters()[points]
    edge = np.concatenate(([False], inside, [False]))
    firsts = np.flatnonzero(edge[1:-1] & ~edge[:-2])
    at = np.flatnonzero(inside)
    codes = np.where(inside, points, 32).astype(np.uint64)
    padded = np.concatenate((np.full(1, 32, np.uint64), codes, np.full(1, 32, np.uint64)))
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    odd = np.uint64(0x9E3779B97F4A7C15)
    hashed = lambda x: ((x * odd) >> np.uint64(48)).astype(np.int32)
    base = np.uint64(1 << 21)
    grams = (hashed(b + np.uint64(1)), hashed((a * base + b) * np.uint64(3) + np.uint64(2)), hashed(((a * base + b) * base + c) * np.uint64(5) + np.uint64(3)))
    scripts = _numbers[np.searchsorted(_starts, points[at], "right") - 1]
    start = np.searchsorted(at, firsts)
    masks = np.bitwise_or.reduceat(np.int32(1) << scripts.astype(np.int32), start) if len(start) else np.zeros(0, np.int32)
    # A text's letters end before the line break that joins it to the next.
    ends = np.cumsum(np.array(lower, np.int64) + 1) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate(([0], np.searchsorted(firsts, ends))))
    return counts, grams, start, masks


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # buckets x languages, natural log
    allowed: np.ndarray  # scripts x languages, bool

    def scores(self, grams, start: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language, those of other scripts out."""
        if not len(start):
            return np.zeros((0, len(self.names)), np.float32)
        each = self.weights[grams[0]] + self.weights[grams[1]] + self.weights[grams[2]]
        out = np.add.reduceat(each, start, axis=0)
        kinds, which = np.unique(masks, return_inverse=True)
        fit = np.array([[all(self.allowed[s, k] for s in range(N_SCRIPTS) if m >> s & 1) for k in range(len(self.names))] for m in kinds.tolist()], bool)
        fit[~fit.any(axis=1)] = True  # a mix of scripts that no language has narrows nothing
        return np.where(fit[which], out, np.float32(-1e4))


def fit(rows: list[tuple[str, str]]) -> Model:
    """Learn from (language, text) rows; the same whatever their order."""
    names = sorted({r[0] for r in rows})
    counts = np.zeros((BUCKETS, len(names)), np.float64)
    scripts = np.zeros((N_SCRIPTS, len(names)), np.float64)
    for k, name in enumerate(names):
        texts = [t for n, t in rows if n == name]
        for i in range(0, len(texts), 200):
            _, grams, start, masks = features(texts[i:i + 200])
            for g in grams:
                counts[:, k] += np.bincount(g, minlength=BUCKETS)
            for s in range(N_SCRIPTS):
                scripts[s, k] += np.count_nonzero(masks >> s & 1)
    weights = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(names, (weights / 2).astype(np.float32), share >= LEAST_SCRIPT)


def viterbi(counts: np.ndarray, scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of every word.  Texts with most words come first, so those
    still running are always a front slice."""
    n_lang = scores.shape[1]
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    running, base = counts[order], first[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores) or n_lang == 1:
        return labels
    came = np.empty((len(scores), n_lang), np.int16)
    steps = int(running[0])
    live = np.searchsorted(-running, -np.arange(steps), "left")  # texts with more words than the step
    own = np.arange(n_lang, dtype=np.int16)[None, :]
    best = None
    last = np.zeros(len(counts), np.int16)
    for t in range(steps):
        k = live[t]
        at = base[:k] + t
        if best is None:
            best = scores[at].copy()
        else:
            if k < len(best):
                last[k:len(best)] = best[k:].argmax(axis=1)
                best = best[:k]
            top = best.argmax(axis=1)
            reach = best[np.arange(k), top] - penalty
            switch = reach[:, None] > best
            came[at] = np.where(switch, top[:, None].astype(np.int16), own)
            best = np.where(switch, reach[:, None], best) + scores[at]
    last[:len(best)] = best.argmax(axis=1)
    here = last.copy()
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = base[:k] + t
        labels[at] = here[:k]
        if t:
            here[:k] = came[at, here[:k]]
    return labels


def sample(docs: DataFrame, text: str, label: str, size: int = SAMPLE, most_texts: int = MOST_TEXTS) -> list[tuple[str, str]]:
    """Up to ``size`` distinct labelled texts of each language, in order of a
    hash of the text; fewer of each, but of every one, where all languages
    together would have more than ``most_texts``."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    order = F.pmod(F.col("h"), F.lit(1_000_003))
    # Copies count once; the first text of a language is taken in any case.
    totals = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n"), F.min(F.struct(order.alias("o"), "h"))["h"].alias("first"))
    n_labels = totals.count()
    each = max(1, min(size, most_texts // max(1, n_labels)))
    if n_labels <= MOST_SENT:
        totals = F.broadcast(totals)
    # Drawn first, so that the order is taken among a few times as many as are kept.
    near = order / F.lit(1_000_003.0) < 2 * each / F.col("n")
    drawn = rows.join(totals, "l").filter(near | (F.col("h") == F.col("first"))).dropDuplicates(["l", "h"])
    place = F.row_number().over(Window.partitionBy("l").orderBy(order, "h"))
    return sorted(map(tuple, drawn.withColumn("place", place).filter(F.col("place") <= each).select("l", "t").collect()))


SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, *, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_spans, lang_pred and lang_score, which replace columns
    so called.

    Words are runs of letters.  The prediction is the language with most words,
    of equals the first by name; the score is its share of the words.  A null
    text, or one without letters, is ``und`` with score 0 and no spans.  Texts
    are read whole; rows may repeat and any other column may be null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c.lower() not in ("lang_spans", "lang_pred", "lang_score")]
    body = carried.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in carried]).schema)
    schema += ", lang_spans array<struct<first_word:int,n_words:int,lang:string>>, lang_pred string, lang_score double"

    def label(texts: list[str]):
        m = shared.value
        n_lang = max(1, len(m.names))
        counts, scores = [], []
        i = 0
        while i < len(texts):  # a few megabytes of text at a time
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            n, grams, start, masks = features(texts[i:j])
            counts.append(n)
            scores.append(m.scores(grams, start, masks))
            i = j
        counts, scores = np.concatenate(counts), np.concatenate(scores)
        found = viterbi(counts, scores, penalty)
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), counts)
        votes = np.bincount(owner * n_lang + found, minlength=len(texts) * n_lang).reshape(len(texts), n_lang)
        pick = votes.argmax(axis=1)
        share = votes[np.arange(len(texts)), pick] / np.maximum(counts, 1)
        new = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))) if len(found) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate((new, [len(found)])))
        spans = pa.ListArray.from_arrays(np.searchsorted(owner[new], np.arange(len(texts) + 1)).astype(np.int32), pa.StructArray.from_arrays(
            [pa.array((new - first[owner[new]]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array([m.names[k] for k in found[new]], pa.string())],
            ["first_word", "n_words", "lang"]))
        return spans.cast(SPANS), [m.names[k] if c else "und" for k, c in zip(pick, counts)], share

    def run(batches):
        for batch in regroup(batches, body, TOGETHER):
            for i in range(0, batch.num_rows, 4000):
                part = batch.slice(i, 4000)
                texts = [t or "" for t in part.column(body).to_pylist()]
                if not shared.value.names:
                    spans, names, share = pa.nulls(len(texts), SPANS), ["und"] * len(texts), np.zeros(len(texts))
                else:
                    spans, names, share = label(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, spans, pa.array(names), pa.array(share)], [*carried, "lang_spans", "lang_pred", "lang_score"])

    return docs.select(*[f"`{c}`" for c in carried]).mapInArrow(run, schema)
