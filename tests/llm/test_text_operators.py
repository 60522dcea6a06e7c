"""Decontamination, personal data, language, packing, language model, quality."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import decontamination, gru, language, language_model, packing, pii, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


# --- benchmark decontamination

def brute_hits(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for name, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(body))
        n = min(window, len(w))
        grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n and name is not None else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark, docs, rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 20]
    items = [(1, " ".join(texts[0].split()[:20])), (10, texts[3].upper()), (9, "one two three"), (2, None), (3, "..."), (None, texts[5]),
             (1, " ".join(texts[2].split()[-15:])), (7, "x"), (7, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t, *_ in rows}
    for limit in (1 << 22, 200):  # one block, many blocks
        marked = decontamination.contamination(docs, bench, block_bytes=limit)
        got = {r.doc_id: r for r in decontamination.digest(marked).collect()}
        assert {i: (r.n_words, r.n_hit, r.found_items) for i, r in got.items()} == want
        for i, r in got.items():
            assert r.contaminated == (want[i][1] > 0 and 20 * want[i][1] >= want[i][0])
            assert r.items_sha256 == hashlib.sha256(",".join(want[i][2]).encode()).hexdigest()
            ends = [(a["start"], a["end"]) for a in r.hit_runs]
            assert all(a < b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
    assert sum(n > 0 for _, n, _ in want.values()) > 3


def test_decontamination_of_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.digest(decontamination.contamination(docs, none)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(empty, none).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS n_words", "2 AS item_id", "3 AS found_items", "4 AS `odd name`")
    out = decontamination.contamination(clash.unionByName(clash), none)
    assert out.count() == 2 * docs.count() and set(out.columns) == {*clash.columns, "hit_runs"}


# --- personal data

def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def card(rng):
    d = [rng.randrange(10) for _ in range(15)]
    total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-total % 10)


def private_texts():
    rng = random.Random(4)
    make = (lambda: f"{prose(rng, 1)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
            lambda: card(rng), lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}")
    texts = [" ".join(x for _ in range(3) for x in (prose(rng, 8), rng.choice(make)())) + "." for _ in range(150)]
    return texts, rng


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    pieces = ["a", "b.c", "@", ".", "1", "22", "333", "+", "-", " ", "(", ")", "x@y.z", "1.2.3.4", "256", "\n", "é", "4111111111111111", "_%", "+1 "]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(t)[0] == brute_base(t), t
    assert pii.base_spans("1" * 30000)[0] == [] and pii.base_spans("a" * 30000 + "@")[0] == []


def test_field_recovers_neighbours_and_leaves_prose():
    texts, rng = private_texts()
    model = pii.fit(texts)
    for _ in range(30):
        a, b = card(rng), card(rng)
        t = f"{prose(rng, 5)} {a} {b} {prose(rng, 5)}"
        base, _ = pii.base_spans(t)
        if not base:
            assert [t[s[1]:s[2]] for s in pii.added(t, base, model)] == [a, b]
    for t in ("version 3.0 of 2024-01-01", "1,234,567 items", "call 12 34", prose(rng, 50), 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'):
        assert pii.added(t, *pii.base_spans(t)[:1], model) == []


def test_personal_data_columns(spark, docs, empty):
    texts, _ = private_texts()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "doc_id long, text string")
    model = pii.fit(pii.sample(frame))
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(frame, model)).collect()}
    for i, t in [*enumerate(texts), (-1, ""), (-2, "")]:
        base = brute_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i].spans.split(","))or not base
    masked = {r.doc_id: r.text for r in pii.personal_data(frame, model, mark="<{}>").collect()}
    assert masked[-1] is None and all(not pii.base_spans(t)[0] for t in masked.values() if t)
    assert pii.personal_data(empty, pii.fit([])).count() == 0
    assert pii.fit(pii.sample(empty)).weights == {}
    clash = docs.selectExpr("doc_id", "text", "1 AS pii_spans", "2 AS kind")
    assert pii.personal_data(clash.unionByName(clash), model).count() == 2 * docs.count()


# --- language

def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = rng.integers(0, 6, 7)
        scores = rng.normal(0, 3, (counts.sum(), 3)).astype(np.float32)
        got, at = language.viterbi(counts, scores, 2.0), 0
        for n in counts:
            value = lambda path: sum(scores[at + i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
            best = max(value(p) for p in np.ndindex(*(3,) * n)) if n else 0
            assert math.isclose(value(got[at:at + n].tolist()), best, abs_tol=1e-3)
            at += n


def test_language_spans_and_held_out_accuracy(spark):
    rng = random.Random(6)
    inventory = {"aa": SYLL_A, "bb": SYLL_B, "cc": SYLL_C}
    rows = [(i, prose(rng, rng.randint(3, 60), inventory[lang]), lang) for i, lang in enumerate(rng.choice(list(inventory)) for _ in range(600))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.sample(frame.filter("doc_id % 3 <> 0"), "text", "lang"))
    mixed = prose(rng, 30, SYLL_A) + ". " + prose(rng, 20, SYLL_C)
    odd = [(-1, None, None), (-2, "", None), (-3, "12 !! 3", None), (-4, mixed, None), (-5, prose(rng, 9000, SYLL_B), None)]
    out = {r.doc_id: r for r in language.identify(frame.unionByName(spark.createDataFrame(odd, frame.schema)), model).collect()}
    held = [(r, lang) for i, _, lang in rows if i % 3 == 0 for r in [out[i]]]
    assert sum(r.lang_pred == lang for r, lang in held) > 0.97 * len(held)
    assert [(out[i].lang_pred, out[i].lang_score, out[i].lang_spans) for i in (-1, -2, -3)] == [("und", 0.0, [])] * 3
    assert [(s["lang"], s["n_words"]) for s in out[-4].lang_spans] == [("aa", 30), ("cc", 20)] and out[-4].lang_score == 0.6
    assert out[-5].lang_pred == "bb"


SYLL_A = "th er on an re he in ed nd ha".split()
SYLL_B = "sch ung keit ver ge lich ich zu tz pf".split()
SYLL_C = "жи ши ра но ка во ты ли".split()


def test_scripts_narrow_and_order_does_not_matter(spark, docs, empty):
    rows = [("ru", "жираф кошка"), ("el", "αβγ δεζ"), ("en", "the cat")]
    a, b = language.fit(rows), language.fit(rows[::-1])
    assert a.names == b.names and np.array_equal(a.weights, b.weights)
    n, grams, start, masks = language.features(["собака", "ωμέγα dog"])
    scores = a.scores(grams, start, masks)
    assert n.tolist() == [1, 2] and [a.names[k] for k in scores.argmax(axis=1)] == ["ru", "el", "en"]
    assert language.sample(empty, "text", "lang") == []
    none = language.fit([])
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    clash = docs.selectExpr("doc_id", "text", "1 AS lang_pred", "2 AS lang")
    assert language.identify(clash.unionByName(clash), a).count() == 2 * docs.count()


# --- packing

def test_fill_is_closest():
    rng = random.Random(9)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        capacity = rng.randint(1, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill(counts, capacity)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


def test_packed_ids_round_trip(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(100_000, "an <|endoftext|> inside", None, None, None), (None, "no id", None, None, None)]
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    pieces = packing.pack(frame, batch_bytes=20_000).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, text, *_ in [*rows, *extra]:
        want = plain.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want
        at = 0
        for p in parts:
            assert p.start == at and p.doc_tokens == len(want)
            at += p.length
    padding = total = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0 and total == sum(len(p.ids) // 4 for p in pieces)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(frame, batch_bytes=20_000)).collect()}
    assert all(crc[p.doc_id, p.start] == zlib.crc32(p.ids) for p in pieces)
    assert packing.pack(empty).count() == 0


# --- language model

def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    order, starts = gru.classes(np.array([50, 30, 20, 10, 5, 3, 2, 1.0]), 3)
    net = gru.new(np.array([50, 30, 20, 10, 5, 3, 2, 1.0])[order], starts, 4, 3)
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    words, begins = rng.integers(0, 8, 40), np.zeros(40, bool)
    begins[[0, 13, 30]] = True
    counts = np.diff(np.append(np.flatnonzero(begins), 40))
    loss = lambda: -gru.score(net, words, counts).sum()
    before = loss()
    trained, mean = gru.train(net, words, begins, rate=1e-4, streams=1, steps=40)
    assert math.isclose(mean * 40, before, rel_tol=1e-9)
    # The first update moves each weight against the sign of its derivative.
    for name in net.p:
        flat, moved = net.p[name].ravel(), (trained.p[name] - net.p[name]).ravel()
        for k in rng.choice(flat.size, min(6, flat.size), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-5
            up = loss()
            flat[k] = keep - 1e-5
            slope = (up - loss()) / 2e-5
            flat[k] = keep
            if abs(slope) > 1e-4:
                assert slope * moved[k] < 0, (name, k)


def test_state_is_carried_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 12).astype(float)
    order, starts = gru.classes(counts, 4)
    net = gru.new(counts[order], starts, 5, 4)
    words = rng.integers(0, 12, 900)
    whole = gru.score(net, words, np.array([900]))[0]
    rows, gru.ROWS = gru.ROWS, 4
    parts = gru.score(net, words, np.array([900]))[0]
    gru.ROWS = rows
    assert math.isclose(whole, parts, rel_tol=1e-5)
    states = rng.normal(0, 1, (3, 5)).astype(np.float32)
    total = sum(np.exp(gru.log_probs(net, states, np.full(3, w))) for w in range(12))
    assert np.allclose(total, 1, atol=1e-5)


def test_scores_equal_counts_and_beat_them(spark, empty):
    rng = random.Random(12)
    kinds = [SYLL_A, SYLL_B]
    rows = [(i, prose(rng, rng.randint(0, 80), rng.choice(kinds)).upper() if i % 4 == 0 else prose(rng, rng.randint(1, 80), rng.choice(kinds))) for i in range(900)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words ñ"), (1003, prose(rng, 3000, SYLL_A)), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    train = frame.filter("doc_id % 5 <> 1 OR doc_id IS NULL")
    keep = language_model.KNOWN
    language_model.KNOWN = 300  # so that many words go through the join
    try:
        got = {r.doc_id: r for r in language_model.train_and_score(frame, train).collect()}
    finally:
        language_model.KNOWN = keep
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]
    c = collections.Counter(w for i, t in rows if i is None or i % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        assert math.isclose(got[i].base_score, want, rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
    held = [got[i] for i, _ in rows if i is not None and i % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.train_and_score(empty, empty).count() == 0
    assert language_model.train_and_score(frame, empty).filter("n_known > 0").count() == 0


# --- quality rules

def brute_quality(rows, most=10):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    plain = lambda l: re.sub(r"[\x20\x09-\x0D]+", " ", l.lower()).strip(" ")  # noqa: E731, E741
    holders = collections.defaultdict(set)
    for i, t, _, host, *_ in rows:
        for l in (t or "").split("\n"):  # noqa: E741
            if words(l):
                holders[host, plain(l)].add((i, t or ""))
    common = {k: min(v, key=lambda x: x[0])[1] for k, v in holders.items() if len({i for i, _ in v}) > most}
    out = {}
    for i, t, _, host, *_ in rows:
        t = t or ""
        w = words(t)
        grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        lines = [l for l in t.split("\n") if words(l)]  # noqa: E741
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        gone = sum(len(words(l)) for l in lines if common.get((host, plain(l)), t) != t)  # noqa: E741
        left = len(w) - gone
        out[i] = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed, gone,
                  not failed and not (gone and (left < 10 or left * 100 < len(w) * 20)))
    return out


def test_quality_equals_brute_force(spark, docs, rows, empty):
    rng = random.Random(2)
    line = prose(rng, 20)
    more = [(5000 + i, line.upper() + "\n" + prose(rng, 3), "en", "host", 1) for i in range(15)] + [(6000, "a # b\n" * 30, None, None, None)]
    every = [*rows, *more]
    frame = spark.createDataFrame(every, docs.schema)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality.judge(frame).collect()}
    want = brute_quality(every)
    assert got == want and sum(w[6] > 0 for w in want.values()) >= 14
    assert {r.doc_id for r in quality.kept_documents(frame).collect()} == {i for i, w in want.items() if w[7]}
    twice = quality.judge(frame.unionByName(frame)).collect()
    assert len(twice) == 2 * len(every) and all(tuple(r[n] for n in names) == want[r.doc_id] for r in twice)
    assert quality.judge(empty).count() == 0 and quality.kept_documents(empty).count() == 0
    lone = spark.createDataFrame([(None, prose(rng, 30), None)], "doc_id long, text string, source string")
    assert quality.kept_documents(lone).count() == 1


@pytest.mark.parametrize("words", [4, 5, 6])
def test_windows_at_the_edge(spark, words):
    frame = spark.createDataFrame([(1, "a b c d e f g"[:2 * words - 1] + " z " + "a b c d e f g"[:2 * words - 1], "s")], "doc_id long, text string, source string")
    assert quality.judge(frame).first().n_repeat_words == (2 * words if words >= 5 else 0)
