"""Suffix arrays and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import corpus, prose
from tidemark.llm import jaccard, suffix_dedup


def brute_repeats(rows, span=50):
    first, out = {}, {}
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, text, *_ in ordered:
        b = (text or "").encode()
        for p in range(len(b) - span + 1):
            first.setdefault(b[p:p + span], i)
    for i, text, *_ in ordered:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - span + 1):
            if first[b[p:p + span]] < i:
                gone[p:p + span] = [True] * span
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def got_repeats(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.repeats(docs)).collect()}


@pytest.mark.parametrize("share", [4096, 1])
def test_repeats_equal_brute_force(docs, rows, share, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)  # 1 splits every hash over shards
    assert got_repeats(docs) == brute_repeats(rows)


def test_repeats_of_odd_tables(spark, docs, empty):
    assert suffix_dedup.repeats(empty).count() == 0
    twice = got_repeats(docs.unionByName(docs))
    assert twice == got_repeats(docs)
    lone = spark.createDataFrame([(None, "q" * 200), (5, "q" * 200)], "doc_id long, text string")
    assert got_repeats(lone)[None][1] == 0 and got_repeats(lone)[5][1] == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS start", "2 AS h", "3 AS kept_bytes", "4 AS doc", "5 AS parts")
    assert got_repeats(clash) == got_repeats(docs)


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for alphabet, n in (("ab", 300), ("a", 100), ("abcdef", 500)):
        raw = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        text = np.frombuffer(raw, np.uint8)
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(text, sa, np.array([0, n // 2]), np.array([n // 2, n - n // 2]), 20)
        for k in range(1, n):
            a, b = raw[sa[k - 1]:], raw[sa[k]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[sa[k]] == min(20, same)


def test_merging_by_binary_search():
    a = (np.array([b"aa", b"cc"]), np.array([5, 6]))
    b = (np.array([b"aa", b"bb", b"dd"]), np.array([3, 9, 4]))
    keys, least = suffix_dedup.merge_sorted([a, b])
    assert keys.tolist() == [b"aa", b"bb", b"cc", b"dd"] and least.tolist() == [3, 9, 6, 4]


def shingles(text, n=5):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def got_components(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}


def test_components_equal_brute_force(docs, rows):
    assert got_components(docs) == brute_components(rows)


def test_components_of_a_family(spark):
    """Edits of one text, not all similar to each other, and texts that share only a passage."""
    rng = random.Random(8)
    base, shared = prose(rng, 150).split(" "), prose(rng, 40)
    texts = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [prose(rng, rng.randint(10, 60)) + "\n" + shared for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_components_of_odd_tables(spark, docs, empty, rows):
    assert jaccard.near_duplicates(empty).count() == 0
    assert got_components(docs.unionByName(docs)) == brute_components(rows)
    lone = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "z"), (6, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(lone).collect()}
    assert got == {(None, 2): 5, (5, 2): 5, (None, 1): None, (6, 0): 6}
    assert jaccard.one_of_each(lone).count() == 3


def test_signature_bound():
    """Sets at the least similarity agree on at least as many signatures as needed."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 4, 5, 9, 10, 33, 100, 101, 400):
        for _ in range(20):
            both = rng.integers(0, 1 << 62, size, dtype=np.uint64)
            keep = -(-4 * size // 5)  # |A and B| / |A or B| with B a part of A
            a, b = np.unique(both), np.unique(both[:keep])
            v, s, need = jaccard.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]))
            shared = len(set(v[s == 0].tolist()) & set(v[s == 1].tolist()))
            assert shared >= max(need), (size, shared, need)
