"""Lexical search against plain Python."""

import math
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=20):
    found = [(i, terms(t)) for i, t in docs]
    N, L = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        query, scored = terms(text), []
        for doc, w in found:
            if not w:
                continue
            m = 75 + 25 * len(w) * N // L
            score = 0
            for t in query:
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, k + 1, d if there else None, -s) for k, (s, there, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def data():
    rng = random.Random(11)
    words = prose(rng, 60).split(" ") + ["é", "naïve", "x1", "日本", "a b", "UPPER"]
    text = lambda n: rng.choice([" ", "  ", "\n", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [(rng.randrange(10 ** 12), text(rng.choice([1, 2, 5, 40, 300]))) for _ in range(150)]
    docs += [(None, text(30)), (5, None), (6, ""), (7, " .,\n"), (8, "the"), (9, "x1" * 40000), (10, text(20000))]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [docs[4]] * 3 + [(docs[4][0], text(12))]
    items = [(i, text(rng.choice([1, 3, 20]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "..."), (103, "no such term as zzzzq"), (104, "é " * 40), items[0], (None, "x1 naïve"), (105, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [lexical_search.BLOCK_BYTES, 400])
def test_search_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical_search, "HELD", 64)  # several steps for each text
    docs, items = data()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, rank int").repartition(5)
    got = lexical_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_text_ids_few_rows_and_empty_tables(spark, empty):
    docs, items = data()
    docs = [(None if i is None else f"d{i}", t) for i, t in docs]
    frame, asked = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical_search.search(frame, asked, top=3).collect()]
    assert len(got) == len({g[:2] for g in got}) and {g[1] for g in got} == {1, 2, 3}
    assert {(g[0], g[1], g[3]) for g in got} == {(b[0], b[1], b[3]) for b in brute([(i, t) for i, t in data()[0]], items, 3)}
    assert lexical_search.search(empty, asked).count() == 0
    assert lexical_search.search(frame, asked.limit(0)).count() == 0
    assert lexical_search.search(frame, spark.createDataFrame([(1, " - ")], "item_id long, text string")).count() == 0


def test_best_rows_do_not_depend_on_the_order_of_batches():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    scored, ids = rng.integers(0, 6, (400, 3)), rng.permutation(400)
    want = None
    for cut in (400, 7, 50):
        best = lexical_search.Best(3, 5, pa.int64())
        order = rng.permutation(400)
        for i in range(0, 400, cut):
            best.add(scored[order[i:i + cut]], pa.array(ids[order[i:i + cut]]))
            best.settle()
        rows = best.settle().to_pylist()
        assert want is None or rows == want
        want = rows
    assert len(want) == 15 and all(r["score"] == 5 for r in want)
