
import math
import random

import numpy as np

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import gru, language_model, quality


def test_training_counts_every_word():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 12).astype(float)
    order, starts = gru.classes(counts, 4)
    net = gru.new(counts[order], starts, 5, 4)
    words, begins = rng.integers(0, 12, 100), np.zeros(100, bool)
    begins[[0, 34, 68]] = True  # three streams, the last one shorter
    _, mean = gru.train(net, words, begins, rate=0.0, streams=3, steps=30)
    assert math.isclose(mean * 100, -gru.score(net, words, np.array([34, 34, 32])).sum(), rel_tol=1e-5)


def test_net_is_trained_on_all_texts_to_their_end(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, 4)) for i in range(4500)] + [(9000, prose(rng, 6000)), (9001, None), (None, "no id")] + [(9100 + i, "the same") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    held, store = {}, language_model.stored
    monkeypatch.setattr(language_model, "stored", lambda df, name: held.setdefault(name, []).append(store(df, name)) or held[name][-1])
    lex = language_model.lexicon(language_model.count_words(train, "text"))
    language_model.fit(train, "text", lex, row="doc_id", shard_tokens=4000)
    total = lex.total - 1  # a null text has no words to train on
    assert sum(len(r.ids) // 4 for r in held["sample"][0].collect()) == total
    copies = held["sample"][0].groupBy("ids").agg({"shard": "approx_count_distinct", "*": "count"}).orderBy("count(1)").collect()[-1]
    assert copies["count(1)"] == 200 and copies["approx_count_distinct(shard)"] > 1
    assert [sum(r.n for r in w.collect()) for w in held["weights"]] == [total] * language_model.ROUNDS


def test_common_lines_leave_the_text(spark):
    rng = random.Random(7)
    line = "a line held by   very many texts"
    bodies = {i: f"{prose(rng, 15)}\n\n{line.upper() if i % 2 else line}\n{prose(rng, 15)}" for i in range(15)}
    rows = [(i, t, "host") for i, t in bodies.items()] + [(100, bodies[0], "host"), (101, bodies[3], "other"), (102, bodies[4], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.cleaned(frame.unionByName(frame.filter("doc_id = 5"))).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, t, _ in rows:
        want = t if i in (0, 100, 101, 102) else "\n".join(x for x in t.split("\n") if x.lower() != line)
        assert (got[i].text, got[i].kept_text) == (t, want)
    assert quality.cleaned(frame).count() == len(rows)
    n = frame.selectExpr("*", "length(text) AS n_chars")
    out = {r.doc_id: r for r in corpus_pipeline.keep_quality(spark, n, "").collect()}
    assert all((out[i].text, out[i].n_chars) == (r.kept_text, len(r.kept_text)) for i, r in got.items())
