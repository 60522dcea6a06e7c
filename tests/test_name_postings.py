"""Containment of names by postings of short sequences."""

import random

from tidemark.operators.contribution import match_names


def test_matches_equal_a_search_of_every_name(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc、 ") for _ in range(n))
    weights = [(word(rng.randint(1, 30)), i) for i in range(80)] + [("x" * 5000 + "needle" + "y" * 5000, 200), (None, 3), ("", 4)]
    names = [word(rng.randint(1, 5)) for _ in range(60)] + ["needle", "nee、dle", "absent", "", "z"]
    plain = lambda t: "".join(c for c in t if c not in "、，。及和的 　")
    want = {}
    for n in set(names):
        fits = [(loose, pos, w) for w, pos in weights if w is not None for loose, (a, b) in enumerate(((w, n), (plain(w), plain(n)))) if b and b in a]
        if fits:
            want[n] = min(fits)[2]
    got = match_names(spark.createDataFrame([(n,) for n in names], "industry string"), spark.createDataFrame(weights, "indicator string, pos int"))
    assert {r.industry: r.indicator for r in got.collect()} == want
