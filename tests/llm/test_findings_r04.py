"""What the fourth round found: work that grew faster than the input."""

import random
import re

import numpy as np
import pytest

from tests.llm.test_duplicates import brute_repeats, got_repeats
from tidemark.llm import pii, quality, suffix_dedup
from tidemark.llm.store import stored


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_passages_shorter_than_a_string_are_not_fetched(spark):
    """Documents that share 24 bytes, too few for a string, share smallest hashes all the same."""
    rng = random.Random(4)
    phrases = [letters(rng, 24) for _ in range(5)]
    short = [(i, letters(rng, 60).join(phrases) + letters(rng, 60)) for i in range(40)]
    found = suffix_dedup._candidates(spark.createDataFrame(short, "doc_id long, text string"), "text", "doc_id")
    assert found.count() == 0
    long = letters(rng, 50)
    whole = short + [(50, letters(rng, 60) + long + letters(rng, 60)), (51, letters(rng, 60) + long + letters(rng, 60))]
    found = suffix_dedup._candidates(spark.createDataFrame(whole, "doc_id long, text string"), "text", "doc_id")
    assert {r.doc for r in found.collect()} == {50, 51}


@pytest.mark.parametrize("period", [1, 3, 16, 17, 35, 60])
def test_texts_of_a_period_equal_brute_force(spark, period, monkeypatch):
    """A smallest hash that comes again within a string, or within a segment."""
    rng = random.Random(period)
    unit, rows = letters(rng, period), []
    for i in range(12):
        at = rng.randrange(period)
        same = (unit * 900)[at:at + rng.choice((45, 50, 51, 70, 130, 700))]
        rows.append((rng.randrange(1000) * 20 + i, letters(rng, rng.randrange(80)) + same + letters(rng, rng.randrange(80))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_repeats(docs) == brute_repeats(rows)


def test_sides_of_equal_strings_agree():
    """Any two segments that hold an equal string are told to be compared."""
    rng = random.Random(9)
    for alphabet in ("ab", "abc", "abcdefgh"):
        text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))  # noqa: B023, E731
        shared = [text(rng.randrange(50, 90)) for _ in range(6)]
        texts = ["".join(text(rng.randrange(40)) + rng.choice(shared) for _ in range(4)) + text(30) for _ in range(30)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        held = {}
        for begin, number, h, _, left, right in zip(*suffix_dedup.segments(data, offsets)):
            for p in range(begin, begin + number):
                held.setdefault(data[p:p + 50].tobytes(), []).append((h, left, right))
        assert any(len(x) > 1 for x in held.values())
        for (h, left, right), *others in held.values():
            for h2, left2, right2 in others:
                assert h == h2 and (0 < left == left2 or 0 < right == right2 or left == right == 0 or left2 == right2 == 0)


def test_lines_are_hashed_in_one_pass(spark, docs):
    """Counting common lines and finding them again read the same written rows, not the texts."""
    plan = quality.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp_replace(lower" not in plan.replace(" ", "")


def test_words_of_a_line_by_its_plain_form(spark):
    """Blanks of any kind separate words; a line of blanks has none."""
    lines = ["one", " \t one  Two\x0b", "\x0c \r", "", "  Ü\tß x ", "a\x00b c"]
    docs = spark.createDataFrame([(1, "\n".join(lines), "s")], "doc_id long, text string, source string")
    got = {r._i: r._w for r in quality.line_rows(docs, "text", "doc_id", "source").collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", x)) for i, x in enumerate(lines)}


def test_sample_searches_the_texts_once(spark, docs, rows, monkeypatch):
    written = []
    monkeypatch.setattr(pii, "stored", lambda df, name: written.append(df.columns) or stored(df, name))
    texts = sorted({r[1] for r in rows if r[1] and re.search("[0-9@]", r[1])} | {"call 1", "a@b.c"})
    more = docs.unionByName(spark.createDataFrame([(t, t) for t in texts + ["none"]], "id string, text string"), allowMissingColumns=True)
    assert pii.sample(more) == texts
    assert written == [["h", "n"]]
