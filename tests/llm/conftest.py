import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from tidemark.session import local_session  # noqa: E402

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


def prose(rng, words, syllables=SYLLABLES):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def corpus(seed=0, size=60):
    """Texts with copies, near copies, shared passages, odd characters, nulls and empties."""
    rng = random.Random(seed)
    passage, line = prose(rng, 30), prose(rng, 14)
    texts = []
    for i in range(size):
        t = prose(rng, rng.choice([1, 3, 8, 40, 120]))
        if i % 5 == 0 and texts and texts[-1]:
            words = texts[-1].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edit"
            t = " ".join(words)
        if i % 7 == 0:
            t = t + "\n" + passage + "\n" + t
        if i % 3 == 0:
            t = line + "\n" + t
        if i % 11 == 0 and texts:
            t = rng.choice(texts)
        texts.append(t)
    texts += [None, "", " \n\t ", "x", "aaaa " * 80, "ß…ñ " * 40, "\x00" * 120, "one two three four", prose(rng, 6000)]
    return texts


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars; columns beside text hold nulls too."""
    out = []
    for i, t in enumerate(corpus()):
        out.append((i * 3 + 1, t, None if i % 9 == 0 else ("en", "de")[i % 2], None if i % 8 == 0 else f"s{i % 3}", None if t is None else len(t)))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
