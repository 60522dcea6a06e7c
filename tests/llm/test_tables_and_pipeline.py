"""URL rules, preference pairs, registered SQL, and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_duplicates import brute_components
from tests.llm.test_text_operators import brute_base, brute_hits, brute_quality
from tidemark.llm import packing, pii, preference, url_rules
from tidemark.llm.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


# --- url rules

def brute_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "a.com.org", "org", "A.Com", "c.b.a.com", "a.com:80", ""]
    paths = ["", "/", "/en/", "/en", "/en/x", "/e", "?q", "#f", "/en/?q#f", "/\n/en/"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += ["http://a.com/en/x"] * 300 + [None, "", "no scheme", "://", "a://b://c/d", "http://é.com/ü"]
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("b.a.com", "/en/", "allow"), ("org", "", "block"), ("a.com", "/en/x", "allow"),
             ("com", "/en/", "block"), ("com", "/en/", "allow"), ("com", "/en/", "block"), (None, "/", "block"), ("a.com", None, "block")]
    pages = spark.createDataFrame([(None if i == 7 else i * 10 ** 15, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in url_rules.judge(pages, table).select("host", "path", F_null("rule"), "verdict").collect())
    want = sorted((h, p, r or "", v) for h, p, r, v in (brute_rule(u, [r for r in rules if None not in r]) for u in urls))
    assert got == want
    ids = {r.page_id for r in url_rules.judge(pages, table).collect()}
    assert ids == {None if i == 7 else i * 10 ** 15 for i in range(len(urls))}
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, table.limit(0)).collect()} == {"allow"}


def F_null(name):
    from pyspark.sql import functions as F
    return F.coalesce(name, F.lit("")).alias(name)


# --- preference pairs

def test_preferences(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"),
             (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "other"),
             (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 2, "user", "r"), (3, 3, "assistant", "b"),
             (4, 0, None, "solo"), (4, 1, "assistant", "x"), (4, 2, "user", None), (4, 3, "assistant", "y"), (4, 3, "assistant", "y"),
             (5, 0, "user", "alone"), (None, 0, "user", "q"), (6, None, "user", "q")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = preference.preference_format(frame).collect()
    got = {(r.chosen, r.rejected, r.kind, r.part, r.turn): r for r in rows}
    assert {k[:3] for k in got} == {(1, 2, "sibling"), (1, 3, "sibling"), (4, 4, "swap")}
    assert {k[3:] for k in got if k[1] == 2} == {("prompt", 0), ("prompt", 1), ("chosen", 2), ("chosen", 3), ("rejected", 2)}
    assert {k[3:] for k in got if k[1] == 3} == {("prompt", t) for t in range(4)}
    assert {k[3:] for k in got if k[0] == 4} == {("prompt", 0), ("prompt", 1), ("prompt", 2), ("chosen", 3), ("rejected", 3)}
    best, worse = got[4, 4, "swap", "chosen", 3], got[4, 4, "swap", "rejected", 3]
    assert best.rendered == "<|im_start|>assistant\ny<|im_end|>\n" and best.rendered[best.train_start:best.train_end] == "y<|im_end|>"
    assert worse.rendered[worse.train_start:worse.train_end] == "x<|im_end|>"
    assert all(r.train_end == 0 for r in rows if r.part == "prompt" or r.role != "assistant")
    assert preference.preference_format(frame.limit(0)).count() == 0


# --- registered queries against their SQL

@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall(), key=key)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == want and want


def test_language_query_holds_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op7_language"](spark, DATA).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


# --- pipeline

def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    every = lambda df: {r.doc_id: tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()}
    for (name, stage), step in zip(corpus_pipeline.STAGES[:4], range(4)):
        before = every(docs)
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = every(docs)
        if step == 0:
            assert set(after) == {i for i, q in brute_quality(list(before.values())).items() if q[7]}
        elif step == 1:
            assert set(after) == {i for i, (_, c) in brute_components(list(before.values())).items() if i == c}
        elif step == 2:
            hits = {i: brute_hits(r[1], items) for i, r in before.items()}
            assert set(after) == {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
        else:
            assert set(after) == set(before)
            for i, r in before.items():
                if not pii.TRIGGER.search(r[1]):
                    assert after[i] == r
                assert not brute_base(after[i][1]) and len(after[i][1]) == after[i][4]
            break
        assert all(after[i] == before[i] for i in after)
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(list(after.values()), docs.schema), DATA).collect()
    enc = packing.encoder("byte_bpe_50k.json")
    for p in packed:
        ids = np.append(enc.ids(after[p.doc_id][1]), np.uint32(1)).astype("<u4")
        assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids)


def test_pipeline_runs_and_takes_odd_rows(spark, docs, empty):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
    extra = docs.selectExpr("*", "1 AS label", "'x' AS _text2", "2 AS component").unionByName(docs.selectExpr("*", "1 AS label", "'x' AS _text2", "2 AS component"))
    rng = random.Random(3)
    odd = spark.createDataFrame([(None, prose(rng, 40), None, None, None, 1, "x", 2)], extra.schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, extra.unionByName(odd), DATA)
        assert set(extra.columns) <= set(out.columns), name
        assert out.filter("doc_id IS NULL").count() == 1, name


# --- lines that many documents of a host share

def test_copies_count_as_documents_and_few_words_left_are_depleted(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import quality
    rng = random.Random(3)
    line = prose(rng, 12)
    copy = f"{line}\n{prose(rng, 20)}"
    rows = [(i, copy, "h") for i in range(30)] + [(100, f"{prose(rng, 30)}\n{line.upper()}", "h"), (101, f"{line}\na few words", "h"), (102, copy, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Kept_Text", F.lit("clash"))
    got = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert all(got[i].kept and not got[i].removed_lines for i in [*range(30), 102])  # the first and its copies
    assert got[100].removed_lines == [1] and got[100].kept and got[101].removed_lines == [0] and not got[101].kept
    out = quality.cleaned(frame)
    assert out.columns == ["doc_id", "text", "source", "kept_text"]
    assert {r.doc_id: r.kept_text for r in out.collect()}[100] == rows[30][1].split("\n")[0]


def test_removed_lines_do_not_reach_the_packed_output(spark, tmp_path):
    rng = random.Random(5)
    line = prose(rng, 25)
    rows = [(i, f"{prose(rng, 40)}\n{line}\n{prose(rng, 40)}", "en", "h", 1) for i in range(14)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokens = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    plain = {r.doc_id: r.doc_tokens for r in packing.digest(packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()}
    assert set(tokens) == set(plain) and tokens[0] == plain[0]
    assert all(tokens[i] < plain[i] - 25 for i in range(1, 14))


# --- samples to learn from

def test_every_language_and_long_texts_are_learned_from(spark, monkeypatch):
    from tidemark.llm import language
    rng = random.Random(9)
    rows = [(f"l{k:03d}", prose(rng, 6)) for k in range(300)] + [("l000", "the same")] * 500 + [("l000", prose(rng, 5)) for _ in range(40)] + [(None, "x"), ("l1", None)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    got = language.sample(frame, "text", "lang", size=3)
    assert {name for name, _ in got} == {name for name, t in rows if name and t}
    assert len(got) == len(set(got)) and got == language.sample(frame.repartition(7), "text", "lang", size=3)
    assert max(sum(1 for g in got if g[0] == name) for name in ("l000", "l001")) <= 3
    few = language.sample(frame, "text", "lang", size=3, most_texts=10)
    assert {name for name, _ in few} == {name for name, _ in got} and len(few) == 300
    long = prose(rng, 9000) + " 10.0.0.1"
    texts = spark.createDataFrame([(long,), ("a 1",), ("a 1",), ("no digit",), (None,)], "text string")
    assert pii.sample(texts) == sorted([long, "a 1"])
    assert len(pii.sample(texts, most_bytes=10)) == 1


def test_columns_that_clash_in_another_case_are_replaced(spark):
    from tidemark.llm import decontamination, language
    frame = spark.createDataFrame([(1, "ask a@b.co", "x", "y", "z")], "doc_id long, text string, PII_SPANS string, Lang_Pred string, N_Words string")
    marked = pii.digest(pii.personal_data(frame, pii.fit([])))
    assert [s.kind for s in marked.first().pii_spans] == ["email"]
    assert language.identify(frame, language.fit([("en", "some words")])).first().lang_pred == "en"
    items = spark.createDataFrame([(1, "ask a b")], "item_id long, text string")
    assert decontamination.contamination(frame, items).select("n_words").first().n_words == 4
