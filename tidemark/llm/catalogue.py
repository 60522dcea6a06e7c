"""Registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (decontamination, jaccard, language, language_model, lexical_search, manifest, packing, pii, preference, quality, secret_scan,
                          suffix_dedup, url_rules)
from tidemark.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.repeats(table(spark, sf_dir, "documents")))


@query
def op2_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out = language_model.train_and_score(docs, docs.filter(~held))
    return out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))


SQL["op3_jaccard"] = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2"""


@query
def op3_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


WORDS = r"[^\x20\x09-\x0D]+"
SQL["op4_quality"] = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
    lines AS (SELECT doc_id, source, t, i, l, len(regexp_extract_all(l, '{WORDS}')) AS k, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM (SELECT doc_id, source, t, i, ls[i] AS l FROM (SELECT doc_id, source, t, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY 1),
    common AS (SELECT coalesce(source, '') AS source, source IS NULL AS nosource, plain, arg_min(t, doc_id) AS home FROM lines GROUP BY ALL HAVING count(DISTINCT doc_id) > 10),
    removed AS (SELECT doc_id, sum(k) AS n, string_agg(i - 1, ',' ORDER BY i) AS places FROM lines JOIN common c ON c.plain = lines.plain AND c.source = coalesce(lines.source, '') AND c.nosource = (lines.source IS NULL) WHERE home <> t GROUP BY 1),
    b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words, coalesce(places, '') AS removed_lines FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
      n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(n_removed_words AS BIGINT) AS n_removed_words, removed_lines,
      NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR (n_words - n_removed_words) * 100 < n_words * 20)) AS kept FROM b"""


@query
def op4_quality(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents")).drop("text_hash")
    return judged.withColumn("removed_lines", F.array_join("removed_lines", ","))


@query
def op5_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = pii.personal_data(docs, pii.fit(pii.sample(docs)))
    return pii.digest(marked).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


@query
def op6_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


@query
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(language.sample(docs.filter(~held), "text", "lang"))
    out = language.identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").cast("long").alias("n_spans"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

SQL["op8_url_rules"] = f"""WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
    rules(h, b, verdict) AS (VALUES {', '.join(repr(r) for r in URL_RULES)}),
    fits AS (SELECT page_id, h || b AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || b) DESC) AS n FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b))
    SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN fits ON fits.page_id = q.page_id AND n = 1"""


@query
def op8_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


SQL["op9_preference"] = """WITH t AS (SELECT conv_id AS conv, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
    f AS (SELECT conv, arg_min(s, turn) AS opening, count(*) AS n FROM t GROUP BY 1),
    g AS (SELECT conv, first_value(conv) OVER (PARTITION BY opening ORDER BY n DESC, conv) AS chosen, count(*) OVER (PARTITION BY opening) AS members FROM f),
    a AS (SELECT conv, turn, s.text AS text, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS k FROM t WHERE s.role = 'assistant'),
    w AS (SELECT l.conv, l.turn AS last, e.text AS earlier FROM a l JOIN a e ON e.conv = l.conv AND l.k = 1 AND e.k = 2 JOIN g ON g.conv = l.conv AND members = 1),
    c AS (SELECT chosen, g.conv AS rejected, 'sibling' AS kind, turn, s FROM g JOIN t ON t.conv = chosen WHERE g.conv <> chosen UNION ALL SELECT w.conv, w.conv, 'swap', turn, s FROM w JOIN t ON t.conv = w.conv),
    r AS (SELECT chosen, g.conv AS rejected, 'sibling' AS kind, turn, s FROM g JOIN t ON t.conv = g.conv WHERE g.conv <> chosen UNION ALL
      SELECT w.conv, w.conv, 'swap', turn, {'role': s.role, 'text': CASE WHEN turn = last THEN earlier ELSE s.text END} FROM w JOIN t ON t.conv = w.conv),
    u AS (SELECT coalesce(c.chosen, r.chosen) AS chosen, coalesce(c.rejected, r.rejected) AS rejected, coalesce(c.kind, r.kind) AS kind, coalesce(c.turn, r.turn) AS turn, c.s AS c, r.s AS r
      FROM c FULL JOIN r ON c.chosen = r.chosen AND c.rejected = r.rejected AND c.kind = r.kind AND c.turn = r.turn),
    m AS (SELECT *, min(CASE WHEN c IS DISTINCT FROM r THEN turn END) OVER (PARTITION BY chosen, rejected, kind) AS split FROM u),
    o AS (SELECT chosen, rejected, kind, 'prompt' AS part, turn, c AS s FROM m WHERE split IS NULL OR turn < split UNION ALL SELECT chosen, rejected, kind, 'chosen', turn, c FROM m WHERE turn >= split AND c IS NOT NULL
      UNION ALL SELECT chosen, rejected, kind, 'rejected', turn, r FROM m WHERE turn >= split AND r IS NOT NULL)
    SELECT chosen, rejected, kind, part, turn, s.role AS role, '<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) AS rendered,
      CAST(CASE WHEN part <> 'prompt' AND s.role = 'assistant' THEN length(s.role) + 13 ELSE 0 END AS BIGINT) AS train_start,
      CAST(CASE WHEN part <> 'prompt' AND s.role = 'assistant' THEN length(s.role) + 13 + length(s.text) + 10 ELSE 0 END AS BIGINT) AS train_end FROM o"""


@query
def op9_preference(spark, sf_dir):
    return preference.preference_format(table(spark, sf_dir, "conversations"))


SQL["op10_decontamination"] = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.n = dw.n),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query
def op10_decontamination(spark, sf_dir):
    marked = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(marked).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL["op11_lexical_search"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS w FROM documents),
    q AS (SELECT item_id, text, term, count(*) AS c FROM (SELECT item_id, text, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
    s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
    t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, s GROUP BY term, docs),
    m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * docs) // terms AS m FROM d, s WHERE terms > 0),
    z AS (SELECT item_id, text, doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
    o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM z WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20"""


@query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_line_breaks(row: str, text: str):
    """The text without its line breaks where 2 divides the checksum of its row's id."""
    even = F.crc32(F.col(row).cast("string")) % 2 == 0
    return F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))


def _field(name):
    return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(text):
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_PARENTS = "list_transform(range(0, len(ns), 3), lambda i: sha256(array_to_string(ns[i + 1:i + 3], '')))"
_SIDES = "array_to_string(ns[p - p % 3 + 1:p], '') AS a, array_to_string(ns[p + 2:p - p % 3 + 3], '') AS b"
# The checksum's polynomial, reflected, is 3988292384; SQL has bits but no checksum.
SQL["op12_manifest"] = f"""WITH RECURSIVE c8 AS (SELECT CAST(range AS BIGINT) AS n, 0 AS k, CAST(range AS BIGINT) AS c FROM range(256)
      UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM c8 WHERE k < 8),
    tab AS (SELECT list(c ORDER BY n) AS t FROM c8 WHERE k = 8),
    crc AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
      UNION ALL SELECT doc_id, s, i + 1, xor(t[CAST(xor(c, CAST(ascii(s[i]) AS BIGINT)) & 255 AS INTEGER) + 1], c >> 8) FROM crc, tab WHERE i <= length(s)),
    even AS (SELECT doc_id FROM crc WHERE i = length(s) + 1 AND xor(c, 4294967295) % 2 = 0),
    d AS (SELECT d.*, CASE WHEN e.doc_id IS NULL THEN text ELSE replace(text, chr(10), '') END AS shown FROM documents d LEFT JOIN even e ON e.doc_id = d.doc_id),
    h AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf('shown')} AS presented FROM d),
    l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS r FROM h),
    tree AS (SELECT source, 0 AS k, list(leaf ORDER BY pos) AS ns FROM l GROUP BY source UNION ALL SELECT source, k + 1, {_PARENTS} FROM tree WHERE len(ns) > 1),
    subs AS (SELECT source, ns[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE len(ns) = 1),
    tops AS (SELECT 0 AS k, list(subroot ORDER BY pos) AS ns FROM subs UNION ALL SELECT k + 1, {_PARENTS} FROM tops WHERE len(ns) > 1),
    steps AS (SELECT r, k, {_SIDES} FROM (SELECT r, k, ns, CAST(pos // CAST(3 ** k AS BIGINT) AS BIGINT) AS p FROM l JOIN tree t ON t.source IS NOT DISTINCT FROM l.source WHERE len(ns) > 1)
      UNION ALL SELECT r, 100 + k, {_SIDES} FROM (SELECT r, k, ns, CAST(s.pos // CAST(3 ** k AS BIGINT) AS BIGINT) AS p FROM l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source, tops WHERE len(ns) > 1)),
    way AS (SELECT r, list(a ORDER BY k) AS a, list(b ORDER BY k) AS b, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY r),
    fold AS (SELECT r, 0 AS k, presented AS node FROM l UNION ALL SELECT f.r, f.k + 1, sha256(a[f.k + 1] || node || b[f.k + 1]) FROM fold f JOIN way w ON w.r = f.r AND f.k < len(a))
    SELECT doc_id, leaf, subroot, (SELECT ns[1] FROM tops WHERE len(ns) = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, node AS folded_root,
      node = (SELECT ns[1] FROM tops WHERE len(ns) = 1) AS verified
    FROM l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN way w ON w.r = l.r JOIN fold f ON f.r = l.r AND f.k = coalesce(len(w.a), 0)"""


@query
def op12_manifest(spark, sf_dir):
    proved = manifest.manifest(table(spark, sf_dir, "documents"), tampered=without_line_breaks("doc_id", "text"))
    return manifest.digest(proved).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _quoted(x):
    return "'" + x.replace("'", "''") + "'"


def _found(pattern, group):
    """Matches with the group's text and their place, from the lengths of what lies between."""
    lengths = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    start = f"CAST({lengths.format('g[1:i]')} + {lengths.format('m[1:i - 1]')} AS BIGINT)"
    return f"""SELECT r, b[i] AS body, {start} AS s, {start} + length(m[i]) AS e FROM (SELECT r, m, b, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r,
      regexp_extract_all(t, {_quoted(pattern)}, 0) AS m, regexp_extract_all(t, {_quoted(pattern)}, {group}) AS b, string_split_regex(t, {_quoted(pattern)}) AS g FROM d))"""


def _dense(c):
    terms = f"[{', '.join(map(str, c.terms))}]"
    total = f"list_sum(list_transform(list_distinct(string_split(win, '')), lambda ch: {terms}[CAST({c.window} - length(replace(win, ch, '')) + 1 AS INTEGER)]))"
    return f"""SELECT r, {secret_scan.KINDS.index(c.kind)} AS k, min(j) AS s, max(j) + {c.window} AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY r, place ORDER BY j) AS island FROM (
      SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY r, place ORDER BY j) <= {c.window} THEN 0 ELSE 1 END AS fresh FROM (
      SELECT r, s AS place, s + j AS j, substr(body, CAST(j + 1 AS INTEGER), {c.window}) AS win FROM (SELECT r, s, body, unnest(range(0, length(body) - {c.window} + 1)) AS j FROM worth
        WHERE {"" if c is secret_scan.HEXADECIMAL else "NOT "}regexp_matches(body, '^[0-9A-Fa-f]+$') AND length(body) >= {c.window}))
      WHERE regexp_matches(win, '[0-9]') AND regexp_matches(win, '[^0-9]') AND {total} <= {c.most})) GROUP BY r, place, island"""


_SPANS = "string_agg([" + ", ".join(map(_quoted, secret_scan.KINDS)) + "][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
SQL["op13_secret_scan"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({" UNION ALL ".join(f"SELECT r, {k} AS k, s, e FROM ({_found(p, g)}) WHERE length(body) >= {n}" for k, (p, g, n) in enumerate(secret_scan.BASE.values()))}),
    worth AS (SELECT * FROM ({_found(secret_scan.CANDIDATE, 0)}) WHERE regexp_matches(body, '[0-9]')
      AND NOT list_bool_and(list_transform(string_split_regex(body, {_quoted(secret_scan.SEPARATORS)}), lambda p: regexp_matches(p, {_quoted(secret_scan.WORD)})))
      {" ".join(f"AND NOT regexp_matches(body, {_quoted(p)})" for p in secret_scan.ALLOWED)}),
    more AS ({" UNION ALL ".join(_dense(c) for c in secret_scan.CLASSES)}),
    spans AS (SELECT r, k, s, e FROM base UNION ALL SELECT r, k, s, e FROM more WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = more.r AND b.s <= more.s AND b.e >= more.e)),
    n AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_SPANS} AS spans FROM base GROUP BY r),
    a AS (SELECT r, {_SPANS} AS spans FROM spans GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(n.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
    FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN a ON a.r = d.r"""


@query
def op13_secret_scan(spark, sf_dir):
    scanned = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digest(scanned).select("doc_id", *[f"n_{k}" for k in secret_scan.BASE], "base_sha256", "spans")
