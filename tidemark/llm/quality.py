"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules judge each text alone.  Then every line is normalised and hashed
with its host, distinct documents that hold it are counted per host, and lines
held by more than ``max_docs`` are removed from all but the first of them and
its exact copies; a document left with too few words is rejected.

Lines are hashed in one pass and written as narrow rows, which are then read
twice.  Counts are grouped with map-side combination, and the join that carries them
back is split by adaptive execution where one line is very common; only hashes
and counts are shuffled, never text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

BLANKS = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: Documents of one host that may share a line, and words that must be left: a count and a share in percent.
MAX_DOCS, LEAST_LEFT, LEAST_SHARE = 10, MIN_WORDS, 20


def _sorted_grams(grams: str):
    """Hashes with their places in order of hash; null where no hash repeats."""
    g = F.col(grams)
    marked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.coalesce(F.size(F.array_distinct(g)) == F.size(g), F.lit(True)), F.lit(None)).otherwise(marked)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long) and base_failed.  A null or empty text has no words and fails."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", F.array_remove(F.split(body, BLANKS), "")).withColumn("_lines", lines)
    out = (out.withColumn("n_words", F.size("_words").cast("long"))
           .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
           .withColumn("n_symbols", F.length(F.regexp_replace(body, NOT_SYMBOLS, "")).cast("long"))
           .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
           .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words", "_lines"))
    spots = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")))
    out = out.withColumn("_grams", F.transform(spots, lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))).drop("_hashes")
    out = out.withColumn("_sorted", _sorted_grams("_grams")).drop("_grams")
    # Equal hashes are neighbours now; places of those with an equal neighbour, in order.
    near = lambda x, k: F.get("_sorted", k)["h"].eqNullSafe(x["h"])
    twin = F.filter(F.transform("_sorted", lambda x, k: F.when(near(x, k - 1) | near(x, k + 1), x["i"])), lambda p: p.isNotNull())
    out = out.withColumn("_places", F.sort_array(twin)).drop("_sorted")
    covered = F.aggregate(
        "_places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED))


def line_rows(docs: DataFrame, text: str, row: str, host: str) -> DataFrame:
    """A row for each line: document, text hash, place, hash of the host and the
    line in lower case and with single blanks, and number of words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(row).alias("_row"), F.xxhash64(body).alias("_text"), F.col(host).alias("_host"), F.posexplode(F.split(body, "\n")).alias("_i", "_line"))
    lines = lines.withColumn("_plain", F.trim(F.regexp_replace(F.lower("_line"), BLANKS, " ")))
    words = F.when(F.col("_plain") == "", 0).otherwise(F.size(F.split("_plain", " ")))
    return lines.select("_row", "_text", "_i", F.xxhash64(F.col("_host").isNull(), "_host", "_plain").alias("_hash"), words.alias("_w"))


def common_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """Hashes of lines held by more than ``max_docs`` distinct documents, and the text that keeps each."""
    counts = lines.groupBy("_hash").agg(F.count_distinct(F.struct("_row")).alias("n"), F.min(F.struct("_row", "_text")).alias("_first"))
    return counts.filter(F.col("n") > max_docs).select("_hash", F.col("_first._text").alias("_home"))


def judge(docs: DataFrame, *, text: str = "text", row: str = "doc_id", host: str = "source",
          max_docs: int = MAX_DOCS, least_left: int = LEAST_LEFT, least_share: int = LEAST_SHARE) -> DataFrame:
    """A row for each row of ``docs``: its id, the columns of ``base``, the number
    of words in removed lines (n_removed_words), the places of these lines from
    0 (removed_lines, ascending), and kept.

    Rows with one id are one document for the counts, and each gets its
    verdict; exact copies under other ids are documents of their own, but those
    of the first document that holds a line keep it as it does.
    A null host is a host of its own; a null id is an id.  An empty table
    gives no rows.  Other columns are not carried."""
    # Written once for both its uses; a filter before would repeat the work on each line.
    lines = stored(line_rows(docs, text, row, host), "lines").filter("_w > 0")
    common = common_lines(lines, max_docs)
    removed = F.when(F.col("_home") != F.col("_text"), F.col("_w")).otherwise(F.lit(0))
    place = F.when(F.col("_home") != F.col("_text"), F.col("_i"))
    left = (lines.join(common, "_hash", "left").groupBy("_row", "_text")
            .agg(F.sum("_w").alias("_all"), F.sum(F.coalesce(removed, F.lit(0))).alias("_removed"), F.array_sort(F.collect_set(place)).alias("_gone")))
    own = base(docs.select(F.col(row).alias("_row"), F.col(text).alias("_body"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text")), "_body").drop("_body")
    out = own.join(left.withColumnsRenamed({"_row": "_row2", "_text": "_text2"}),
                   F.col("_row").eqNullSafe(F.col("_row2")) & (F.col("_text") == F.col("_text2")), "left")
    # Repeated rows repeat their lines, so the share is what counts.
    gone = F.coalesce((F.col("_removed") * F.col("n_words") / F.col("_all")).cast("long"), F.lit(0).cast("long"))
    out = out.withColumn("n_removed_words", gone)
    rest = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((rest < least_left) | (rest * 100 < F.col("n_words") * least_share))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        F.col("_row").alias(row), F.col("_text").alias("text_hash"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "n_removed_words", F.coalesce("_gone", F.array().cast("array<int>")).alias("removed_lines"), "kept")


def _met(docs: DataFrame, text: str, row: str, host: str, limits: dict) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the places of their removed
    lines as _gone.  Only hashes of lines and verdicts are written, never texts."""
    # Written first: pushed down, the filter would repeat the rules' nested expressions.
    verdicts = stored(judge(docs, text=text, row=row, host=host, **limits).select(
        F.col(row).alias("_row"), F.col("text_hash").alias("_text"), F.col("removed_lines").alias("_gone"), "kept"), "verdicts")
    # Rows that repeat have one verdict for each of them.
    good = verdicts.filter("kept").groupBy("_row", "_text").agg(F.first("_gone").alias("_gone"))
    match = docs[row].eqNullSafe(good["_row"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == good["_text"])
    return docs.join(good.hint("shuffle_hash"), match)


def kept_documents(docs: DataFrame, *, text: str = "text", row: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return _met(docs, text, row, host, limits).select(*[docs[c] for c in docs.columns])


def cleaned(docs: DataFrame, *, text: str = "text", row: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and
    kept_text: the text without its lines that ``judge`` names as removed.
    Other lines, blank ones too, stay as they are; a null text stays null.  A
    column that is called kept_text, in any case, is replaced."""
    met = _met(docs, text, row, host, limits)
    rest = F.filter(F.split(docs[text], "\n"), lambda x, i: ~F.array_contains("_gone", i))
    body = F.when(F.size("_gone") == 0, docs[text]).otherwise(F.array_join(rest, "\n"))
    return met.select(*[docs[c] for c in docs.columns if c.lower() != "kept_text"], body.alias("kept_text"))
