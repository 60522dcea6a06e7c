"""From documents to packed sequences: quality rules, near duplicates, benchmark
decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, packing, pii, quality
from tidemark.llm.store import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line frequencies keep, without common lines.

    A null or empty text fails the base rules.  Rows that repeat have one
    verdict each, ties for the first document of a line go to the smaller id,
    nulls first.  n_chars follows a changed text.  All columns are carried."""
    kept = quality.cleaned(docs)
    changed = ~F.col("kept_text").eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).withColumn("text", F.col("kept_text")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates.

    Texts without words are alone in their group and stay; of rows that repeat
    an id one stays; rows with a null id stay, equal ones once, unless an equal
    text has an id.  All columns are carried."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words in benchmark windows.

    Null and wordless texts stay, rows that repeat too; an empty benchmark
    drops nothing.  All columns are carried."""
    marked = decontamination.digest(decontamination.contamination(docs, table(spark, sf_dir, "benchmark")))
    return marked.filter(~F.col("contaminated")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind.

    Null and empty texts stay as they are, rows that repeat are masked alike;
    n_chars follows a changed text.  All columns are carried."""
    marked = pii.personal_data(docs, pii.fit(pii.sample(docs)), mark="<{}>")
    n_chars = F.when(F.size("pii_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n_chars).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences.

    A null or empty text is its end alone; rows that repeat are packed each.
    An empty table gives no pieces."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality rules", keep_quality), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal data", mask_personal_data), ("packing", pack_sequences)]

#: The field of personal data and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
