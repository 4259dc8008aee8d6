"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage works on all documents that the one before has kept, and returns the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, mixing, similar, substring
from millrace.llm.common import fold_of, read, small_batches, written

#: A text that needs so many times the phrases usual in its best language is in none of the languages.
STRANGE = 3.0


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: those without letters, and letters strung together at random."""
    small_batches(spark)
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    samples = langid.labelled_samples(docs.where(~held_out))
    # whatever the columns are called, none clashes with the operator's
    named = docs.select("doc_id", "text", *(F.col(c).alias(f"column_{i}") for i, c in enumerate(docs.columns)))
    found = langid.identify(named.drop(f"column_{docs.columns.index('text')}"), samples, keep=("text", *(f"column_{i}" for i, c in enumerate(docs.columns) if c != "text")))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("strangeness") < STRANGE))
    return kept.select(*(F.col("text" if c == "text" else f"column_{i}").alias(c) for i, c in enumerate(docs.columns)))


def by_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest id; rows without an id come last.

    Near duplicates share four fifths of their five-word shingles. SimHash components are compared first; fingerprints of
    64 bits miss most such pairs in short texts, so the operator then compares the shingles of the rest.
    """
    small_batches(spark)
    return similar.one_of_each(docs)


def by_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller id has go; documents left empty go with them."""
    small_batches(spark)
    found = substring.cut_rows(docs, tuple(docs.columns)).where("n_removed = 0 or kept_text <> ''")
    own = {c: F.col(f"column_{i}") for i, c in enumerate(docs.columns)}
    own["text"] = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.length(own["text"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(column.alias(c) for c, column in own.items()))


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item leaks go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose tokens have the target shares of source, language and topic."""
    return mixing.mix(docs).select(docs.columns)


STAGES = [
    ("language ID", by_language),
    ("SimHash near-dedup", by_simhash),
    ("substring dedup", by_substring),
    ("benchmark decontamination", by_benchmark),
    ("mixing sources to target weights", by_mixture),
]
#: Fingerprints, cross-parsing and substring runs have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
