"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame; all but
the last keep the columns of ``documents``. Empty tables pass through as empty. A null text is an empty one
that stays null until it is encoded, to no tokens; a null id stays in every stage; repeated rows with
an id are copies of each other only in their texts, and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, jaccard, mixing, pii, toxicity, words


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more for toxicity go. Labels of ``sf_dir`` train the tagger."""
    tagger = toxicity.train(docs, words.read(spark, sf_dir, "labels"))
    return toxicity.score(docs, tagger, keep_text=True).filter(F.col("tox_score") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the smallest id stays."""
    return jaccard.first_of_each(docs, percent=80, k=5)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: written files follow it from first to last. A null
    source is one of its own."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the hash of the text that they decode to, with the
    document's ``position`` in the mixture: a table that is read again has no order of its own. A null text
    has no tokens."""
    placed = mixing.schedule(docs).drop("block", "slot").withColumnRenamed("seq", "position")
    return bpe.tokenized(placed).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Tagging and encoding cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored before the next reads it."""
    docs = words.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = words.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
