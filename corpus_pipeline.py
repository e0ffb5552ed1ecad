"""Documents to training sequences: quality rules, near-duplicates, personal data, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's input, so a lost executor costs at most the stage that runs.

Edge cases, for every stage: null and empty texts have no words, so the quality rules reject them, and later stages take them as
empty; rows without an id or a source stay rows of their own; repeated rows are judged alike, near-dedup leaves one
of each id, and what is left is mixed and packed row by row; an empty table gives an empty one; further columns pass through
unchanged whatever their names, and the last stage returns pieces instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import common, mixing, packing, pii, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the full policy rejects go; null texts have no words and go too."""
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Groups are op1's: four-word shingles, links at 4 bits or fewer.  Rows without an id have no group and stay.
    """
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows, and is null where the text is."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those it doesn't take are not in its result."""
    mixed = mixing.mix(docs, [3, 1, 2], quality=mixing.quality_weights(spark, sf_dir))
    return mixing.repeat_rows(docs, mixed)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into as few sequences as possible."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("best-fit packing", sequences),
]

#: SQL can express neither the fingerprints nor the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = common.stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
