"""The corpus pipeline: quality rules, near-duplicates, personal data, source mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the
columns of ``documents``. The last returns ``doc_id, n_tokens, ids``, a row for each time the mix takes a document.

Defined results of all stages: an empty table gives an empty one; texts of any length are worked on whole; further
columns, whatever their names, are carried, by all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, minhash, mixing, pii, quality_rules
from tidepanel.llm.common import materialize
from tidepanel.llm.queries import vocabulary_path


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where they have it, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go; the others lose their failing lines, and ``n_chars`` follows the text.

    Null and empty texts have too few words and go; repeated rows, and ties at a limit, are judged alike: what reaches it fails or stays by the rule alone.
    """
    return counted(quality_rules.keep_good(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates on 5-word shingles, the document of the smallest id stays.

    Null and empty texts are in no group and stay, as rows without an id do; of repeated rows, equal in id and text, one stays.
    """
    return minhash.deduplicate(docs, k=5, threshold=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked, and ``n_chars`` follows the text. A null text stays null; repeated rows are masked alike; spans that overlap become one, named after the first."""
    return counted(pii.mask_personal_data(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null texts have size 0; a null source is a source, the last; repeated rows count each; ties in the hash order go by id and size.
    """
    return mixing.mix_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: none for a null or empty one, the same for repeated rows; there are no ties."""
    return bpe.encode(docs, vocabulary_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("personal data", personal_data_stage),
    ("source mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the sketches, the tagger and the tokens; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
