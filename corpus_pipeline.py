"""A corpus from raw documents: quality rules, near-dedup, secret scans, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where ``docs``
has the columns of documents, and returns what its stage keeps of it. All but the last
return the columns of documents. The modules of the operators are imported by the stages.

Edge cases: a null or empty text fails the quality rules; rows with a null id are judged one by one, aren't
compared as copies and stay; repeated rows become one (near dedup); texts are read whole; an empty table gives no
rows; columns beyond those of documents, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    from lodestack.llm import quality
    from lodestack.llm.common import table

    return quality.quality_filter(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    from lodestack.llm import neardup

    return neardup.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    from lodestack.llm import secrets

    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    from lodestack.llm import mixing

    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens with their texts, length buckets and batches."""
    from lodestack.llm import packing, tokencount

    return packing.pack(docs, tokencount.TOKENIZER)


STAGES = [
    ("quality rules", rules),
    ("near dedup", near_dedup),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The trees, the classes of near-duplicates and the bucket search have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and tables that are done with are removed."""
    from lodestack.llm.common import materialize, scratch, table

    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return keep(docs)
