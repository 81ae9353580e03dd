"""From raw documents to packed training sequences: language, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import discard, free_name, scratch, stored, table
from terralith.llm.language import accepted_documents
from terralith.llm.packing import default_tokenizer, pack
from terralith.llm.secrets import redact
from terralith.llm.simhash import keep_one_per_group


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the rest goes.

    Null, empty and letterless texts are of no language and go. Repeated rows stay or go
    together, rows without an id stay, ties between languages go to the first by name. Columns
    beside those of ``documents`` stay, whatever their names; an empty table stays empty.
    """
    return accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest id.

    Null and empty texts have one fingerprint and are one group. Rows that carry one id shrink
    to one of them; rows without an id stay. Further columns stay, whatever their names; an
    empty table stays empty.
    """
    return keep_one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` of the new text.

    Null and empty texts and texts without a secret stay as they are, with their ``n_chars``;
    repeated rows stay. Further columns stay, whatever their names; an empty table stays empty.
    """
    before = free_name(docs, "before")
    clean = redact(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, sources mixed by their shares.

    Null and empty texts are the end id alone, a null source is the source ''; rows with one id
    are packed one by one; other columns are not read; an empty table gives no pieces.
    """
    return pack(docs, default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Fingerprints, trained language models and token ids are beyond SQL; tests compare with a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next.

    Once a stage's rows are written, the tables it stored on the way and its own input go.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before, keep = path, []
        with scratch(spark, keep):
            docs, path = stored(stage(spark, docs, sf_dir))
            keep.append(path)
        if before:
            discard(spark, before)
    return docs
