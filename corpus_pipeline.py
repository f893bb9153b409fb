"""Corpus pipeline: toxic documents out, one of each group of near copies, repeated passages cut, benchmark leaks out, ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents; the last returns the ids and what they decode to by its digest.
In every stage an empty table gives an empty one, texts of any length are taken whole, and columns beside doc_id and text,
whatever their names, are carried along and not read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, common, decontaminate, ngram_jaccard, substring_dedup, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go; they learn from the labelled rows that came in.

    Null and empty texts score what a document without evidence does; without labels of both classes nothing goes but what
    the share of toxic labels decides for all; a score of 0.5 is toxic; repeated rows go or stay together; of rows that share
    a doc_id, or have none, each goes for its own text.
    """
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, that with the smallest doc_id stays.

    Null, empty and blank texts are linked with nothing and stay; of equal doc_ids, and where all are null, a hash of the
    text decides; of rows that repeat doc_id and text one stays.
    """
    return ngram_jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words go from the texts; all documents stay.

    Null and empty texts, and texts without repeats, stay as they are; others become their kept words joined by one space,
    which may be the empty text; repeated rows are repeats of one another, with or without a doc_id.
    """
    return substring_dedup.remove_repeats(docs)


def reject_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a piece of a benchmark item go.

    Null and empty texts hold none and stay; an empty benchmark removes nothing; repeated rows go or stay together; of rows
    that share a doc_id, or have none, each goes for its own text.
    """
    return decontaminate.drop_leaked(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and the digest of the decoded bytes, for every row; null and empty texts have no ids."""
    found = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontaminate", reject_leaked),
    ("byte_bpe", encode),
]

#: Language models, similarity links and byte-pair merges are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's table goes once the next is written."""
    work, docs, last = common.Scratch(spark), common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        docs = work.write(found, name)
        common.finished(found)
        if last is not None:
            work.release(last)
        last = docs
    return docs
