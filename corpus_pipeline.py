"""A corpus pipeline of five stages over ``documents``: each stage keeps whole rows and hands them to the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, exact_dedup, language_id, mixing, near_dedup, queries
from docloom.session import shared_folder, small_batches, table

#: Rows that go to Python at a time. A batch is held on both sides, outside the heap, and workers keep the most they ever held.
TEXTS_AT_ONCE = 500


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that noise explains better than any learnt language.

    One rule for texts of all lengths: the bits that noise saves must outweigh the odds before reading, so one strange
    word is no evidence yet and a page of them is. A document without a language gets the one that was found. Null text
    has no letter and goes; rows that repeat are judged alike; with nothing learnt, or an empty table, nothing stays.
    """
    small_batches(spark, TEXTS_AT_ONCE)
    found = language_id.predict_column(F.col("text").cast("string"), language_id.train(docs)).alias("found")
    told = docs.select(exact_dedup.nested(docs), found)
    kept = told.filter((F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.evidence") >= -language_id.PRIOR_BITS))
    lang = F.coalesce("row.lang", "found.lang_pred")
    return kept.select(*[lang.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, whole.

    Null text is the empty text. A null doc_id stays only where its text has no other; of rows that repeat doc_id and
    text one stays, so ties don't arise. Other columns are kept, whatever their names; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that chain together at a similarity of 0.8 (sets of five-word shingles) the smallest doc_id stays, whole.

    Null text and text without a word are one group; a text of fewer words is one shingle. A null doc_id stays only where
    its group has no other; of rows that repeat doc_id and text one stays. Other columns are kept, whatever their names;
    an empty table stays empty.
    """
    small_batches(spark, TEXTS_AT_ONCE)
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it, the better ones by the labels' quality first.

    Null source is a source, null text has no words, a document without a label counts with the default weight; see
    ``mixing`` for ties and repeated rows. Other columns are kept, whatever their names; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids as little-endian unsigned 32-bit integers, one row per document of the mix.

    Null and empty texts have no ids; rows that repeat are encoded each; an empty table gives no row.
    """
    small_batches(spark, TEXTS_AT_ONCE)
    coded = bpe.encode(docs, queries.vocabulary())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: SQL can't express the language model, the fingerprints or the byte-pair merges.
ORACLE_SQL = None
