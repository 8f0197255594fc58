"""A corpus pipeline over the table documents: each stage is written as Parquet and read again as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, strings that repeat across what is left are cut out,
personal data get surrogates, and the rest is packed into sequences.  All stages but the last return the columns of
documents, whatever other columns come in; every stage makes an empty table an empty one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, minhash, packing, pii, suffix, toxicity
from lexiloom.llm.common import DOC_COLUMNS, saved, table

#: Bytes of a string that counts as a repeated passage.  Passages of over 50 words have as many where a word and what
#: follows it come to four bytes on average; passages of shorter words (51 of one letter have 101 bytes) can fall short.
PASSAGE = 200
#: Least similarity of near duplicates, in percent of shingles; op1's own contract is tighter.
ALIKE = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a grammar learned from the labels that are not held out.

    Null and empty texts stay, having nothing toxic; of repeated rows all stay or go; ids, null or not, tell nothing.
    """
    docs = docs.select(DOC_COLUMNS)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows with null ids, null texts or texts without words stay; repeated rows of an id that stays all stay.
    """
    return minhash.keep_one(docs.select(DOC_COLUMNS), percent=ALIKE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE bytes that occur more than once in what is left.

    A null text becomes an empty one; a text that is there twice, in rows of one id or of several, repeats itself and goes from both.
    """
    return suffix.without_repeats(docs, PASSAGE)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; those without any, null ones among them, stay as they are, and so do repeated rows."""
    made = pii.replace_personal_data(docs.select(DOC_COLUMNS))
    return made.select("doc_id", "text", "lang", "source", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in the packed sequences, in BPE tokens; null and empty texts are an end mark alone, repeated rows are packed each."""
    return packing.packed(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("personal data", replace_private),
    ("packing", pack_documents),
]

#: SQL can express none of the learned, hashed or sorted stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
