"""A corpus pipeline: language ID, exact dedup, near dedup, repeated substrings, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and reads what the stage before it wrote. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import block_naming, language_id, minhash, packing, simhash, suffix_array
from quillgraph.llm.common import table
from quillgraph.llm.text_sql import ascii_lower
from quillgraph.operators.components import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose language is less certain than this is rejected; one without a letter always is.
MIN_SCORE = 0.5
#: Passages of so many words or more that occur elsewhere too go.
PASSAGE = 50


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; NULL texts and texts without a letter go."""
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"))))
    if not model.languages:  # nothing is labelled: a text with a letter is not rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(docs, model, keep=True)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id (rows that repeat it wholly: once)."""
    kept = block_naming.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("k"), "text_sha256").distinct()
    docs = docs.select(*COLUMNS, F.sha2(ascii_lower(F.col("text")), 256).alias("sha"))
    left = docs.join(kept, docs["doc_id"].eqNullSafe(kept["k"]) & (docs["sha"] == kept["text_sha256"]), "left_semi")
    return left.dropDuplicates(["doc_id", "sha"]).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of near copies reach, that with the smallest doc_id (rows that share a doc_id stay or go together).

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more, counted exactly. Candidates are texts whose SimHash
    fingerprints differ in four bits at most, and, as such texts often differ in more, those that share a MinHash band.
    """
    kept = minhash.near_duplicates(docs, also=simhash.near_pairs(docs)).where("doc_id <=> class_id").select(F.col("doc_id").alias("k")).distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["k"]), "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of PASSAGE words that occur elsewhere too; a document of which no word is left goes.

    n_chars is of the text that is left. Documents without such a run stay as they are. Repeated rows are texts of their
    own, so what they share goes from each; columns other than those of documents are not read.
    """
    cut = suffix_array.remove_repeats(docs, with_text=True, carry=("lang", "source", "n_chars", "text"), window=PASSAGE, words=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    changed = F.col("n_removed") > 0
    return left.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences of at most 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]
#: SQL has no word for a fitted classifier, near-copy components or bin packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read from there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
