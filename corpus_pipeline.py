"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; between stages
the rows are written as Parquet and read again. All stages but the last return the columns of documents.

Cases: a null text is of no language and goes in the first stage, as an empty or blank one does; a null doc_id is a
value like any other, but never trains, comes after all others where the least doc_id decides, and its row stays if no other of its group does;
of repeated rows, and of rows with equal doc_id and text, one stays; rows of one doc_id and different texts are
judged each by its text; ties go by doc_id, then by a hash of the text; extra columns are carried through all stages but the last,
which returns doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids; extra columns named like an inner column of a stage change
nothing, those named like an output of an operator (lang_pred, score, bits_per_byte, kept, n_lines, n_removed, n_runs) are not
carried; texts are read whole whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, common, decontaminate, language_id, line_dedup, near_copies

#: A document goes if no language has this share of its posterior.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language fits better than all others together, go."""
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop(*language_id.OUTPUTS)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go from the texts; a document of which nothing is left goes."""
    found = line_dedup.dedup(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    length = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))}
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns if c not in line_dedup.OUTPUTS))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by SimHash fingerprints (op5's, by its pivot tables) one row stays: the least doc_id, null last.

    What three bits cannot see goes next: of the texts that are left, those linked by a similarity of 0.8 or more on five-word shingles, likewise.
    """
    return near_copies.keep_one(common.checkpoint(near_copies.keep_one_by_fingerprint(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the hash of what they decode to."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", delete_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]
#: A trained model, XXH64 fingerprints and merges are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written beside the checkpoints, read again, and deleted after the next stage."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), ""
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            common.delete(spark, before)
        before = path
    return docs
