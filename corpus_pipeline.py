"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

quality     documents that importance resampling rejects go
line_dedup  repeated chunks of lines go but for the first; a document of which nothing is left goes
near_dedup  of each group of near-duplicates (shingles of five words, similarity 0.8) the smallest doc_id stays
secrets     spans of secrets are masked in the texts
packing     texts become pieces of at most 4096 tokens, packed into sequences by best-two-fit

Each stage but the last returns the columns of ``documents``; n_chars follows the text where it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import lines, packing, quality, secrets, shingles, simhash
from millrace.llm.common import free_name, table, written
from millrace.llm.queries import word_bpe

CAPACITY, END_ID = 4096, 1


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is there, as its text now has them (null for a null text)."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling keeps; null, empty and blank texts go, repeated rows stay or go together."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; rows of which nothing is left go, null and blank texts stay."""
    dropped = free_name("dropped_lines", docs.columns)
    left = lines.deduplicated(docs, dropped=dropped)
    emptied = (F.size(dropped) > 0) & (F.regexp_replace("text", r"\s", "") == "")
    return _measured(left.filter(~F.coalesce(emptied, F.lit(False))).drop(dropped))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id. Texts without words count as equal; of repeated rows one stays; a
    row without an id goes if its group has one."""
    return simhash.first_of_groups(docs, shingles.near_duplicates(docs, words=5, radius=6, least=0.8))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with [SECRET] for each span of a secret; a null text stays null."""
    return _measured(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its place in a sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is a piece of the end token alone."""
    return packing.pack(packing.pieces(docs, word_bpe, END_ID, CAPACITY), CAPACITY)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No SQL: n-gram models, chunk boundaries, fingerprints and packing are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``; what each stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
