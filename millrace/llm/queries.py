"""The registered queries of this subpackage, one an operator, and their SQL."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, language, lines, neardup_vectors, oracle, packing, quality, records, sampling, secrets, simhash, tokens
from millrace.llm.common import table

#: Folder of the public tokenizer files; None: where the installed package says.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(name: str, leading_space: bool, texts: pa.Array) -> list[np.ndarray]:
    return tokens.encoder(tokenizer_path(name), leading_space)(texts)


byte_bpe = partial(_encode, "byte_bpe_50k.json", True)
word_bpe = partial(_encode, "word_bpe_49k.json", False)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.BASE
    return found.select(
        "doc_id",
        *[F.size(F.col("found")[r.kind]).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(secrets.digest("found", base), 256).alias("base_sha256"),
        secrets.digest("found", base + secrets.MORE).alias("spans"),
    )


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = records.write_records(table(spark, sf_dir, "documents"), byte_bpe, end_id=2, vocabulary=50_257)
    return records.read_records(path, files)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93, by="label")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), dropped="removed_lines")
    return found.select("doc_id", "removed_lines", F.char_length("text").cast("long").alias("n_chars"), "text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), word_bpe, end_id=1, capacity=4096), 4096)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out("doc_id")))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "langs")


def op10_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.encode(table(spark, sf_dir, "documents"), partial(tokenizer_path, "piece_bpe_32k.model"), k=2)


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": oracle.secrets(), "op4_ann": oracle.ANN, "op5_embedding_neardup": oracle.EMBEDDING_NEARDUP}
