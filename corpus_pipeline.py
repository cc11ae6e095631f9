"""The training-data pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, decontaminate, langid, line_dedup, queries, simhash
from quillmesh.llm.common import crc_mod, ensure_checkpoint_dir, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (no letter, or too far from every
    centroid) go. Learned from the training folds of docs."""
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    judged = langid.predict(docs, model, id_col=F.struct(*COLUMNS))
    return judged.where(~F.col("rejected")).select("id.*").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's boilerplate lines are cut out; documents that were nothing
    else go (a text that was blank before stays). Copies count as one page: one of
    them is left for near-dedup to keep."""
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS), host_col="source", copies_once=True)
    rest = cleaned.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(line_dedup.BLANKS + "\n"))) > 0))
    return rest.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays, of
    several with that id the one of the smallest hash; documents without an id stay
    where no copy has one. Unlike documents under one id are documents of their own."""
    keyed = docs.select(*COLUMNS).withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), *COLUMNS))
    keyed = keyed.withColumn("_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    stay = simhash.one_per_component(keyed, "_key")
    stay = stay.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("key").alias("_key"))
    return keyed.join(stay, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and whether decoding them gives the text.
    Blocks are smaller than by default: they give texts and ids, not their digests."""
    path, pattern = queries.tokenizer_file()
    coded = bpe.encode_documents(docs, path, pattern, keep=["text", "lang", "source"], block_bytes=3 << 20)
    text = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: Learned and hashed stages aren't expressible in SQL; tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written below the checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
