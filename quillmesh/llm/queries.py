"""The registered queries of the training-data operators, each over its whole
intended table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, decontaminate, html_extract, langid, line_dedup, quality, simhash, suffix_dedup, toxicity, url_filter
from quillmesh.llm.common import crc_mod, read_table


def tokenizer_file() -> tuple[str, str]:
    """The rank file and pattern that the BPE query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page's URL names the document it shows by its number; a page is
    bad if that document is labelled toxic or of low quality."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels")
    number = F.regexp_extract("url", r"^[^?#]*/(\d{1,18})", 1)
    shown = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    rules = url_filter.mine_rules(shown.join(marked, "doc_id"))
    return url_filter.judge_urls(pages, rules)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = langid.fit(docs.where(~held_out))
    found = langid.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 4) == 2
    model = toxicity.fit(docs, labels.where(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), with_text=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, host_col="source")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_file()
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, pattern, digest=True)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination,
        op2_url_filter,
        op3_html_extraction,
        op4_language_id,
        op5_simhash,
        op6_toxicity,
        op7_quality,
        op8_line_dedup,
        op9_byte_bpe,
        op10_suffix_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE.format(docs="documents", items="benchmark"),
    "op7_quality": quality.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE.format(docs="(SELECT doc_id, source, text FROM documents)"),
}
