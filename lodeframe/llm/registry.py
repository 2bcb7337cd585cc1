"""The op queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of `documents`."""
    import public_tokenizers

    from lodeframe.llm.tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: (action, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed URLs: the canonical URLs that `pages` holds under two or more raw URLs."""
    from lodeframe.llm.urlfilter import crawl_traps, judge_urls

    pages = read_table(spark, sf_dir, "pages")
    return judge_urls(pages, URL_RULES, crawl_traps(pages))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` within windows of `benchmark`, and the longest verbatim match with its place."""
    from lodeframe.llm.decontaminate import contamination

    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(
        F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("bigint"), lambda a, n: a + n
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "longest",
        "longest_word",
        "longest_item",
        "longest_item_word",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of `documents` to its sources' targets."""
    from lodeframe.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` archived as WARC records and read back."""
    from lodeframe.llm.warc import archive_pages, read_archives

    capture = archive_pages(read_table(spark, sf_dir, "pages"))
    return read_archives(capture).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of `documents`."""
    from lodeframe.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of `documents`, learnt from `labels`."""
    from lodeframe.llm.quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of `documents`, learnt from `labels`."""
    from lodeframe.llm.toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of `documents`; `labels` name the trusted ones."""
    from lodeframe.llm.rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of `documents`, learnt from those that are not held out."""
    from lodeframe.llm.maxent import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened coordinates of every usable vector of `embeddings`."""
    from lodeframe.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-the-middle output, and of the text that is rebuilt from it."""
    from lodeframe.llm.fim import fill_in_middle, restore

    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the token files of `documents`, and their crc, as read back."""
    import public_tokenizers

    from lodeframe.llm.tokenfiles import read_documents, write_token_files

    archive = write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, archive)
