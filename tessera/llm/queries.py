"""The queries op1_ to op10_ and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, sql
from .bpe import encode
from .decontaminate import contamination
from .html_extract import main_text
from .language_id import fit, held_out, identify
from .license_scan import scan
from .ngram_join import near_duplicates
from .pii import KINDS, personal_data
from .runtime import table
from .topk import exact_topk
from .url_filter import filter_urls, host_of


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    span = lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licences", span), ",").alias("spans"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def captures_and_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages as captures, fetched on a day of 2024 by their id's digest; a list whose entries follow from the digests of the pages' hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    digest = lambda c, at=1: F.conv(F.substring(F.md5(c), at, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp")
    captures = pages.withColumn("fetched_at", day(digest(F.col("page_id").cast("string")) % 366))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.withColumn("d", digest(F.col("host"))).withColumn("e", digest(F.col("host"), 9))
    above = F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    rule = lambda name, kind, pattern, action, when, where: hosts.where(where).select(
        F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(when).alias("dated")
    )
    d, e = F.col("d"), F.col("e")
    entries = [
        rule("spam", "host", F.col("host"), "add", d % 200, "d % 4 = 0"),
        rule("spam", "host", F.col("host"), "remove", d % 200 + e % 150, "d % 8 = 0"),
        rule("spam", "host", F.col("host"), "add", d % 200 + e % 150 + 20, "d % 16 = 0"),
        rule("adult", "domain", above, "add", e % 300, "e % 9 = 0"),
        rule("adult", "domain", above, "remove", e % 300 + 40, "e % 18 = 0"),
        rule("legal", "prefix", F.concat("host", F.lit("/fr")), "add", e % 100, "d % 3 = 0"),
    ]
    every = entries[0]
    for x in entries[1:]:
        every = every.union(x)
    return captures, every


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = captures_and_list(spark, sf_dir)
    found = filter_urls(captures, entries, keep=("page_id",))
    return found.select(F.col("kept_page_id").alias("page_id"), "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "blocked", F.size("rules").cast("long").alias("n_rules"), F.array_join("rules", ",").alias("rules"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    digest = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(rank_file)
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents"))
    model = quality.fit(measured.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = quality.score(measured, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_ngram_jaccard_join,
        op3_decontamination,
        op4_license_scan,
        op5_language_id,
        op6_url_filter,
        op7_personal_data,
        op8_byte_bpe,
        op9_exact_topk,
        op10_quality,
    )
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": sql.NGRAM_JACCARD_JOIN,
    "op3_decontamination": sql.DECONTAMINATION,
    "op6_url_filter": sql.URL_FILTER,
    "op9_exact_topk": sql.EXACT_TOPK,
}
