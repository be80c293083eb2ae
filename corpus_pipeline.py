"""A corpus pipeline of five of the training-data operators.

documents -> language ID -> n-gram Jaccard join -> benchmark decontamination -> personal data -> byte-level BPE.
Each stage takes all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitfilter import without
from tessera.llm.bpe import encode
from tessera.llm.decontaminate import contamination
from tessera.llm.language_id import UNDETERMINED, fit, held_out, identify
from tessera.llm.ngram_join import near_duplicates
from tessera.llm.pii import mask
from tessera.llm.runtime import table, written


def own(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, which an operator has kept beside its own."""
    return found.select(*(F.col(f"`kept_{c}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; those without a text or a letter go. Where no language was learned, none is told and none goes for it."""
    found = identify(docs, fit(docs.where(~held_out()).select("text", "lang")), keep=tuple(docs.columns))
    return own(found.where((F.col("lang_pred") != UNDETERMINED) | F.col("kept_text").rlike(r"\p{L}")), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one: of the smallest id, then by hashes of its text and columns; rows without an id link too and come last.

    Rows are told apart by a key of their own, so repeated rows and copies under one id are linked like others.
    """
    hashed = [f"kept_{c}" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # those that Spark hashes
    keyed = docs.select(F.monotonically_increasing_id().alias("doc_id"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in docs.columns))
    keyed = written(keyed, "rows")
    place = F.struct(F.col("kept_doc_id").isNull().alias("none"), "kept_doc_id", F.xxhash64("kept_text").alias("text"), F.xxhash64(*(F.col(f"`{c}`") for c in hashed)).alias("hash"), "doc_id")
    classes = near_duplicates(keyed, text_col="kept_text").select("doc_id", "component_id")
    placed = written(classes.join(keyed.select("doc_id", place.alias("place")), "doc_id"), "classes")
    first = placed.groupBy("component_id").agg(F.min("place").alias("place")).select("place.doc_id")
    gone = written(placed.join(first, "doc_id", "left_anti").select("doc_id"), "gone")
    return own(without(keyed, gone), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, however small a part of the document it is."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return own(found.where("n_hit = 0"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by its kind; n_chars follows the text."""
    return mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with the digest of what the ids decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = encode(docs, path, public_tokenizers.PATTERN, keep=("lang", "source"), decoded=True)
    kept = (F.col(f"kept_{c}").alias(c) for c in ("lang", "source"))
    return tokens.select("doc_id", *kept, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", byte_bpe),
]

#: Language mixtures, bootstrapped patterns and BPE can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
