"""The corpus pipeline: documents -> quality -> near-duplicates -> personal data -> mix -> token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.llm import dedup, mixing, pieces, pii, quality
from ladle.llm.common import stage, table
from ladle.llm.queries import PIECE_MODEL, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the rules' posterior keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked at 0.8 over five-word shingles."""
    return dedup.drop_near_duplicates(docs, k=5, threshold_pct=80)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix: a document is a row for each time that it is drawn, whole."""
    return mixing.mixed_documents(docs, whole=True)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_tokens and the hash of the text decoded from the ids."""
    model = pieces.load(tokenizer_path(PIECE_MODEL))
    back = pieces.encode_and_decode(docs, model)
    return back.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("personal data", remove_pii),
    ("source mix", mix_sources),
    ("sentencepiece", sentencepiece),
]

# The stages rest on hashes, an iterative fit and a tokenizer, which SQL cannot
# express; tests/llm compares them with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
