"""Corpus pipeline: language ID, near duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartolith.llm import language, mixing, near_copies, packing, secrets, simhash
from cartolith.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject. Null texts and texts without a letter go."""
    docs = docs.select(*COLUMNS)
    return language.predict(docs, language.fit(docs)).where(~F.col("lang_rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; of repeated rows one stays.

    The representative of a group without any doc_id is the one of the smallest text.
    """
    docs = docs.select(*COLUMNS)
    kept = simhash.simhash_groups(docs).where("kept").select(F.col("id").alias("doc_id")).distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null")
    if not nameless.limit(1).count():
        return named
    groups = simhash.simhash_groups(docs)
    alone = groups.where("component_id is null").select("fp").distinct()
    own = simhash.fingerprints(nameless.withColumn("row", F.xxhash64("text")), id_column="row").distinct()
    lone = own.join(alone, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("row"))
    return named.unionByName(nameless.withColumn("row", F.xxhash64("text")).join(lone, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies: one that goes shares 0.8 or more of its five-word shingles with one that stays.

    :func:`near_duplicates` gives op2's fingerprint groups instead, which the stage does not use: they are neither
    verified nor do they reach such pairs.
    """
    return near_copies.without_near_copies(docs.select(*COLUMNS), words=5, threshold=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret value replaced by a mark; n_chars follows the text."""
    found = secrets.find_secrets(docs.select(*COLUMNS))
    clean = secrets.redacted(F.col("text"), F.col("secret_spans"))
    hit = F.size("secret_spans") > 0
    return found.select("doc_id", clean.alias("text"), "lang", "source",
                        F.when(hit, F.length(clean)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says, rounded by a hash of its id and text."""
    mixed = mixing.mix(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    times = mixing.copies(F.col("rate"), F.col("doc_id"), F.col("text"))
    # a filter on the number would be pushed below the scores: worked out twice, with a copy of the model's tables for each mention of a score
    return mixed.select(*COLUMNS, times.alias("__times")).select(
        *COLUMNS, F.explode(F.array_repeat(F.lit(True), F.col("__times"))).alias("__copy")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most 2048 tokens."""
    import public_tokenizers

    packed = packing.packed_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", distinct_texts),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# None of the classifier, the fingerprints, the fitted rates and the genetic algorithm can be said in SQL; the tests
# compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
