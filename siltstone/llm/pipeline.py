"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, packing.

Each stage reads what its predecessor wrote.  A row is named by a hash of its id and text, so null ids and ids used twice
do no harm.  Extra columns of the input are dropped by the first stage.

Language ID drops texts without a letter and those of no clear language (a score under LEAST_SCORE).  Of near
duplicates (five-word shingles, Jaccard 0.8) and repeated rows one document stays, that with the least id, and of equal ids that with
the least key; texts without words stay.  Decontamination drops documents that hold a benchmark passage.  Personal data is replaced in
the text, and n_chars counts the new text.  Packing returns one row per piece of each document that is left.

Very long texts go through every stage whole; an empty table, or one that a stage empties, gives empty tables from there on, and a
benchmark without items drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard, langid, packing, pii
from siltstone.llm.textops import prepared, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.4
#: Rows named by up to so many keys are removed by a broadcast join, beyond that by a shuffled one.
BROADCAST_KEYS = 1_000_000
KEY = "row_key_"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias(KEY))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among ``keys`` (stored, distinct)."""
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(side, KEY, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    own = docs.select(*COLUMNS)
    known = langid.identified(own, langid.learn(own), *COLUMNS)
    return known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    own = _keyed(docs)
    rows = stored(jaccard.clustered(own, 5, 8, 10, KEY).where("n_shingles > 0"), "clusters")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias("first_"))
    gone = stored(rows.join(first, "component").where(F.col(KEY) != F.col("first_")).select(KEY).distinct(), "duplicates")
    left = _without(own, gone)
    again = stored(rows.groupBy(KEY).count().where("count > 1").select(KEY).join(gone, KEY, "left_anti"), "repeated")
    if not again.head(1):
        return left.select(*COLUMNS)
    once = left.join(F.broadcast(again) if again.count() <= BROADCAST_KEYS else again, KEY, "left_semi").dropDuplicates([KEY])
    return _without(left, again).unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    own = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = stored(decontaminate.contaminated(own, benchmark, KEY).select(KEY).distinct(), "contaminated")
    return _without(own, hits).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    found = pii.detected(docs, pii.learn(spark), *COLUMNS)
    clean = found.withColumn("new_", F.when(F.size("spans") > 0, pii.redacted(F.col("text"), "spans")).otherwise(F.col("text")))
    n_chars = F.when(F.size("spans") > 0, F.char_length("new_").cast("long")).otherwise(F.col("n_chars"))
    return clean.select("doc_id", F.col("new_").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return packing.packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: No stage but the last can be said in SQL: models, trie joins and alignments decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
