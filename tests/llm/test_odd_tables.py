"""Operators on one table of null ids, null, empty and repeated texts, a very long text, and columns whose names they use themselves."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard, langid, license, packing, quality, ranking, rules, sharding, suffixes

CLASH = ("row_", "text_", "key_a", "key_b", "gram", "block", "n", "h", "cls", "bucket_", "slice", "code", "spans", "base", "more", "score", "label", "size", "slot", "units", "flat_", "lang_pred", "bits_", "item_", "rank", "k0_", "copy_", "kept", "rule", "x")
LONG = "word other thing again " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    prose = [" ".join(f"w{i}x{j}" for j in range(70)) for i in range(6)]
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[0] + " end"), (3, None), (4, ""), (None, prose[1]), (5, LONG), (6, " \n\t "), (None, None), (7, prose[2]), (8, "Ünï çödé " * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("*", F.lit("en").alias("lang"), *(F.lit("1").alias(c) for c in CLASH)).repartition(3).cache()


def ids(frame):
    return sorted(str(r.doc_id) for r in frame.select("doc_id").collect())


def test_every_document_has_its_row(spark, docs, tmp_path):
    every = ids(docs)
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 0)], "doc_id long, quality int").withColumn("label", F.lit("x"))
    assert ids(langid.identified(docs, langid.learn(docs))) == every
    groups = {(str(r.doc_id), r.n_shingles): r.component_id for r in jaccard.clustered(docs).select("doc_id", "n_shingles", "component_id").collect()}
    assert groups["1", 67] == groups["2", 68] == 1 and groups["3", 0] == 3 and len(ids(jaccard.clustered(docs))) == len(every)
    assert ids(sharding.sharded(docs, 3)) == every
    assert ids(license.scanned(docs)) == every
    assert set(ids(packing.packing(docs))) == set(every)
    assert ids(rules.judged(docs, rules.learn(docs, labels))) == every
    vectors = quality.word_vectors(docs)
    out = quality.scored(docs, vectors, quality.learn(docs, labels, vectors)).collect()
    assert sorted(str(r.doc_id) for r in out) == every and all(0 <= r.score <= 1 for r in out)
    cut = suffixes.deduplicated(docs, 60)
    assert ids(cut) == every and {r.doc_id: r.n_removed for r in cut.collect()}[5] > len(LONG) - 60


def test_searches_find_the_repeated_rows(spark, docs):
    text = " ".join(f"w0x{j}" for j in range(40))
    items = spark.createDataFrame([("i", text), (None, None), ("e", "")], "item_id string, text string").select("*", *(F.lit("1").alias(c) for c in CLASH))
    assert [(r.item_id, r.doc_id) for r in ranking.ranked(docs, items).orderBy("rank").collect()] == [("i", 1), ("i", 1), ("i", 2)]
    assert sorted((r.item_id, r.doc_id) for r in decontaminate.contaminated(docs, items).collect()) == [("i", 1), ("i", 1), ("i", 2)]
