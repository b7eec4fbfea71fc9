import importlib
from collections import Counter

import corpus_pipeline
from siltstone.llm import pipeline as cp
from siltstone.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_registry():
    assert (corpus_pipeline.STAGES, corpus_pipeline.ORACLE_SQL, corpus_pipeline.run) == (cp.STAGES, cp.ORACLE_SQL, cp.run)
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"] and cp.ORACLE_SQL is None
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    entry = importlib.import_module("__spark_entry__")
    assert set(names) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_on_planted_rows(spark, tmp_path):
    prose = [f"The {i} of and with {' '.join(f'word{i}x{j}' for j in range(60))} this there from" for i in range(40)]
    item = " ".join(f"bench{j}mark" for j in range(25))
    rows = [(i, t, "en") for i, t in enumerate(prose)]
    rows += [(100, prose[0], "en"), (101, prose[1] + " tail", "en"), (102, "12 34 !!", "en"), (103, None, "en"), (104, f"{prose[5][:60]} new {item} {prose[7][-80:]}", "en"), (105, prose[9].upper() + " mail a@b.co", "en"), (None, prose[2], None), (3, prose[3], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS long) AS n_chars", "'x' AS lang_pred", "1 AS component")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, own = {}, docs
    for name, stage in cp.STAGES:
        own = stage(spark, own, str(tmp_path))
        if name != "packing":
            assert own.columns == list(cp.COLUMNS)
            own = own.cache()
            kept[name] = Counter(r.doc_id for r in own.collect())
    assert set(kept["language_id"]) == set(range(40)) | {100, 101, 104, 105, None} and kept["language_id"][3] == 2
    assert set(kept["near_duplicates"]) == set(range(40)) - {9} | {104, 9} and set(kept["near_duplicates"].values()) == {1}
    assert set(kept["decontamination"]) == set(range(40))
    assert {r.doc_id for r in own.collect()} == set(range(40))


def test_personal_data_is_replaced(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "en", "s", 15), (2, "clean", "en", "s", 5), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: (r.text, r.n_chars) for r in cp.personal_data(spark, docs, "").collect()}
    assert rows == {1: ("mail [EMAIL] now", 16), 2: ("clean", 5), 3: (None, None)}


def test_whole_run(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and len({(r.bin_group, r.bin, r.bin_offset) for r in rows}) == len(rows)


def test_empty_tables(spark, tmp_path):
    """No documents, no benchmark, or nothing left after a stage."""
    docs = spark.createDataFrame([(1, "12 34", "en", "s", 5), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, own in enumerate((docs, docs.limit(0))):
        path = str(tmp_path / str(i))
        own.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        assert cp.run(spark, path).count() == 0


def test_a_very_long_text_stays_whole(spark, tmp_path):
    long = " ".join(f"the word{i} of this" for i in range(60_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", len(long) + 4)] + [(10 + i, f"the quick {i} brown fox of this {' '.join(f'w{i}x{j}' for j in range(50))}", "en", "s", 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of the kind stands anywhere here at all, so no document is dropped")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path)).groupBy("doc_id").sum("n_tokens").collect()
    got = {r[0]: r[1] for r in out}
    assert got[1] == 240_001 and 2 not in got and len(got) == 13
