"""Every query of this subpackage through its registered entry, against its SQL where it has some."""

import math
import os

import duckdb
import pytest

from siltstone.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op3_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op5_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_license_scan": {"doc_id": "bigint", "license": "string", "notices": "string"},
    "op7_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_best_fit_packing": {"doc_id": "bigint", "bin": "bigint", "capacity": "bigint"},
    "op9_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op12_embedding_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: ("nan" if math.isnan(v) else round(v, 3)) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    frame, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, frame.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    """Types, one row for each document (but for searches and pieces), and held-out folds."""
    import zlib

    frame = queries.queries()[name](spark, SF)
    types = dict(frame.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got, docs = frame.collect(), sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    if name == "op4_decontamination":
        assert got and {r.doc_id for r in got} < set(docs)
    elif name == "op12_embedding_whitening":
        vectors = sorted(r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect())
        assert sorted((r.vec_id, r.component) for r in got) == [(v, c) for v in vectors for c in range(1, 33)]
    elif name == "op13_lexical_search":
        assert {r.doc_id for r in got} <= set(docs) and max(r["rank"] for r in got) == 10
    elif name == "op8_best_fit_packing":
        assert {r.doc_id for r in got} == set(docs)
    else:
        assert sorted(r.doc_id for r in got) == docs
    if "held_out" in types:
        modulus, rest = (7, 2) if name == "op5_lm_scoring" else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
