"""Every registered query of the code-search half against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from siltstone.functions.naming import LINE_ENDS
from siltstone.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    frame, want = queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, frame.collect()) == rows(want.columns, want.fetchall())


def test_segments_of_whole_texts(spark):
    import re

    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}

    def loop(text):
        out, now = [], None
        for line in re.split(LINE_ENDS, text):
            if now is not None and len(now) + len(line) + 1 > 4096:
                out.append(now)
                now = line
            else:
                now = line if now is None else f"{now}\n{line}"
        return [*out, now]

    got = {r.doc_id: (r.n_segments, r.longest) for r in queries.segment_lines(spark, SF).collect()}
    assert got == {d: (len(s := loop(t)), max(map(len, s))) for d, t in texts.items()}


def test_entry(spark):
    frame = queries.entry(spark)
    assert "score" in frame.columns and frame.count() > 0


def test_every_query_vector_meets_every_vector(spark):
    ids = [r.vec_id for r in queries.table(spark, SF, "embeddings").select("vec_id").collect()]
    got = sorted((r.query_id, r.n) for r in queries.vector_dot(spark, SF).collect())
    assert got == sorted((q, len(ids)) for q in ids if q % 20 == 0)


def test_positions_in_files_with_odd_texts(spark, tmp_path):
    """The package comes from the ``file`` chunk, and texts that are too short, blank or null take no position."""
    texts = ["x" * 20, "x" * 19, None, "", " \t\r\n\x0b" + "y" * 20 + "\x0b\f ", " " * 30, "z" * 5000, "é" * 19 + "\U0001f600", "two\nlines of { text }\n"]
    own = [(i, t, lang, source) for i, (t, lang, source) in enumerate((t, lang, source) for t in texts * 3 for lang in ("de", "en") for source in ("a", "b"))]
    spark.createDataFrame([*own, (len(own), "short", "fr", "a")], "doc_id LONG, text STRING, lang STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    frame, con = queries.position_counter(spark, str(tmp_path)), duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.SQL["position_counter"])
    got = rows(frame.columns, frame.collect())
    assert got == rows(want.columns, want.fetchall())
    assert len(got) == 60 and {r.first_line for r in frame.collect()} == {"[behavior] p"}
