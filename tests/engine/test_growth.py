"""Steps whose cost must grow no faster than their input: files are parsed once, nothing of a row for each file is broadcast, pairs and gains aren't held."""

import hashlib
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import encoder
from siltstone.operators import lists
from siltstone.operators import resolve as R
from siltstone.operators import search as S
from siltstone.operators.documents import RETRIEVAL_FROM, index_documents, retrieval_documents, with_package
from siltstone.plans import indexing
from siltstone.scratch import stored
from siltstone.sources import files, store
from siltstone.sources.workspace import inferred_edges


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def parses(frame):
    return len(re.findall(r"MapIn(?:Arrow|Pandas)", plan(frame).split("== Initial Plan ==")[0]))


@pytest.fixture
def java(spark):
    own = [("a", b"package p.q;\nclass A { class B { class C { } } void m() { class Local { class Deep { } } System.gc(); } }\nclass A { class B { } }"), ("b", b"class D { }"), ("c", None), ("d", b"")]
    return spark.createDataFrame(own, "path STRING, content BINARY")


def test_symbols_parse_each_file_once(java):
    rows = files.source_symbols(java, ":m")
    assert sorted((r.filepath, r.qualified_name, r.container) for r in rows.collect()) == [("a", "p.q.A", ":m"), ("a", "p.q.A.B", ":m"), ("a", "p.q.A.B.C", ":m"), ("b", "D", ":m")]
    assert parses(rows) == 1
    top = files.top_level_types(java)
    assert sorted(map(tuple, top.collect())) == [("A", ["p.q.A"]), ("D", ["D"])] and parses(top) == 1


def test_names_of_columns_are_asked_once_for_many_rows(spark, monkeypatch):
    """The names are those of the schema: what a row costs doesn't hold asking a field of the schema for its name."""
    asked = []

    class Field:
        def __init__(self, own):
            self.own, self.type = own, own.type

        @property
        def name(self):
            asked.append(self.own.name)
            return self.own.name

    schema = [Field(f) for f in files._arrow_schema(spark, files.CHUNKS)]
    monkeypatch.setattr(files, "_arrow_schema", lambda *_: schema)
    made = lambda arrays, schema: pa.RecordBatch.from_arrays(arrays, names=[f.own.name for f in schema])
    monkeypatch.setattr(files, "pa", SimpleNamespace(array=pa.array, RecordBatch=SimpleNamespace(from_arrays=made)))
    frame = SimpleNamespace(sparkSession=spark, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    given = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(50)], "content": [b"package p;\nclass A { void m() { } }"] * 50})
    rows = [r for out in files.chunks(frame)(iter([given])) for r in out.to_pylist()]
    assert len(rows) == 200 and {r["file_package"] for r in rows} == {"package p;"}
    assert sorted(asked) == sorted(f.own.name for f in schema)


def test_chunks_of_odd_files(spark):
    own = [("a", b"package p;\n@Tag(x = 1, y = 2) class A { }"), ("a", b"package p;\n@Tag(x = 1, y = 2) class A { }"), (None, b"class N { }"), ("null", None), ("empty", b""), ("odd", b"\xff } class")]
    rows = files.chunks(spark.createDataFrame(own, "path STRING, content BINARY")).collect()
    of = lambda path: [(r.kind, r.name, r.file_package) for r in rows if r.filepath == path]
    assert of("a") == [("file", None, "package p;"), ("type", "A", "package p;"), ("skeleton", "A", "package p;")] * 2
    assert [r.annotations[0].attributes for r in rows if r.filepath == "a" and r.kind != "file"] == [{"x": "1", "y": "2"}] * 4
    assert of(None) == [("file", None, None), ("type", "N", None), ("skeleton", "N", None)] and of("empty") == [("file", None, None)]
    assert of("null") == [("failed", None, None)] and [r.error for r in rows if r.filepath == "null"] == ["TypeError: cannot convert 'NoneType' object to bytes"]
    assert of("odd")[0] == ("file", None, None) and {k for k, _, _ in of("odd")} == {"file", "parse_error"}


def test_documents_parse_each_file_once(java):
    rows = files.chunks(java).withColumns({"repo_root": F.lit("/r"), "source_set": F.lit(":m")})
    for made in (index_documents(rows, "now"), retrieval_documents(rows)):
        assert parses(made) == 1
    assert {r.package_name for r in retrieval_documents(rows).where("filepath = 'a'").collect()} == {"p.q"}
    # Chunks made otherwise have the package on the ``file`` chunk alone.
    by_file = with_package(rows.drop("file_package")).select("filepath", "chunk_ord", "package")
    assert sorted(map(str, by_file.collect())) == sorted(map(str, with_package(rows).select("filepath", "chunk_ord", "package").collect()))


def test_resolution_parses_each_file_once(spark, java):
    index = R.type_index(spark.createDataFrame([("java.lang.System",)], "qualified_name STRING"))
    rows = R.resolved_chunks(files.chunks(java), index)
    assert parses(rows) == 0  # the chunks are stored before
    assert [r.calls for r in rows.where("name = 'm'").collect()] == [["java.lang.System.gc"]]


def test_upserts_parse_once_and_broadcast_few_keys(spark, java, monkeypatch):
    first = stored(indexing.index_retrieval(None, java.where("path = 'a'"), None, spark), "first")
    few = indexing.index_retrieval(first, java, None, spark)
    assert parses(few) == 0
    want = sorted(r.chunk_id for r in few.collect())
    assert len(set(want)) == len(want) == indexing.index_retrieval(None, java, None, spark).count()
    monkeypatch.setattr(store, "SENT_KEYS", 0)
    many = indexing.index_retrieval(first, java, None, spark)
    assert "Broadcast" not in plan(many) and sorted(r.chunk_id for r in many.collect()) == want


def test_retrieval_documents_are_sent_only_the_columns_they_read(spark, java):
    """The Python step gives the columns that the documents are made of, no more; the documents are those of whole chunks."""
    odd = java.unionByName(java.where("path = 'a'")).unionByName(spark.createDataFrame([(None, b"@T(x = 1) enum E { A; int f() { return 1; } }"), ("r", b"record R(int a) implements I, J { }")], java.schema))
    made = indexing.index_retrieval(None, odd, None, spark)
    sent = re.search(r"MapInArrow run\(.*?\)#\d+, \[(.*?)\]", plan(made))[1]
    assert {c.split("#")[0].strip() for c in sent.split(",")} == set(RETRIEVAL_FROM)
    whole = files.chunks(odd).where("kind <> 'failed'").withColumns({"source_set": F.lit(None).cast("string"), "repo_root": F.lit(None).cast("string")})
    want = retrieval_documents(whole)
    assert made.schema == want.schema and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def test_a_build_makes_documents_and_ids_once(spark, java, monkeypatch):
    """What a build returns reads stored rows: documents aren't made again for their ids, their texts and their rows, nor the clashes for the log."""
    own = [(f"/r/{p}", c) for p, c in java.collect()] + [("/r/x", b"class X { void run() { int value; go(value); } }"), (None, b"class Nowhere { int value; }")]
    given = spark.createDataFrame(own, java.schema)
    for most in (0, store.SENT_KEYS):
        monkeypatch.setattr(store, "SENT_KEYS", most)
        documents, failed = indexing.build(given, "/r", None, spark, "now")
        assert not re.search("Window|MapIn|Aggregate", plan(documents) + plan(failed)) and ("Broadcast" in plan(documents)) == (most > 0)
        assert sorted((r.path, r.error[:13]) for r in failed.collect()) == [("/r/a", "duplicate id:"), ("/r/c", "TypeError: ca")]
        rows = index_documents(files.chunks(given).where("kind <> 'failed'").withColumns({"source_set": F.lit(None).cast("string"), "repo_root": F.lit("/r")}), "now").where("file_path <> 'a'")
        assert documents.dtypes == rows.dtypes and sorted(map(str, documents.collect())) == sorted(map(str, rows.collect()))


def test_files_without_rows_rewrite_no_bucket(spark, tmp_path, monkeypatch):
    """Files that have no rows and get none leave every bucket where it is; a file that loses its rows takes only its bucket along; a null path stays."""
    monkeypatch.setattr(store, "BUCKETS", 8)
    s = store.Store(spark, str(tmp_path / "i"))

    def rows(*paths):
        given = spark.createDataFrame([(f"c{p}", p) for p in paths], "chunk_id STRING, file_path STRING")
        documents = given.select(*(F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(store.DOCUMENTS)))
        return documents, documents.select("chunk_id", "file_path", F.lit(1).alias("dims"), F.array(F.lit(1.0).cast("float")).alias("matrix"))

    s.save(*rows(*"abcdefgh", "a", None), "m", "t")
    before, writes, real = s.manifest(), [], store.Store._write
    monkeypatch.setattr(store.Store, "_write", lambda self, frames, n: writes.append(1) or real(self, frames, n))
    changed = lambda *paths: spark.createDataFrame([(p,) for p in paths], "file_path STRING")
    none = [t.limit(0) for t in rows("a")]
    s.replace_files(changed(*"pqrstuvwxyz", "p", None), *none, "m", "u")
    assert not writes and s.manifest()["buckets"] == before["buckets"] and s.manifest()["indexed_at"] == "u" and s.read("documents").count() == s.read("vectors").count() == 10
    s.replace_files(changed("a", *"pqrstuvwxyz", None), *none, "m", "v")
    after = s.manifest()["buckets"]
    assert len(writes) == 1 and sum(after[b] != before["buckets"][b] for b in after) == 1
    assert sorted(str(r.file_path) for r in s.read("documents").collect()) == ["None", *"bcdefgh"] and s.read("vectors").count() == 8
    # Only in the index being built, which is empty yet: nothing to read, nothing in it.
    s.start("/r", "sig", "m", "t", 3)
    s.replace_files(changed("a"), *none, "m", "t", staged=True)
    s.replace_files(changed("a", "b"), *rows("b"), "m", "t", staged=True)
    s.replace_files(changed("a"), *none, "m", "t", staged=True)
    s.finish()
    assert [r.file_path for r in s.read("documents").collect()] == ["b"]


def test_vectors_come_in_few_batches(spark, monkeypatch):
    """Short texts come back together, long ones as soon as there are enough numbers; null and empty texts have empty matrices."""
    frame = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    texts = [None, "", *(f"word{i} again word{i}" for i in range(318))]
    given = pa.RecordBatch.from_pydict({"chunk_id": [*(f"c{i}" for i in range(319)), None], "file_path": ["f"] * 320, "retrieval_text": texts})
    made = list(encoder.embedded(frame, encoder.HashedEncoder(8))(iter([given, given.slice(0, 0)])))
    assert [m.num_rows for m in made] == [320]
    own = encoder.HashedEncoder(8)
    want = [[x for v in own._rows(t, encoder.DOCUMENT_TOKENS) for x in v.tolist()] for t in texts]
    assert made[0].column("matrix").to_pylist() == want and made[0].column("dims").to_pylist() == [0, 0] + [8] * 318
    assert made[0].column("chunk_id").to_pylist() == given.column("chunk_id").to_pylist()
    monkeypatch.setattr(encoder, "GATHERED_NUMBERS", 100)
    parts = list(encoder.embedded(frame, own)(iter([given])))
    assert max(m.num_rows for m in parts) <= 9 and [x for m in parts for x in m.column("matrix").to_pylist()] == want
    uneven = SimpleNamespace(prepare=lambda: None, close=lambda: None, documents=lambda t: [[[1.0], [1.0, 2.0]] for _ in t])
    with pytest.raises(ValueError, match="different lengths"):
        list(encoder.embedded(frame, uneven)(iter([given])))
    rows = encoder.embedded(spark.createDataFrame([("a", None, "one two"), ("a", "f", None)], "chunk_id STRING, file_path STRING, retrieval_text STRING"), own).collect()
    assert sorted((r.chunk_id, r.file_path, r.dims, len(r.matrix)) for r in rows if r.file_path) == [("a", "f", 0, 0)] and [len(r.matrix) for r in rows if not r.file_path] == [16]


def test_pairs_of_several_entries_are_told_apart_without_holding_them(spark):
    classpath = [(s, f"e{e}") for s in range(12) for e in range(8) if (s * 5 + e * 3) % 4 < 2] + [(1, None), (None, "e1"), (2, "jar"), (2, "e1"), (2, "e1")]
    outputs = [(d, f"e{e}") for d in range(12) for e in range(8) if (d + e * e) % 3 == 0] + [(3, None), (None, "e2"), (5, "e1"), (5, "e1")]
    got = inferred_edges(spark.createDataFrame(classpath, "src INT, entry STRING"), spark.createDataFrame(outputs, "dst INT, entry STRING"))
    want = {(s, d) for s, e in classpath for d, f in outputs if None not in (s, d, e) and e == f and s != d}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    above = re.split(r"\w+Join", plan(got))[0]
    assert "Aggregate" not in above


def test_vectors_of_tokens_are_drawn_once():
    own = encoder.HashedEncoder(8)
    before = encoder._drawn.cache_info().misses
    own.documents(["once more once", "more once"] * 20)
    assert encoder._drawn.cache_info().misses - before <= 2
    for token in ("once", "ä", "x" * 50):
        v = np.random.default_rng(int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big")).normal(size=8)
        assert own.vector(token) == (v / np.linalg.norm(v)).astype(np.float32).tolist()


@pytest.mark.parametrize("probes", [3, 24])
def test_many_queries_shuffle_vectors_and_not_gains(spark, tmp_path, probes, monkeypatch):
    """The same candidates whether gains or vectors travel; with many query rows for each list it is the vectors."""
    draw = np.random.default_rng(5)
    rows = [(c, i, [float(x) for x in draw.normal(size=4)]) for c in range(200) for i in range(1 + c % 4)]
    chunks = stored(lists_of(spark, rows), "chunks")
    asked = spark.createDataFrame([(c, i, v) for c, i, v in rows if c % 4 == 0], "query_id INT, q_row INT, vec ARRAY<FLOAT>")
    own, path = lists.centroids(chunks, 24), str(tmp_path / "lists")
    lists.write_lists(chunks, own, path)
    table, found = spark.read.parquet(path), []
    for cost in (32, 0):
        monkeypatch.setattr(lists, "GAIN_BYTES", cost)
        near = lists.candidates(table, own, asked, 20, probes)
        assert ("q_row" in plan(near)) == (cost == 0)
        found.append(sorted(map(tuple, near.collect())))
    assert found[0] == found[1] and len(found[0]) == 50 * 20
    if probes == 24:
        assert found[0] == sorted((r.query_id, r.chunk_id) for r in S.vector_search(chunks, asked, 20).collect())


def lists_of(spark, rows):
    from siltstone.functions.vectors import matrices

    return matrices(spark.createDataFrame(rows, "chunk_id INT, token_pos INT, vec ARRAY<FLOAT>"))
