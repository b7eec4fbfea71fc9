import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import lexical as L
from siltstone.functions import naming as N
from siltstone.functions.encoder import HashedEncoder, bisected, embedded
from siltstone.functions.vectors import matrices
from siltstone.operators import evaluate as E
from siltstone.operators import lists
from siltstone.operators import resolve as R
from siltstone.operators import search as S
from siltstone.operators.documents import index_documents, retrieval_documents
from siltstone.plans import indexing, retrieval
from siltstone.scratch import stored
from siltstone.sources import files, store
from siltstone.sources.workspace import LISTS, Workspace, closure, export_command, owners, split_key, validate
from siltstone.streaming.refresh import debounced, refresh


def value(spark, column, **cells):
    frame = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cells.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small indexes, few files."""
    monkeypatch.setattr(store, "BUCKETS", 3)


# --- terms and scores


def test_terms(spark):
    assert value(spark, L.tokens(F.lit("getBean HTTPClient a-b ÄX 9z"))) == ["get", "bean", "httpclient", "a", "b", "x", "9z"]
    assert value(spark, L.significant(F.lit("Where is the Bean bean lookup a"))) == ["bean", "lookup"]
    assert value(spark, L.significant(F.lit("how where i"))) == ["how", "where"]
    assert value(spark, L.expanded(L.words(("bean", "x", "lookup")))) == ["bean", "x", "lookup", "beandefinition", "beanregistration", "get", "getbean", "find", "findbean", "resolve", "resolvebean"]
    assert value(spark, L.asks_implementation(L.words(("resolver",)))) and not value(spark, L.asks_implementation(L.words(("other",))))
    assert [value(spark, L.confidence(F.lit(x))) for x in (2.5, 2.49, 1.0, 0.99)] == ["high", "medium", "medium", "low"]
    assert value(spark, L.summary(F.lit("a \n b\t" + "x" * 300))) == "a b " + "x" * 193 + "..." and value(spark, L.summary(F.lit(" "), F.lit("b  c"))) == "b c"


BEANS = [
    ("method", "method", "com.app", ["BeanLocator"], "getBean", "public Bean getBean(String name)", "context/BeanLocator.java", "[method] com.app.BeanLocator.getBean\npublic Bean getBean(String name)\nfind and resolve bean lookup", [], "public Bean getBean(String name) { return find(name); }"),
    ("plain", "field", None, [], "x", None, "a.txt", "nothing", [], "int x"),
]
DOC = "chunk_id STRING, chunk_kind STRING, package STRING, owner_chain ARRAY<STRING>, name STRING, signature STRING, file_path STRING, retrieval_text STRING, modifiers ARRAY<STRING>, source_text STRING"


def test_hybrid_score_by_hand(spark):
    docs = spark.createDataFrame(BEANS, DOC).selectExpr("*", "1 AS start_line", "2 AS end_line", "'m' AS source_set")
    found = spark.createDataFrame([("q", "method", 1.0), ("q", "plain", 1.0), ("blank", "plain", 1.0)], "query_id STRING, chunk_id STRING, score DOUBLE")
    asked = spark.createDataFrame([("q", "bean lookup"), ("blank", "  ")], "query_id STRING, query STRING")
    rows = S.hits(found, docs, asked, 1).collect()
    assert [(r.query_id, r.chunk_id, r.has_more) for r in rows] == [("q", "method", True)]
    # name terms bean, get; symbol terms the same; signature 2; path 1; text: bean, find, get, lookup, resolve (getbean is never a token); signals lookup, resolve; phrase; callable, verb, text
    assert rows[0].score == pytest.approx(1 + 2 * 0.45 + 2 * 0.3 + 0.4 + 0.2 + 5 * 0.12 + 2 * 0.35 + 0.6 + 0.7 + 0.35 + 0.15)
    assert rows[0].why_matched[0] == "semantic" and "lookup_terms:lookup, resolve" in rows[0].why_matched and rows[0].symbol == "com.app.BeanLocator.getBean" and rows[0].confidence == "high"


def chunk_rows(spark, rows, *keep):
    """(chunk_id, vec, keep...) rows as chunks."""
    kinds = "".join(f", {k} INT" for k in keep)
    own = [(c, i, v, *rest) for i, (c, v, *rest) in enumerate(rows)]
    return matrices(spark.createDataFrame(own, f"chunk_id STRING, token_pos INT, vec ARRAY<FLOAT>{kinds}").repartition(5), *keep)


def test_vector_search_and_shortlist(spark):
    rows = [(f"chunk-{i:03d}", [150.0 - i, 0.0], i % 3) for i in range(150)] + [("nan", [float("nan"), 0.0], 0)]
    chunks = chunk_rows(spark, rows, "shard")
    q = spark.createDataFrame([("q", 0, [1.0, 0.0])], "query_id STRING, q_row INT, vec ARRAY<FLOAT>")
    some = spark.createDataFrame([("q", "chunk-000"), ("q", "chunk-001"), ("q", "chunk-002"), ("other", "chunk-000")], "query_id STRING, chunk_id STRING")
    for candidates in (None, some):
        got = S.vector_search(chunks, q, 2, candidates=candidates).orderBy("rank").collect()
        assert [(r.chunk_id, r.score) for r in got] == [("chunk-000", 150.0), ("chunk-001", 149.0)]
    assert S.vector_search(chunks, q, 0).count() == 0
    assert S.shortlist(chunks, q, 8, 100).count() == 24
    with pytest.raises(Exception, match="different lengths"):
        S.maxsim(chunks.withColumns({"matrix": F.array(F.lit(1.0).cast("float")), "dims": F.lit(1)}), q).collect()
    with pytest.raises(Exception, match="different lengths"):
        chunk_rows(spark, [("a", [1.0]), ("a", [1.0, 2.0])]).collect()


def test_a_search_shuffles_no_vectors(spark):
    """Chunks are read and multiplied in one stage; what is shuffled are each task's best rows."""
    chunks = chunk_rows(spark, [(f"c{i}", [float(i), 1.0]) for i in range(50)])
    stored_chunks = stored(chunks, "chunks")
    q = spark.createDataFrame([("q", 0, [1.0, 0.0])], "query_id STRING, q_row INT, vec ARRAY<FLOAT>")
    plan = S.maxsim(stored_chunks, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Sort" not in plan


def test_inverted_file(spark, tmp_path):
    """Recall against the exact search with a shortlist of 4 % of the chunks; lists that aren't probed aren't read."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    rows = [(f"c{i // 5:04}", (centres[rng.integers(40)] + 0.6 * rng.normal(size=16)).tolist()) for i in range(5000)]
    asked = [(f"q{i // 4}", i % 4, (centres[rng.integers(40)] + 0.6 * rng.normal(size=16)).tolist()) for i in range(80)]
    chunks = stored(chunk_rows(spark, rows), "chunks")
    q = spark.createDataFrame(asked, "query_id STRING, q_row INT, vec ARRAY<FLOAT>")
    own, path = lists.centroids(chunks, 64), str(tmp_path / "lists")
    assert own.shape == (64, 16) and np.allclose(np.linalg.norm(own, axis=1), 1)
    lists.write_lists(chunks, own, path)
    table = spark.read.parquet(path)
    assert table.agg(F.sum(F.size("matrix"))).first()[0] == 5000 * 16
    best = {(r.query_id, r.chunk_id) for r in S.vector_search(chunks, q, 10).collect()}
    found = {}
    for probes in (4, 16, 64):
        near = lists.candidates(table, own, q, 40, probes)
        found[probes] = len(best & {(r.query_id, r.chunk_id) for r in S.vector_search(chunks, q, 10, candidates=near).collect()}) / len(best)
    assert found[4] <= found[16] <= found[64] == 1 and found[16] >= 0.9
    probes, recall = lists.calibrated(chunks, table, own, 10, 40, n=12)
    assert probes in (16, 32) and recall >= 0.9
    one = q.where("query_id = 'q0' AND q_row = 0")
    plan = lists.candidates(table, own, one, 40, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[list#\d+ IN \(\d+,\d+\)\]", plan)


def test_group_dedup(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "rank INT, g STRING")
    assert [r.rank for r in S.first_of_groups(rows, F.col("g"), "rank").collect()] == [1, 3]
    assert [r.rank for r in S.first_of_groups(rows, F.col("g"), "rank", 1).collect()] == [1]


def test_chunks_of_one_type_are_one_group(spark, tmp_path):
    (tmp_path / "X.java").write_text("class X { void a() { } void b() { } class Y { int c; } }")
    rows = files.chunks(files.java_files(spark, [str(tmp_path)])).where("kind <> 'file'").withColumn("rank", F.col("chunk_ord"))
    groups = {(r.kind, r.name): r.g for r in rows.withColumn("g", S.enclosing_group()).collect()}
    own = {r.name: r.chunk_id for r in rows.where("kind = 'skeleton'").collect()}
    assert {groups[k] for k in (("type", "X"), ("skeleton", "X"), ("method", "a"), ("method", "b"))} == {own["X"]}
    assert {groups[k] for k in (("type", "Y"), ("skeleton", "Y"), ("field", "c"))} == {own["Y"]}
    assert [(r.kind, r.name) for r in S.first_of_groups(rows, S.enclosing_group(), "rank").collect()] == [("type", "X"), ("type", "Y")]


def test_verdicts(spark):
    empty = ([], [], [], [], [], [])
    cases = [("symbol", [], ["Foo.run"], [], [[40, 45]], [], []), ("second", ["p"], [], [], [], ["s"], []), ("outside", [], ["Foo.run"], [], [[80, 90]], [], []), ("file", ["f"], [], [], [[1, 5]], [], []), ("late", [], ["Foo"], [], [], [], []), ("none", *empty), ("anchor", ["f"], [], [10], [], [], [])]
    hits = [("symbol", 1, "a.foo.RUN", "x", 42, 50), ("second", 1, "z", "s", 1, 2), ("outside", 1, "Foo.run", "x", 20, 30), ("file", 1, None, "f", 9, 9), ("file", 2, None, "f", 5, 9), ("late", 4, "Foo", "x", None, None), ("anchor", 1, None, "f", 35, 40)]
    frame = spark.createDataFrame(cases, "case_id STRING, primary_paths ARRAY<STRING>, primary_symbols ARRAY<STRING>, primary_lines ARRAY<INT>, primary_line_ranges ARRAY<ARRAY<INT>>, secondary_paths ARRAY<STRING>, secondary_symbols ARRAY<STRING>")
    found = spark.createDataFrame(hits, "case_id STRING, rank INT, symbol STRING, file_path STRING, start_line INT, end_line INT")
    got = {r.case_id: (r.verdict, r["rank"], r.line_hit) for r in E.verdicts(frame, found).collect()}
    assert got == {"symbol": ("strong_pass", 1, True), "second": ("near_miss", None, False), "outside": ("near_miss", None, False), "file": ("strong_pass", 2, True), "late": ("pass", 4, False), "none": ("fail", None, False), "anchor": ("strong_pass", 1, True)}
    total = E.summarised(E.verdicts(frame, found)).first()
    assert (total.cases, total.strong_pass, total["pass"], total.near_miss, total.fail, total.score) == (7, 3, 1, 2, 1, 0.5)


# --- names


def test_names(spark):
    assert value(spark, N.package_name(F.lit("package a.b ;"))) == "a.b" and value(spark, N.package_name(F.lit("package ;"))) is None
    assert [value(spark, N.class_name(F.lit(x))) for x in ("com/app/P.class", "Outer$Inner.class", "Outer$1.class", "module-info.class", "a/package-info.class", "x.txt")] == ["com.app.P", "Outer.Inner", None, None, None, None]
    assert value(spark, N.split_clause(F.lit("implements A, B<C,D> "), "implements")) == ["A", "B<C", "D>"] and value(spark, N.split_clause(F.lit(None).cast("string"), "x")) == []
    sign = lambda kind, ret: N.signature(F.lit(kind), F.lit("m"), F.lit("(int a)"), F.lit(ret), L.words(("public",)), L.words(("E", "F")))
    assert value(spark, sign("method", "void")) == "public void m(int a) throws E F" and value(spark, sign("constructor", None)) == "public m(int a) throws E F" and value(spark, sign("field", "int")) is None


@pytest.mark.parametrize("most", [1, 7, 20])
def test_segments_against_a_loop(spark, most):
    texts = ["", "a", "a\n", "ab\ncd\nefghijklmnop\n\nq", "x" * 50, "a\r\nb\rc\nd"]

    def loop(text):
        out, now = [], None
        for line in __import__("re").split(N.LINE_ENDS, text):
            if now is not None and len(now) + len(line) + 1 > most:
                out.append(now)
                now = line
            else:
                now = line if now is None else f"{now}\n{line}"
        return out + [now]

    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", N.segments(F.col("t"), most).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: loop(t) for t in texts}


def test_type_resolution(spark):
    ctx = spark.createDataFrame([("f", "package own;", ["import java.util.List;", "import a.*;", "import b.*;", "import static q.S;"], ["Local"]), ("g", None, [], [])], "filepath STRING, package STRING, imports ARRAY<STRING>, local_types ARRAY<STRING>")
    index = R.type_index(spark.createDataFrame([(n,) for n in ("own.Gate", "a.Gate", "a.Map", "b.Map", "a.One", "java.lang.String", "a.String", "b.Only", "java.lang.Long", "S")], "qualified_name STRING"))
    want = {"List<String>[]": ("explicit_import", "java.util.List<String>[]"), "Gate": ("same_package", "own.Gate"), "One": ("wildcard_import", "a.One"), "Map<K>": ("ambiguous", "Map<K>"), "String": ("ambiguous", "String"), "Long": ("java_lang", "java.lang.Long"), "Local": ("local_type", "own.Local"), "S": ("unresolved", "S"), "?": ("unresolved", "?"), "Map<A,\nB>": ("unresolved", "Map<A,\nB>"), None: ("empty", None)}
    refs = spark.createDataFrame([("f", t) for t in want] + [("g", "Gate")], "filepath STRING, type_name STRING")
    got = {(r.filepath, r.type_name): r for r in R.resolved(refs, R.import_context(ctx), index).collect()}
    assert {t: (got["f", t].strategy, got["f", t].best_name) for t in want} == want
    assert got["f", "Map<K>"].candidates == ["a.Map<K>", "b.Map<K>"] and got["g", "Gate"].strategy == "unresolved"


# --- a workspace on disk

ORDERS = """package com.orders;
import com.pay.Gateway;
/** Places orders. */
public class OrderService {
    private final Gateway gateway = new Gateway();
    public void cancelOrder(String id) { gateway.refund(id); }
    public Hidden secret(Hidden h) { return h.reveal(); }
}
"""
PAY = "package com.pay;\npublic class Gateway {\n    public void refund(String id) { System.out.println(\"refund payment \" + id); }\n}\n"
HIDDEN = "package com.orders;\npublic class Hidden { Hidden reveal() { return this; } }\n"


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
        return str(at)

    put("orders/src/OrderService.java", ORDERS)
    put("pay/src/Gateway.java", PAY)
    put("internal/src/Hidden.java", HIDDEN)
    put("orders/test/OrderTest.java", "package com.orders;\npublic class OrderTest { void check() { new OrderService(); } }\n")
    root = str(tmp_path)
    sets = {
        ":orders:main": {"source_roots": [f"{root}/orders/src", f"{root}/missing"], "compile_classpath_entries": [f"{root}/pay/out"]},
        ":pay:main": {"source_roots": [f"{root}/pay/src"], "output_dirs": [f"{root}/pay/out/"], "project_dependencies": [":orders:main", ":nowhere:main"]},
        ":internal:main": {"source_roots": [f"{root}/internal/src"]},
        ":orders:test": {"source_roots": [f"{root}/orders/test"], "project_dependencies": [":orders:main"]},
    }
    put("workspace.json", json.dumps({"schema_version": 1, "jdk_home": None, "source_sets": sets}))
    return tmp_path


def test_workspace_graph(spark, tree):
    w = Workspace.load(spark, str(tree / "workspace.json"))
    assert w.visible(":orders:main") == [":orders:main", ":pay:main"] and w.visible(":orders:test") == [":orders:test", ":orders:main", ":pay:main"] and w.visible("x") == []
    assert w.owner(f"{tree}/orders/src/a/B.java") == ":orders:main" and w.owner("/else/B.java") is None and split_key(":a:b:main") == (":a:b", "main")
    assert w.visible_roots(":orders:main") == [f"{tree}/orders/src", f"{tree}/missing", f"{tree}/pay/src"]
    paths = spark.createDataFrame([(f"{tree}/orders/src/X.java",), ("/none/Y.java",)], "path STRING")
    assert {r.path: r.source_set for r in owners(paths, w.roots(spark)).collect()} == {f"{tree}/orders/src/X.java": ":orders:main", "/none/Y.java": None}
    for bad in ([], {}, {"schema_version": 2, "source_sets": {}}, {"schema_version": 1, "source_sets": []}, {"source_sets": {}}):
        with pytest.raises(ValueError):
            validate(bad)
    validate({"source_sets": {}}, require_version=False)
    command = export_command("/build", "o")
    assert command[:2] == ["/build/gradlew", "-I"] and command[3:] == ["exportWorkspaceModel", "-Poutput=o"]
    assert all(f"{k}:" in open(command[2]).read() for k in ("schema_version", "jdk_home", "source_sets", *LISTS))


def test_index_search_read_and_refresh(spark, tree):
    w, s, root = Workspace.load(spark, str(tree / "workspace.json")), store.Store(spark, str(tree / "index")), str(tree)
    assert s.status() is None and s.read("documents") is None
    state = indexing.index_workspace(spark, s, repo_root=root, workspace=w)
    assert (state["status"], state["total_files"], state["deferred_source_sets"], state["deferred_files"]) == ("completed", 3, ["test"], 1)
    docs = {r.name: r for r in s.read("documents").where("chunk_kind = 'method'").collect()}
    assert docs["cancelOrder"].resolved_calls == ["com.pay.Gateway.refund"] and docs["secret"].resolved_calls == ["Hidden.reveal"]
    assert docs["cancelOrder"].source_set == ":orders:main" and docs["cancelOrder"].file_path == "orders/src/OrderService.java"
    assert docs["cancelOrder"].retrieval_text.split("\n")[:2] == ["[method] com.orders.OrderService.cancelOrder", "public void cancelOrder(String id)"]

    hits = retrieval.search_code(spark, s, "cancel order", top_k=3).collect()
    assert hits[0].symbol == "com.orders.OrderService.cancelOrder" and hits[0].has_more and "semantic" in hits[0].why_matched
    assert {h.file_path for h in retrieval.search_code(spark, s, "refund", file_path="pay/src/Gateway.java").collect()} == {"pay/src/Gateway.java"}
    assert retrieval.search_code(spark, s, "  ").count() == 0
    row = retrieval.read_code(s, docs["cancelOrder"].chunk_id)
    assert len(row.neighbors) == 2 and {n.kind for n in row.neighbors} <= {"method", "field", "type", "skeleton", "behavior"} and retrieval.read_code(s, "no") is None
    assert retrieval.read_code(s, docs["cancelOrder"].chunk_id, surrounding=False).neighbors == []

    (tree / "pay/src/Gateway.java").write_text(PAY.replace("refund", "repay"))
    indexing.index_file(spark, s, f"{tree}/pay/src/Gateway.java", repo_root=root, workspace=w)
    indexing.index_file(spark, s, f"{tree}/orders/test/OrderTest.java", repo_root=root, workspace=w)
    names = {r.name for r in s.read("documents").where("chunk_kind = 'method'").collect()}
    assert "repay" in names and "refund" not in names and {"cancelOrder", "check"} <= names
    assert s.read("documents", 1).where("name = 'refund'").count() == 1  # an old version is still whole
    assert s.read("vectors").join(s.read("documents"), "chunk_id", "left_anti").count() == 0
    with pytest.raises(ValueError):
        indexing.index_file(spark, s, f"{tree}/no.java", repo_root=root)

    bursts = spark.createDataFrame([(f"{tree}/pay/src/Gateway.java", "2020-01-01", True)], "path STRING, last STRING, deleted BOOLEAN")
    refresh(spark, s, bursts, repo_root=root, workspace=w)
    assert s.read("documents").where("file_path = 'pay/src/Gateway.java'").count() == 0
    s.prune(older_than=0)
    assert s.status()["chunks"] == s.read("documents").count() > 0

    suite = {"benchmark_version": "1", "cases": [{"case_id": "a", "query": "cancel order", "primary_symbols": ["OrderService.cancelOrder"]}, {"case_id": "b", "query": "zzz", "primary_paths": ["nowhere"]}]}
    (tree / "suite.json").write_text(json.dumps(suite))
    result = retrieval.run_suite(spark, s, str(tree / "suite.json"), repo_root=root, top_k=0)
    assert result["top_k"] == 5 and result["strong_pass"] == 1 and result["fail"] == 1 and result["score"] == 0.5
    retrieval.write_artifact(spark, result, str(tree / "out/run.json"))
    made = json.loads((tree / "out/run.json").read_text())
    assert made["retrieval_version"].startswith("hashed-tokens-32/v") and made["cases"] == 2 and made["fixture_path"].endswith("suite.json") and made["repository_candidate_limit_policy"] == "max(search_top_k * 20, 100)"
    with pytest.raises(LookupError, match="inverted file"):
        retrieval.search_code(spark, s, "cancel order", probes=2)
    s.index_lists()
    ids = lambda **how: [h.chunk_id for h in retrieval.search_code(spark, s, "cancel order", **how).collect()]
    assert s.manifest()["lists"]["recall"] >= 0.9 and len(ids(probes=0)) == 5
    assert ids(probes=1000) == ids() and ids(probes=1000, file_path="orders/src/OrderService.java") == ids(file_path="orders/src/OrderService.java")
    (tree / "internal/src/Hidden.java").write_text("package q;\npublic class Hidden { void cancelOrderNow() { } }\n")
    indexing.index_file(spark, s, f"{tree}/internal/src/Hidden.java", repo_root=root, workspace=w)
    assert ids(probes=1000) == ids() and any("cancelOrderNow" in i for i in ids(probes=1000))  # replaced files are searched beside the lists


def log_rows(spark, **status):
    return spark.createDataFrame([(p, "failed" if e else "completed", e) for p, e in status.items()], "path STRING, status STRING, error STRING")


def test_command_line(spark, tree, capsys, monkeypatch):
    from siltstone import cli
    from siltstone import session as module

    monkeypatch.setattr(module, "session", lambda *a, **k: spark)
    at = ["--repo-root", str(tree), "--index", str(tree / "cli-index")]
    run = lambda *words: (cli.main(list(words)), capsys.readouterr().out)[1]
    assert json.loads(run("index", "status", *at)) == {"status": "no index"}
    state = json.loads(run("index", "workspace", *at, "--workspace-json", str(tree / "workspace.json"), "--model", "hashed-tokens-16"))
    assert state["status"] == "completed" and state["model_name"] == "hashed-tokens-16" and state["completed"] == 3
    assert json.loads(run("index", "lists", *at))["version"] == 2
    exact, probed = (json.loads(run("retrieve", "search", *at, "cancel order", "--top-k", "1", "--json", *more)) for more in ([], ["--probes", "500"]))
    assert exact["symbol"] == "com.orders.OrderService.cancelOrder" and exact["retrieval_version"].endswith("exact")
    assert probed.pop("retrieval_version").endswith("probes-500") and exact.pop("retrieval_version") and probed == exact
    monkeypatch.setattr(cli, "subprocess", None)
    assert "exportWorkspaceModel" in run("workspace", "export", "/build", "out.json", "--print")
    shown = run("parse", f"{tree}/orders/src/OrderService.java", "--workspace-json", str(tree / "workspace.json"))
    assert "cancelOrder" in shown and "Gateway -> com.pay.Gateway (explicit_import)" in shown
    with pytest.raises(SystemExit, match="needs a file"):
        cli.main(["parse", "--workspace-json", "x"])
    with pytest.raises(Exception, match="pylate"):
        cli.main(["index", "workspace", *at, "--workspace-json", str(tree / "workspace.json"), "--model", "some/model", "--device", "cpu"])


def test_an_empty_index_is_made_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    assert s.create("m", "t") == 1 and s.create("other", "t") == 1
    assert s.status() == {"chunks": 0, "indexed_at": "t", "model_name": "m"} and s.read("vectors").count() == 0


def test_build_state_and_log(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    with pytest.raises(store.CorruptState):
        s.finish()
    s.start("/r", "sig", "m", "t", 2)
    s.note(log_rows(spark, a=None, b="broken"))
    assert s.finish()["status"] == "partial"
    again = s.start("/r", "sig", "m", "t2", 2)
    assert again["status"] == "in_progress" and [r.path for r in s.done().collect()] == ["a"]
    s.note(log_rows(spark, b=None))
    assert sorted((r.path, r.status, r.error, r.attempt) for r in s.log().collect()) == [("a", "completed", None, 1), ("b", "completed", None, 2)]
    s.compact()
    assert len(s.staged()["log"]) == 1 and s.log().count() == 2
    assert s.finish() == s.state() and s.state()["status"] == "completed" and (s.state()["completed"], s.state()["failed"]) == (2, 0)
    assert "a" not in json.dumps([v for k, v in s.state().items() if k not in ("repo_root", "status", "workspace_signature", "build")])
    s.start("/r", "sig", "m", "t3", 2)
    assert s.done().count() == 0
    s.files.write(str(tmp_path / "i/state.json"), "{")
    with pytest.raises(store.CorruptState):
        s.state()


def rows_of(spark, **texts):
    """(documents, vectors, changed) of one chunk per file."""
    documents = spark.createDataFrame([(p, p, t) for p, t in texts.items()], "chunk_id STRING, file_path STRING, source_text STRING")
    documents = documents.select(*(F.col(c) if c in documents.columns else F.lit(None).cast(k).alias(c) for c, k in spark.createDataFrame([], store.DOCUMENTS).dtypes))
    vectors = documents.select("chunk_id", "file_path", F.lit(1).alias("dims"), F.array(F.lit(1.0).cast("float")).alias("matrix"))
    return documents, vectors, documents.select("file_path")


def texts(s):
    return {r.file_path: r.source_text for r in s.read("documents").collect()}


def test_two_writers_lose_no_update(spark, tmp_path, monkeypatch):
    """One writer reads a version; another publishes before it does.  Both updates stay, also where both touch one bucket."""
    monkeypatch.setattr(store, "BUCKETS", 2)
    s = store.Store(spark, str(tmp_path / "i"))
    s.save(*rows_of(spark, **{k: "old" for k in "abcdefgh"})[:2], "m", "t")
    real, others, rewritten = store.Store._publish, ["b", "c"], []

    def racing(self, read, manifest):
        if others:
            name = others.pop()
            documents, vectors, changed = rows_of(spark, **{name: "new"})
            store.Store(spark, self.path).replace_files(changed, documents, vectors, "m", "t")
        return real(self, read, manifest)

    monkeypatch.setattr(store.Store, "_publish", racing)
    written = store.Store._write
    monkeypatch.setattr(store.Store, "_write", lambda self, frames, n: rewritten.append(1) or written(self, frames, n))
    documents, vectors, changed = rows_of(spark, a="new")
    s.replace_files(changed, documents, vectors, "m", "t")
    assert texts(s) == {k: "new" if k in "abc" else "old" for k in "abcdefgh"}
    assert s.read("vectors").count() == 8 and len(rewritten) <= 6


def test_a_build_carries_over_what_was_refreshed(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    s.save(*rows_of(spark, a="old", b="old")[:2], "m", "t")
    s.start("/r", "sig", "m", "t", 2)
    documents, vectors, changed = rows_of(spark, a="built", b="built")
    s.replace_files(changed, documents, vectors, "m", "t", staged=True, log=log_rows(spark, **{"/r/a": None, "/r/b": None}))
    documents, vectors, changed = rows_of(spark, b="refreshed")
    assert s.replace_files(changed, documents, vectors, "m", "t", batch=("stream", 4)) == 2
    assert s.finish()["status"] == "completed" and texts(s) == {"a": "built", "b": "refreshed"} and s.applied(("stream", 4))
    # Under another model the vectors can't be taken over: the file is to be done again.
    s.start("/r", "other", "m2", "t", 2)
    s.replace_files(changed, *rows_of(spark, a="again", b="again")[:2], "m2", "t", staged=True, log=log_rows(spark, **{"/r/a": None, "/r/b": None}))
    s.replace_files(changed, documents, vectors, "m", "t")
    assert s.finish()["status"] == "partial" and [r.path for r in s.done().collect()] == ["/r/a"]


def test_a_batch_that_comes_again_changes_nothing(spark, tree):
    s, root = store.Store(spark, str(tree / "index")), str(tree)
    bursts = spark.createDataFrame([(f"{tree}/pay/src/Gateway.java", "2020-01-01", False)], "path STRING, last STRING, deleted BOOLEAN")
    s.save(spark.createDataFrame([], store.DOCUMENTS), spark.createDataFrame([], store.VECTORS), "m", "t")
    assert refresh(spark, s, bursts, repo_root=root, batch=("at", 0)) == 2
    assert refresh(spark, s, bursts, repo_root=root, batch=("at", 0)) is None and s.version() == 2
    assert refresh(spark, s, bursts, repo_root=root, batch=("elsewhere", 0)) == 3 and refresh(spark, s, bursts, repo_root=root, batch=("at", 1)) == 4
    assert s.replace_files(bursts.select(F.lit("x").alias("file_path")), *rows_of(spark, x="y")[:2], "m", "t", batch=("at", 1)) is None and "x" not in texts(s)


def test_clashing_ids_fail_the_file(spark, tmp_path):
    (tmp_path / "X.java").write_text("class X { void a() { run(new Runnable() { public void run() { go(1); } }); run(new Runnable() { public void run() { go(2); } }); } }")
    docs, failed = indexing.build(files.java_files(spark, [str(tmp_path)]), str(tmp_path), None, spark, "t")
    assert docs.count() == 0 and "duplicate id" in failed.first().error


def test_documents_of_chunks(spark, tmp_path):
    (tmp_path / "B.java").write_text("package p;\nclass B extends C implements D, E {\n int a;\n void x() {}\n void over(int first) { call(1); }\n void over(String first) { call(2); }\n" + "".join(f" static final int CONSTANT_{i} = {i};\n" for i in range(200)) + "}\n")
    rows = files.chunks(files.java_files(spark, [str(tmp_path)])).withColumns({"repo_root": F.lit(str(tmp_path)), "source_set": F.lit(None).cast("string")}).cache()
    docs = index_documents(rows, "now").collect()
    names = [d.name for d in docs]
    assert "a" not in names and "x" not in names and len({d.chunk_id for d in docs if d.name == "over"}) == 2
    parts = [d for d in docs if d.chunk_kind == "skeleton"]
    assert len(parts) > 1 and all(len(d.source_text) <= 4096 for d in parts) and f"segment 1/{len(parts)}" in parts[0].retrieval_text and any("CONSTANT_199" in d.source_text for d in parts)
    assert parts[0].implements == ["D", "E"] and parts[0].extends == "C"
    skeleton = retrieval_documents(rows).where("kind = 'skeleton'").first()
    assert "extends extends C" in skeleton.retrieval_text.split("\n") and skeleton.resolved_symbols == ["extends C"]


def test_symbols(spark, tmp_path):
    (tmp_path / "O.java").write_text("package p; class Outer { class Inner { } void m() { class Local { } } } ")
    assert {r.qualified_name for r in files.source_symbols(files.java_files(spark, [str(tmp_path)]), "c").collect()} == {"p.Outer", "p.Outer.Inner"}
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        for n in ("com/app/P.class", "Outer$Inner.class", "Outer$1.class", "readme.txt"):
            z.writestr(n, "")
    (tmp_path / "classes/q").mkdir(parents=True)
    (tmp_path / "classes/q/R.class").write_bytes(b"x")
    got = {(r.qualified_name, r.origin_kind) for r in files.binary_symbols(spark, [str(tmp_path / "a.jar"), str(tmp_path / "classes"), str(tmp_path / "gone.jar")]).collect()}
    assert got == {("com.app.P", "binary"), ("Outer.Inner", "binary"), ("q.R", "binary")}
    (tmp_path / "jmods").mkdir()
    with zipfile.ZipFile(tmp_path / "jmods/java.base.jmod", "w") as z:
        for n in ("classes/java/lang/String.class", "classes/module-info.class", "bin/java"):
            z.writestr(n, "")
    assert [r.qualified_name for r in files.jdk_symbols(spark, str(tmp_path)).collect()] == ["java.lang.String"]
    with pytest.raises(FileNotFoundError):
        files.jdk_symbols(spark, str(tmp_path / "classes"))
    assert [tuple(r) for r in files.top_level_types(files.java_files(spark, [str(tmp_path)])).collect()] == [("Outer", ["p.Outer"])]


def test_encoder_and_batches(spark):
    seen = []

    def small(texts):
        seen.append(len(texts))
        if len(texts) > 1:
            raise RuntimeError("CUDA out of memory")
        return [[[1.0]] for _ in texts]

    assert len(bisected(small, ["a", "b", "c"])) == 3 and max(seen) == 3
    with pytest.raises(RuntimeError):
        bisected(lambda t: (_ for _ in ()).throw(RuntimeError("out of memory")), ["a"])
    with pytest.raises(RuntimeError, match="other"):
        bisected(lambda t: (_ for _ in ()).throw(RuntimeError("other")), ["a", "b"])
    docs = spark.createDataFrame([("c", "f", "getBean bean"), ("d", "f", "")], "chunk_id STRING, file_path STRING, retrieval_text STRING")
    rows = embedded(docs, HashedEncoder(8)).collect()
    assert [(r.chunk_id, r.dims, len(r.matrix)) for r in rows] == [("c", 8, 16), ("d", 0, 0)]
    assert sum(x * x for x in rows[0].matrix[:8]) == pytest.approx(1, abs=1e-5)


def test_table_forms(spark):
    rows = spark.createDataFrame([("r", "a_b:1", "m"), ("r", "axb:1", "m"), (None, "a_b:2", "f")], "repo_root STRING, chunk_id STRING, kind STRING")
    assert {r.chunk_id for r in store.without_prefix(rows, "r", "a_b:").collect()} == {"axb:1", "a_b:2"}
    assert {r.chunk_id for r in store.without(rows, repo_root="r").collect()} == {"a_b:2"}
    assert [r.chunk_id for r in store.listed(rows, kind="m").collect()] == ["a_b:1", "axb:1"]
    new = spark.createDataFrame([("r", "a_b:1", "z")], rows.schema)
    assert {(r.chunk_id, r.kind) for r in store.upserted(rows, new, "chunk_id").collect()} == {("a_b:1", "z"), ("axb:1", "m"), ("a_b:2", "f")}


def test_bursts(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    events = spark.createDataFrame([("a", at(0), False), ("a", at(1), False), ("a", at(5), True), ("b", at(0), False)], "path STRING, t STRING, deleted BOOLEAN").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.path, r.n, r.deleted) for r in debounced(events).collect()) == [("a", 1, True), ("a", 2, False), ("b", 1, False)]


def test_fingerprints_and_cache(spark, tmp_path):
    (tmp_path / "A.java").write_text("class A { }")
    w = Workspace.from_dict({"source_sets": {":a:main": {"source_roots": [str(tmp_path)]}}})
    cache = indexing.SymbolCache(spark)
    first = cache.source([str(tmp_path)], w)
    assert cache.source([str(tmp_path)], w) is first
    (tmp_path / "B.java").write_text("class B { }")
    assert {r.qualified_name for r in cache.source([str(tmp_path)], w).collect()} == {"A", "B"}


def test_another_session_parses_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text("class A { class B { } }")
    w, root, at = Workspace.from_dict({"source_sets": {":a:main": {"source_roots": [str(tmp_path / "src")]}}}), str(tmp_path / "src"), str(tmp_path / "symbols")
    first = {r.qualified_name for r in indexing.SymbolCache(spark, at).source([root], w).collect()}
    assert [r.qualified_name for r in R.ordered(R.merged(*(indexing.SymbolCache(spark, at).source([root], w) for _ in range(2)))).collect()] == ["A", "A.B"]
    monkeypatch.setattr(indexing, "source_symbols", lambda *a: pytest.fail("parsed again"))
    assert {r.qualified_name for r in indexing.SymbolCache(spark, at).source([root], w).collect()} == first == {"A", "A.B"}
    (tmp_path / "src/C.java").write_text("class C { }")
    with pytest.raises(BaseException, match="parsed again"):
        indexing.SymbolCache(spark, at).source([root], w)


def test_signatures(spark, monkeypatch):
    import hashlib

    paths = spark.createDataFrame([(p,) for p in "cabca"], "path STRING")
    assert indexing.signature(paths) == hashlib.sha1(b"a\nb\nc\n").hexdigest()
    many = spark.range(5000).select(F.col("id").cast("string").alias("path"))
    one = indexing.digest(many.repartition(3), "path")
    assert one == indexing.digest(many.orderBy(F.rand(1)).repartition(11), "path") != indexing.digest(many.where("id < 4999"), "path")
    monkeypatch.setattr(indexing, "LISTED", 10)
    assert indexing.signature(many) == one


def test_closure_of_a_long_chain(spark, monkeypatch):
    from siltstone.sources import workspace

    rounds, real = [], workspace.stored
    monkeypatch.setattr(workspace, "stored", lambda frame, name: rounds.append(name) or real(frame, name))
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(300, 200), (7, 7)], "src long, dst long"))
    got = {(r.start, r.node) for r in closure(edges, spark.createDataFrame([(0,), (250,), (900,)], "start long")).collect()}
    assert got == {(0, n) for n in range(301)} | {(250, n) for n in range(200, 301)} | {(900, 900)} and rounds.count("front") <= 11


def test_neighbours_against_all_pairs(spark):
    import random

    pick = random.Random(5)
    rows = [(f"{pick.choice('ab')}{i:03}", pick.choice(["f", "g"]), pick.choice([None, 0, 1, 1, 5, 9, pick.randint(0, 60)])) for i in range(150)] + [("z1", "h", 3)]
    docs = spark.createDataFrame(rows, "chunk_id STRING, file_path STRING, start_line INT")
    targets = docs.unionByName(spark.createDataFrame([("outside", "f", 33), ("nowhere", "none", 1)], docs.schema))
    for limit in (1, 2, 4):
        want = {}
        for t, file, line in [*rows, ("outside", "f", 33)]:
            want[t] = [c for _, c in sorted((abs((n or 0) - (line or 0)), c) for c, f, n in rows if f == file and c != t)[:limit]]
        got = {}
        for r in S.neighbours(targets, docs, limit).orderBy("target_id", "rank").collect():
            got.setdefault(r.target_id, []).append(r.chunk_id)
        assert got == {k: v for k, v in want.items() if v}


def test_a_build_that_dies_goes_on(spark, tree, monkeypatch):
    """The second of three batches fails: the old index stays in sight, and the next run takes up after the first batch."""
    w, s, root = Workspace.load(spark, str(tree / "workspace.json")), store.Store(spark, str(tree / "index")), str(tree)
    for i in range(12):
        (tree / f"pay/src/More{i}.java").write_text(f"package com.more;\npublic class More{i} {{ int value{i}() {{ return {i}; }} }}\n")
    s.save(spark.createDataFrame([], store.DOCUMENTS), spark.createDataFrame([], store.VECTORS), "old", "t")
    real, calls = store.Store.replace_files, []

    def dying(self, *args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(self, *args, **options)

    monkeypatch.setattr(store.Store, "replace_files", dying)
    with pytest.raises(RuntimeError, match="killed"):
        indexing.index_workspace(spark, s, repo_root=root, workspace=w, batch_files=5)
    first = {r.path for r in s.done().collect()}
    assert 0 < len(first) < 15 and s.status() == {"chunks": 0, "indexed_at": "t", "model_name": "old"}
    state = indexing.index_workspace(spark, s, repo_root=root, workspace=w, batch_files=5)
    log = {r.path: r.attempt for r in s.log().collect()}
    assert state["status"] == "completed" and state["completed"] == len(log) == 15 and first < set(log) and set(log.values()) == {1}
    names = {r.name for r in s.read("documents").where("chunk_kind = 'method'").collect()}
    assert {f"value{i}" for i in range(12)} | {"cancelOrder", "refund"} <= names and s.staged() is None
    assert s.read("documents").groupBy("chunk_id").count().where("count > 1").count() == 0


def test_small_files_are_replaced_in_one_step(spark, tmp_path):
    f = store.Files(spark)
    at = str(tmp_path / "x.json")
    f.write(at, "one")
    f.write(at, "two")
    assert f.read(at) == "two" and f.names(str(tmp_path)) and not f.create(at, "three") and f.create(str(tmp_path / "y"), "z")


def test_exact_search_against_plain_sums(spark):
    """Kernel with partial best rows against a plain loop, ties and NaN included."""
    rng = np.random.default_rng(4)
    vecs = [(f"c{i // 3:03}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(240)] + [("cnan", [float("nan")] * 4), ("c000", [float("nan"), 0.0, 0.0, 0.0])]
    qs = [(f"q{i // 2}", i % 2, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(8)]
    v = chunk_rows(spark, vecs)
    q = spark.createDataFrame(qs, "query_id string, q_row int, vec array<float>")
    want = {}
    for query in {x[0] for x in qs}:
        scores = {}
        for c in {x[0] for x in vecs}:
            dots = [[float(np.dot(a, b)) for n, a in vecs if n == c] for qid, _, b in qs if qid == query]
            best = [max(x for x in row if x == x) for row in dots if any(x == x for x in row)]
            if best:
                scores[c] = sum(best)
        want[query] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7]
    every = v.select("chunk_id").crossJoin(q.select("query_id").distinct())
    for candidates in (None, every):
        got = S.vector_search(v, q, 7, candidates=candidates).orderBy("query_id", "rank").collect()
        assert {k: [(r.chunk_id, r.score) for r in got if r.query_id == k] for k in want} == want
