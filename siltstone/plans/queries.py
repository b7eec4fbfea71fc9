"""Registered queries: every operator bound to the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import lexical as L
from siltstone.functions import naming as N
from siltstone.functions.encoder import HashedEncoder, embedded, query_vectors
from siltstone.functions.vectors import matrices, sane
from siltstone.operators import evaluate as E
from siltstone.operators import lists as IVF
from siltstone.operators import resolve as R
from siltstone.operators import search as S
from siltstone.operators.documents import index_documents, retrieval_documents, twice_named
from siltstone.plans import indexing as I
from siltstone.plans.retrieval import load_suite, write_artifact
from siltstone.schemas import CHUNKS, DOCUMENTS
from siltstone.scratch import scratch, stored
from siltstone.session import spread
from siltstone.sources import store as T
from siltstone.sources.files import archive_symbols, chunks, scan, source_symbols, top_level_types
from siltstone.sources.workspace import Workspace, closure, inferred_edges, owners
from siltstone.streaming.refresh import debounced

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENS = "list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
STOP = ", ".join(f"'{w}'" for w in L.STOPWORDS)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with much work for each row, in as many tasks as there are cores at least."""
    return spread(table(spark, sf_dir, name).select(*columns))


# --- query terms and scores


@query(f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS INT) AS n_tokens, CAST(len(list_distinct({TOKENS.format('text')})) AS INT) AS n_distinct FROM documents")
def tokenize_terms(spark, sf_dir):
    own = spread_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", L.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


SIGNIFICANT = f"list_filter({TOKENS.format('text')}, lambda x: len(x) > 1 AND x NOT IN ({STOP}))"


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct({SIGNIFICANT})), ' ') AS terms FROM benchmark")
def significant_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(L.significant(F.col("text"))), " ").alias("terms"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({TOKENS.format('p_type')}, ['bean', 'lookup', 'get', 'getbean', 'find', 'findbean', 'resolve', 'resolvebean', 'beandefinition', 'beanregistration']))), ' ') AS terms FROM part")
def synonym_expand(spark, sf_dir):
    terms = L.expanded(F.array_distinct(L.tokens(F.concat(F.col("p_type"), F.lit(" bean lookup")))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(terms), " ").alias("terms"))


@query(
    f"""WITH q AS (SELECT DISTINCT item_id, unnest({SIGNIFICANT}) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
    m AS (SELECT item_id, doc_id, count(*) AS n_common FROM q JOIN d USING (term) GROUP BY ALL)
    SELECT item_id, doc_id, n_common, round(0.12::DOUBLE * least(n_common, 6), 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n_common DESC, doc_id) <= 10"""
)
def term_overlap_score(spark, sf_dir):
    """The ten documents that share most terms with each item."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), L.significant(F.col("text")).alias("terms"))
    d = spread_table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("chunk_id"), F.array_distinct(L.tokens(F.col("text"))).alias("terms"))
    best = S.ranked(S.overlaps(d, q, 10), "score", 10)
    n = F.col("score").cast("long")
    return best.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), n.alias("n_common"), F.round(F.lit(0.12) * F.least(n, F.lit(6)), 6).alias("score"))


@query(
    """SELECT p_partkey, round(CAST(CASE p_size % 3 WHEN 0 THEN 0.7 WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN -0.75 WHEN 1 THEN -0.35 WHEN 2 THEN 0.5 ELSE -1.2 END ELSE 0 END
    + CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0 END + 0.35 + 0.15 AS DOUBLE), 6) AS bias FROM part"""
)
def implementation_bias(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "method").when(size % 3 == 1, "type").otherwise("field")
    head = F.when(size % 4 == 0, "public interface ").when(size % 4 == 1, "public abstract class ").when(size % 4 == 2, "public class ").otherwise("public @interface ")
    name = F.concat(F.when(size % 2 == 0, "Default").otherwise("Simple"), F.lit("Finder"), F.col("p_partkey").cast("string"))
    own = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), name.alias("name"), F.concat(head, name).alias("source"))
    steps = L.bias(F.col("kind"), F.col("name"), F.expr(N.STRINGS), F.col("source"), F.lit("find it"), L.tokens(F.col("name")), L.words(("find",)))
    total = F.lit(0.0)
    for condition, delta, _ in steps:
        total = total + F.when(condition, delta).otherwise(F.lit(0.0))
    return own.select("p_partkey", F.round(total, 6).alias("bias"))


@query("SELECT CASE WHEN o_totalprice / 100000 >= 2.5 THEN 'high' WHEN o_totalprice / 100000 >= 1.0 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM orders GROUP BY 1")
def confidence_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(L.confidence(F.col("o_totalprice") / 100000).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({FLAT}) > 200 THEN left({FLAT}, 197) || '...' ELSE {FLAT} END AS summary FROM documents")
def summary_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.summary(F.col("text")).alias("summary"))


# --- vectors: five consecutive vectors are one chunk, every twentieth chunk is a query


def _vectors(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    return own.select(F.expr("vec_id div 5").alias("chunk_id"), F.expr("cast(vec_id % 5 as int)").alias("token_pos"), F.col("embedding").alias("vec"), F.col("label").alias("shard"))


def _chunks(spark, sf_dir):
    """The index: one row per chunk, stored; searches only read it."""
    return stored(matrices(_vectors(spark, sf_dir)), "chunks")


def _queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("token_pos").alias("q_row"), "vec")


V = "v AS (SELECT vec_id // 5 AS chunk_id, vec_id % 5 AS pos, embedding::DOUBLE[] AS vec, label AS shard FROM embeddings), q AS (SELECT chunk_id AS query_id, pos AS q_row, vec FROM v WHERE chunk_id % 20 = 0), d AS (SELECT q.query_id, q.q_row, v.chunk_id, v.shard, list_dot_product(v.vec, q.vec) AS dot FROM v CROSS JOIN q)"
MAXSIM = f"{V}, b AS (SELECT query_id, chunk_id, q_row, max(dot) AS best FROM d GROUP BY ALL), m AS (SELECT query_id, chunk_id, sum(best) AS score FROM b GROUP BY ALL)"


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS query_id, count(*) AS n, round(sum(list_dot_product(a.e, b.e)), 4) AS total, round(max(list_dot_product(a.e, b.e)), 6) AS best FROM v a CROSS JOIN v b WHERE a.vec_id % 20 = 0 GROUP BY 1")
def vector_dot(spark, sf_dir):
    """Ids divisible by 20 against all vectors: how many each met, the sum of the products and the greatest."""
    own = table(spark, sf_dir, "embeddings")
    asked = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("q_row"), F.col("embedding").alias("vec"))
    return S.dot_totals(own.select(F.col("embedding").alias("vec")), asked).select("query_id", "n", F.round("total", 4).alias("total"), F.round("best", 6).alias("best"))


@query(f"WITH {MAXSIM} SELECT query_id, chunk_id, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 50")
def maxsim_topk(spark, sf_dir):
    return S.vector_search(_chunks(spark, sf_dir), _queries(spark, sf_dir), 50).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(SQL["maxsim_topk"])
def probed_lists(spark, sf_dir):
    """The same by an inverted file whose lists are all probed: the shortlist of 200 holds the 50 best."""
    chunks, path = _chunks(spark, sf_dir), scratch(spark, "lists")
    own = IVF.centroids(chunks)
    IVF.write_lists(chunks, own, path)
    near = IVF.candidates(spark.read.parquet(path), own, _queries(spark, sf_dir), 200, probes=len(own))
    return S.vector_search(chunks, _queries(spark, sf_dir), 50, candidates=near).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {V}, t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, shard, q_row ORDER BY dot DESC, chunk_id DESC) <= 8),
    b AS (SELECT query_id, shard, q_row, chunk_id, max(dot) AS best FROM t GROUP BY ALL), s AS (SELECT query_id, chunk_id, sum(best) AS total FROM b GROUP BY ALL)
    SELECT query_id, chunk_id, round(total, 6) AS total FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) <= 20"""
)
def ann_shortlist(spark, sf_dir):
    return S.shortlist(matrices(_vectors(spark, sf_dir), "shard"), _queries(spark, sf_dir), 8, 20).select("query_id", "chunk_id", F.round("total", 6).alias("total"))


def _search(spark, sf_dir, **filters):
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    documents = d.select(
        F.col("doc_id").alias("chunk_id"), F.lit("document").alias("chunk_kind"), none.alias("package"), F.expr(N.STRINGS).alias("owner_chain"), none.alias("name"), none.alias("signature"), F.col("source").alias("file_path"),
        F.col("text").alias("retrieval_text"), F.col("text").alias("source_text"), F.expr(N.STRINGS).alias("modifiers"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("lang").alias("source_set"),
    )
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = _vectors(spark, sf_dir)
    query_vectors = vectors.join(asked, F.col("chunk_id") == F.col("query_id"), "left_semi").select(F.col("chunk_id").alias("query_id"), F.col("token_pos").alias("q_row"), "vec")
    hits = S.search(documents, _chunks(spark, sf_dir), asked, query_vectors, 10, **filters)
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "confidence", "has_more")


def _search_sql(where: str = "true") -> str:
    return f"""WITH v AS (SELECT vec_id // 5 AS chunk_id, vec_id % 5 AS pos, embedding::DOUBLE[] AS vec FROM embeddings),
    f AS (SELECT doc_id AS chunk_id, text, source FROM documents WHERE {where}),
    w AS (SELECT v.* FROM v WHERE chunk_id IN (SELECT chunk_id FROM f) OR {'true' if where == 'true' else 'false'}),
    d AS (SELECT q.chunk_id AS query_id, q.pos AS q_row, w.chunk_id, max(list_dot_product(w.vec, q.vec)) AS best FROM w CROSS JOIN (SELECT * FROM v WHERE chunk_id IN (SELECT item_id FROM benchmark)) q GROUP BY 1, 2, 3),
    n AS (SELECT query_id, chunk_id, sum(best) AS semantic FROM d GROUP BY 1, 2), m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, chunk_id) <= 100),
    q AS (SELECT item_id, trim(text) AS query, {SIGNIFICANT} AS terms FROM benchmark),
    s AS (SELECT query_id, chunk_id, semantic + 0.2 * least(len(list_intersect(terms, {TOKENS.format('f.source')})), 3) + 0.12 * least(len(list_distinct(list_intersect(terms, {TOKENS.format('f.text')}))), 6)
      + CASE WHEN contains(lower(f.text), lower(query)) THEN 0.6 ELSE 0 END AS score FROM m JOIN f USING (chunk_id) JOIN q ON q.item_id = m.query_id)
    SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, chunk_id, round(score, 6) AS score, CASE WHEN score >= 2.5 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence, count(*) OVER (PARTITION BY query_id) > 10 AS has_more
    FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER w <= 10"""


@query(_search_sql())
def hybrid_search(spark, sf_dir):
    """Flagship: late interaction, then the lexical rerank."""
    return _search(spark, sf_dir)


@query(_search_sql("lang = 'en' AND source = 'src1'"))
def search_filtered(spark, sf_dir):
    return _search(spark, sf_dir, source_set="en", file_path="src1")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0.2 OR x < -0.2 THEN 0::DOUBLE ELSE x::DOUBLE END)), 6) AS total FROM embeddings")
def vector_sanitize(spark, sf_dir):
    bad = F.transform("embedding", lambda x: F.when(x > F.lit(0.2).cast("float"), F.lit(float("nan"))).when(x < F.lit(-0.2).cast("float"), F.lit(float("-inf"))).otherwise(x).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(sane(bad), F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# --- groups, neighbours, reads


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def group_dedup(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("rank", F.struct(-F.col("l_extendedprice"), F.col("l_linenumber")))
    return S.first_of_groups(own, F.col("l_orderkey"), "rank").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """SELECT a.conv_id * 1000 + a.turn AS target_id, b.conv_id * 1000 + b.turn AS chunk_id, CAST(row_number() OVER w AS INT) AS rank FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn
    WINDOW w AS (PARTITION BY a.conv_id, a.turn ORDER BY abs(a.turn - b.turn), b.turn) QUALIFY row_number() OVER w <= 2"""
)
def neighbor_read(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("file_path"), F.col("turn").alias("start_line"))
    return S.neighbours(own, own).select("target_id", "chunk_id", "rank")


@query(
    f"""WITH d AS (SELECT doc_id::VARCHAR AS id, source, lang, text, n_chars::INT AS line FROM documents), one AS (SELECT * FROM d WHERE id = '7'),
    n AS (SELECT d.id FROM d JOIN one USING (source) WHERE d.id <> '7' ORDER BY abs(d.line - one.line), d.id LIMIT 2)
    SELECT id AS chunk_id, 'document' AS kind, 'p.' || lang AS symbol, source AS file_path, CASE WHEN length({FLAT}) > 200 THEN left({FLAT}, 197) || '...' ELSE {FLAT} END AS summary, line AS start_line, 'p' AS package_name, (SELECT string_agg(id, ',') FROM n) AS neighbors FROM one"""
)
def point_read(spark, sf_dir):
    """One chunk by its id, with its context and its nearest neighbours."""
    row = S.read(_documents(spark, sf_dir), "7")
    return row.select("chunk_id", "kind", "symbol", "file_path", "summary", "start_line", "surrounding_context.package_name", F.array_join(F.transform("neighbors", lambda n: n["chunk_id"]), ",").alias("neighbors"))


def _documents(spark, sf_dir):
    """Documents as chunks: named by language, by source as file, the number of characters as line."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.lit("document").alias("chunk_kind"), F.lit("p").alias("package"), F.expr(N.STRINGS).alias("owner_chain"), F.col("lang").alias("name"), none.alias("signature"), F.col("source").alias("file_path"),
        F.col("text").alias("retrieval_text"), F.col("text").alias("source_text"), F.expr(N.STRINGS).alias("modifiers"), F.col("n_chars").cast("int").alias("start_line"), F.col("n_chars").cast("int").alias("end_line"), F.col("lang").alias("source_set"), none.alias("indexed_at"),
    )


# --- evaluation: items are cases, documents of good quality that share words are hits


def _eval(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    cases = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("case_id"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("primary_paths"), F.expr(N.STRINGS).alias("primary_symbols"), F.expr("cast(array() as array<int>)").alias("primary_lines"),
        F.array(F.array((F.col("item_id") * 20).cast("int"), (F.col("item_id") * 20 + 400).cast("int"))).alias("primary_line_ranges"), F.array(F.concat(F.lit("src"), ((F.col("item_id") + 1) % 20).cast("string"))).alias("secondary_paths"), F.expr(N.STRINGS).alias("secondary_symbols"),
    )
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi").select("doc_id", "source", "lang", (F.col("doc_id") % 997).cast("int").alias("start_line"))
    best = d.withColumn("case_id", F.col("doc_id") % 40).withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy("doc_id")))
    hits = best.select("case_id", "rank", F.col("lang").alias("symbol"), F.col("source").alias("file_path"), "start_line", (F.col("start_line") + 10).alias("end_line"))
    return cases, hits


JUDGED = """WITH h AS (SELECT doc_id % 40 AS case_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS rank, source, doc_id % 997 AS a FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    j AS (SELECT case_id, rank, source = 'src' || (case_id % 20) AS path, source = 'src' || ((case_id + 1) % 20) AS second, greatest(a, case_id * 20) <= least(a + 10, case_id * 20 + 400) AS line FROM h),
    v AS (SELECT item_id AS case_id, min(rank) FILTER (path AND line) AS rank, bool_or(path OR second) AS near FROM benchmark LEFT JOIN j ON j.case_id = item_id GROUP BY item_id),
    c AS (SELECT case_id, CASE WHEN rank <= 3 THEN 'strong_pass' WHEN rank IS NOT NULL THEN 'pass' WHEN near THEN 'near_miss' ELSE 'fail' END AS verdict, CAST(rank AS INT) AS rank FROM v)"""


@query(f"{JUDGED} SELECT * FROM c")
def eval_case_verdict(spark, sf_dir):
    return E.verdicts(*_eval(spark, sf_dir)).select("case_id", "verdict", "rank")


@query(f"{JUDGED} SELECT count(*) AS cases, count_if(verdict = 'strong_pass')::BIGINT AS strong_pass, count_if(verdict = 'pass')::BIGINT AS pass, count_if(verdict = 'near_miss')::BIGINT AS near_miss, count_if(verdict = 'fail')::BIGINT AS fail, round((2 * count_if(verdict = 'strong_pass') + count_if(verdict = 'pass')) / (2 * count(*)), 6) AS score FROM c")
def eval_suite_summary(spark, sf_dir):
    out = E.summarised(E.verdicts(*_eval(spark, sf_dir)))
    return out.select("cases", *(F.col(c).cast("decimal(38,0)").cast("long").alias(c) for c in ("strong_pass", "pass", "near_miss", "fail")), F.round("score", 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey, 100) <= least(l_partkey + CAST(l_quantity AS INT), 900) AS hit FROM lineitem")
def line_range_overlap(spark, sf_dir):
    start = F.col("l_partkey").cast("int")
    hit = E.line_match(start, start + F.col("l_quantity").cast("int"), F.expr("cast(array() as array<int>)"), F.array(F.array(F.lit(100), F.lit(900))), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hit.alias("hit"))


# --- workspace and symbols


PREFIXES = [(":a:main", "https:", 0), (":b:main", "https://", 1), (":c:main", "http:", 2)]


@query("SELECT page_id, url, CASE WHEN url LIKE 'https:/%' THEN ':a:main' WHEN url LIKE 'http:/%' THEN ':c:main' END AS source_set FROM pages")
def longest_prefix_owner(spark, sf_dir):
    roots = spark.createDataFrame([(k, r.rstrip("/"), i) for k, r, i in PREFIXES], "source_set STRING, root STRING, ordinal INT")
    return owners(table(spark, sf_dir, "pages").select("page_id", "url"), roots, "url")


EDGES = "e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey) % 25 FROM nation WHERE n_regionkey = 2)"


@query(f"WITH RECURSIVE {EDGES}, c AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation UNION SELECT c.start, e.dst FROM c JOIN e ON c.node = e.src) SELECT start::BIGINT AS start, node::BIGINT AS node FROM c")
def visible_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    edges = n.select(key.alias("src"), ((key * 7 + 3) % 25).alias("dst")).unionByName(n.where("n_regionkey = 2").select(key.alias("src"), ((key + F.col("n_regionkey")) % 25).alias("dst")))
    return closure(edges, n.select(key.alias("start")))


@query("SELECT DISTINCT s.s_suppkey AS src, c.c_custkey AS dst FROM supplier s JOIN customer c ON s.s_nationkey * 1000 + s.s_suppkey % 50 = c.c_nationkey * 1000 + c.c_custkey % 50 WHERE s.s_suppkey <> c.c_custkey")
def inferred_classpath_edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") * 1000 + F.col("s_suppkey") % 50).alias("entry"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dst"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 50).alias("entry"))
    return inferred_edges(s, c)


@query("SELECT string_split(replace(p_name, ' ', '.'), '.')[-1] AS simple_name, array_to_string(list_sort(list_distinct(list(replace(p_name, ' ', '.')))), ',') AS candidates FROM part GROUP BY 1")
def type_index_group(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.translate("p_name", " ", ".").alias("qualified_name"))
    return R.type_index(names).select("simple_name", F.array_join("candidates", ",").alias("candidates"))


@query("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def symbol_merge_distinct(spark, sf_dir):
    return R.merged(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")))


@query(
    """SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'explicit_import' WHEN 1 THEN 'same_package' WHEN 2 THEN 'wildcard_import' WHEN 3 THEN 'ambiguous' WHEN 5 THEN 'local_type' WHEN 6 THEN 'java_lang' WHEN 7 THEN 'empty' WHEN 8 THEN CASE WHEN p_partkey % 2 = 0 THEN 'explicit_import' ELSE 'unresolved' END ELSE 'unresolved' END AS strategy,
    CASE p_size % 9 WHEN 0 THEN 'x.y.T0<A>' WHEN 1 THEN 'own.T1<A>' WHEN 2 THEN 'w.T2<A>' WHEN 5 THEN 'own.T5<A>' WHEN 6 THEN 'java.lang.T6<A>' WHEN 7 THEN NULL WHEN 8 THEN CASE WHEN p_partkey % 2 = 0 THEN 'late.T8<A>' ELSE 'T8<A>' END ELSE 'T' || (p_size % 9) || '<A>' END AS best_name,
    CASE WHEN p_size % 9 = 3 THEN 'w.T3<A>,z.T3<A>' ELSE '' END AS candidates FROM part"""
)
def resolve_precedence(spark, sf_dir):
    """Every strategy, in two files that differ in their imports."""
    name = F.when(F.col("p_size") % 9 != 7, F.concat(F.lit("T"), (F.col("p_size") % 9).cast("string"), F.lit("<A>")))
    refs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), (F.col("p_partkey") % 2).cast("string")).alias("filepath"), name.alias("type_name"))
    common = ["import x.y.T0;", "import w.*;", "import z.*;", "import static q.T4;"]
    files = spark.createDataFrame([("f0", "package own;", [*common, "import early.T8;", "import late.T8;"], ["T5"]), ("f1", "package own;", common, ["T5"])], "filepath STRING, package STRING, imports ARRAY<STRING>, local_types ARRAY<STRING>")
    names = spark.createDataFrame([(n,) for n in ("own.T1", "w.T1", "w.T2", "w.T3", "z.T3", "k.T4", "own.T5", "java.lang.T6", "k.T8")], "qualified_name STRING")
    return R.resolved(refs, R.import_context(files), R.type_index(names)).select("p_partkey", "strategy", "best_name", F.array_join("candidates", ",").alias("candidates"))


# --- names and texts


@query("SELECT n_regionkey, sha1(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS signature FROM nation GROUP BY 1")
def signature_hash(spark, sf_dir):
    """The signature of each region's names."""
    return I.signatures(table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("path")), "n_regionkey")


@query("SELECT p_partkey, substr(sha1('/repo/' || p_brand), 1, 12) || ':' || p_type || ':method:p.' || p_name || '(' || p_size || ')' AS chunk_id FROM part")
def chunk_identity(spark, sf_dir):
    name = N.chunk_id(F.concat(F.lit("/repo/"), F.col("p_brand")), F.col("p_type"), F.lit("method"), F.lit("p"), F.expr(N.STRINGS), F.col("p_name"), F.concat(F.lit("( "), F.col("p_size").cast("string"), F.lit("\n)")), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("chunk_id"))


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'), lambda x: length(x)) AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, n, 2 AS pos, n[1] AS size, 1 AS segments, 0::BIGINT AS longest FROM l UNION ALL
      SELECT doc_id, n, pos + 1, CASE WHEN size + n[pos] + 1 > 4096 THEN n[pos] ELSE size + n[pos] + 1 END, CASE WHEN size + n[pos] + 1 > 4096 THEN segments + 1 ELSE segments END, CASE WHEN size + n[pos] + 1 > 4096 THEN greatest(longest, size) ELSE longest END FROM s WHERE pos <= len(n))
    SELECT doc_id, segments::INT AS n_segments, greatest(longest, size)::INT AS longest FROM s WHERE pos > len(n)"""
)
def segment_lines(spark, sf_dir):
    """Segments of every whole text."""
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", N.segments(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").alias("n_segments"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query(
    """WITH d AS (SELECT *, regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS t FROM documents)
    SELECT substr(sha1('/r'), 1, 12) || ':' || source || '/' || lang || ':behavior:' || (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) AS chunk_id, '[behavior] p' AS first_line, length(t)::INT AS n FROM d WHERE length(t) >= 20"""
)
def position_counter(spark, sf_dir):
    """Documents as behaviours of a file each source and language: positions count those of 20 characters or more."""
    d = table(spark, sf_dir, "documents")
    given = {"chunk_ord": F.col("doc_id").cast("int"), "kind": F.lit("behavior"), "filepath": F.concat_ws("/", F.lit("/r"), "source", "lang"), "text": F.col("text")}
    # Every file has a chunk of its own, which gives the package: no file_package, whose nulls would say that there is none.
    fields = [f for f in StructType.fromDDL(CHUNKS).fields if f.name != "file_package"]
    rows = d.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields), F.lit("/r").alias("repo_root"), F.lit(None).cast("string").alias("source_set"))
    files = rows.dropDuplicates(["filepath"]).withColumns({"kind": F.lit("file"), "package": F.lit("package p;")})
    out = index_documents(rows.unionByName(files), "now")
    return out.select("chunk_id", F.regexp_extract("retrieval_text", r"^\[behavior\] \w+", 0).alias("first_line"), F.length("source_text").alias("n"))


@query("SELECT p_partkey, '[method] own.' || p_name || chr(10) || p_type || chr(10) || CASE WHEN p_size % 2 = 0 THEN '@A @B' || chr(10) ELSE '' END || p_brand AS retrieval_text FROM part")
def retrieval_text(spark, sf_dir):
    kind = F.lit("method")
    notes = F.when(F.col("p_size") % 2 == 0, L.words(("@A", "@B"))).otherwise(F.expr(N.STRINGS))
    text = N.retrieval_text(kind, N.label(kind, F.lit("own"), F.expr(N.STRINGS), F.col("p_name")), N.declaration(kind, F.col("p_brand"), F.col("p_type")), notes, F.col("p_brand"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("retrieval_text"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 'com.' || n_name || '.Inner' END AS qualified_name FROM nation")
def class_entry_names(spark, sf_dir):
    entry = F.concat(F.lit("com/"), F.col("n_name"), F.when(F.col("n_regionkey") == 0, "$1.class").otherwise("$Inner.class"))
    return table(spark, sf_dir, "nation").select("n_nationkey", N.class_name(entry).alias("qualified_name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_payload_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.payload_value(F.col("props"), "k").alias("k"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS packed FROM part")
def sparse_payload(spark, sf_dir):
    """Payloads drop blanks; reading them back gives the rest."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.lit("").alias("blank"), F.expr(N.STRINGS).alias("none"))
    packed = own.withColumn("j", N.payload({"p_name": "string", "p_brand": "string", "blank": "string", "none": "array<string>"}))
    return packed.select("p_partkey", F.concat_ws("|", *(N.payload_value(F.col("j"), k) for k in ("p_name", "p_brand", "blank", "none"))).alias("packed"))


# --- maintenance


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def replace_by_key(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.where("o_custkey % 10 = 0").withColumn("o_totalprice", F.lit(0.0))
    return T.upserted(old, new, "o_custkey").select("o_orderkey", "o_totalprice")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    """The first of each user's events by time, newest first."""
    own = table(spark, sf_dir, "events").withColumn("rank", F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")))
    return S.first_of_groups(own, F.col("user_id"), "rank").select("user_id", "event_id")


@query("SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def pending_files(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("path"))
    return I.pending(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")), done)


@query("SELECT CASE WHEN source IN ('src1', 'src2', 'src3') THEN ':' || source || ':main' WHEN source LIKE 'src1%' THEN ':many:gen' END AS source_set, count(*) AS count FROM documents GROUP BY 1")
def count_by_source_set(spark, sf_dir):
    sets = {f":src{i}:main": {"source_roots": [f"/w/src{i}"]} for i in (1, 2, 3)} | {":many:gen": {"generated_source_roots": [f"/w/src1{i}" for i in range(10)]}}
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("/w"), "source", F.col("doc_id").cast("string")).alias("path"))
    return I.files_by_set(files, Workspace.from_dict({"source_sets": sets}), spark)


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k"""
)
def debounce_sessions(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("deleted", F.lit(False))
    return debounced(own, "1 hour", None, "user_id").select("user_id", "first", "last", "n")


def _java(spark, sf_dir):
    """A Java file made of each part, of one of four shapes: a class with a lambda, an interface, an enum, a class with an inner one."""
    size = F.col("p_size").cast("string")
    lines = {
        0: F.concat(F.lit(" class Part{} {\n    private int size = "), size, F.lit(";\n    int size() { run(() -> size); return size; }\n}\n")),
        1: F.lit(" interface Part{} {\n    int max(int a, int b);\n    default int both() { return max(1, 2); }\n}\n"),
        2: F.concat(F.lit(" enum Part{} {\n    ONE(1), TWO("), size, F.lit(");\n    private final int code;\n    Part{}(int code) { this.code = code; }\n    int code() { return code; }\n}\n")),
        3: F.concat(F.lit(" class Part{} {\n    private String name = \""), F.col("p_name"), F.lit("\";\n    Part{}() { }\n    String name() { return name; }\n    static class Inner {\n        void run() { System.gc(); }\n    }\n}\n")),
    }
    text = F.when(F.col("p_size") % 4 == 0, lines[0]).when(F.col("p_size") % 4 == 1, lines[1]).when(F.col("p_size") % 4 == 2, lines[2]).otherwise(lines[3])
    source = F.concat(F.lit("package own;\npublic"), F.replace(text, F.lit("{}"), F.col("p_partkey").cast("string")))
    return spread_table(spark, sf_dir, "part", "p_partkey", "p_size", "p_name").select(F.col("p_partkey").cast("string").alias("path"), source.cast("binary").alias("content"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'behavior,field,file,method,skeleton,type' WHEN 1 THEN 'file,method,method,skeleton,type' WHEN 2 THEN 'constructor,enum_constant,enum_constant,field,file,method,skeleton,type' ELSE 'constructor,field,file,method,method,skeleton,skeleton,type,type' END AS kinds,
    CASE p_size % 4 WHEN 0 THEN 'own.Part' || p_partkey || '.size()' WHEN 1 THEN 'own.Part' || p_partkey || '.max(int a, int b)' WHEN 2 THEN 'own.Part' || p_partkey || '.code()' ELSE 'own.Part' || p_partkey || '.Inner.run()' END AS method FROM part"""
)
def java_chunks(spark, sf_dir):
    rows = chunks(_java(spark, sf_dir))
    name = F.max(F.when((F.col("kind") == "method") & ~F.col("name").isin("both", "name"), F.concat(F.lit("own."), F.array_join("owner_chain", "."), F.lit("."), F.col("name"), F.col("parameters"))))
    return rows.groupBy(F.col("filepath").cast("long").alias("p_partkey")).agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), name.alias("method"))


# --- single functions on the driver's tables


@query("SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace('package ' || replace(p_name, ' ', '.') || ';;', '^package ', ''), ';+$', '')), '') AS package, CASE WHEN contains(p_type, ' ') THEN regexp_replace(replace(p_type, ' ', '.'), '\\.[^.]*$', '') END AS parent, string_split(replace(p_type, ' ', '.'), '.')[-1] AS simple FROM part")
def package_and_parent(spark, sf_dir):
    kind = F.translate("p_type", " ", ".")
    return table(spark, sf_dir, "part").select("p_partkey", N.package_name(F.concat(F.lit("package "), F.translate("p_name", " ", "."), F.lit(";;"))).alias("package"), R.parent(kind).alias("parent"), R.simple(kind).alias("simple"))


@query("SELECT p_partkey, p_brand || '/' || p_name AS path FROM part")
def relative_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.relative_path(F.concat_ws("/", F.lit("/repo"), "p_brand", "p_name"), F.lit("/repo")).alias("path"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Owner' ELSE p_name END AS name FROM part")
def display_names(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "behavior").when(F.col("p_size") % 3 == 1, "constructor").otherwise("method")
    name = F.when(F.col("p_size") % 3 != 1, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", N.display_name(kind, name, L.words(("Outer", "Owner"))).alias("name"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS names, replace(p_type, ' ', ', ') AS clause FROM part")
def clauses(spark, sf_dir):
    implements = F.concat(F.lit("implements "), F.replace("p_name", F.lit(" "), F.lit(" , ")))
    extends = F.concat(F.lit("extends "), F.replace("p_type", F.lit(" "), F.lit(", ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(N.split_clause(implements, "implements"), "|").alias("names"), N.strip_clause(extends, "extends").alias("clause"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN trim(CASE WHEN p_size % 2 = 0 THEN 'public static ' ELSE '' END || p_brand || ' ' || p_name || '(int a)' || CASE WHEN p_size % 5 = 0 THEN ' throws E F' ELSE '' END)
    WHEN p_size % 3 = 1 THEN trim(CASE WHEN p_size % 2 = 0 THEN 'public static ' ELSE '' END || p_name || '(int a)' || CASE WHEN p_size % 5 = 0 THEN ' throws E F' ELSE '' END) END AS signature FROM part"""
)
def signatures(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "method").when(F.col("p_size") % 3 == 1, "constructor").otherwise("field")
    some = lambda n, *w: F.when(F.col("p_size") % n == 0, L.words(w)).otherwise(F.expr(N.STRINGS))
    return table(spark, sf_dir, "part").select("p_partkey", N.signature(kind, F.col("p_name"), F.lit("(int a)"), F.col("p_brand"), some(2, "public", "static"), some(5, "E", "F")).alias("signature"))


@query("SELECT c_custkey, c_custkey % 7 = 0 AS asks FROM customer")
def asks_implementation(spark, sf_dir):
    word = F.when(F.col("c_custkey") % 7 == 0, F.when(F.col("c_custkey") % 2 == 0, "where").otherwise("getBean")).otherwise("list")
    terms = F.array_distinct(L.tokens(F.concat(F.lit("show "), word, F.lit(" orders"))))
    return table(spark, sf_dir, "customer").select("c_custkey", L.asks_implementation(F.array_distinct(F.concat(terms, F.array(F.lower(word))))).alias("asks"))


@query("SELECT s_suppkey, s_nationkey % 5 = 2 OR s_nationkey = 7 AS hit FROM supplier")
def symbol_match(spark, sf_dir):
    symbol = F.when(F.col("s_nationkey") % 5 == 2, "own.Thing.CancelOrder").when(F.col("s_nationkey") == 7, "other.REFUND").when(F.col("s_nationkey") % 5 == 3, "else")
    return table(spark, sf_dir, "supplier").select("s_suppkey", E.symbol_match(symbol, L.words(("Thing.cancelOrder", "", "refund"))).alias("hit"))


@query("SELECT l_orderkey, l_linenumber, abs(l_partkey - 500) <= 25 OR abs(l_partkey - 900) <= 25 AS hit FROM lineitem")
def line_anchors(spark, sf_dir):
    hit = E.line_match(F.col("l_partkey").cast("int"), F.lit(None).cast("int"), F.array(F.lit(500), F.lit(900)), F.expr("cast(array() as array<array<int>>)"), F.lit(25))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hit.alias("hit"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def listed_rows(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), "c_name", F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("repo_root"))
    return T.listed(own, repo_root="3", kind="BUILDING").select(F.col("chunk_id").alias("c_custkey"), "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 3 AND c_mktsegment LIKE 'B%') AND NOT (c_nationkey = 4)")
def removed_rows(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("repo_root"), F.col("c_mktsegment").alias("chunk_id"))
    return T.without(T.without_prefix(own, "3", "B"), repo_root="4").select("c_custkey")


@query(
    """SELECT n.n_regionkey::VARCHAR AS source_set, s.s_name AS qualified_name FROM supplier s JOIN nation n ON s.s_nationkey % 5 <= n.n_regionkey WHERE s.s_suppkey % 3 <> 0
    UNION SELECT DISTINCT n_regionkey::VARCHAR, s_name FROM nation, supplier WHERE s_suppkey % 3 = 0"""
)
def visible_symbols(spark, sf_dir):
    """Symbols by the sets that see their containers; those of the JDK by all."""
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "jdk").when(F.col("s_suppkey") % 3 == 1, "source").otherwise("binary")
    symbols = s.select(F.col("s_name").alias("qualified_name"), (F.col("s_nationkey") % 5).cast("string").alias("container"), kind.alias("origin_kind"))
    sees = spark.createDataFrame([(str(a), str(b), k) for a in range(5) for b in range(a + 1) for k in ("source", "binary")], "source_set STRING, container STRING, origin_kind STRING")
    return R.visible_names(symbols, sees)


# --- Java files: members, names, documents


#: What the files of ``_java`` hold, by shape; {} stands for the part's key.
MEMBERS = """m(shape, kind, name, nested, line, col, modifiers, result, parameters, calls, touched, code) AS (VALUES
    (0, 'method', 'size', '', 4, 5, '', 'int', '()', 'run', 'size', 'int size() { run(() -> size); return size; }'), (1, 'method', 'max', '', 3, 5, '', 'int', '(int a, int b)', '', '', 'int max(int a, int b);'),
    (1, 'method', 'both', '', 4, 5, 'default', 'int', '()', 'max', '', 'default int both() { return max(1, 2); }'), (2, 'constructor', 'Part{}', '', 5, 5, '', NULL, '(int code)', '', 'code', 'Part{}(int code) { this.code = code; }'),
    (2, 'method', 'code', '', 6, 5, '', 'int', '()', '', 'code', 'int code() { return code; }'), (3, 'constructor', 'Part{}', '', 4, 5, '', NULL, '()', '', '', 'Part{}() { }'),
    (3, 'method', 'name', '', 5, 5, '', 'String', '()', '', 'name', 'String name() { return name; }'), (3, 'method', 'run', '.Inner', 7, 9, '', 'void', '()', 'System.gc', '', 'void run() { System.gc(); }')),
    w AS (SELECT p_partkey, p_partkey::VARCHAR AS path, 'Part' || p_partkey || nested AS owner, kind, replace(name, '{}', p_partkey::VARCHAR) AS name, line, col, modifiers, result, parameters, calls, touched,
      replace(code, '{}', p_partkey::VARCHAR) AS code, concat_ws(' ', nullif(modifiers, ''), result, replace(name, '{}', p_partkey::VARCHAR) || parameters) AS sig FROM part JOIN m ON p_size % 4 = shape)"""


def _joined(*columns: str) -> list:
    return [F.array_join(c, " ").alias(c) for c in columns]


@query(f"WITH {MEMBERS} SELECT p_partkey, kind, name, replace(owner, '.', ' ') AS owner_chain, line AS start_line, line AS end_line, col AS start_col, col + length(code) AS end_col, modifiers, result AS return_type, parameters, calls, touched AS fields_accessed, code AS text FROM w")
def java_members(spark, sf_dir):
    """Methods and constructors, with their places, calls and fields."""
    rows = chunks(_java(spark, sf_dir)).where("kind in ('method', 'constructor')")
    return rows.select(
        F.col("filepath").cast("long").alias("p_partkey"), "kind", "name", "start_line", "end_line", "start_col", F.col("end_col"), "return_type", "parameters", "text", *_joined("owner_chain", "modifiers", "calls", "fields_accessed")
    )


@query(
    """SELECT p_partkey, kind, name, line AS start_line, modifiers, type AS field_type FROM part JOIN (VALUES (0, 'field', 'size', 3, 'private', 'int'), (2, 'enum_constant', 'ONE', 3, '', NULL), (2, 'enum_constant', 'TWO', 3, '', NULL),
    (2, 'field', 'code', 4, 'private final', 'int'), (3, 'field', 'name', 3, 'private', 'String')) f(shape, kind, name, line, modifiers, type) ON p_size % 4 = shape"""
)
def java_fields(spark, sf_dir):
    rows = chunks(_java(spark, sf_dir)).where("kind in ('field', 'enum_constant')")
    return rows.select(F.col("filepath").cast("long").alias("p_partkey"), "kind", "name", "start_line", "field_type", *_joined("modifiers"))


@query(
    """SELECT p_partkey, name, replace(replace(text, '{}', p_partkey::VARCHAR), '~', chr(10)) AS text FROM (
    SELECT p_partkey, 'Part' || p_partkey AS name, CASE p_size % 4 WHEN 0 THEN 'public class Part{}~  private int size = ' || p_size || ';~  int size()' WHEN 1 THEN 'public interface Part{}~  int max(int a, int b)~  default int both()'
      WHEN 2 THEN 'public enum Part{}~  constants: ONE, TWO~  private final int code;~  Part{}(int code)~  int code()' ELSE 'public class Part{}~  private String name = "' || p_name || '";~  Part{}()~  String name()' END AS text FROM part
    UNION ALL SELECT p_partkey, 'Inner', 'static class Inner~  // enclosing: Part{}~  void run()' FROM part WHERE p_size % 4 = 3)"""
)
def java_skeletons(spark, sf_dir):
    """The outline of each type."""
    return chunks(_java(spark, sf_dir)).where("kind = 'skeleton'").select(F.col("filepath").cast("long").alias("p_partkey"), "name", "text")


TYPES = "SELECT p_partkey, 'own.Part' || p_partkey AS qualified_name FROM part UNION ALL SELECT p_partkey, 'own.Part' || p_partkey || '.Inner' FROM part WHERE p_size % 4 = 3"


@query(f"SELECT qualified_name, ':app:main' AS container, 'source' AS origin_kind, p_partkey::VARCHAR AS filepath FROM ({TYPES})")
def source_type_symbols(spark, sf_dir):
    """Qualified names of top-level and member types."""
    return source_symbols(_java(spark, sf_dir), ":app:main")


@query("SELECT 'Part' || p_partkey AS simple_name, 'own.Part' || p_partkey AS candidates FROM part")
def top_level_index(spark, sf_dir):
    return top_level_types(_java(spark, sf_dir)).select("simple_name", F.array_join("candidates", ",").alias("candidates"))


@query(f"WITH {MEMBERS} SELECT p_partkey, name, CASE WHEN calls = 'System.gc' AND p_partkey % 2 = 0 THEN 'java.lang.System.gc' ELSE calls END AS calls FROM w WHERE kind = 'method'")
def resolved_calls(spark, sf_dir):
    """Calls by what their file's source set sees: only one of two sees the class."""
    rows = chunks(_java(spark, sf_dir)).withColumn("source_set", (F.col("filepath").cast("long") % 2).cast("string"))
    index = R.type_index(spark.createDataFrame([("0", "java.lang.System")], "source_set STRING, qualified_name STRING"), "source_set")
    return R.resolved_chunks(rows, index, "source_set").where("kind = 'method'").select(F.col("filepath").cast("long").alias("p_partkey"), "name", *_joined("calls"))


@query(
    f"""WITH {MEMBERS} SELECT substr(sha1('/r'), 1, 12) || ':' || path || ':' || kind || ':own.' || owner || '.' || name || regexp_replace(parameters, '\\s+', '', 'g') AS chunk_id, path AS file_path, sig AS signature, 'own' AS package,
    '[' || kind || '] own.' || owner || '.' || name || chr(10) || sig || chr(10) || code AS retrieval_text, ':m' AS source_set FROM w WHERE length(code) >= 20"""
)
def method_documents(spark, sf_dir):
    """Documents of methods and constructors, those of fewer than 20 characters left out."""
    rows = chunks(_java(spark, sf_dir)).withColumns({"filepath": F.concat(F.lit("/r/"), "filepath"), "repo_root": F.lit("/r"), "source_set": F.lit(":m")})
    out = index_documents(rows, "now").where("chunk_kind in ('method', 'constructor')")
    return out.select("chunk_id", "file_path", "signature", "package", "retrieval_text", "source_set")


@query(
    f"""WITH {MEMBERS} SELECT p_partkey, name, concat_ws(chr(10), 'package own', 'filepath ' || path, 'source_set :m', 'owner ' || replace(owner, '.', ' '), 'kind ' || kind, 'name ' || name, 'signature ' || sig, 'modifiers ' || nullif(modifiers, ''),
    'fields_accessed ' || nullif(touched, ''), 'calls ' || nullif(calls, ''), 'resolved_symbols ' || nullif(calls, ''), 'code ' || code) AS retrieval_text FROM w"""
)
def labelled_documents(spark, sf_dir):
    """Retrieval documents: a line for each property, and the symbols referred to."""
    rows = chunks(_java(spark, sf_dir)).withColumns({"repo_root": F.lit("/r"), "source_set": F.lit(":m")})
    return retrieval_documents(rows).where("kind in ('method', 'constructor')").select(F.col("filepath").cast("long").alias("p_partkey"), "name", "retrieval_text")


@query("SELECT p_brand AS file_path, 'duplicate id: ' || min(p_name) AS error FROM (SELECT p_brand, p_name FROM part GROUP BY ALL HAVING count(*) > 1) GROUP BY 1")
def clashing_ids(spark, sf_dir):
    return twice_named(table(spark, sf_dir, "part").select(F.col("p_brand").alias("file_path"), F.col("p_name").alias("chunk_id")))


# --- scores, encoders, stores and workspaces over whole tables


def _common(column: str) -> str:
    return f"len(list_distinct(list_intersect(terms, {TOKENS.format(column)})))"


@query(
    f"""WITH a AS (SELECT *, p_name AS query, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) ELSE 'Other' END AS name, list_distinct({TOKENS.format('p_name')}) AS terms FROM part),
    b AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN name ELSE 'own.' || name END AS symbol, CASE WHEN p_size % 2 = 0 THEN 'void ' || p_name || '()' ELSE 'int ' || split_part(p_name, ' ', 2) || '()' END AS signature,
      lower(p_type) || '/' || split_part(p_name, ' ', 2) AS path, CASE WHEN p_size % 7 < 3 THEN upper(p_name) || ' ' || p_brand ELSE p_type END AS body FROM a),
    c AS (SELECT p_partkey, p_size, CASE WHEN lower(query) = lower(name) THEN 1.0 WHEN contains(lower(query), lower(name)) THEN 0.4 ELSE 0 END::DOUBLE AS x1, CASE WHEN contains(lower(query), lower(symbol)) THEN 0.8 ELSE 0 END::DOUBLE AS x2,
      CASE WHEN contains(lower(signature), lower(query)) THEN 0.6 ELSE 0 END::DOUBLE AS x3, 0.45::DOUBLE * {_common('name')} AS x4, 0.3::DOUBLE * {_common('symbol')} AS x5, 0.2::DOUBLE * least({_common('signature')}, 3) AS x6,
      0.2::DOUBLE * least({_common('path')}, 3) AS x7, 0.12::DOUBLE * least({_common('body')}, 6) AS x8, CASE WHEN contains(lower(body), lower(query)) THEN 0.6 ELSE 0 END::DOUBLE AS x9 FROM b)
    SELECT p_partkey, round(p_size / 10 + x1 + x2 + x3 + x4 + x5 + x6 + x7 + x8 + x9, 6) AS score, (1 + (x1 > 0)::INT + (x2 > 0)::INT + (x3 > 0)::INT + (x4 > 0)::INT + (x5 > 0)::INT + (x6 > 0)::INT + (x7 > 0)::INT + (x8 > 0)::INT + (x9 > 0)::INT)::INT AS n_reasons FROM c"""
)
def hybrid_boosts(spark, sf_dir):
    """The boosts of names, symbols, signatures, paths and texts, and how many reasons are stated."""
    size, own = F.col("p_size"), F.col("p_name")
    name = F.when(size % 3 == 0, own).when(size % 3 == 1, F.split_part(own, F.lit(" "), F.lit(1))).otherwise("Other")
    rows = table(spark, sf_dir, "part").withColumn("name", name)
    second = F.split_part(own, F.lit(" "), F.lit(2))
    out = L.hybrid(
        rows, query=own, semantic=size / 10, name=F.col("name"), symbol=F.when(size % 5 == 0, F.col("name")).otherwise(F.concat(F.lit("own."), "name")),
        signature=F.when(size % 2 == 0, F.concat(F.lit("void "), own, F.lit("()"))).otherwise(F.concat(F.lit("int "), second, F.lit("()"))), path=F.concat_ws("/", F.lower("p_type"), second),
        text=F.when(size % 7 < 3, F.concat_ws(" ", F.upper(own), "p_brand")).otherwise(F.col("p_type")), kind=F.lit("field"), modifiers=F.expr(N.STRINGS), source=F.lit(""),
    )
    return out.select("p_partkey", F.round("score", 6).alias("score"), F.size("why_matched").alias("n_reasons"))


@query(f"SELECT doc_id, len(list_distinct(({TOKENS.format('text')})[1:8192])) AS n, 32 AS dims FROM documents WHERE len({TOKENS.format('text')}) > 0")
def encoded_tokens(spark, sf_dir):
    """How many vectors each text gets, and of how many numbers."""
    rows = spread_table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("f").alias("file_path"), F.col("text").alias("retrieval_text"))
    out = embedded(rows, HashedEncoder()).where("dims > 0")
    return out.select(F.col("chunk_id").cast("long").alias("doc_id"), (F.size("matrix") / F.col("dims")).cast("long").alias("n"), "dims")


EVAL_CASES = """WITH h AS (SELECT doc_id % 40 AS case_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS rank, 'p.' || lang AS symbol, source, doc_id % 997 AS a FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    j AS (SELECT case_id, rank, symbol, case_id % 3 < 2 AND contains(symbol, '.en') AS sym, source = 'src' || (case_id % 20) AS path, abs(a - case_id * 20) <= 25 AND case_id % 3 > 0 AS line FROM h),
    p AS (SELECT *, CASE case_id % 3 WHEN 0 THEN sym WHEN 1 THEN sym AND line ELSE path AND line END AS hit FROM j),
    v AS (SELECT item_id AS case_id, min(rank) FILTER (hit) AS rank, min_by(symbol, rank) FILTER (hit) AS symbol, bool_or(sym OR path OR symbol = 'p.fr') AS near FROM benchmark LEFT JOIN p ON p.case_id = item_id GROUP BY item_id)"""


@query(f"{EVAL_CASES} SELECT case_id, CASE WHEN rank <= 3 THEN 'strong_pass' WHEN rank IS NOT NULL THEN 'pass' WHEN near THEN 'near_miss' ELSE 'fail' END AS verdict, CAST(rank AS INT) AS rank, symbol FROM v")
def eval_symbols_and_anchors(spark, sf_dir):
    """Verdicts by symbols, by symbols and anchors, and by paths and anchors, one kind of case in three each."""
    cases, hits = _eval(spark, sf_dir)
    k, none = F.col("case_id") % 3, F.expr(N.STRINGS)
    ints = "cast(array() as array<int>)"
    cases = cases.withColumns({
        "primary_symbols": F.when(k < 2, F.array(F.lit(".EN"))).otherwise(none), "primary_lines": F.when(k > 0, F.array((F.col("case_id") * 20).cast("int"))).otherwise(F.expr(ints)),
        "primary_line_ranges": F.expr("cast(array() as array<array<int>>)"), "secondary_paths": none, "secondary_symbols": F.array(F.lit("P.fr")),
    })
    return E.verdicts(cases, hits.withColumn("symbol", F.concat(F.lit("p."), "symbol"))).select("case_id", "verdict", "rank", "symbol")


@query("SELECT doc_id::VARCHAR AS chunk_id, coalesce(source, 'none') AS file_path, CASE WHEN source = 'src3' THEN 'new' ELSE 'old' END AS indexed_at, coalesce(length(text), 0) AS n FROM documents WHERE source IS DISTINCT FROM 'src4'")
def stored_snapshot(spark, sf_dir):
    """An index saved whole, then one file replaced and one removed; what readers of the newest manifest see."""
    own = table(spark, sf_dir, "documents")
    given = {"chunk_id": F.col("doc_id").cast("string"), "file_path": F.coalesce("source", F.lit("none")), "source_text": F.col("text"), "indexed_at": F.lit("old")}
    documents = own.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(DOCUMENTS).fields))
    vectors = documents.select("chunk_id", "file_path", F.lit(1).alias("dims"), F.array(F.lit(1.0).cast("float")).alias("matrix"))
    store = T.Store(spark, scratch(spark, "store"))
    store.save(documents, vectors, "model", "old")
    changed = spark.createDataFrame([("src3",), ("src4",)], "file_path STRING")
    store.replace_files(changed, documents.where("file_path = 'src3'").withColumn("indexed_at", F.lit("new")), vectors.where("file_path = 'src3'"), "model", "new")
    return store.read("documents").select("chunk_id", "file_path", "indexed_at", F.coalesce(F.length("source_text"), F.lit(0)).alias("n"))


@query(
    """WITH RECURSIVE c AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation UNION SELECT start, (node * 7 + 3) % 25 FROM c)
    SELECT ':n' || start || ':main' AS source_set, ':n' || node || ':main' AS container, 'source' AS origin_kind FROM c UNION SELECT ':n' || start || ':main', '/lib/' || n_regionkey || '.jar', 'binary' FROM c JOIN nation ON n_nationkey = node"""
)
def workspace_visibility(spark, sf_dir):
    """What each source set sees, by its dependencies: sets and binary entries.  A workspace is a small description."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    sets = {f":n{n}:main": {"project_dependencies": [f":n{(n * 7 + 3) % 25}:main"], "external_jars": [f"/lib/{r}.jar"], "source_roots": [f"/w/n{n}"]} for n, r in nations}
    return Workspace.from_dict({"schema_version": 1, "source_sets": sets}, require_version=True).visibility(spark)


@query("SELECT p_brand || '.java' AS name, sum(strlen(p_name) + 1)::BIGINT AS bytes FROM part GROUP BY 1")
def scanned_files(spark, sf_dir):
    """A folder of texts for each brand: the Java files below two roots, of which one doesn't exist and one is given twice, with their sizes."""
    own = table(spark, sf_dir, "part").select("p_name", F.concat("p_brand", F.lit(".java")).alias("name"))
    root = scratch(spark, "files")
    # A folder may have any name; the files in it are what is scanned.
    own.repartition("name").write.partitionBy("name").option("compression", "none").text(root)
    found = scan(spark, [root, f"{root}/none", root], "part-*.txt", content=False)
    folder = F.element_at(F.split("path", "/"), -2)
    name = F.url_decode(F.regexp_replace(folder, "^name=", ""))
    return found.groupBy(name.alias("name")).agg(F.sum("length").alias("bytes"))


ARCHIVES = """SELECT replace(p_brand, '#', '') AS brand, p_partkey FROM part"""


@query(
    f"""SELECT 'own.' || brand || '.Part' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.Inner' ELSE '' END AS qualified_name, brand || '.jar' AS container, 'binary' AS origin_kind FROM ({ARCHIVES}) WHERE p_partkey % 5 <> 0
    UNION SELECT 'own.' || brand || '.Part' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.Inner' ELSE '' END, brand || '.jmod', 'jdk' FROM ({ARCHIVES}) WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0"""
)
def archive_class_symbols(spark, sf_dir):
    """An archive and a module for each brand, one class file for each part: classes and member classes, anonymous ones left out; of modules what lies under classes/."""
    brand, key = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_partkey")
    inner = F.when(key % 5 == 0, "$1").when(key % 3 == 0, "$Inner").otherwise("")
    entry = F.concat(F.lit("own/"), brand, F.lit("/Part"), key.cast("string"), inner, F.lit(".class"))
    own = table(spark, sf_dir, "part").select(brand.alias("brand"), entry.alias("entry"), F.when(key % 2 == 0, "classes/").otherwise("lib/").alias("top"))
    jars = own.select(F.concat("brand", F.lit(".jar")).alias("path"), "entry").unionByName(own.where("entry like '%Part1%'").select(F.concat("brand", F.lit(".jar")).alias("path"), F.lit("META-INF/MANIFEST.MF").alias("entry")).distinct())
    modules = own.select(F.concat("brand", F.lit(".jmod")).alias("path"), F.concat("top", "entry").alias("entry"))

    def pack(rows):
        import io
        import zipfile

        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name in rows["entry"]:
                archive.writestr(name, b"")
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [out.getvalue()]})

    packed = [archives.groupBy("path").applyInPandas(pack, "path STRING, content BINARY") for archives in (jars, modules)]
    return archive_symbols(packed[0]).unionByName(archive_symbols(packed[1], "jdk")).select("qualified_name", "container", "origin_kind")


@query(
    """SELECT s_nationkey, CASE WHEN count(DISTINCT v) = 0 THEN 'unknown' WHEN count(DISTINCT v) = 1 THEN max(v) ELSE 'mixed' END AS version
    FROM (SELECT s_nationkey, CASE WHEN s_nationkey % 3 = 0 THEN NULL WHEN s_nationkey % 3 = 1 THEN 'v1' ELSE 'v' || s_suppkey % 2 END AS v FROM supplier) GROUP BY 1"""
)
def run_versions(spark, sf_dir):
    """The version of a run whose cases have none, one or several."""
    v = F.when(F.col("s_nationkey") % 3 == 1, "v1").when(F.col("s_nationkey") % 3 == 2, F.concat(F.lit("v"), (F.col("s_suppkey") % 2).cast("string")))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(E.version(v).alias("version"))


SYMBOL_TABLE = """SELECT 'own.' || replace(p_brand, '#', '') || '.' || replace(p_type, ' ', '') AS qualified_name, p_brand AS container, CASE WHEN p_size % 2 = 0 THEN 'source' ELSE 'binary' END AS origin_kind,
    CASE WHEN p_size % 2 = 0 THEN 'f' || p_size END AS filepath FROM part"""


def _symbol_table(spark, sf_dir):
    source = F.col("p_size") % 2 == 0
    return table(spark, sf_dir, "part").select(
        F.concat_ws(".", F.lit("own"), F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_type", F.lit(" "), F.lit(""))).alias("qualified_name"), F.col("p_brand").alias("container"),
        F.when(source, "source").otherwise("binary").alias("origin_kind"), F.when(source, F.concat(F.lit("f"), F.col("p_size").cast("string"))).alias("filepath"),
    )


@query(f"SELECT DISTINCT * FROM ({SYMBOL_TABLE}) ORDER BY qualified_name, origin_kind, coalesce(container, ''), coalesce(filepath, '')")
def symbols_in_order(spark, sf_dir):
    """Each definition once, in the order of the table."""
    return R.ordered(R.merged(_symbol_table(spark, sf_dir)))


@query(f"SELECT DISTINCT string_split(qualified_name, '.')[-1] AS simple_name, qualified_name, container, origin_kind, filepath FROM ({SYMBOL_TABLE}) WHERE string_split(qualified_name, '.')[-1] LIKE '%STEEL'")
def symbol_lookup(spark, sf_dir):
    own = R.merged(_symbol_table(spark, sf_dir))
    names = own.select(R.simple(F.col("qualified_name")).alias("simple_name")).where("simple_name like '%STEEL'")
    return R.lookup(own, names)


@query(f"SELECT DISTINCT qualified_name FROM ({SYMBOL_TABLE}) WHERE origin_kind = 'source' AND container IN (SELECT p_brand FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%3')")
def names_of_containers(spark, sf_dir):
    some = table(spark, sf_dir, "part").where("p_brand like '%1' or p_brand like '%3'").select(F.col("p_brand").alias("container"))
    return R.qualified_names(_symbol_table(spark, sf_dir), "source", some)


@query(
    """SELECT event_id, CASE WHEN k % 7 IN (0, 1) THEN k WHEN k % 7 = 2 THEN 1 END AS n, CASE k % 7 WHEN 0 THEN k::VARCHAR WHEN 1 THEN k::VARCHAR WHEN 2 THEN 'true' WHEN 3 THEN 'x' WHEN 4 THEN NULL WHEN 5 THEN '1.5' ELSE '["a",1]' END AS text,
    CASE WHEN k % 7 = 6 THEN 'a|1' ELSE '' END AS items, CASE k % 3 WHEN 0 THEN '@A|@B(' || k || ')' WHEN 1 THEN '@C' ELSE '' END AS annotations FROM (SELECT event_id, event_id AS k FROM events)"""
)
def coerced_values(spark, sf_dir):
    """Numbers, texts, lists and annotations of payloads whose values are of any type."""
    k = F.col("event_id").cast("string")
    value = F.element_at(F.array(k, F.concat(F.lit('"'), k, F.lit('"')), F.lit("true"), F.lit('"x"'), F.lit("null"), F.lit("1.5"), F.lit('["a",1]')), (F.col("event_id") % 7 + 1).cast("int"))
    notes = F.element_at(F.array(F.concat(F.lit('[{"text":"@A","name":"A"},"@B('), k, F.lit(')",{"name":"none"}]')), F.lit('["@C"]'), F.lit('{"text":"@D"}')), (F.col("event_id") % 3 + 1).cast("int"))
    own = table(spark, sf_dir, "events").select("event_id", F.parse_json(value).alias("v"), F.parse_json(notes).alias("a"))
    return own.select("event_id", N.optional_int(F.col("v")).alias("n"), N.optional_text(F.col("v")).alias("text"), F.array_join(N.text_list(F.col("v")), "|").alias("items"), F.array_join(N.annotation_texts(F.col("a")), "|").alias("annotations"))


#: A record with comments, annotations, thrown types and a member class; ~ stands for the end of a line, {} for the part's key, <> for its brand.
NOTED = '~'.join([
    "package own;", "", "import x.Thing;", "", "// licence {}", "", "/** Part {}. */", '@Tag(value = Thing.class, name = "<>")', "public record Part{}(int a, String b) {", "  // counts", "", "  // all of them", "  /** The total. */", "  @Deprecated", "  @Max({})",
    "  int total() throws java.io.IOException, BadCount { return a; }", "", "  static class Inner {", "    void run() { }", "  }", "}", "",
])
NOTED_SQL = f"c AS (SELECT p_partkey, replace(replace(replace('{NOTED}', '~', chr(10)), '{{}}', p_partkey::VARCHAR), '<>', p_brand) AS code FROM part)"


def _noted(spark, sf_dir):
    code = F.replace(F.replace(F.replace(F.lit(NOTED), F.lit("~"), F.lit("\n")), F.lit("{}"), F.col("p_partkey").cast("string")), F.lit("<>"), F.col("p_brand"))
    return chunks(spread_table(spark, sf_dir, "part", "p_partkey", "p_brand").select(F.col("p_partkey").cast("string").alias("path"), code.cast("binary").alias("content")))


@query(
    """SELECT p_partkey, 'Part' || p_partkey AS name, '@Tag(value = Thing.class, name = "' || p_brand || '")' AS text, 'Tag' AS annotation, 'name="' || p_brand || '",value=Thing.class' AS attributes FROM part
    UNION ALL SELECT p_partkey, 'total', '@Deprecated', 'Deprecated', '' FROM part UNION ALL SELECT p_partkey, 'total', '@Max(' || p_partkey || ')', 'Max', 'value=' || p_partkey FROM part"""
)
def java_annotations(spark, sf_dir):
    """Annotations of types and methods: text, name and attributes."""
    rows = _noted(spark, sf_dir).where("kind in ('skeleton', 'method')").select(F.col("filepath").cast("long").alias("p_partkey"), "name", F.explode("annotations").alias("a"))
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries("a.attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("p_partkey", "name", "a.text", F.col("a.name").alias("annotation"), attributes.alias("attributes"))


@query(
    """SELECT p_partkey, 'Part' || p_partkey AS name, 'int a,String b' AS components, '' AS throws, '/** Part ' || p_partkey || '. */' AS comment, '/** Part ' || p_partkey || '. */' AS javadoc FROM part
    UNION ALL SELECT p_partkey, 'total', '', 'java.io.IOException,BadCount', '// all of them' || chr(10) || '/** The total. */', '/** The total. */' FROM part
    UNION ALL SELECT p_partkey, 'Inner', '', '', NULL, NULL FROM part UNION ALL SELECT p_partkey, 'run', '', '', NULL, NULL FROM part"""
)
def java_comments_and_clauses(spark, sf_dir):
    """Record components, thrown types, and the comments that stand right above a declaration."""
    rows = _noted(spark, sf_dir).where("kind in ('skeleton', 'method')")
    components = F.array_join(F.transform("record_components", lambda c: F.concat_ws(" ", c["type"], c["name"])), ",")
    return rows.select(F.col("filepath").cast("long").alias("p_partkey"), "name", F.coalesce(components, F.lit("")).alias("components"), F.coalesce(F.array_join("throws", ","), F.lit("")).alias("throws"), F.col("leading_comment").alias("comment"), "javadoc")


@query(
    f"""WITH {NOTED_SQL}, s AS (SELECT p_partkey, p_partkey::VARCHAR AS k, strpos(code, '@Tag') - 1 AS lo, length(code) - 1 AS hi, strpos(code, '@Deprecated') - 1 AS m, strpos(code, 'return a; }}') + 10 AS me, strpos(code, 'static class') - 1 AS i,
      strpos(code, 'void run') - 1 AS r, length(code) - 3 AS ie FROM c)
    SELECT p_partkey, 'total' AS name, k || ':method:Part' || k || ':total:' || m || ':' || me AS chunk_id, k || ':skeleton:-:Part' || k || ':' || lo || ':' || hi AS parent_chunk_id FROM s
    UNION ALL SELECT p_partkey, 'run', k || ':method:Part' || k || '.Inner:run:' || r || ':' || r + 14, k || ':skeleton:Part' || k || ':Inner:' || i || ':' || ie FROM s"""
)
def java_parents(spark, sf_dir):
    """Ids of members by their place, and those of the types that hold them."""
    return _noted(spark, sf_dir).where("kind = 'method'").select(F.col("filepath").cast("long").alias("p_partkey"), "name", "chunk_id", "parent_chunk_id")


@query("SELECT p_partkey, 'own' AS package, 'import x.Thing;' AS imports FROM part")
def java_files_context(spark, sf_dir):
    """Package and imports of each file."""
    rows = _noted(spark, sf_dir).where("kind = 'file'")
    return rows.select(F.col("filepath").cast("long").alias("p_partkey"), N.package_name(F.col("package")).alias("package"), F.array_join("imports", "|").alias("imports"))


@query(
    f"""WITH {MEMBERS} SELECT p_partkey, kind, name, concat_ws(chr(10), '// file: ' || path, '// package own;', '// class: ' || owner, '// fields: ' || CASE WHEN contains(owner, '.') THEN NULL ELSE CASE p_size % 4 WHEN 0 THEN 'size' WHEN 2 THEN 'code' WHEN 3 THEN 'name' END END, code) AS text
    FROM w JOIN part USING (p_partkey)"""
)
def java_embed_headers(spark, sf_dir):
    """The texts to embed: a header of file, package, classes and fields above the code."""
    rows = chunks(_java(spark, sf_dir)).where("kind in ('method', 'constructor')")
    return rows.select(F.col("filepath").cast("long").alias("p_partkey"), "kind", "name", F.col("embed_text").alias("text"))


INDEXED = """r AS (SELECT p_partkey, p_size % 10 = 0 AS bad, p_size % 4 AS shape FROM part)"""


@query(
    f"""WITH {INDEXED} SELECT 'own/Part' || p_partkey || '.java' AS file_path, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, 1 + (bad AND p_partkey % 2 = 0)::INT AS attempt,
    CASE WHEN bad THEN 0 ELSE [4, 4, 5, 7][shape + 1] END::BIGINT AS documents FROM r"""
)
def built_index(spark, sf_dir):
    """A whole build of the parts' files into a store, half of the failed ones tried again: what became of each file, and its documents in the published index."""
    size = F.col("p_size")
    own = _java(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_size").hint("merge"), "path")
    files = own.select(F.concat(F.lit("/r/own/Part"), "path", F.lit(".java")).alias("path"), F.when(size % 10 != 0, F.col("content")).alias("content"), ((size % 10 == 0) & (F.col("p_partkey") % 2 == 0)).alias("again"))
    store = T.Store(spark, scratch(spark, "store"))
    store.start("/r", "signature", "hashed-tokens-8", "now", files.count())
    for batch in (files, files.where("again")):
        documents, failures = I.build(batch, "/r", None, spark, "now")
        log = batch.select("path").join(failures, "path", "left").withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed"))
        changed = batch.select(F.substr("path", F.lit(4)).alias("file_path"))
        store.replace_files(changed, documents, embedded(documents, HashedEncoder(8)), "hashed-tokens-8", "now", staged=True, log=log)
    store.finish()
    found = store.read("documents").groupBy("file_path").agg(F.count(F.lit(1)).alias("documents"))
    return store.log().select(F.substr("path", F.lit(4)).alias("file_path"), "status", "attempt").join(found, "file_path", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


@query("SELECT p_brand AS file_path, count(*) AS n, CASE WHEN p_brand LIKE '%1' THEN 'second' WHEN p_brand LIKE '%2' THEN 'third' ELSE 'first' END AS indexed_at FROM part WHERE p_brand NOT LIKE '%3' GROUP BY p_brand")
def stored_batches(spark, sf_dir):
    """An index that two streams refresh: each batch that comes again, or late, changes nothing; some files are left out on reading."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_brand").alias("file_path"))
    given = {"chunk_id": F.col("chunk_id"), "file_path": F.col("file_path"), "indexed_at": F.lit("first")}
    documents = own.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(DOCUMENTS).fields))
    vectors = documents.select("chunk_id", "file_path", F.lit(1).alias("dims"), F.array(F.lit(1.0).cast("float")).alias("matrix"))
    store = T.Store(spark, scratch(spark, "store"))
    store.save(documents, vectors, "model", "first")

    def put(end: str, at: str, batch: tuple[str, int]) -> None:
        some = F.col("file_path").like(f"%{end}")
        store.replace_files(documents.where(some).select("file_path"), documents.where(some).withColumn("indexed_at", F.lit(at)), vectors.where(some), "model", at, batch=batch)

    put("1", "second", ("a", 0))
    put("2", "third", ("b", 0))
    put("1", "never", ("a", 0))
    put("2", "never", ("b", 0))
    rest, _ = store.retained()
    return rest.where("file_path not like '%3'").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("indexed_at").alias("indexed_at"))


@query("SELECT count(*) AS chunks, 'model' AS model_name, (SELECT count(*) FROM part WHERE p_brand <> 'Brand#11') AS others FROM part")
def index_status(spark, sf_dir):
    """Number of chunks and model of an index, and how many chunks stay without one file."""
    own = table(spark, sf_dir, "part")
    given = {"chunk_id": F.col("p_partkey").cast("string"), "file_path": F.col("p_brand")}
    documents = own.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(DOCUMENTS).fields))
    store = T.Store(spark, scratch(spark, "store"))
    store.save(documents, documents.select("chunk_id", "file_path", F.lit(1).alias("dims"), F.array(F.lit(1.0).cast("float")).alias("matrix")), "model", "now")
    status = store.status()
    return store.retained(exclude_file="Brand#11")[1].agg(F.lit(status["chunks"]).cast("long").alias("chunks"), F.lit(status["model_name"]).alias("model_name"), F.count(F.lit(1)).alias("others"))


@query(f"WITH {MEMBERS} SELECT p_partkey, kind, name, CASE WHEN p_size % 4 = 0 THEN 'twice' ELSE 'once' END AS given FROM w JOIN part USING (p_partkey)")
def retrieval_upserts(spark, sf_dir):
    """The table of retrieval documents after some files were put in, and then all."""
    files = _java(spark, sf_dir)
    some = files.join(table(spark, sf_dir, "part").where("p_size % 4 = 0").select(F.col("p_partkey").cast("string").alias("path")).hint("merge"), "path", "left_semi")
    first = stored(I.index_retrieval(None, some, None, spark), "retrieval")
    rows = I.index_retrieval(first, files, None, spark).where("kind in ('method', 'constructor')").select(F.col("filepath").cast("long").alias("p_partkey"), "kind", "name", "chunk_id")
    return rows.join(first.select("chunk_id", F.lit("twice").alias("given")).hint("merge"), "chunk_id", "left").select("p_partkey", "kind", "name", F.coalesce("given", F.lit("once")).alias("given"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ':a:main' WHEN 1 THEN ':a:test' END AS source_set, [1, 1, 1, 2][p_size % 4 + 1]::BIGINT AS types FROM part")
def parsed_in_workspace(spark, sf_dir):
    """Files parsed within a workspace: the source set of each and its types."""
    folder = F.element_at(F.array(*map(F.lit, ("/w/a/main", "/w/a/test", "/w/else"))), (F.col("p_size") % 3 + 1).cast("int"))
    at = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), folder.alias("folder"))
    files = _java(spark, sf_dir).join(at, "path").select(F.concat_ws("/", "folder", "path").alias("path"), "content")
    workspace = Workspace.from_dict({"source_sets": {":a:main": {"source_roots": ["/w/a/main"]}, ":a:test": {"source_roots": ["/w/a", "/w/a/test"]}}})
    rows = I.parsed(files, workspace, spark)
    return rows.groupBy(F.element_at(F.split("filepath", "/"), -1).cast("long").alias("p_partkey"), "source_set").agg(F.count_if(F.col("kind") == "skeleton").alias("types"))


@query("SELECT ':' || n_name || ':main' AS source_set, '/w/' || n_nationkey || CASE WHEN i = 1 THEN '/gen' ELSE '' END AS root, (row_number() OVER (ORDER BY n_name, i) - 1)::INT AS ordinal FROM nation, (SELECT unnest([0, 1]) AS i)")
def loaded_workspace(spark, sf_dir):
    """A description written as JSON and read back: the roots of its source sets, generated ones after the others."""
    n = table(spark, sf_dir, "nation").orderBy("n_name")
    root = F.concat(F.lit("/w/"), F.col("n_nationkey").cast("string"))
    one = F.struct(F.array(root).alias("source_roots"), F.array(F.concat(root, F.lit("/gen/"))).alias("generated_source_roots"))
    sets = n.select(F.concat(F.lit('"'), F.concat(F.lit(":"), "n_name", F.lit(":main")), F.lit('": '), F.to_json(one)).alias("s"), "n_name")
    text = sets.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "s"))), lambda x: x["s"]), ", ").alias("s"))
    path = scratch(spark, "workspace")
    text.select(F.concat(F.lit('{"schema_version": 1, "jdk_home": null, "source_sets": {'), "s", F.lit("}}"))).coalesce(1).write.text(path)
    return Workspace.load(spark, path).roots(spark)


@query("SELECT item_id::VARCHAR AS case_id, text AS query, 5 AS top_k, 25 AS line_tolerance, CASE WHEN item_id % 2 = 0 THEN 'p' || item_id ELSE '' END AS paths, '' AS symbols, CASE WHEN item_id % 3 = 0 THEN item_id || '-' || item_id + 9 ELSE '' END AS ranges FROM benchmark")
def loaded_suite(spark, sf_dir):
    """A suite of cases written as JSON and read back, absent numbers and lists with their defaults."""
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    case = F.struct(k.cast("string").alias("case_id"), F.col("text").alias("query"), F.when(k % 2 == 0, F.array(F.concat(F.lit("p"), k.cast("string")))).alias("primary_paths"), F.when(k % 3 == 0, F.array(F.array(k, k + 9))).alias("primary_line_ranges"))
    path = scratch(spark, "suite")
    b.agg(F.collect_list(case).alias("cases")).select(F.to_json(F.struct(F.lit("1").alias("benchmark_version"), "cases"))).coalesce(1).write.text(path)
    settings, cases = load_suite(spark, path)
    ranges = F.array_join(F.transform("primary_line_ranges", lambda r: F.concat_ws("-", r[0].cast("string"), r[1].cast("string"))), ",")
    numbers = (F.lit(settings[k]).alias(k) for k in ("top_k", "line_tolerance"))
    return cases.select("case_id", "query", *numbers, F.array_join("primary_paths", ",").alias("paths"), F.array_join("primary_symbols", ",").alias("symbols"), ranges.alias("ranges"))


@query(f"{JUDGED} SELECT count(*) AS cases, count_if(verdict = 'fail')::BIGINT AS fail, true AS sorted FROM c")
def written_artifact(spark, sf_dir):
    """The result of an evaluation, written as sorted JSON and read back."""
    out = E.summarised(E.verdicts(*_eval(spark, sf_dir))).first().asDict()
    path = scratch(spark, "artifact") + ".json"
    write_artifact(spark, {k: int(v) if k != "score" else float(v) for k, v in out.items()}, path)
    text = spark.read.text(path, wholetext=True)
    keys = F.regexp_extract_all("value", F.lit(r'"(\w+)":'), 1)
    return text.select(F.get_json_object("value", "$.cases").cast("long").alias("cases"), F.get_json_object("value", "$.fail").cast("long").alias("fail"), (keys == F.array_sort(keys)).alias("sorted"))


@query(f"WITH {V} SELECT query_id, count(*) AS n, min(chunk_id) AS least FROM (SELECT DISTINCT query_id, chunk_id FROM d WHERE chunk_id % 3 <> 0) GROUP BY 1")
def chunks_without_vectors(spark, sf_dir):
    """Chunks without vectors never match."""
    some = _chunks(spark, sf_dir).withColumn("matrix", F.when(F.col("chunk_id") % 3 != 0, F.col("matrix")).otherwise(F.expr("cast(array() as array<float>)")))
    return S.maxsim(some, _queries(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("least"))


@query(f"SELECT item_id::VARCHAR AS query_id, len(list_distinct(({TOKENS.format('text')})[1:32])) AS n, 16 AS dims, true AS unit FROM benchmark WHERE len({TOKENS.format('text')}) > 0")
def encoded_queries(spark, sf_dir):
    """How many vectors each query gets; all are of length one."""
    asked = [(str(r["item_id"]), r["text"]) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return query_vectors(spark, asked, HashedEncoder(16)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), F.min(F.abs(norm - 1) < 1e-5).alias("unit"))


@query(f"SELECT qualified_name, p_partkey::VARCHAR AS filepath FROM ({TYPES})")
def kept_symbols(spark, sf_dir):
    """Symbols that one cache wrote and another, of another session, reads."""
    path = scratch(spark, "kept-symbols")
    I.SymbolCache(spark, path).table("key", lambda: source_symbols(_java(spark, sf_dir), ":app:main"))
    again = I.SymbolCache(spark, path).table("key", lambda: source_symbols(_java(spark, sf_dir).limit(0), ":app:main"))
    return again.select("qualified_name", "filepath")


def entry(spark: SparkSession) -> DataFrame:
    return hybrid_search(spark, "/root/testdata/sf0.001")
