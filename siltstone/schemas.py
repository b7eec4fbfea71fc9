"""Schemas of the stored tables, as DDL."""

SPAN = "STRUCT<lo: BIGINT, hi: BIGINT>"
ANNOTATION = "STRUCT<text: STRING, name: STRING, attributes: MAP<STRING, STRING>>"
COMPONENT = "STRUCT<name: STRING, type: STRING>"
SYMBOL = "STRUCT<name: STRING, type: STRING>"

#: One row per chunk of a source file.  file_package is the package clause of its file; symbols and calls_raw feed the resolution join, which fills calls.
CHUNKS = f"""
chunk_ord INT, chunk_id STRING, parent_chunk_id STRING, kind STRING, name STRING, owner_chain ARRAY<STRING>, filepath STRING,
span {SPAN}, type_span {SPAN}, start_line INT, end_line INT, start_col INT, end_col INT, text STRING, embed_text STRING,
node_type STRING, type_kind STRING, leading_comment STRING, javadoc STRING, return_type STRING, parameters STRING,
annotations ARRAY<{ANNOTATION}>, modifiers ARRAY<STRING>, throws ARRAY<STRING>, calls ARRAY<STRING>,
fields_accessed ARRAY<STRING>, field_type STRING, component_type STRING, `extends` STRING, implements STRING, permits STRING,
type_parameters STRING, is_exception BOOLEAN, fields ARRAY<STRING>, method_signatures ARRAY<STRING>, enum_constants ARRAY<STRING>,
record_components ARRAY<{COMPONENT}>, package STRING, imports ARRAY<STRING>, module STRING, symbols ARRAY<{SYMBOL}>,
local_types ARRAY<STRING>, error STRING, file_package STRING
""".replace("\n", " ").strip()

DOCUMENTS = """
chunk_id STRING, repo_root STRING, file_path STRING, chunk_kind STRING, owner_chain ARRAY<STRING>, package STRING, name STRING,
start_line INT, end_line INT, start_col INT, end_col INT, signature STRING, return_type STRING, field_type STRING,
annotations ARRAY<STRING>, modifiers ARRAY<STRING>, resolved_calls ARRAY<STRING>, fields_accessed ARRAY<STRING>, throws ARRAY<STRING>,
implements ARRAY<STRING>, `extends` STRING, source_set STRING, retrieval_text STRING, source_text STRING, indexed_at STRING
""".replace("\n", " ").strip()

#: One row per chunk: its vectors, one after the other, of ``dims`` numbers each.
VECTORS = "chunk_id STRING, file_path STRING, dims INT, matrix ARRAY<FLOAT>"
#: The vectors of a chunk that lie in one list of an inverted file.
LISTS = "chunk_id STRING, bucket INT, dims INT, matrix ARRAY<FLOAT>, list INT"
SYMBOLS = "qualified_name STRING, container STRING, origin_kind STRING, filepath STRING"
#: What became of each file of a build, one row per attempt.
BUILD_LOG = "build STRING, path STRING, status STRING, error STRING, attempt INT"
EVAL_SUITE = "benchmark_version STRING, repo_name STRING, repo_commit STRING, model_name STRING, top_k INT, line_tolerance INT, cases ARRAY<STRUCT<case_id: STRING, query: STRING, primary_paths: ARRAY<STRING>, primary_symbols: ARRAY<STRING>, primary_lines: ARRAY<INT>, primary_line_ranges: ARRAY<ARRAY<INT>>, secondary_paths: ARRAY<STRING>, secondary_symbols: ARRAY<STRING>>>"
