"""The registered queries of this subpackage, and the SQL that must give the same rows.

Beside the operators' own queries stand facts about their results that SQL can state, taken from the same queries: columns that no
model decides, and the laws that placements must keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard, langid, license, lm, packing, pii, pipeline, quality, ranking, rules, sharding, suffixes, whitening

Query = Callable[[SparkSession, str], DataFrame]


def language_und(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == langid.UNKNOWN).alias("und"), F.col("score").between(0, 1).alias("in_range"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many records and bytes were placed, and whether every shard is gapless and sizes differ by one record at most."""
    own = sharding.query(spark, sf_dir)
    each = own.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("different"))
    gapless = F.min((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("different") == F.col("n")))
    return each.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"), gapless.alias("gapless"), (F.max("bytes") - F.min("bytes") <= F.max("largest")).alias("near_equal"))


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and pieces of each document among all bins, and whether its bins hold what is in them."""
    rows = packing.query(spark, sf_dir)
    bins = rows.groupBy("bin_group", "bin").agg((F.sum("n_tokens") <= F.max("capacity")).alias("fits"))
    return rows.join(bins, ["bin_group", "bin"]).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.min("fits").alias("fits"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact column of each vector, and whether its components are as many as asked for, whiten, and explain the variance in falling order."""
    w = Window.partitionBy("vec_id").orderBy("component")
    rows = whitening.query(spark, sf_dir).withColumn("before", F.lag("explained").over(w))
    return rows.groupBy("vec_id").agg(F.max("n").alias("n"), F.max("deviation").alias("deviation"), F.count(F.lit(1)).alias("components"), F.min(F.coalesce(F.col("before") >= F.col("explained"), F.lit(True))).alias("falling"), (F.max("identity_error") <= 1e-4).alias("white"))


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": langid.query,
        "op2_jaccard_join": jaccard.query,
        "op3_sharding": sharding.query,
        "op4_decontamination": decontaminate.query,
        "op5_lm_scoring": lm.query,
        "op6_license_scan": license.query,
        "op7_personal_data": pii.query,
        "op8_best_fit_packing": packing.query,
        "op9_quality_rules": rules.query,
        "op10_quality_classifier": quality.query,
        "op11_suffix_dedup": suffixes.query,
        "op12_embedding_whitening": whitening.query,
        "op13_lexical_search": ranking.query,
        "pipeline": pipeline.run,
    } | {f.__name__: f for f in (language_und, shard_law, lm_base_columns, pii_base_spans, packed_tokens, quality_base_counts, whitening_deviations)}


WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a text of ASCII characters, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length({0}))), lambda c, i: xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr({0}, i // 8 + 1, 1))::BIGINT) ELSE c END) >> 1, ((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr({0}, i // 8 + 1, 1))::BIGINT) ELSE c END) & 1) * 3988292384)), 4294967295)"
FOLD = CRC32.format("coalesce(doc_id::VARCHAR, '')")


def _jaccard_sql() -> str:
    return f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rn, doc_id, {WORDS.format(LOWER)} AS w FROM documents),
    s AS (SELECT rn, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
    e AS (SELECT rn, unnest(s) AS h FROM s), n AS (SELECT rn, doc_id, len(s) AS n FROM s),
    p AS (SELECT a.rn AS x, b.rn AS y, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.rn < b.rn GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.rn = x JOIN n b ON b.rn = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
    t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT rn AS node, rn AS reach FROM n UNION SELECT r.node, t.y FROM r JOIN t ON t.x = r.reach)
    SELECT a.doc_id, any_value(a.n) AS n_shingles, min(b.doc_id) AS component_id FROM r JOIN n a ON a.rn = r.node JOIN n b ON b.rn = r.reach GROUP BY a.rn, a.doc_id"""


def _lm_sql() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {FOLD} % 7 = 2 AS held_out, {WORDS.format(LOWER)} AS w FROM documents),
    t AS (SELECT rn, held_out, unnest(list_append(w, ' ')) AS token FROM d), c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
    g AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
    SELECT doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
    FROM d JOIN t USING (rn) LEFT JOIN c USING (token), g GROUP BY rn, doc_id"""


def _spans(kind: int, pattern: str, good: str) -> str:
    """Matches with their places: the text is cut at the matches, and lengths are summed up."""
    return f"""SELECT rn, {kind} AS kind, s, s + length(m) AS e FROM (SELECT rn, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
      FROM (SELECT rn, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d)) WHERE {good}"""


def _pii_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN substr({digits}, i, 1)::INT WHEN substr({digits}, i, 1)::INT > 4 THEN 2 * substr({digits}, i, 1)::INT - 9 ELSE 2 * substr({digits}, i, 1)::INT END)) % 10 = 0"
    kinds = [
        _spans(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _spans(1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda x: x::HUGEINT <= 255))"),
        _spans(2, r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END"),
        _spans(3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    ]
    count = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(pii.KINDS))
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(pii.KINDS)) + " END"
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents), x AS ({' UNION ALL '.join(kinds)})
    SELECT doc_id, {count}, sha256(coalesce(string_agg({name} || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind IS NOT NULL), '')) AS base_sha256 FROM d LEFT JOIN x USING (rn) GROUP BY rn, doc_id"""


def _rules_sql() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
    l AS (SELECT rn, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    g AS (SELECT rn, i, list_value(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    m AS (SELECT rn, i FROM g QUALIFY count(*) OVER (PARTITION BY rn, g) > 1),
    c AS (SELECT rn, count(DISTINCT i + k) AS n_repeat_words FROM m, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
    a AS (SELECT rn, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d)
    SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM a LEFT JOIN l USING (rn) LEFT JOIN c USING (rn)"""


def _whitening_sql() -> str:
    return """WITH v AS (SELECT row_number() OVER () AS rn, vec_id, embedding FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    x AS (SELECT rn, vec_id, unnest(range(len(embedding))) AS i, (floor(64 * unnest(embedding)::DOUBLE) + 1000000)::HUGEINT AS x FROM v),
    s AS (SELECT i, count(*)::HUGEINT AS n, sum(x)::HUGEINT AS s FROM x GROUP BY i)
    SELECT any_value(vec_id) AS vec_id, max(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation, least(count(*), 32)::BIGINT AS components, true AS falling, true AS white FROM x JOIN s USING (i) GROUP BY rn"""


def oracle_sql() -> dict[str, str]:
    """What SQL can state; tests hold the rest against brute force."""
    tokens = f"len({WORDS.format("coalesce(text, '')")}) + 1"
    return {
        "op2_jaccard_join": _jaccard_sql(),
        "op6_license_scan": license.oracle_sql(),
        "language_und": f"SELECT doc_id, {FOLD} % 5 = 0 AS held_out, NOT coalesce(regexp_matches(text, '\\p{{L}}'), false) AS und, true AS in_range FROM documents",
        "shard_law": "SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, 8::BIGINT AS shards, true AS gapless, true AS near_equal FROM documents",
        "lm_base_columns": _lm_sql(),
        "pii_base_spans": _pii_sql(),
        "packed_tokens": f"SELECT doc_id, sum({tokens})::BIGINT AS n_tokens, sum(({tokens} + 8191) // 8192)::BIGINT AS n_pieces, true AS fits FROM documents GROUP BY doc_id",
        "quality_base_counts": _rules_sql(),
        "op13_lexical_search": ranking.oracle_sql(),
        "whitening_deviations": _whitening_sql(),
    }
