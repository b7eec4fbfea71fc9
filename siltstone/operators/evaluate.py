"""Evaluation of ranked hits against cases with expected places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lexical import holds

CASE_ARRAYS = ("primary_paths", "primary_symbols", "primary_lines", "primary_line_ranges", "secondary_paths", "secondary_symbols")


def line_match(start: Column, end: Column, anchors: Column, ranges: Column, tolerance: Column) -> Column:
    """Does the hit overlap a range?  Without ranges: does it start within ``tolerance`` of an anchor?  False without either or without lines."""
    overlap = F.exists(ranges, lambda r: F.greatest(start, r[0]) <= F.least(F.coalesce(end, start), r[1]))
    near = F.exists(anchors, lambda a: F.abs(start - a) <= tolerance)
    return F.coalesce(F.when(F.size(ranges) > 0, overlap).when(F.size(anchors) > 0, near), F.lit(False))


def symbol_match(symbol: Column, expected: Column) -> Column:
    return F.coalesce(F.exists(expected, lambda e: holds(symbol, e)), F.lit(False))


def judged(cases: DataFrame, hits: DataFrame, tolerance: int = 25) -> DataFrame:
    """cases (case_id and CASE_ARRAYS), hits (case_id, rank, symbol, file_path, start_line, end_line): each hit with primary, line_hit and near."""
    met = hits.join(cases.select("case_id", *CASE_ARRAYS), "case_id")
    lines = line_match(F.col("start_line"), F.col("end_line"), F.col("primary_lines"), F.col("primary_line_ranges"), F.lit(tolerance))
    has_symbols, has_lines = F.size("primary_symbols") > 0, (F.size("primary_lines") > 0) | (F.size("primary_line_ranges") > 0)
    symbol, path = symbol_match(F.col("symbol"), F.col("primary_symbols")), F.coalesce(F.array_contains("primary_paths", F.col("file_path")), F.lit(False))
    primary = F.when(has_symbols & has_lines, symbol & F.col("line_hit")).when(has_symbols, symbol).when(has_lines, path & F.col("line_hit")).otherwise(path)
    near = symbol | path | symbol_match(F.col("symbol"), F.col("secondary_symbols")) | F.coalesce(F.array_contains("secondary_paths", F.col("file_path")), F.lit(False))
    return met.withColumn("line_hit", lines).withColumn("primary", primary).withColumn("near", near)


def verdicts(cases: DataFrame, hits: DataFrame, tolerance: int = 25) -> DataFrame:
    """(case_id, verdict, rank, symbol, line_hit): by the first primary hit; at rank 3 or better a strong pass.  Cases without hits fail."""
    own = judged(cases, hits, tolerance)
    first = F.when(F.col("primary"), F.col("rank"))
    best = own.groupBy("case_id").agg(F.min(first).alias("rank"), F.min_by("symbol", first).alias("symbol"), F.min_by("line_hit", first).alias("line_hit"), F.max("near").alias("near"))
    verdict = F.when(F.col("rank") <= 3, "strong_pass").when(F.col("rank").isNotNull(), "pass").when(F.col("near"), "near_miss").otherwise("fail")
    return cases.select("case_id").join(best, "case_id", "left").select("case_id", verdict.alias("verdict"), "rank", "symbol", F.coalesce("line_hit", F.lit(False)).alias("line_hit"))


def summarised(results: DataFrame) -> DataFrame:
    """One row: the number of cases and of each verdict, and the scalar score (2 strong + pass) / (2 cases)."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("strong_pass", "pass", "near_miss", "fail")}
    score = F.when(F.count(F.lit(1)) > 0, (2 * n["strong_pass"] + n["pass"]) / (2 * F.count(F.lit(1)))).otherwise(F.lit(0.0))
    return results.agg(F.count(F.lit(1)).alias("cases"), *(c.alias(k) for k, c in n.items()), score.alias("score"))



def version(versions: Column) -> Column:
    """Aggregate: the one version that all rows share; ``unknown`` without any, ``mixed`` for several."""
    return F.when(F.count_distinct(versions) == 0, "unknown").when(F.count_distinct(versions) == 1, F.max(versions)).otherwise("mixed")
