"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; vectors of different lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def sane(v: Column) -> Column:
    """NaN and infinite entries become 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.transform(v, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x).cast("float"))


def matrices(vectors: DataFrame, *keep: str) -> DataFrame:
    """Rows (chunk_id, keep..., token_pos, vec) as one row per chunk (chunk_id, keep..., dims, matrix): its vectors in order, one after the other.  A chunk has at most as
    many vectors as its encoder gives; vectors of different lengths are an error."""
    rows = vectors.groupBy("chunk_id", *keep).agg(F.array_sort(F.collect_list(F.struct("token_pos", "vec"))).alias("v_"), F.min(F.size("vec")).alias("dims"), F.max(F.size("vec")).alias("most_"))
    dims = F.when(F.col("dims") == F.col("most_"), F.col("dims")).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("int"))
    return rows.select("chunk_id", *keep, dims.alias("dims"), F.flatten(F.transform("v_", lambda x: x["vec"])).alias("matrix"))
