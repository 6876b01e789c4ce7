"""Running positions over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialise

MAX_KEY_ROWS = 5_000_000


def running_marks(df: DataFrame, key: str, order: Sequence[str], mark: str,
                  max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """Adds seq (1-based position in the key's order) and mark_seq (seq of the latest row at or
    before this one whose `mark` holds, NULL when none).

    Keys up to max_key_rows take one window. A larger key is range-partitioned by its order, so
    its rows spread over tasks; each piece is numbered on its own and the pieces' totals carry
    over. `order` must be unique within the key.
    """
    # a table of fewer rows has no larger key; over files this count comes from the footers
    if df.count() <= max_key_rows:
        return _numbered(df, [key], order, mark)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_key_rows)
    found = sizes.collect()  # at most rows / max_key_rows keys
    if not found:
        return _numbered(df, [key], order, mark)
    hot = df.sparkSession.createDataFrame(found, sizes.schema).select(key)
    pieces = 2 * -(-sum(r["_n"] for r in found) // max_key_rows)
    normal = _numbered(df.join(hot, key, "left_anti"), [key], order, mark)
    spread = (df.join(hot, key, "left_semi").repartitionByRange(pieces, key, *order)
              .withColumn("_piece", F.spark_partition_id()))
    # the piece number depends on sampled range bounds: fix it before two branches read it
    local = _numbered(materialise(spread, "pieces"), [key, "_piece"], order, mark)
    totals = local.groupBy(key, "_piece").agg(
        F.max("seq").alias("_rows"), F.max("mark_seq").alias("_last"))
    earlier = (Window.partitionBy(key).orderBy("_piece")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = (totals
               .withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
               .withColumn("_mark", F.col("_base") + F.col("_last"))
               .withColumn("_carry", F.max("_mark").over(earlier))
               .select(key, "_piece", "_base", "_carry"))
    joined = (local.join(carried, [key, "_piece"])
              .withColumn("mark_seq", F.coalesce(F.col("mark_seq") + F.col("_base"), F.col("_carry")))
              .withColumn("seq", F.col("seq") + F.col("_base")))
    return normal.unionByName(joined.drop("_piece", "_base", "_carry"))


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("seq", F.row_number().over(w).cast("long"))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn("mark_seq", F.max(F.when(F.col(mark), F.col("seq"))).over(so_far))
